"""Disassembly as a stripped binary shows it: no addresses, labels by first use, own functions and data under anonymous names,
imports and strings as notes. Text in, text out: the listings and tables come from tools that are not part of this library.

Two kinds of listing: of object files (relocation lines name the targets), and of linked files (targets are numbers, looked up in
a table of regions).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

DATA, NOTE = "data", "    ; -> "
_SYMBOL = re.compile(r"(0x[0-9a-f]+ )?<([\w.$]+?)(\+0x[0-9a-f]+)?>")
_RIP = re.compile(r"\[rip(?:\s*([+-])\s*(0x[0-9a-f]+|\d+))?\]")
_JUMP = re.compile(r"^((?:call|j|loop)\w*\s+)0x([0-9a-f]+)$")
_SECTION = re.compile(r"__[a-z][a-z0-9_]*")


def display(text: str, most: int = 80) -> str:
    """A string escaped and in quotes, cut with an ellipsis."""
    plain = text.encode("unicode_escape").decode("ascii").replace('"', '\\"')
    return f'"{plain[:most]}…"' if len(plain) > most else f'"{plain}"'


@dataclass
class Lines:
    """Instructions in order, and labels for those that something in the function jumps to."""

    at: list[int | None] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    labels: dict = field(default_factory=dict)

    def label(self, place) -> str:
        return self.labels.setdefault(place, f"loc_{len(self.labels) + 1}")

    def joined(self) -> str:
        return "\n".join(part for at, t in zip(self.at, self.text, strict=True) for part in ([f"{self.labels[at]}:"] if at in self.labels else []) + [t])


def string_at(strings: dict[int, str], address: int | None) -> str | None:
    """The string that starts at an address or, as tails are shared, holds it."""
    if address is None or not strings:
        return None
    starts = sorted(strings)
    i = bisect_right(starts, address) - 1
    raw = strings[starts[i]].encode() if i >= 0 else b""
    inside = address - starts[i]
    return raw[inside:].decode("utf-8", "replace") if i >= 0 and (inside == 0 or inside < len(raw)) else None


def object_listing(lines: list[str], names: dict[str, str], strings: dict[int, str], own: str) -> str:
    """Lines `address: instruction` and, after the instruction they belong to, `address: X86_64_RELOC_... symbol`. names: symbols of
    the file and their anonymous names; other symbols are imports. own: the function's name."""
    bare = lambda s: s[1:] if s.startswith("_") else s
    out, pointed = Lines(), None

    def branch(m: re.Match) -> str:
        inside = m[3] or bare(m[2]) == own
        return out.label(int(m[1], 16) if m[1] else m[0]) if inside else names.get(bare(m[2]), "loc")

    for line in lines:
        head, colon, body = line.strip().partition(":")
        known = colon and re.fullmatch("[0-9a-f]+", head)
        body = body.strip() if known else line.strip()
        if body.startswith("X86_64_RELOC"):
            symbol = re.sub(r"[-+](?:0x[0-9a-f]+|\d+)$", "", body.split()[-1].split("@")[0])
            text = string_at(strings, pointed) if symbol == "__cstring" else None
            hidden = _SECTION.fullmatch(symbol) or not symbol.startswith("_") or "." in symbol
            target = display(text) if text is not None else DATA if hidden else names.get(bare(symbol), bare(symbol))
            if out.text:
                was = re.sub(r"\s*(0x[0-9a-f]+ )?<[^>]*>", "", _RIP.sub("[rip]", out.text[-1]))
                out.text[-1] = was.rstrip() + NOTE + target
            continue
        code, _, remark = body.partition("##")
        hit = re.match(r"\s*0x([0-9a-f]+)", remark)
        pointed = int(hit[1], 16) if hit else None
        code = _SYMBOL.sub(branch, code.rstrip())
        if code and not code.startswith("<"):
            out.at.append(int(head, 16) if known else None), out.text.append(code)
    return out.joined()


@dataclass
class Regions:
    """Where an address leads: imports, own functions and data by their start, strings and functions also by what they hold."""

    names: dict[int, str]
    strings: dict[int, str]
    functions: list[tuple[int, int]]

    def target(self, address: int) -> str:
        if address in self.names:
            return self.names[address]
        if (text := string_at(self.strings, address)) is not None:
            return display(text)
        i = bisect_right(self.functions, (address, 1 << 64)) - 1
        if i >= 0 and self.functions[i][0] <= address < self.functions[i][1]:
            return self.names.get(self.functions[i][0], DATA)
        return DATA


def linked_listing(code: list[tuple[int, int, str]], regions: Regions) -> str:
    """(address, size, instruction) of a function: jumps inside it become labels, other targets names and notes, addresses relative
    to the instruction `[rip]` with a note, absolute ones the name in brackets."""
    out, inside, start = Lines(), {a for a, _, _ in code}, code[0][0] if code else 0
    for address, size, text in code:
        text, note = re.sub(r"\s*<[^>]*>", "", text.partition("##")[0]).strip(), None
        if m := _JUMP.match(text):
            to = int(m[2], 16)
            recursion = text.startswith("call") and to == start
            name = out.label(to) if to in inside and not recursion else (note := regions.target(to))
            text = m[1] + name
        if m := _RIP.search(text):
            note = regions.target(address + size + (int(m[2], 0) * (-1 if m[1] == "-" else 1) if m[2] else 0))
            text = _RIP.sub("[rip]", text)
        text = re.sub(r"\[0x([0-9a-f]+)\]", lambda m: f"[{regions.target(int(m[1], 16))}]", text)
        out.at.append(address), out.text.append(text + (NOTE + note if note else ""))
    return out.joined()


@F.pandas_udf(StringType())
def anonymous_object(listing: pd.Series, names: pd.Series, strings: pd.Series, own: pd.Series) -> pd.Series:
    """(listing text, map of symbol to name, map of address to string, own name); null listings give null."""
    rows = zip(listing, names, strings, own, strict=True)
    return pd.Series([None if t is None else object_listing(t.split("\n"), dict(n if n is not None else ()), dict(s if s is not None else ()), o) for t, n, s, o in rows], dtype=object)


@F.pandas_udf(StringType())
def anonymous_code(code: pd.Series, names: pd.Series, strings: pd.Series, functions: pd.Series) -> pd.Series:
    """(array of struct(address, size, text), map of address to name, map of address to string, array of struct(start, end))."""

    def one(rows, n, s, f) -> str | None:
        if rows is None:
            return None
        spans = sorted((int(x["start"]), int(x["end"])) for x in (f if f is not None else ()))
        return linked_listing([(int(r["address"]), int(r["size"]), r["text"]) for r in rows], Regions(dict(n if n is not None else ()), dict(s if s is not None else ()), spans))

    return pd.Series([one(*r) for r in zip(code, names, strings, functions, strict=True)], dtype=object)
