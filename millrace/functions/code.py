"""Source and assembly text: literals, names in code, summaries of calls, context names, anonymous names, definitions.

All but anonymise(), definitions(), uleb128() and shown() are Column expressions that stay in the JVM. Null texts give null.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.names import best_copy_f1, tokens
from millrace.functions.text import QUOTED, inner_calls, lines, prompt, prompt_parts, word_count

#: Strings, character constants and comments; one that is never closed reaches to the end.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\z)' + r"|'[^'\\]*+(?:\\.[^'\\]*+)*+(?:'|\z)"
_COMMENT = r"//[^\n]*+|/\*.*?(?:\*/|\z)"
_PIECE = rf"(?s){_STRING}|{_COMMENT}|[^\"'/]++|."
IDENTIFIER = r"(?<![A-Za-z0-9_])[A-Za-z_][A-Za-z0-9_]*"
ANONYMOUS = r"(?<![A-Za-z0-9_])sub_[0-9a-fA-F]++(?![A-Za-z0-9_])"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, also where lambdas inside body use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mask(text: Column, comments: bool = True) -> Column:
    """text with strings and character constants (and comments) as spaces; positions and line ends stay."""
    opens = r"^([\"']|//|/\*)" if comments else "^[\"']"
    parts = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(F.regexp_like(p, F.lit(opens)), F.regexp_replace(p, r"[^\n]", " ")).otherwise(p)), "")


def name_in_code(text: Column, name: Column) -> Column:
    """The first identifier outside strings that is the name, with or without a leading `_`, in any case; else null."""
    wanted = F.array(F.lower(name), F.concat(F.lit("_"), F.lower(name)))
    found = F.regexp_extract_all(mask(text, comments=False), F.lit(IDENTIFIER), F.lit(0))
    # Most texts do not hold the name at all, and need no look at their identifiers.
    return F.when((name != "") & F.contains(F.lower(text), F.lower(name)), F.get(F.filter(found, lambda x: F.array_contains(wanted, F.lower(x))), F.lit(0)))


def call_summary(name: Column, n: Column, asm: Column, unit: str = "instructions", calls: str = "calls", strings: str = "string", data: str = "data") -> Column:
    """One line: name (n unit): calls imports and inner targets; string literals. At most 6 imports, 4 targets, 4 strings."""

    def line(targets: Column) -> Column:
        cut = lambda s: F.when(F.length(s) <= 60, s).otherwise(F.concat(F.regexp_replace(F.substring(s, 1, 58), r"\\+$", ""), F.lit('…"')))
        quoted = F.slice(F.array_distinct(F.transform(F.filter(targets, lambda t: t.startswith('"')), cut)), 1, 4)
        outside = lambda t: ~F.regexp_like(t, F.lit(rf'^("|sub_|dat_)|^{data}$'))
        heads = F.concat(F.slice(F.array_distinct(F.filter(targets, outside)), 1, 6), F.slice(inner_calls(asm), 1, 4))
        part = lambda word, xs: F.when(F.size(xs) > 0, F.concat(F.lit(word + " "), F.array_join(xs, ", ")))
        rest = F.concat_ws("; ", part(calls, heads), part(strings, quoted))
        return F.concat(name, F.lit(" ("), n.cast("string"), F.lit(f" {unit})"), F.when(rest != "", F.concat(F.lit(": "), rest)).otherwise(""))

    targets = F.filter(F.transform(lines(asm), lambda x: F.regexp_extract(x, r";\s*->\s*(.+?)\s*$", 1)), lambda t: t != "")
    return let(targets, line)


def renamed(context: Column, names: Column) -> Column:
    """A context with sub_x tokens outside strings replaced by the map names."""
    found = F.regexp_extract_all(context, F.lit(rf'(?s){QUOTED}|{ANONYMOUS}|[^"s]++|.'), F.lit(0))
    return F.array_join(F.transform(found, lambda t: F.when(t.startswith("sub_"), F.coalesce(F.try_element_at(names, t), t)).otherwise(t)), "")


def symbols_of(context: Column) -> Column:
    """Distinct sub_x tokens outside strings."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(context, QUOTED, '""'), F.lit(f"({ANONYMOUS})"), F.lit(1)))


def rewrite_context(text: Column, names: Column) -> Column:
    """A prompt whose context is renamed(); the other parts stay."""
    return let(prompt_parts(text), lambda p: F.when(p["context"] == "", text).otherwise(prompt(p["asm"], renamed(p["context"], names), p["decompiled"])))


def name_candidates(context: Column, calls: str = "calls") -> Column:
    """Sorted names that a context gives: heads `name (` of lines, and what stands after `calls` up to a semicolon."""

    def of_line(x: Column) -> Column:
        bare = F.regexp_replace(x, QUOTED, "")
        head = F.array(F.regexp_extract(bare, r"^([A-Za-z_][A-Za-z0-9_]*)\s*\(", 1))
        return F.concat(head, F.regexp_extract_all(F.regexp_extract(bare, rf"{calls} ([^;]*)", 1), F.lit(IDENTIFIER), F.lit(0)))

    found = F.flatten(F.transform(lines(context), of_line))
    return F.array_sort(F.array_distinct(F.filter(found, lambda t: (t != "") & ~F.regexp_like(t, F.lit("^sub_[0-9a-fA-F]+$")))))


def lexical(target: Column, candidates: Column) -> Column:
    """struct(target_tokens, shared_tokens, token_recall, any_shared, all_shared, best_copy_f1) of a name and candidate names."""
    wanted = F.array_distinct(tokens(target))
    have = F.array_distinct(F.flatten(F.transform(candidates, tokens)))

    def body(s: Column) -> Column:
        n, c = F.size(s["w"]), F.size(F.array_intersect(s["w"], s["h"]))
        recall = F.when(n > 0, c / n).otherwise(0.0)
        return F.struct(
            n.cast("long").alias("target_tokens"), c.cast("long").alias("shared_tokens"), recall.alias("token_recall"), (c > 0).alias("any_shared"),
            ((n > 0) & (c == n)).alias("all_shared"), best_copy_f1(s["k"], s["w"]).alias("best_copy_f1"),
        )

    return let(F.struct(wanted.alias("w"), have.alias("h"), candidates.alias("k")), body)


def ordinal_labels(text: Column, pattern: str, prefix: str) -> Column:
    """Matches of pattern replaced by prefix and their number by first use, from 1."""
    cut = rf"(?s){pattern}|(?:(?!{pattern}).)"
    parts = F.struct(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("seen"), F.regexp_extract_all(text, F.lit(cut), F.lit(0)).alias("all"))
    label = lambda s, t: F.when(F.array_position(s["seen"], t) > 0, F.concat(F.lit(prefix), F.array_position(s["seen"], t).cast("string"))).otherwise(t)
    return let(parts, lambda s: F.array_join(F.transform(s["all"], lambda t: label(s, t)), ""))


def quality_flags(name: Column, text_en: Column, text: Column, asm: Column, context: Column, raw: Column, n_instructions: Column, least: int = 8, least_words: int = 5) -> Column:
    """Flags of a prepared row, in this order: name_in_string, no_description, too_short, too_long, name_in_text, short_description."""
    en, tr, nm = (F.coalesce(x, F.lit("")) for x in (text_en, text, name))
    has = lambda where: F.contains(F.lower(where), F.lower(nm))
    strings = F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(QUOTED), F.lit(0))
    longer = F.contains(F.concat_ws("\n", asm, context), F.lit("; ... cut")) | (F.size(lines(F.coalesce(raw, asm))) > F.size(lines(asm)))
    flags = [
        ("name_in_string", (nm != "") & F.exists(strings, has)), ("no_description", (en == "") | (tr == "")), ("too_short", n_instructions < least), ("too_long", longer),
        ("name_in_text", (nm != "") & (en != "") & has(en)), ("short_description", ((en != "") & (word_count(en) < least_words)) | ((tr != "") & (word_count(tr) < least_words))),
    ]
    return F.filter(F.array(*[F.when(c, F.lit(f)) for f, c in flags]), lambda f: f.isNotNull())


def judge_scores(text: Column, fields: tuple[str, ...], scores: str = "scores", agreement: str = "agreement") -> Column:
    """struct(valid, agreement, fields...): whole scores 0 to 2 (digit strings too) and yes/no (booleans too) of a judge's JSON,
    fenced or inside other text. valid: all are there."""

    def body(js: Column) -> Column:
        raw = {f: F.coalesce(F.get_json_object(js, f"$.{scores}.{f}"), F.get_json_object(js, f"$.{f}")) for f in fields}
        got = {f: F.when(F.regexp_like(F.trim(v), F.lit("^[012]$")), F.trim(v).cast("int")) for f, v in raw.items()}
        said = F.lower(F.trim(F.get_json_object(js, f"$.{agreement}")))
        agree = F.when(said.isin("yes", "true"), "yes").when(said.isin("no", "false"), "no")
        valid = agree.isNotNull()
        for v in got.values():
            valid = valid & v.isNotNull()
        return F.struct(valid.alias("valid"), agree.alias("agreement"), *[v.alias(f) for f, v in got.items()])

    return let(F.regexp_extract(text, r"(?s)(\{.*\})", 1), body)


def strict_name(text: Column, field: str = "name") -> Column:
    """The named field of an answer that is JSON and nothing else (a fence aside) and an identifier that is not anonymous; else null."""
    bare = F.regexp_replace(F.trim(text), r"^```(?:json)?\s*|\s*```$", "")
    name = F.get_json_object(bare, f"$.{field}")
    good = F.regexp_like(name, F.lit("^[A-Za-z_][A-Za-z0-9_]*$")) & ~F.regexp_like(name, F.lit("^sub_[0-9a-fA-F]+$"))
    return F.when(good & F.regexp_like(bare, F.lit(r"(?s)^\{.*\}$")), name)


def around(text: Column, name: Column, window: int) -> Column:
    """Characters from window before to window after the name's first place, or the first 2 * window; short texts stay."""
    at = F.greatest(F.position(name, text), F.lit(1))
    return F.when(F.length(text) <= 2 * window, text).otherwise(F.substr(text, F.greatest(at - window, F.lit(1)), F.lit(2 * window)))


_SCAN = re.compile(r"""(?P<string>"(?:\\.|[^"\\])*(?:"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z))|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<word>[A-Za-z_]\w*)|->|\S""", re.S | re.A)
_PLAIN = re.compile(r"(?P<word>[A-Za-z_]\w*)|->|\S", re.A)


def scan(text: str) -> Iterator[tuple[str, str, int]]:
    """(kind, token, start): strings whole; words and signs of code and of comments."""
    for m in _SCAN.finditer(text):
        if m.lastgroup == "comment":
            for n in _PLAIN.finditer(m.group()):
                yield n.lastgroup or "sign", n.group(), m.start() + n.start()
        else:
            yield m.lastgroup or "sign", m.group(), m.start()


def words_of(text: Column) -> Column:
    """Distinct words of a text, and those without their leading `_`: all names that anonymise() can find in it are among them."""
    words = F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))
    return let(words, lambda w: F.array_union(w, F.transform(F.filter(w, lambda t: t.startswith("_")), lambda t: t.substr(F.lit(2), F.length(t)))))


def anonymised(text: str, names: set[str], exempt: set[str], used: list[tuple[int, int]] = ()) -> tuple[str, int, int, int]:
    """text with names of functions (called, declared or after `&`) as FUN_x1, FUN_x2, ... by first use; how many tokens were
    replaced and how many stand elsewhere, and how many lines changed. A leading `_` is part of no name; exempt names stay.
    used: sorted ranges (first, last) of numbers that are not given, besides those of names and words."""
    found = list(scan(text))
    taken = {t for kind, t, _ in found if kind == "word"} | names
    given, parts, done, other, changed, number, at_range = {}, [], 0, 0, [], 0, 0
    for before, (kind, token, at), after in zip([("", "", 0), *found], found, [*found[1:], ("", "", 0)], strict=False):
        name = token if token in names else token.removeprefix("_")
        if kind != "word" or name not in names or {token, name, token.removeprefix("_")} & exempt:
            continue
        if not (before[1] == "&" or (after[1] == "(" and before[1] not in (".", "->"))):
            other += 1
            continue
        if name not in given:
            number += 1
            while f"FUN_x{number}" in taken or (at_range < len(used) and used[at_range][0] <= number):
                if at_range < len(used) and used[at_range][0] <= number:
                    number, at_range = max(number, used[at_range][1] + 1), at_range + 1
                else:
                    number += 1
            given[name] = f"FUN_x{number}"
        parts += [text[done:at], given[name]]
        done = at + len(token)
        changed.append(at)
    rows = {text.count("\n", 0, at) for at in changed}
    return "".join([*parts, text[done:]]), len(changed), other, len(rows)


_REPLACED = T.StructType([T.StructField("text", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("n_replaced", "n_elsewhere", "n_lines")]])
_SOURCES = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("name", "source")]))


@F.pandas_udf(_REPLACED)
def anonymise(texts: pd.Series, names: pd.Series, exempt: pd.Series, used: pd.Series = None) -> pd.DataFrame:
    """(text, names array, exempt array, and used numbers as an array of ranges if there are any): see anonymised()."""
    some = lambda v: v if v is not None else ()
    ranges = [[(r["first"], r["last"]) for r in some(u)] for u in used] if used is not None else [()] * len(texts)
    rows = [anonymised(t, set(some(n)), set(some(e)), u) if isinstance(t, str) else (None, None, None, None) for t, n, e, u in zip(texts, names, exempt, ranges, strict=True)]
    return pd.DataFrame(rows, columns=["text", "n_replaced", "n_elsewhere", "n_lines"]).astype({c: "Int64" for c in ("n_replaced", "n_elsewhere", "n_lines")})


def _closing(found: list[tuple[str, int]], i: int) -> int:
    """The place of the bracket that closes the one at i, or -1."""
    depth, pair = 0, {"(": ")", "{": "}"}[found[i][0]]
    for j in range(i, len(found)):
        depth += (found[j][0] == found[i][0]) - (found[j][0] == pair)
        if not depth:
            return j
    return -1


def found_definitions(text: str, wanted: set[str] | None = None) -> list[tuple[str, str]]:
    """(name, source) of the C functions defined in a text (of the wanted names only, if given), in order.

    A definition is a name, its parameters, and a body; between the last two may stand attributes, or declarations of all
    parameters where these are bare names. Directives, prototypes, calls and initialisers are none."""
    blank = lambda m: re.sub(r"[^\n]", " ", m.group())
    code = _SCAN.sub(lambda m: blank(m) if m.lastgroup in ("string", "comment") else m.group(), text)
    code = re.sub(r"(?m)^[ \t]*#(?:[^\n\\]|\\.|\\\n)*", blank, code)
    found = [(m.group(), m.start()) for m in re.finditer(r"[A-Za-z_]\w*|\S", code)]
    out, since, i = [], 0, 0
    while i < len(found):
        token = found[i][0]
        if token in ";}{":
            since = i + 1
        head = token.isidentifier() and i + 1 < len(found) and found[i + 1][0] == "("
        if not head or token in ("if", "for", "while", "switch", "return", "sizeof", "do") or i == since:
            i += 1
            continue
        end = _closing(found, i + 1)
        params = [t for t, _ in found[i + 2 : end]] if end > 0 else []
        bare = set(params[::2]) if params and all(t.isidentifier() for t in params[::2]) and set(params[1::2]) <= {","} else set()
        j, declared = end + 1, set()
        while 0 < j < len(found) and found[j][0] not in "{}=,;)":
            j = _closing(found, j) + 1 if found[j][0] == "(" else j + 1
        if bare and 0 < j < len(found) and found[j][0] in ",;":
            while j < len(found) and found[j][0] not in "{}=":
                declared.add(found[j][0]) if found[j][0] != ";" else None
                j += 1
            k = next((k for k in range(end + 1, j) if found[k][0] not in "();,*"), j)
            declared |= {t for t, _ in found[k:j]}
            j = j if bare <= declared and found[j - 1][0] == ";" else -1
        stop = _closing(found, j) if 0 < j < len(found) and found[j][0] == "{" else -1
        if stop < 0:
            i += 1
            continue
        if wanted is None or token in wanted:
            out.append((token, text[found[since][1] : found[stop][1] + 1]))
        i = since = stop + 1
    return out


@F.pandas_udf(_SOURCES)
def definitions(texts: pd.Series) -> pd.Series:
    """All functions that a C text defines, to be exploded; see found_definitions()."""
    return texts.map(lambda t: [{"name": n, "source": s} for n, s in found_definitions(t)] if isinstance(t, str) else None)


def uleb_values(raw: bytes) -> list[int]:
    """All unsigned LEB128 numbers of a byte string; an unfinished one, or one over 64 bits, is an error."""
    out, value, shift = [], 0, 0
    for b in raw:
        value |= (b & 0x7F) << shift
        shift += 7
        if not b & 0x80:
            out.append(value)
            value, shift = 0, 0
        elif shift > 63:
            raise ValueError("a LEB128 number is too long")
    if shift:
        raise ValueError("a LEB128 number is not finished")
    return out


@F.pandas_udf(T.ArrayType(T.DecimalType(20, 0)))
def uleb128(raw: pd.Series) -> pd.Series:
    from decimal import Decimal

    return raw.map(lambda b: [Decimal(v) for v in uleb_values(b)] if b is not None else None)


@F.pandas_udf(T.StringType())
def shown(texts: pd.Series) -> pd.Series:
    """A string for display: escaped, in quotes, 80 characters at most and an ellipsis."""
    escape = lambda t: t.encode("unicode_escape").decode("ascii").replace('"', '\\"')
    return texts.map(lambda t: None if t is None else f'"{escape(t)}"' if len(escape(t)) <= 80 else f'"{escape(t)[:80]}…"')
