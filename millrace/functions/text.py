"""Text, assembly and answer functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unrolled, so that Java's matcher does not recurse for each character of a long string.
QUOTED = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
CONTEXT, DECOMPILED = "\n; context\n", "\n; decompiled\n"


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def instruction_count(text: Column) -> Column:
    """Lines that are neither blank nor end in a colon."""
    return F.size(F.filter(lines(text), lambda x: (F.trim(x) != "") & ~x.endswith(":"))).cast("long")


def line_cap(text: Column, n: int, marker: str = "; ... cut") -> Column:
    """The first n lines and a marker line, or the text as it is."""
    return F.when(F.size(lines(text)) > n, F.concat(F.array_join(F.slice(lines(text), 1, n), "\n"), F.lit("\n" + marker))).otherwise(text)


def shorten(text: Column, head: int, tail: int, marker: str) -> Column:
    """First head and last tail lines around a marker, where there are more."""
    x = lines(text)
    return F.when(F.size(x) > head + tail + 1, F.concat_ws("\n", F.array_join(F.slice(x, 1, head), "\n"), F.lit(marker), F.array_join(F.slice(x, -tail, tail), "\n"))).otherwise(text)


def budget_prefix(text: Column, budget: int, cost=lambda line: F.length(line) + 1) -> Column:
    """The longest run of first lines whose added costs stay in the budget."""
    def step(acc: Column, line: Column) -> Column:
        total = acc["total"] + cost(line).cast("long")
        fits = acc["open"] & (total <= budget)
        return F.struct(total.alias("total"), fits.alias("open"), (acc["n"] + fits.cast("int")).alias("n"))

    got = F.aggregate(lines(text), F.struct(F.lit(0).cast("long").alias("total"), F.lit(True).alias("open"), F.lit(0).alias("n")), step)
    return F.array_join(F.slice(lines(text), F.lit(1), got["n"]), "\n")


def token_estimate(text: Column) -> Column:
    return F.floor((F.length(text) + 3) / 4).cast("long")


def word_count(text: Column) -> Column:
    """Runs of letters and digits, with one apostrophe inside at most."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)?")).cast("long")


def normal_asm(text: Column) -> Column:
    """SHA-1 with generated labels reduced to their kind."""
    return F.sha1(F.regexp_replace(text, r"\b(sub|dat|ext)_[0-9a-f]{4,}\b", "$1"))


#: Generated labels and what stands for each kind (fixed values).
LABELS = ((r"sub_[0-9a-fA-F]+", "sub_"), (r"(?:dat|DAT)_[0-9a-fA-F]+", "dat_"), (r"(?:FUN|LAB|PTR_DAT|PTR_FUN|PTR_LOOP|thunk_FUN)_[0-9a-fA-F]+", "ghidra_"))


def normalise(text: Column) -> Column:
    """Generated labels reduced to their kind, runs of Unicode white space to one space, none at the ends."""
    out = text
    for label, kind in LABELS:
        out = F.regexp_replace(out, rf"(?U)\b{label}\b", kind)
    return F.trim(F.regexp_replace(out, r"(?U)[\s\x1c-\x1f]+", " "))


def text_hash(text: Column) -> Column:
    """SHA-256 of the normalised text; null for blank ones. The text is normalised once, in whatever filters the hash is used."""
    return F.get(F.transform(F.array(normalise(text)), lambda t: F.when(t != "", F.sha2(t, 256))), F.lit(0))


def has_identifier(text: Column, name: Column, any_case: bool = False) -> Column:
    pattern = F.concat(F.lit(("(?i)" if any_case else "") + r"(?<![A-Za-z0-9_])\Q"), name, F.lit(r"\E(?![A-Za-z0-9_])"))
    return F.regexp_like(text, pattern)


def leak_flag(text: Column, name: Column) -> Column:
    """The name has over three characters and stands in the text as a whole identifier, in any case."""
    return (F.length(name) > 3) & has_identifier(text, name, True)


def leak_kind(text: Column, name: Column) -> Column:
    """null: under four characters or no substring; identifier: whole outside quotes; string: in quotes; else substring."""
    bare = F.regexp_replace(text, QUOTED, '""')
    in_string = F.exists(F.regexp_extract_all(text, F.lit(QUOTED), F.lit(0)), lambda s: F.contains(s, name))
    return F.when((F.length(name) < 4) | ~F.contains(text, name), F.lit(None)).when(has_identifier(bare, name), "identifier").when(in_string, "string").otherwise("substring")


def direct_calls(text: Column) -> Column:
    """Targets of call and jmp at the start of a line, as written."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:call|jmp)\s+(sub_[0-9a-fA-F]+)\b"), F.lit(1))


def inner_calls(text: Column, most: int = 8) -> Column:
    """Distinct targets in first-seen order: what a `; -> sub_x` at the end of the line names, else the operand."""
    noted = lambda x: F.regexp_extract(x, r"^\s*(?:call|jmp)\w*\s.*;\s*->\s*(sub_[0-9a-f]+)\s*$", 1)
    operand = lambda x: F.regexp_extract(x, r"^\s*(?:call|jmp)\w*\s+(sub_[0-9a-f]+)\b", 1)
    found = F.transform(lines(text), lambda x: F.when(noted(x) != "", noted(x)).otherwise(operand(x)))
    return F.slice(F.array_distinct(F.filter(found, lambda t: t != "")), 1, most)


#: What holds no constants: strings, character constants and comments.
NO_CODE = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"' + r"|'[^'\\]*+(?:\\.[^'\\]*+)*+'|/\*.*?\*/|//[^\n]*+"
NUMBER = r"(?<![\w.])[-+]?(?:0[xX][0-9a-fA-F]+|[0-9]+)(?:[uU](?:[lL]{1,2})?|[lL]{1,2}[uU]?)?(?![\w.])"


def blanked(text: Column, pattern: str = NO_CODE) -> Column:
    """text with spaces for all but the line ends of what matches the pattern, whose matches start with a quote or a slash."""
    # What opens no match goes in runs, so that a text has few parts; those of one character opened none.
    opens = lambda p: (F.length(p) > 1) & F.substring(p, 1, 1).isin('"', "'", "/")
    parts = F.regexp_extract_all(text, F.lit(rf"(?s){pattern}|[^\"'/]++|."), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(opens(p), F.regexp_replace(p, r"[^\n]", " ")).otherwise(p)), "")


def numeric_literals(text: Column, assembly: bool = True) -> Column:
    """array of struct(literal, line): numbers with sign, prefix and suffix as written, outside strings and comments, and their
    lines from 1. In assembly what follows a semicolon, and what stands in square brackets, holds none."""

    def of_line(line: Column, i: Column) -> Column:
        return F.transform(F.regexp_extract_all(line, F.lit(NUMBER), F.lit(0)), lambda n: F.struct(n.alias("literal"), (i + 1).cast("int").alias("line")))

    # Neither reaches over the end of a line, so whole texts are cleared at once.
    code = blanked(text)
    code = F.regexp_replace(F.regexp_replace(code, ";.*", ""), r"\[[^\]\n]*\]", " ") if assembly else code
    return F.flatten(F.transform(lines(code), of_line))


def literal_bits(literal: Column) -> Column:
    """The 64 bits of a literal as 16 hex digits, negative ones as two's complement; null where it has more (decimal: 20 digits on)."""
    found = F.regexp_extract(literal, r"^[-+]?(?:0[xX])?0*([0-9a-fA-F]*)", 1)
    body = F.when(found == "", "0").otherwise(found)
    signed = F.concat(F.when(F.startswith(literal, F.lit("-")), "-").otherwise(""), body)
    hexed = F.contains(F.lower(literal), F.lit("x"))
    bits = F.when(hexed & (F.length(body) <= 16), F.conv(signed, 16, 16)).when(~hexed & (F.length(body) <= 19), F.conv(signed, 10, 16))
    return F.lower(F.lpad(bits, 16, "0"))


def last_flat_object(text: Column) -> Column:
    """The last {...} without braces inside."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(r"\{[^{}]*\}"), F.lit(0)), F.lit(-1))


def parse_answer(text: Column, field: str = "name", others: tuple[str, ...] = ()) -> Column:
    """struct(name, others..., valid_json) of an answer that may hold other text, or be cut.

    The first object that can be decoded and has a string in the field gives all; what stands after it plays no part, an object
    inside one counts if the outer one does not. Else (not valid) the fields are taken by pattern, whole strings only; else the name
    is the first identifier. An object that names a key twice cannot be decoded. Other fields that are absent are empty."""
    suffixes = F.regexp_extract_all(text, F.lit(r"(?s)(?=(\{.*))"), F.lit(1))
    kind = lambda v: F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))
    good = F.get(F.filter(F.transform(suffixes, F.try_parse_json), lambda v: kind(v) == "STRING"), F.lit(0))
    string = lambda v, f: F.try_variant_get(v, f"$.{f}", "string")
    # A string found by pattern is decoded as the only value of an object.
    found = lambda f: F.regexp_extract(text, rf'"{f}"\s*:\s*("(?:\\.|[^"\\])*")', 1)
    by_field = lambda f: F.coalesce(string(F.try_parse_json(F.concat(F.lit('{"x":'), found(f), F.lit("}"))), "x"), F.lit(""))
    first = F.regexp_extract(text, r"([A-Za-z_][A-Za-z0-9_]*)", 1)
    name = F.when(by_field(field) != "", by_field(field)).otherwise(first)
    rest = lambda f: F.when(by_field(field) != "", by_field(f)).otherwise("")
    whole = lambda v: F.struct(string(v, field).alias("name"), *[F.coalesce(string(v, f), F.lit("")).alias(f) for f in others], F.lit(True).alias("valid_json"))
    part = F.struct(name.alias("name"), *[rest(f).alias(f) for f in others], F.lit(False).alias("valid_json"))
    return F.get(F.transform(F.array(good), lambda v: F.when(v.isNotNull(), whole(v)).otherwise(part)), F.lit(0))


def clean_identifier(text: Column, most: int = 80) -> Column:
    """ASCII identifier of a free text, or null: letters transliterated, the rest `_`, runs collapsed, lower-cased."""
    plain = F.translate(text, "çğıöşüÇĞİÖŞÜ", "cgiosuCGIOSU")
    out = F.lower(F.regexp_replace(F.regexp_replace(plain, "[^A-Za-z0-9_]+", "_"), "_+", "_"))
    out = F.substring(F.regexp_replace(out, "^_+|_+$", ""), 1, most)
    return F.when(F.regexp_like(out, F.lit("^[a-z_][a-z0-9_]*$")) & ~F.regexp_like(out, F.lit("^(sub|fun|dat)_[0-9a-f]+$")), out)


def clean_description(text: Column, most_words: int = 25) -> Column:
    """First sentence of an answer: fences dropped, spaces collapsed, 25 words at most, first letter upper, a final dot."""
    x = F.trim(F.regexp_replace(F.regexp_replace(text, "```[a-z]*", " "), r"\s+", " "))
    x = F.regexp_replace(x, r"^(?i)(this function|the function|it)\s+", "")
    x = F.array_join(F.slice(F.split(F.regexp_extract(x, r"^(.*?)(?:\.\s|\.?$)", 1), " "), 1, most_words), " ")
    return F.when(x != "", F.concat(F.upper(F.substring(x, 1, 1)), F.expr("''"), x.substr(F.lit(2), F.length(x)), F.lit(".")))


def merge_comment(old: Column, text: Column, tag: str = "[model] ") -> Column:
    """old with its tagged lines replaced by the lines of text, each tagged; other lines and the kind of line end stay. Without a text
    old stays; the new lines come last."""
    was, new = F.coalesce(old, F.lit("")), F.trim(F.coalesce(text, F.lit("")))
    end = F.when(F.contains(was, F.lit("\r\n")), "\r\n").otherwise("\n")
    rows = F.regexp_extract_all(was, F.lit(r"[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+$"), F.lit(0))
    rest = F.array_join(F.filter(rows, lambda x: ~F.startswith(x, F.lit(tag))), "")
    gap = F.when((rest != "") & ~F.regexp_like(rest, F.lit(r"[\r\n]\z")), end).otherwise("")
    tagged = F.array_join(F.transform(F.split(new, "\r\n|\n|\r"), lambda x: F.concat(F.lit(tag), x)), "\n")
    return F.when(new == "", was).otherwise(F.concat(rest, gap, F.replace(tagged, F.lit("\n"), end)))


def function_classes(opt: Column, size: Column, is_wrapper: Column, is_leaf: Column, has_string: Column, has_import: Column) -> Column:
    """All classes of a function: all, opt:x, size:x, and wrapper, leaf, string, import where they hold."""
    labels = [F.lit("all"), F.concat(F.lit("opt:"), opt), F.concat(F.lit("size:"), size_class(size)), *[F.when(c, F.lit(n)) for n, c in (("wrapper", is_wrapper), ("leaf", is_leaf), ("string", has_string), ("import", has_import))]]
    return F.array_compact(F.array(*labels))


def excluded_path(path: Column, folder: str, file: str | None = None) -> Column:
    """A folder of the path starts with a dot or matches the first pattern, or its file name the second."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    bad = F.exists(folders, lambda x: F.startswith(x, F.lit(".")) | F.regexp_like(x, F.lit(folder)))
    return bad | F.regexp_like(F.element_at(parts, -1), F.lit(file)) if file else bad


def prompt(asm: Column, context: Column, decompiled: Column) -> Column:
    part = lambda head, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(head), c)).otherwise("")
    return F.concat(asm, part(CONTEXT, context), part(DECOMPILED, decompiled))


def prompt_parts(text: Column) -> Column:
    """struct(asm, context, decompiled); a part that is missing is empty. The decompiled part is cut first."""
    first = F.split(text, DECOMPILED, 2)
    rest = F.split(first[0], CONTEXT, 2)
    return F.struct(rest[0].alias("asm"), F.coalesce(F.get(rest, F.lit(1)), F.lit("")).alias("context"), F.coalesce(F.get(first, F.lit(1)), F.lit("")).alias("decompiled"))


def size_class(n: Column, bounds: tuple[int, ...] = (20, 60, 200)) -> Column:
    """`<20`, `20-59`, `60-199`, `200+`."""
    out = F.when(n < bounds[0], f"<{bounds[0]}")
    for a, b in zip(bounds, bounds[1:], strict=False):
        out = out.when(n < b, f"{a}-{b - 1}")
    return out.otherwise(f"{bounds[-1]}+")


def hash_share(key: Column) -> Column:
    """The first 32 bits of SHA-1 as a share in [0, 1)."""
    return F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def seeded(seed: str, key: Column) -> Column:
    """Order key: hex SHA-256 of seed, NUL, key."""
    return F.sha2(F.concat(F.lit(seed), F.lit("\0"), key.cast("string")), 256)
