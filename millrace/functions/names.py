"""Name tokens and name scores as Column expressions; all stay in the JVM and can be used in SQL through register()."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Words that count as one in the wide fold; the first of each group stands for all.
SYNONYMS = (
    ("red", "crimson"), ("green", "emerald"), ("blue", "azure"), ("widget", "gadget"), ("gear", "cog"), ("bolt", "screw"),
    ("get", "fetch", "read", "load"), ("set", "put", "write", "store"), ("init", "create", "new", "setup"), ("free", "destroy", "delete", "release"), ("len", "length", "size", "count"), ("buf", "buffer"), ("str", "string"), ("cmp", "compare", "equal"),
)
#: Groups for one-to-one matching.
NARROW = (("red", "crimson"), ("blue", "azure"), ("widget", "gadget"), ("buf", "buffer"), ("str", "string"), ("len", "length"))


def tokens(name: Column) -> Column:
    """Distinct-case words: camel-case borders split, lower-cased, cut at all but Unicode letters and digits."""
    cut = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")
    return F.filter(F.split(F.lower(cut), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def fold(words: Column, groups: tuple[tuple[str, ...], ...]) -> Column:
    """Each word's group's first word, or the word."""
    table = F.create_map(*[F.lit(x) for g in groups for w in g for x in (w, g[0])])
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w))


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("long")


def n_distinct(a: Column) -> Column:
    return F.size(F.array_distinct(a)).cast("long")


def f1(pred: Column, gold: Column) -> Column:
    """2c / (|P| + |G|) over sets of words; 0 where nothing is shared. Null names count as empty."""
    p, g = (F.coalesce(x, F.array().cast("array<string>")) for x in (pred, gold))
    total = n_distinct(p) + n_distinct(g)
    return F.when(total == 0, 0.0).otherwise(2.0 * shared(p, g) / total)


def precision(pred: Column, gold: Column) -> Column:
    return F.when(n_distinct(pred) == 0, 0.0).otherwise(shared(pred, gold) / n_distinct(pred))


def recall(pred: Column, gold: Column) -> Column:
    return F.when(n_distinct(gold) == 0, 0.0).otherwise(shared(pred, gold) / n_distinct(gold))


def without_prefixes(pred: Column, gold: Column, prefixes: Column) -> tuple[Column, Column]:
    """Predicted and gold words without prefixes. A gold name of prefixes only keeps them; a predicted one becomes empty."""
    g = F.array_except(gold, prefixes)
    return F.array_except(pred, prefixes), F.when(F.size(g) == 0, gold).otherwise(g)


def f1_without(pred: Column, gold: Column, prefixes: Column) -> Column:
    """F1 without the words of prefixes; see without_prefixes()."""
    return f1(*without_prefixes(pred, gold, prefixes))


def narrow_f1(pred: Column, gold: Column, groups: tuple[tuple[str, ...], ...] = NARROW) -> Column:
    """One-to-one matching where words match if equal or in one group. That is an equivalence, so the largest matching is
    the sum over classes of the smaller number of words; the denominators are the unfolded set sizes."""
    p, g = F.array_distinct(pred), F.array_distinct(gold)
    pf, gf = fold(p, groups), fold(g, groups)
    times = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    matched = F.aggregate(F.array_intersect(pf, gf), F.lit(0), lambda n, w: n + F.least(times(pf, w), times(gf, w)))
    total = F.size(p) + F.size(g)
    return F.when(total == 0, 0.0).otherwise(2.0 * matched / total)


def strip_prefix(name: Column, prefixes: Column) -> Column:
    """name without the longest of prefixes that starts it (any case, with one `_` after it), never to empty."""
    longest = F.array_sort(F.filter(prefixes, lambda p: F.startswith(F.lower(name), F.lower(p))), lambda a, b: F.length(b) - F.length(a))
    rests = F.transform(longest, lambda p: F.regexp_replace(F.substr(name, F.length(p) + 1), "^_", ""))
    return F.coalesce(F.get(F.filter(rests, lambda r: r != ""), F.lit(0)), name)


def best_copy_f1(candidates: Column, gold: Column) -> Column:
    """The largest F1 of any candidate name; 0 without one."""
    return F.coalesce(F.array_max(F.transform(candidates, lambda c: f1(tokens(c), gold))), F.lit(0.0))


def register(spark: SparkSession) -> None:
    """SQL functions name_tokens(name) and name_f1(pred, gold)."""
    spark.sql(r"""CREATE OR REPLACE TEMPORARY FUNCTION name_tokens(x STRING) RETURNS ARRAY<STRING>
        RETURN filter(split(lower(regexp_replace(x, '([a-z0-9])([A-Z])', '$1_$2')), '[^\\p{L}\\p{N}]+'), t -> t <> '')""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION name_f1(p STRING, g STRING) RETURNS DOUBLE
        RETURN CASE WHEN size(array_distinct(name_tokens(p))) + size(array_distinct(name_tokens(g))) = 0 THEN 0D
        ELSE 2D * size(array_intersect(name_tokens(p), name_tokens(g))) / (size(array_distinct(name_tokens(p))) + size(array_distinct(name_tokens(g)))) END""")
