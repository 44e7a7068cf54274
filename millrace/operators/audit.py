"""Audits: rates with empty classes, ceilings, recalls, reproduction, flagged samples, eligibility, intervals, two-hop context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.select import cap_per_group


def class_rates(df: DataFrame, fields: dict[str, tuple[str, ...]]) -> DataFrame:
    """(field, class, n, rate) for each field's listed classes; classes that no row has get 0. One pass over df."""
    one = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(f) == c).alias(f"{f}.{c}") for f, cs in fields.items() for c in cs])
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(c).alias("class"), F.col(f"`{f}.{c}`").alias("n")) for f, cs in fields.items() for c in cs])
    return one.select("total", F.inline(cells)).select("field", "class", "n", F.when(F.col("total") > 0, F.col("n") / F.col("total")).alias("rate"))


def ceiling(df: DataFrame, score: Column, flagged: Column) -> DataFrame:
    """One row: n, n_flagged, mean, mean_flagged, gain (if all flagged rows scored 1) and ceiling; means of no rows are null."""
    of = F.when(flagged, score)
    out = df.agg(F.count(F.lit(1)).alias("n"), F.count(of).alias("n_flagged"), F.avg(score).alias("mean"), F.avg(of).alias("mean_flagged"), F.coalesce(F.sum(1 - of), F.lit(0.0)).alias("_lost"))
    gain = F.when(F.col("n") > 0, F.col("_lost") / F.col("n"))
    return out.select("n", "n_flagged", "mean", "mean_flagged", gain.alias("gain"), (F.col("mean") + gain).alias("ceiling"))


def micro_macro(df: DataFrame, groups: list, shared: str, total: str) -> DataFrame:
    """Per group: n_rows, micro (sum of shared / sum of total), macro (mean of ratios; a ratio of nothing counts 0)."""
    ratio = F.when(F.col(total) > 0, F.col(shared) / F.col(total)).otherwise(0.0)
    micro = F.when(F.sum(total) > 0, F.sum(shared) / F.sum(total)).otherwise(0.0)
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_rows"), micro.alias("micro"), F.avg(ratio).alias("macro"))


def reproduction(expected: DataFrame, made: DataFrame, key: str, digest: str) -> DataFrame:
    """(state, n): same, changed, missing (not made again), extra (not expected) by key and digest."""
    a, b = expected.select(key, F.col(digest).alias("_a")), made.select(key, F.col(digest).alias("_b"))
    both = a.withColumn("_in_a", F.lit(True)).join(b.withColumn("_in_b", F.lit(True)), key, "full")
    state = F.when(F.col("_in_b").isNull(), "missing").when(F.col("_in_a").isNull(), "extra").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed")
    return both.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def flagged_sample(df: DataFrame, order: list, flagged: Column, n_any: int, n_flagged: int) -> DataFrame:
    """n_any rows by order, and n_flagged more with the flag that are not among them; `picked` says which."""
    rows = df.withColumn("_f", F.coalesce(flagged, F.lit(False)))
    # Both picks lie among the first n_any rows and the first n_any + n_flagged flagged ones.
    some = rows.orderBy(*order).limit(n_any).withColumn("_k", F.lit(0))
    more = rows.filter("_f").orderBy(*order).limit(n_any + n_flagged).withColumn("_k", F.lit(1))
    both = some.unionByName(more).withColumn("_n", F.row_number().over(Window.partitionBy(*order).orderBy("_k"))).filter("_n = 1")
    ranked = both.withColumn("_r", F.row_number().over(Window.partitionBy("_k").orderBy(*order)))
    out = ranked.filter((F.col("_k") == 0) | (F.col("_r") <= n_flagged))
    return out.withColumn("picked", F.when(F.col("_k") == 0, "any").otherwise("flagged")).drop("_f", "_k", "_n", "_r")


def evenly_spaced(df: DataFrame, groups: list, order: list, n: int) -> DataFrame:
    """About n rows a group at equal steps of its order, the first included."""
    w = Window.partitionBy(*groups)
    step = F.greatest(F.floor(F.count(F.lit(1)).over(w) / n), F.lit(1))
    ranked = df.withColumn("_step", step).withColumn("_r", F.row_number().over(w.orderBy(*order)) - 1)
    return ranked.filter((F.col("_r") % F.col("_step") == 0) & (F.col("_r") < F.col("_step") * n)).drop("_step", "_r")


def shortest(df: DataFrame, groups: list, text: str, key: str, n: int) -> DataFrame:
    """The n shortest texts of each group, ties by key."""
    return cap_per_group(df, groups, n, [F.length(text), key])


def eligible(name: Column, about: Column, fork: Column, license: Column, bad_name: str, bad_text: str, needed: str | None = None, platform: str | None = None) -> Column:
    """A repository that is no fork, has a licence, and whose name and text match no bad pattern (any case); where needed is
    given, the text must match it and not the platform pattern. Hyphens and underscores count as spaces."""
    text = F.translate(F.concat_ws(" ", name, about), "-_", "  ")
    has = lambda where, p: F.coalesce(F.regexp_like(where, F.lit(f"(?i){p}")), F.lit(False))
    good = ~F.coalesce(fork, F.lit(False)) & (F.coalesce(license, F.lit("")) != "") & ~has(name, bad_name) & ~has(text, bad_text)
    if needed:
        good = good & has(text, needed)
    return good & ~has(text, platform) if platform else good


def is_generated(content: Column, size: Column, pattern: str, head: int = 2048, most: int = 1_500_000) -> Column:
    """The first bytes match the pattern of a generator, or the file is too large."""
    return (size > most) | F.regexp_like(F.substring(content, 1, head).cast("string"), F.lit(pattern))


def subtract_intervals(spans: DataFrame, holes: DataFrame, scope: str, width: int = 4096) -> DataFrame:
    """What is left of spans (scope, id, lo, hi) without holes (scope, lo, hi), half-open whole numbers: rows (scope, id, lo, hi).

    Spans meet holes in bins of `width` only, each pair in the first bin that both touch; empty spans and holes count for nothing."""
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width))).alias("_bin")
    full = spans.filter("lo < hi").select(scope, "id", "lo", "hi")
    cuts = holes.select(scope, F.col("lo").alias("_a"), F.col("hi").alias("_b")).filter("_a < _b")
    both = full.select("*", bins("lo", "hi")).join(cuts.select("*", bins("_a", "_b")), [scope, "_bin"]).filter("_a < hi and _b > lo")
    both = both.filter(F.col("_bin") == F.floor(F.greatest("lo", "_a") / width)).drop("_bin")
    ends = both.select(scope, "id", "lo", "hi", "_a", "_b").unionByName(full.select(scope, "id", "lo", "hi", F.col("hi").alias("_a"), F.col("hi").alias("_b")))
    before = Window.partitionBy(scope, "id", "lo", "hi").orderBy("_a", "_b").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.greatest(F.coalesce(F.max("_b").over(before), F.col("lo")), F.col("lo"))
    return ends.withColumn("_from", begin).filter("_from < _a").select(scope, "id", F.col("_from").alias("lo"), F.col("_a").alias("hi"))


def resolve_callees(calls: DataFrame, functions: DataFrame, scope: str, wide: str, node: str, callee: str, columns: list[str]) -> DataFrame:
    """calls with the columns of the callee: the function of that name in the same scope, else the first one in the same wide scope."""
    near = functions.select(scope, wide, F.col(node).alias(callee), F.struct(*columns).alias("_near"))
    far = functions.groupBy(wide, F.col(node).alias(callee)).agg(F.min_by(F.struct(*columns), F.col(scope)).alias("_far"))
    out = calls.join(near, [scope, wide, callee], "left").join(far, [wide, callee], "left").withColumn("_got", F.coalesce("_near", "_far"))
    return out.select(*calls.columns, *[F.col(f"_got.{c}").alias(f"callee_{c}") for c in columns])


def deep_context(functions: DataFrame, key: list[str], node: str, calls: str, n: str, asm: str, summary: str, most_lines: int = 150, first: int = 6, second: int = 4, small: int = 40) -> DataFrame:
    """(key, node, context): for the first callees their text if small, else their summary and those of their own callees.

    Callees are looked up in the same key; each hop is one equi-join, and a function meets `first` times `second` others at most."""
    has = functions.select(*key, F.col(node).alias("_c"), F.col(n).alias("_n"), F.col(asm).alias("_asm"), F.col(summary).alias("_sum"), F.slice(calls, 1, second).alias("_next"))
    hop = functions.select(*key, node, F.posexplode(F.slice(calls, 1, first)).alias("_i", "_c")).join(has, [*key, "_c"])
    below = hop.filter(F.col("_n") > small).select(*key, node, "_i", F.posexplode("_next").alias("_j", "_d"))
    below = below.join(has.select(*key, F.col("_c").alias("_d"), F.col("_sum").alias("_line")), [*key, "_d"])
    own = hop.select(*key, node, "_i", F.lit(-1).alias("_j"), F.when(F.col("_n") <= small, F.concat(F.lit("; "), "_c", F.lit(" ("), F.col("_n").cast("string"), F.lit(" instructions):\n"), "_asm")).otherwise(F.col("_sum")).alias("_line"))
    rows = own.unionByName(below.select(*key, node, "_i", "_j", F.concat(F.lit("  "), "_line").alias("_line")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_j", "_line"))), lambda r: r["_line"]), "\n")
    out = rows.groupBy(*key, node).agg(F.split(text, "\n").alias("_lines"))
    cut = F.concat(F.slice("_lines", 1, most_lines - 1), F.array(F.lit("; ... cut")))
    return out.select(*key, node, F.array_join(F.when(F.size("_lines") > most_lines, cut).otherwise(F.col("_lines")), "\n").alias("context"))


def token_costs(df: DataFrame, groups: list, tokens: str, text: str, price: float) -> DataFrame:
    """Per group: n, tokens as recorded, tokens as estimated from the text, and what the recorded ones cost."""
    from millrace.functions.text import token_estimate

    total = F.sum(F.coalesce(tokens, F.lit(0))).cast("long")
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), total.alias("tokens"), F.sum(token_estimate(F.col(text))).alias("estimated"), (total * price).alias("cost"))


def project_status(per_option: DataFrame, project: str) -> DataFrame:
    """From a row (project, opt, n_rows, seconds, n_failed) for each option: sums, maxima, and done, partly or failed."""
    status = F.when(F.col("n_failed") == 0, "done").when(F.col("n_failed") < F.col("n_rows"), "partly").otherwise("failed")
    sums = per_option.groupBy(project).agg(F.count_distinct("opt").alias("n_opts"), F.sum("n_rows").alias("n_rows"), F.max("n_rows").alias("most_rows"), F.max("seconds").alias("seconds"), F.sum("n_failed").alias("n_failed"))
    return sums.withColumn("status", status)


def hit_groups(df: DataFrame, hits: str, score: str) -> DataFrame:
    """(grp, n, mean): a row counts in all, in hits or others, and in signature:x for each of its hits."""
    own = F.array(F.lit("all"), F.when(F.size(hits) > 0, "hits").otherwise("others"))
    labels = F.concat(own, F.transform(F.array_distinct(hits), lambda h: F.concat(F.lit("signature:"), h)))
    return df.select(F.explode(labels).alias("grp"), score).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"))


def link_map(lines: DataFrame, column: str = "value") -> DataFrame:
    """(address, symbol, object) of the symbols in a linker's map: `[ 1] path` names an object, `0xADDRESS 0xSIZE [ 1] _symbol` a symbol in it;
    the symbol loses one underscore. Objects without a line are null."""
    text = F.col(column)
    objects = lines.select(F.regexp_extract(text, r"^\[\s*(\d+)\]\s+(.+)$", 1).alias("_n"), F.regexp_extract(text, r"^\[\s*(\d+)\]\s+(.+)$", 2).alias("object")).filter("_n != ''")
    row = r"^0x([0-9a-fA-F]+)\s+0x[0-9a-fA-F]+\s+\[\s*(\d+)\]\s+(.+)$"
    symbols = lines.filter(text.rlike(row)).select(F.conv(F.regexp_extract(text, row, 1), 16, 10).cast("long").alias("address"), F.regexp_replace(F.regexp_extract(text, row, 3), "^_", "").alias("symbol"), F.regexp_extract(text, row, 2).alias("_n"))
    return symbols.join(objects, "_n", "left").select("address", "symbol", "object")


def attributed(symbols: DataFrame, mapped: DataFrame) -> DataFrame:
    """symbols (address, symbol, ...) with the object that the link map has for the same address and name, else null."""
    return symbols.join(mapped.select("address", "symbol", "object").distinct(), ["address", "symbol"], "left")
