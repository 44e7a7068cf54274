"""Joins with contracts: every id found, unique keys, fallbacks, overlays, best overlap, lower bound, version difference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def violations(df: DataFrame, bad: Column, message: str) -> DataFrame:
    """df, failing at run time with the message where bad holds or is null.

    The check counts as random to the planner, which moves no later filter ahead of it: a bad row fails the query also where
    a filter would drop it."""
    good = F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.monotonically_increasing_id() >= 0)
    return df.withColumn("_ok", good).filter("_ok").drop("_ok")


def assert_unique(df: DataFrame, keys: list) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return violations(df.withColumn("_n", n), F.col("_n") > 1, "a key occurs twice").drop("_n")


def checked_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join in which each left key must have a right row."""
    marked = left.join(right.withColumn("_found", F.lit(True)), key, "left")
    return violations(marked, F.col("_found").isNull(), "an id has no row").drop("_found")


def aligned(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Full outer join of two tables that must have the same ids."""
    both = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), key, "full")
    return violations(both, F.col("_a").isNull() | F.col("_b").isNull(), "the ids differ").drop("_a", "_b")


def ordered_lookup(ids: DataFrame, rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    return checked_join(ids, rows, key).orderBy(ordinal)


def unique_by(candidates: DataFrame, keys: list, value: str, name: str) -> DataFrame:
    """(keys, name): value of the keys that have one row only."""
    return candidates.groupBy(*keys).agg(F.min(value).alias(name), F.count(F.lit(1)).alias("_n")).filter("_n = 1").drop("_n")


def fallback_ladder(rows: DataFrame, rungs: list[tuple[str, DataFrame, list]], value: str) -> DataFrame:
    """rows with value from the first rung (name, table of keys and value, keys) that has it, and the rung's name as `rule`."""
    out, got, rule = rows, [], []
    for i, (name, table, keys) in enumerate(rungs):
        out = out.join(table.select(*keys, F.col(value).alias(f"_v{i}")), keys, "left")
        got.append(F.col(f"_v{i}"))
        rule.append(F.when(F.col(f"_v{i}").isNotNull(), name))
    return out.select(*rows.columns, F.coalesce(*got).alias(value), F.coalesce(*rule, F.lit("none")).alias("rule"))


def overlay(tables: list[DataFrame], key: str) -> DataFrame:
    """Union in which the last table with a key wins; `versions` counts the tables that have it."""
    ranked = [t.select(key, F.struct(F.lit(i).alias("_rank"), F.struct(*[c for c in t.columns if c != key]).alias("row")).alias("v")) for i, t in enumerate(tables)]
    out = ranked[0]
    for t in ranked[1:]:
        out = out.unionByName(t)
    best = out.groupBy(key).agg(F.max_by("v", F.col("v._rank")).alias("v"), F.count(F.lit(1)).alias("versions"))
    return best.select(key, "v.row.*", "versions")


def first_writer(df: DataFrame, key: str, value: str, rank: str) -> DataFrame:
    return df.groupBy(key).agg(F.min_by(value, rank).alias(value))


def conflicts(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.count_distinct(value).alias("n_values")).filter("n_values > 1")


def best_overlap(left: DataFrame, right: DataFrame, group_l: str, group_r: str, item: str, least_share: float) -> DataFrame:
    """For each left group the right group with most items in common (ties: smaller name), if the share is high enough.

    Both tables hold distinct (group, item) rows; the join meets on items, never on pairs of groups."""
    sizes = left.groupBy(group_l).agg(F.count(F.lit(1)).alias("n_items"))
    common = left.join(right, item).groupBy(group_l, group_r).agg(F.count(F.lit(1)).alias("n_common"))
    # The least of (-count, group) is the most frequent group with the smallest name.
    best = common.groupBy(group_l).agg(F.min(F.struct((-F.col("n_common")).alias("less"), F.col(group_r))).alias("m"))
    best = best.select(group_l, F.col(f"m.{group_r}").alias(group_r), (-F.col("m.less")).alias("n_common"))
    return best.join(sizes, group_l).filter(F.col("n_common") >= F.col("n_items") * least_share).select(group_l, group_r, "n_common", "n_items")


def lower_bound(points: DataFrame, starts: DataFrame, scope: str, at: str, payload: list[str]) -> DataFrame:
    """Each point with the payload of the last start at or before it in its scope: one sort of both, no range join."""
    row = F.struct(F.col(at).alias("_s"), *payload)
    both = points.withColumn("_kind", F.lit(1)).withColumn("_row", F.lit(None).cast(starts.select(row.alias("r")).schema["r"].dataType)).unionByName(
        starts.select(scope, at, F.lit(0).alias("_kind"), row.alias("_row")), allowMissingColumns=True
    )
    w = Window.partitionBy(scope).orderBy(at, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_last", F.last("_row", True).over(w)).filter("_kind = 1")
    return out.select(*points.columns, *[F.col(f"_last.{p}").alias(p) for p in payload])


def version_diff(old: DataFrame, new: DataFrame, keys: list, value: str) -> DataFrame:
    """keys, state (both, old, new), change of value."""
    a, b = old.select(*keys, F.col(value).alias("_o")), new.select(*keys, F.col(value).alias("_n"))
    both = a.join(b, keys, "full")
    state = F.when(F.col("_n").isNull(), "old").when(F.col("_o").isNull(), "new").otherwise("both")
    return both.select(*keys, state.alias("state"), (F.col("_n") - F.col("_o")).alias("change"))


def resume(rows: DataFrame, done: DataFrame, key: str, healthy: Column) -> DataFrame:
    """Rows that have no healthy result yet."""
    return rows.join(done.filter(healthy).select(key), key, "left_anti")


def label_merge(texts: DataFrame, details: DataFrame, key: str, fields: list[str], unknown: str) -> DataFrame:
    """Details that have a text: key, project (the key up to its first slash), text, fields (null is empty), model (that of the
    details, else of the text, else `unknown`; empty counts as missing)."""
    t = texts.select(key, F.coalesce("text", F.lit("")).alias("text"), F.nullif("model", F.lit("")).alias("_m"))
    out = details.join(t, key)
    model = F.coalesce(F.nullif(F.col("model"), F.lit("")), F.col("_m"), F.lit(unknown))
    return out.select(key, F.substring_index(key, "/", 1).alias("project"), "text", *[F.coalesce(f, F.lit("")).alias(f) for f in fields], model.alias("model"))


def for_judging(references: DataFrame, sources: DataFrame, predictions: DataFrame, id_: str, key: str, strict: bool) -> DataFrame:
    """Predictions with their reference (by id) and source (by key). strict: a missing one fails the query; else the row is left out."""
    if strict:
        return checked_join(checked_join(predictions, references, id_), sources, key)
    return predictions.join(references, id_).join(sources, key)


def refresh(rows: DataFrame, news: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with the columns of news; each key of either side must be on the other."""
    both = aligned(rows.drop(*columns), news.select(key, *columns), key)
    return both.select(*rows.columns)


def is_subset(small: DataFrame, large: DataFrame, key: str) -> DataFrame:
    """One row: n (distinct keys of small), n_missing (of these not in large), holds."""
    keys = small.select(key).distinct().join(large.select(key).distinct().withColumn("_in", F.lit(True)), key, "left")
    return keys.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_in").isNull()).alias("n_missing")).withColumn("holds", F.col("n_missing") == 0)


def same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: n_both, n_left, n_right (keys of one side only), same."""
    both = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full")
    out = both.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_both"), F.count_if(F.col("_b").isNull()).alias("n_left"), F.count_if(F.col("_a").isNull()).alias("n_right"))
    return out.withColumn("same", (F.col("n_left") == 0) & (F.col("n_right") == 0))
