"""Mixing sources to target weights.

Documents get hash-random keys (MD5 of a seed and the id, or of the text where there is no id). Within a source the keys are range-sorted: the leading twelve
bits name one of 4,096 ranges, whose word counts are summed and accumulated over the ranges of a source, and the rest is
accumulated within each range. So no task orders a whole source, however large, and each source is cut at its exact budget;
a budget above the source's size repeats whole epochs first. The document at the cut gives its first words only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, most: int = 2) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) for each source.

    Sources in code point order, null last, have the weights in turn. They share percent % of all sizes by weight; a target
    stops at most times its source's size, the excess is shared again by weight. This is water-filling: with sources
    ordered by size / weight, all up to some place are full and the rest share what is left."""
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    named = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long"))
    full = (F.col("source_size") * most).cast("double")
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0))) * percent / 100
    before = Window.orderBy(full / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(full / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = total - F.coalesce(F.sum(full).over(before), F.lit(0.0))
    level = named.withColumn("left", left).withColumn("shared", F.sum("weight").over(after)).withColumn("is_full", full * F.col("shared") <= F.col("left") * F.col("weight"))
    # The first source that isn't full sets the level of all that follow.
    first = F.min(F.when(~F.col("is_full"), F.struct((full / F.col("weight")).alias("r"), F.col("source").isNull().alias("z"), F.coalesce("source", F.lit("")).alias("s"), "left", "shared"))).over(Window.partitionBy(F.lit(0)))
    level = level.withColumn("first", first)
    reached = F.struct((full / F.col("weight")).alias("r"), F.col("source").isNull().alias("z"), F.coalesce("source", F.lit("")).alias("s"))
    rest = F.col("first.left") * F.col("weight") / F.col("first.shared")
    target = F.when(F.col("first").isNull() | (reached < F.struct("first.r", "first.z", "first.s")), full).otherwise(rest)
    return level.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, percent: int = 150, most: int = 2, seed: str = "mix") -> DataFrame:
    """Per row: doc_id, size (words; null text 0), source, source_size, target (of its source), taken (words, repeats counted).

    taken never exceeds most times the size, and a source's taken words are its target rounded down. Null sources are one
    source of their own; null ids share one key; ties of the key go by id, size and text. Repeated rows count each (equal rows
    differ in their place only). Sources without words take nothing. Empty tables give no rows. Reruns agree."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    own = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    key = F.md5(F.concat_ws(":", F.lit(seed), own))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key"), F.xxhash64(text_col).alias("tie"))
    from_key = F.substring("key", 1, 3).alias("part")
    # Written once: the texts are read and their words counted in one scan, and all that follows works on these short rows.
    rows = cut(rows.withColumn("part", from_key), "mix-rows")
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("n"))
    targets = source_targets(parts.groupBy("source").agg(F.sum("n").alias("source_size")), weights, percent, most)
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    plan = parts.join(targets, parts["source"].eqNullSafe(targets["source"])).select(parts["source"].alias("s"), F.col("part").alias("p"), "ahead", "source_size", "target")
    within = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("done", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(plan, rows["source"].eqNullSafe(plan["s"]) & (rows["part"] == plan["p"]))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    over = budget - epochs * F.col("source_size") - F.col("ahead") - F.col("done")
    taken = (epochs * F.col("size") + F.least(F.greatest(over, F.lit(0)), F.col("size"))).cast("long")
    return rows.select("doc_id", "size", "source", "source_size", "target", taken.alias("taken"))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS k, text,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS BIGINT) AS weight,
         (SELECT sum(source_size) * 150 / 100 FROM s) AS total
  FROM s
), r AS (
  SELECT *, row_number() OVER (ORDER BY source_size * 2.0 / weight, source NULLS LAST) AS n FROM w
), l AS (
  SELECT *, total - coalesce(sum(source_size * 2.0) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shared
  FROM r
), f AS (SELECT n, rest, shared FROM l WHERE source_size * 2.0 * shared > rest * weight ORDER BY n LIMIT 1),
t AS (
  SELECT l.source, l.source_size,
         CAST(CASE WHEN f.n IS NULL OR l.n < f.n THEN l.source_size * 2.0 ELSE CAST(f.rest AS DOUBLE) * l.weight / f.shared END AS DOUBLE) AS target
  FROM l LEFT JOIN f ON true
), p AS (
  SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM d
)
SELECT p.doc_id, p.size, t.source_size, t.target,
       CAST(CASE WHEN t.source_size = 0 THEN 0 ELSE floor(floor(t.target) / t.source_size) * p.size
         + least(greatest(floor(t.target) - floor(floor(t.target) / t.source_size) * t.source_size - p.done, 0), p.size) END AS BIGINT) AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""
