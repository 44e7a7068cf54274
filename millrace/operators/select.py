"""Row selection: first of a key, caps, balanced and stratified samples, variants, length buckets.

Random picks order by SHA-256 of a seed and the key, so they do not depend on partitions or row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list, order: list) -> DataFrame:
    """One row a key: the first by order (unlike dropDuplicates, always the same one)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def cap_per_group(df: DataFrame, groups: list, n: int | Column, order: list) -> DataFrame:
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def round_robin(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """One row of each group in turn until n: by rank in the group, then by group. Rows beyond rank n never leave their task."""
    w = Window.partitionBy(group).orderBy(*order)
    ranked = df.withColumn("round", F.row_number().over(w)).filter(F.col("round") <= n)
    return ranked.orderBy("round", group, *order).limit(n)


def largest_remainder(sizes: DataFrame, group: str, count: str, n: int) -> DataFrame:
    """(group, quota): n shared in proportion to count, whole parts first, then by largest remainder (ties by group).

    sizes has a row a group; its windows see group totals only."""
    total = F.sum(count).over(Window.partitionBy(F.lit(0)))
    whole = F.floor(F.col(count) * n / total)
    rest = F.pmod(F.col(count) * n, total)
    left = F.lit(n) - F.sum(whole).over(Window.partitionBy(F.lit(0)))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(rest), group))
    return sizes.select(group, (whole + (place <= left).cast("long")).cast("long").alias("quota"))


def stratified(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_c"))
    quota = largest_remainder(sizes, group, "_c", n)
    w = Window.partitionBy(group).orderBy(*order)
    ranked = df.withColumn("_n", F.row_number().over(w))
    return ranked.join(quota, group).filter("_n <= quota").drop("_n", "quota")


def weighted_variants(df: DataFrame, unit: list, project: str, weight: Column, uniform: Column, target: int, cap: int) -> DataFrame:
    """One variant of each unit by weighted draw, then at most one more, until target rows; second variants stop at the
    project's cap, first ones may exceed it. uniform is a share in [0, 1) that depends on seed and row only."""
    draw = -F.log(F.lit(1.0) - uniform) / weight
    ranked = df.withColumn("_draw", draw).withColumn("variant", F.row_number().over(Window.partitionBy(*unit).orderBy("_draw"))).filter("variant <= 2")
    by_project = Window.partitionBy(project).orderBy("variant", "_draw")
    ranked = ranked.withColumn("_place", F.row_number().over(by_project)).filter((F.col("variant") == 1) | (F.col("_place") <= cap))
    return ranked.orderBy("variant", "_draw").limit(target).drop("_draw", "_place")


def length_buckets(df: DataFrame, order: Column, length: Column, size: int = 800) -> DataFrame:
    """position and bucket of each row: seeded order cut into buckets of size, each by falling length.

    Ranks come from counts of hash ranges, so that no task orders all rows."""
    keyed = df.withColumn("_k", order).withColumn("_p", F.substring("_k", 1, 2))
    parts = keyed.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    ahead = parts.select("_p", (F.sum("_c").over(Window.partitionBy(F.lit(0)).orderBy("_p")) - F.col("_c")).alias("_a"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("_k")) - 1
    placed = keyed.withColumn("_r", rank).join(F.broadcast(ahead), "_p").withColumn("_r", F.col("_r") + F.col("_a"))
    placed = placed.withColumn("bucket", F.floor(F.col("_r") / size).cast("long"))
    within = F.row_number().over(Window.partitionBy("bucket").orderBy(length.desc(), "_r"))
    return placed.withColumn("position", (F.col("bucket") * size + within).cast("long")).drop("_k", "_p", "_a", "_r")
