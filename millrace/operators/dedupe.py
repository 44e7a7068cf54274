"""Merging splits: duplicates within and across splits, embedded copies, and audit counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_reasons(rows: DataFrame, role: str, digest: str, pair: list, seq: str, protected: str, other: str) -> DataFrame:
    """rows with `reason`: cross (digest in the protected split), embedded (protected split's row whose pair is in the other
    split), repeat (not the first of its digest among the rest of its split), else kept. Forbidden digests and pairs
    come from all rows, before any is dropped."""
    is_protected = F.col(role) == protected
    digests = rows.filter(is_protected).select(digest).distinct().withColumn("_d", F.lit(True))
    pairs = rows.filter(F.col(role) == other).select(*pair).distinct().withColumn("_p", F.lit(True))
    out = rows.join(digests, digest, "left").join(pairs, pair, "left")
    first = F.when(~is_protected & F.col("_d").isNotNull(), "cross").when(is_protected & F.col("_p").isNotNull(), "embedded")
    out = out.withColumn("reason", first)
    place = F.row_number().over(Window.partitionBy(role, digest, F.col("reason").isNull()).orderBy(seq))
    return out.withColumn("reason", F.coalesce("reason", F.when(place > 1, "repeat"), F.lit("kept"))).drop("_d", "_p")


def split_overlap(rows: DataFrame, split: str, keys: list[str]) -> DataFrame:
    """(key, left, right, n): distinct values that two splits share, for each key column."""
    out = None
    for k in keys:
        has = rows.select(split, F.col(k).cast("string").alias("v")).distinct()
        a, b = has.select(F.col(split).alias("left"), "v"), has.select(F.col(split).alias("right"), "v")
        n = a.join(b, "v").filter("left < right").groupBy("left", "right").agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("key"), "left", "right", "n")
        out = n if out is None else out.unionByName(n)
    return out


def multi_valued(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value."""
    return rows.groupBy(key).agg(F.count_distinct(value).alias("n_values"), F.count(F.lit(1)).alias("n_rows")).filter("n_values > 1")
