"""Quantiles, agreement, and bootstrap intervals with hashed draws."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.scratch import cut


def order_statistics(df: DataFrame, group: str, value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(group, n, names...): values at given ranks (from 1, as functions of the number n of values) of each group's sorted values.

    Nulls do not count. Equal values are counted first; the counts are dealt by ranges of the value and a prefix sum over the
    ranges places them, so no task sorts a whole group, whatever its size or its most frequent value."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_c"))
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(counts.repartitionByRange(parts, value, group).withColumn("_p", F.spark_partition_id()), "ranks")
    sums = dealt.groupBy(group, "_p").agg(F.sum("_c").alias("_s"))
    w = Window.partitionBy(group)
    sums = sums.select(F.col(group).alias("_g"), F.col("_p").alias("_q"), (F.sum("_s").over(w.orderBy("_p")) - F.col("_s")).alias("_before"), F.sum("_s").over(w).alias("n"))
    wanted = F.array(*[F.struct(F.lit(name).alias("k"), rank(F.col("n")).cast("long").alias("r")) for name, rank in ranks.items()])
    placed = dealt.join(sums, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_q")))
    high = F.col("_before") + F.sum("_c").over(Window.partitionBy(group, "_p").orderBy(value))
    hits = placed.withColumn("_hi", high).select(group, "n", value, F.explode(F.filter(wanted, lambda x: (x["r"] > F.col("_hi") - F.col("_c")) & (x["r"] <= F.col("_hi")))).alias("x"))
    return hits.groupBy(group, "n").agg(*[F.max(F.when(F.col("x.k") == name, F.col(value))).alias(name) for name in ranks])


def nearest_rank(p: int) -> Callable[[Column], Column]:
    """Rank ceil(n p / 100)."""
    return lambda n: F.greatest(F.ceil(n * p / 100), F.lit(1))


def floor_rank(q: float) -> Callable[[Column], Column]:
    """The place int(n q), from 0, at most the last."""
    return lambda n: F.least(n, F.floor(n * q) + 1)


def medians(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, median): the mean of the two middle values."""
    two = order_statistics(df, group, value, {"_a": lambda n: F.floor((n + 1) / 2), "_b": lambda n: F.floor(n / 2) + 1})
    return two.select(group, "n", ((F.col("_a") + F.col("_b")) / 2).alias("median"))


def mode_first_seen(df: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """(key, value, n): each key's most frequent value; ties go to the one seen first."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(seq).alias("_s"))
    best = F.min(F.struct((-F.col("n")).alias("less"), "_s", value)).alias("m")
    return counts.groupBy(key).agg(best).select(key, f"m.{value}", (-F.col("m.less")).alias("n"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, n_agree, po, pe, kappa (null for no rows or pe = 1) of two raters' columns."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("c"))
    n = cells.agg(F.sum("c").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("c")).otherwise(0)).alias("n_agree"))
    left, right = (cells.groupBy(F.col(x).alias("v")).agg(F.sum("c").alias(f"n_{x}")) for x in (a, b))
    product = left.join(right, "v").agg(F.coalesce(F.sum(F.col(f"n_{a}") * F.col(f"n_{b}")), F.lit(0)).alias("s"))
    out = n.withColumn("_k", F.lit(1)).join(product.withColumn("_k", F.lit(1)), "_k").drop("_k")
    po, pe = F.col("n_agree") / F.col("n"), F.col("s") / (F.col("n") * F.col("n"))
    return out.select("n", "n_agree", po.alias("po"), pe.alias("pe"), F.when((F.col("n") > 0) & (F.abs(1 - pe) > 1e-12), (po - pe) / (1 - pe)).alias("kappa"))


def draw(seed: str, n: Column, *parts: str) -> Column:
    """A number in [0, n) that depends on the seed and the parts only."""
    text = F.concat_ws("\0", F.lit(seed), *[F.col(p).cast("string") for p in parts])
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long"), n)


#: Draws that are made at once, and that meet one block of units.
_AT_ONCE, _A_BLOCK = 1 << 20, 1 << 24


def _draws(seed: str, repeats: int, step: int, size: int, scope: str):
    """draw() of (rep, slot) for spans of slots: a row for each block of `size` places, its draws by repeat as two bytes each."""
    heads = [f"{seed}\0{rep}\0".encode() for rep in range(repeats)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, start, n in zip(frame[scope], frame["_start"], frame["n"], strict=True):
                slots = [b"%d" % i for i in range(start, min(start + step, n))]
                places = np.frombuffer(b"".join([sha256(h + s).digest() for h in heads for s in slots]), ">u4")[::8].astype(np.int64) % n
                block, blocks = places // size, (n - 1) // size + 1
                counts = np.bincount(block * repeats + np.repeat(np.arange(repeats), len(slots)), minlength=blocks * repeats).astype(np.int32).reshape(blocks, repeats)
                offsets = (places % size).astype(np.uint16)[np.argsort(block.astype(np.uint16) if blocks < 1 << 16 else block, kind="stable")]
                ends = np.cumsum(counts.sum(axis=1))
                some = np.flatnonzero(counts.any(axis=1))
                parts = [offsets[ends[i - 1] if i else 0 : ends[i]].tobytes() for i in some]
                yield pd.DataFrame({scope: pd.Series([key] * len(some), dtype=frame[scope].dtype), "_block": some, "_counts": [counts[i].tobytes() for i in some], "_offsets": parts})

    return run


def _block_sums(repeats: int, size: int, scope: str, total: str, weight: str):
    """Sums of a block's units by repeat, and how many of the drawn ones have a value."""

    def run(key, draws: pd.DataFrame, units: pd.DataFrame) -> pd.DataFrame:
        at = (units["_place"] % size).to_numpy()
        out = {scope: [key[0]] * repeats, "rep": np.arange(repeats)}
        for name, column in (("total", total), ("weight", weight)):
            whole = pd.api.types.is_integer_dtype(units[column].dtype)
            values, known = np.zeros(size, np.int64 if whole else np.float64), np.zeros(size, np.int64)
            known[at] = units[f"_has_{name}"].to_numpy()
            values[at] = units[column].to_numpy()
            sums, seen = np.zeros(repeats, values.dtype), np.zeros(repeats, np.int64)
            for counts, offsets in zip(draws["_counts"], draws["_offsets"], strict=True):
                n, of = np.frombuffer(counts, np.int32), np.frombuffer(offsets, np.uint16)
                starts, some = (np.cumsum(n) - n)[n > 0], n > 0
                sums[some] += np.add.reduceat(values[of], starts)
                seen[some] += np.add.reduceat(known[of], starts)
            out[name], out[f"n_{name}"] = sums, seen
        return pd.DataFrame(out)

    return run


def bootstrap_means(units: DataFrame, scope: str, total: str, weight: str, repeats: int, seed: str) -> DataFrame:
    """(scope, rep, value): resampled sum(total) / sum(weight) of each scope. units has a row a unit (row or cluster); total and
    weight are whole numbers or doubles.

    The work is units times repeats, spread over all tasks: units are numbered by ranges and a prefix sum, draws are made by spans of
    slots and packed, two bytes each, for the block of units that they meet. No table of draws is held or broadcast."""
    size = max(1, min(1 << 16, _A_BLOCK // repeats))
    step = max(1, _AT_ONCE // repeats)
    parts = max(1, int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kind = lambda c: c if units.schema[c].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else None
    number = lambda c: F.col(c).cast("long" if kind(c) else "double")
    values = [F.coalesce(number(c), F.lit(0).cast("long" if kind(c) else "double")).alias(n) for c, n in ((total, "_total"), (weight, "_weight"))]
    dealt = units.filter(F.col(scope).isNotNull()).select(scope, "unit", *values, F.col(total).isNotNull().cast("long").alias("_has_total"), F.col(weight).isNotNull().cast("long").alias("_has_weight"))
    dealt = cut(dealt.repartitionByRange(parts, scope, "unit").withColumn("_p", F.spark_partition_id()), "units")
    w = Window.partitionBy(scope)
    sums = dealt.groupBy(scope, "_p").agg(F.count(F.lit(1)).alias("_c"))
    sums = cut(sums.select(scope, "_p", (F.sum("_c").over(w.orderBy("_p")) - F.col("_c")).alias("_before"), F.sum("_c").over(w).alias("n")), "ranges")
    place = F.col("_before") + F.row_number().over(Window.partitionBy(scope, "_p").orderBy("unit")) - 1
    numbered = dealt.join(sums, [scope, "_p"]).select(scope, "_total", "_weight", "_has_total", "_has_weight", place.alias("_place"))
    numbered = numbered.withColumn("_block", F.floor(F.col("_place") / size).cast("long"))
    spans = sums.select(scope, "n").distinct().select(scope, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(step).cast("long"))).alias("_start"), "n")
    of = f"`{scope}` {units.schema[scope].dataType.simpleString()}"
    draws = spans.repartition(parts).mapInPandas(_draws(seed, repeats, step, size, scope), f"{of}, _block long, _counts binary, _offsets binary")
    types = {n: "long" if kind(c) else "double" for c, n in ((total, "total"), (weight, "weight"))}
    met = draws.groupBy(scope, "_block").cogroup(numbered.groupBy(scope, "_block")).applyInPandas(
        _block_sums(repeats, size, scope, "_total", "_weight"), f"{of}, rep int, total {types['total']}, n_total long, weight {types['weight']}, n_weight long"
    )
    sum_of = lambda n: F.when(F.sum(f"n_{n}") > 0, F.sum(n))
    return met.groupBy(scope, "rep").agg((sum_of("total") / sum_of("weight")).alias("value"))


def interval(samples: DataFrame, scope: str, low: int, high: int) -> DataFrame:
    """(scope, low, high): the samples at two places (from 0) of the sorted repeats."""
    xs = F.sort_array(F.collect_list("value"))
    return samples.groupBy(scope).agg(xs[low].alias("low"), xs[high].alias("high"))


def places(repeats: int) -> tuple[int, int]:
    return int(0.025 * repeats), min(repeats - 1, int(0.975 * repeats))
