"""Approximate nearest neighbours: a forest of sorted hash strings with synchronous ascent.

A hash string has 64 bits: a cross-polytope digit (which of the randomly turned axes is nearest, and on which side), then the
signs of random projections. The index is cut into blocks of bounded size; in a block every tree sorts the strings of all
vectors, once. A query's longest matching prefixes in all trees are shortened together, first to the digit's end and then to nothing,
until the ranges of all trees add up to `share` of the block (in the last step trees join in turn). The union of the ranges is scored
exactly in double precision. Vectors are extended by one component, so that the angle orders them by inner product.

How much has to be read for a wanted recall is a matter of the data, so `share` is fitted: on a bounded sample of the index,
against brute force, the least of SHARES that reaches `recall`. Every vector is indexed, whatever the sample.

Equal vectors are one index entry with their smallest ids. Each query goes to each index block once, in batches, so the work is
queries times rows times the part of a block that is read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import cut, trimmed

TREES, BITS, MOST_AXES = 96, 64, 64
#: The forest's ranges together, as a share of the block; in the last case the whole block is read.
SHARES = (0.005, 0.01, 0.02, 0.03, 0.05, 0.07, 0.1, 0.13, 0.17, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.6, 0.8, 1.0, math.inf)
SAMPLE, SAMPLE_CELLS, SAMPLE_QUERIES = 16384, 1 << 21, 128
_BATCH = 256


class PrefixForest:
    def __init__(self, x: np.ndarray, trees: int = TREES, seed: int = 5):
        """x: float64, a row for each vector."""
        self.x, norm = x, np.linalg.norm(x, axis=1)
        longer = np.concatenate([x, np.sqrt(np.maximum(norm.max() ** 2 - norm**2, 0))[:, None]], axis=1).astype(np.float32)
        rng = np.random.Generator(np.random.PCG64(seed))
        axes = min(longer.shape[1], MOST_AXES)
        self.digit = max(1, (2 * axes - 1).bit_length())
        self.planes = [(rng.standard_normal((longer.shape[1], axes)).astype(np.float32), rng.standard_normal((longer.shape[1], BITS - self.digit)).astype(np.float32)) for _ in range(trees)]
        self.order, self.sorted = [], []
        for p in self.planes:
            code = self.strings(longer, *p)
            order = np.argsort(code, kind="stable")
            self.order.append(order.astype(np.int32)), self.sorted.append(code[order])

    def strings(self, v: np.ndarray, axes: np.ndarray, signs: np.ndarray) -> np.ndarray:
        turned = v @ axes
        at = np.abs(turned).argmax(axis=1)
        digit = (2 * at + (turned[np.arange(len(v)), at] > 0)).astype(np.uint64)
        low = np.zeros((len(v), 64), bool)
        low[:, self.digit :] = (v @ signs) > 0
        return digit << np.uint64(64 - self.digit) | np.packbits(low, axis=1).view(">u8").ravel().astype(np.uint64)

    def ranges(self, codes: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each tree and query, the range of the sorted strings that share the first `depth` bits."""
        if not depth:
            zero = np.zeros((len(codes), len(codes[0])), np.int64)
            return zero, zero + len(self.x)
        rest = np.uint64((1 << 64 - depth) - 1)
        lo = np.stack([np.searchsorted(s, c & ~rest) for c, s in zip(codes, self.sorted, strict=True)])
        return lo, np.stack([np.searchsorted(s, c | rest, "right") for c, s in zip(codes, self.sorted, strict=True)])

    def candidates(self, q: np.ndarray, least: int, share: float) -> Iterator[np.ndarray]:
        """For each query in turn, the positions of its candidates; `least` is the least number of all ranges together."""
        flat = np.concatenate([q, np.zeros((len(q), 1))], axis=1).astype(np.float32)
        codes = [self.strings(flat, *p) for p in self.planes]
        need = max(least, share * len(self.x))
        # The ascent stops at the deepest level with enough; it is found from the other end, as ranges shrink with depth.
        level, deep, deeper = 0, self.ranges(codes, 0), self.ranges(codes, self.digit)
        stop = np.zeros((4, len(self.planes), len(q)), np.int64)
        open_ = np.ones(len(q), bool)
        while True:
            last = (deeper[1] - deeper[0]).sum(axis=0) < need
            now = open_ & last
            for i, part in enumerate((*deep, *deeper)):
                stop[i][:, now] = part[:, now]
            open_ &= ~last
            if not open_.any():
                break
            level = self.digit if not level else level + 1
            deep = deeper
            deeper = self.ranges(codes, level + 1) if level < BITS else tuple(np.zeros_like(x) for x in deep)
        lo, hi, inner_lo, inner_hi = stop
        for i in range(len(q)):
            more = np.cumsum((hi[:, i] - lo[:, i]) - (inner_hi[:, i] - inner_lo[:, i])) + (inner_hi[:, i] - inner_lo[:, i]).sum()
            whole = np.arange(len(more)) <= np.searchsorted(more, need)
            hit = np.zeros(len(self.x), bool)
            for order, a, b in zip(self.order, np.where(whole, lo[:, i], inner_lo[:, i]), np.where(whole, hi[:, i], inner_hi[:, i]), strict=True):
                hit[order[a:b]] = True
            yield np.flatnonzero(hit)

    def search(self, q: np.ndarray, k: int, share: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query, the k nearest candidates and those level with the last: positions and inner products."""
        for v, at in zip(q, self.candidates(q, k + 1, share), strict=True):
            score = self.x[at] @ v
            if len(at) > k:
                least = np.partition(score, len(score) - k)[len(score) - k]
                at, score = at[score >= least], score[score >= least]
            yield at, score


def measured(x: np.ndarray, forest: PrefixForest, asked: np.ndarray, k: int, share: float) -> tuple[float, float]:
    """Of the queries x[asked] among the rows of x: recall of the k nearest others against brute force, and the part of x read."""
    found = read = wanted = 0
    for i, at in zip(asked, forest.candidates(x[asked], k + 1, share), strict=True):
        score = x @ x[i]
        score[i] = -np.inf
        best = np.argpartition(-score, min(k, len(x) - 1))[:k]
        found, read, wanted = found + len(np.intersect1d(best, at)), read + len(at), wanted + len(best)
    return found / max(1, wanted), read / max(1, len(asked) * len(x))


def fitted_share(x: np.ndarray, k: int, recall: float, trees: int) -> float:
    """The least of SHARES with the wanted recall for SAMPLE_QUERIES of the rows of x among all of them. Recall grows with the share."""
    if len(x) <= k + 1:
        return math.inf
    forest, asked = PrefixForest(x, trees), np.unique(np.linspace(0, len(x) - 1, SAMPLE_QUERIES).astype(int))
    lo, hi = 0, len(SHARES) - 1
    while lo < hi:
        at = (lo + hi) // 2
        lo, hi = (lo, at) if measured(x, forest, asked, k, SHARES[at])[0] >= recall else (at + 1, hi)
    return SHARES[lo]


def _search(k: int, share: float, trees: int):
    """Over rows (ib, dim, ask, vid, v) sorted by the first three: a block's forest is made once, then its queries come in batches."""
    kinds = (pa.int64(), pa.int64(), pa.float64())

    def vectors(rows: pa.RecordBatch) -> np.ndarray:
        return rows.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows.num_rows, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, ids, forest = None, [], None, None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)], axis=1)
            edges = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1), len(keys)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                rows = batch.slice(a, b - a)
                if tuple(keys[a, :2]) != block:
                    block, parts, forest = tuple(keys[a, :2]), [], None
                if not keys[a, 2]:
                    parts.append((rows.column("vid").to_numpy(), vectors(rows)))
                    continue
                if forest is None and parts:
                    ids, x = (np.concatenate(p) for p in zip(*parts, strict=True))
                    order = np.argsort(ids)
                    ids, forest = ids[order], PrefixForest(x[order], trees)
                    parts = []
                if forest is None:
                    continue
                asked, q = rows.column("vid").to_numpy(), vectors(rows)
                for i in range(0, len(q), _BATCH):
                    out: list[list] = [[], [], []]
                    for query, (at, score) in zip(asked[i : i + _BATCH], forest.search(q[i : i + _BATCH], k, share), strict=True):
                        best = np.lexsort((ids[at], -score))[:k]
                        out[0].append(np.full(len(best), query)), out[1].append(ids[at[best]]), out[2].append(score[best])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(out, kinds, strict=True)], names=["qid", "vid", "score"])

    return trimmed(run)


def _fitted(index: DataFrame, k: int, recall: float, trees: int) -> float:
    """fitted_share() on the rows of the commonest length among the SAMPLE with the smallest hashes of the id."""
    dim = index.agg(F.max(F.size("v"))).first()[0]
    rows = min(SAMPLE, max(2000, SAMPLE_CELLS // max(1, dim or 1)))
    sample = index.select("vid", "v").orderBy(F.xxhash64("vid"), "vid").limit(rows).select("v").toArrow().column("v").combine_chunks()
    lengths = Counter(len(v) for v in sample)
    if not lengths:
        return math.inf
    common = max(lengths, key=lambda n: (lengths[n], n))
    return fitted_share(np.array([v.as_py() for v in sample if len(v) == common]), k, recall, trees)


def nearest(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, recall: float = 0.93, share: float | None = None, trees: int = TREES, index_block: int = 32768) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found for each row where is_query (a column over vec_id) holds.

    Nearness is the inner product in double precision; ties go to the smaller vec_id; a query's own id is no candidate.
    Rows with a null id, and vectors that are null, zero or hold null or non-finite components take no part; vectors of
    different lengths never meet. Of rows with the same id the smallest vector counts. Empty tables give no rows. Other columns
    are ignored. `share` is fitted to `recall` unless it is given.
    """
    v = F.col(vector_col).cast("array<double>")
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = src.filter(finite & F.exists("v", lambda c: c != 0)).groupBy("vec_id").agg(F.min("v").alias("v"))
    few = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    index = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("vid"), "v", "ids")
    index = cut(index, "vectors")
    asked = cut(rows.filter(is_query).join(index.select("v", "vid"), "v").select(F.col("vec_id").alias("query_id"), "vid"), "queries")
    ask = asked.select("vid").distinct().join(index.select("vid", "v"), "vid")
    n_index = max(1, math.ceil(index.count() / index_block))
    share = share or _fitted(index, k, recall, trees)
    own = F.pmod(F.xxhash64("vid"), F.lit(n_index)).cast("int")
    left = index.select(own.alias("ib"), F.size("v").alias("dim"), F.lit(0).alias("ask"), "vid", "v")
    right = ask.select(F.explode(F.sequence(F.lit(0), F.lit(n_index - 1))).alias("ib"), F.size("v").alias("dim"), F.lit(1).alias("ask"), "vid", "v")
    work = left.unionByName(right).repartition(n_index, "ib").sortWithinPartitions("ib", "dim", "ask")
    found = work.mapInArrow(_search(k + 1, share, trees), "qid long, vid long, score double")
    near = Window.partitionBy("qid").orderBy(F.desc("score"), "vid")
    found = found.withColumn("n", F.row_number().over(near)).filter(F.col("n") <= k + 1).drop("n")
    hits = asked.join(found, asked["vid"] == found["qid"]).select("query_id", found["vid"], "score")
    hits = hits.join(index.select("vid", "ids"), "vid").select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
