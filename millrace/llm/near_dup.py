"""MinHash near-duplicate detection with sequential Bayesian verification.

1. Every text becomes a set of word shingles (64-bit hashes). Texts with equal sets form one node, so that copies cost
   one row each from here on.
2. 32 bands of 4 min-hashes propose candidates; a pair with similarity 0.8 shares no band with probability
   (1 - 0.8^4)^32 = 5e-8.
3. Candidates compare signature batches of 16 other min-hashes. After each batch a pair is pruned if the posterior
   probability (uniform prior) that its similarity reaches the threshold is below `miss`.
4. Survivors are verified exactly on full sets; verified links make components.

Each bucket first tests one link a member (to the bucket's pivot). Only buckets whose members are still in different
components are compared further, in blocks of bounded size; a component with many members there has blocks of its own,
which never meet each other. Such a task verifies what the batches leave, best pairs first, and skips pairs that its links
already join, so it returns fewer links than it has members. A bucket with a third of all rows makes links in proportion
to its size, and no link that would join two components is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import LOWER, SPACE, bitmap_bits, bitmap_of, bound_batches, chunks, cut, in_bitmap, mix, powers, remove, spans, trimmed, windows, word_hashes

BANDS, ROWS, BATCH, BATCHES = 32, 4, 16, 4
HASHES = BANDS * ROWS + BATCH * BATCHES
#: Members and shingles of a block, about; a set with more shingles is a block of its own.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20

_rng = np.random.Generator(np.random.PCG64(7))
_A = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)[:, None]


def least_matches(percent: int, miss: float) -> list[int]:
    """For 16, 32, ... compared hashes: the least number of matches that is not pruned."""
    out, t = [], percent / 100
    for batch in range(1, BATCHES + 1):
        n = batch * BATCH
        below = [math.comb(n + 1, j) * t**j * (1 - t) ** (n + 1 - j) for j in range(n + 2)]
        out.append(next(m for m in range(n + 1) if sum(below[: m + 1]) >= miss))
    return out


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each row; with fewer than k words the whole sequence is one shingle."""
    for lo, hi, data, offsets in chunks(texts):
        data = LOWER[data]
        starts, ends, first = spans(data, offsets, SPACE)
        h = word_hashes(data, starts, ends)
        w = windows(h, k)
        for row in range(lo, hi):
            a, b = int(first[row - lo]), int(first[row - lo + 1])
            yield row, np.unique(w[a : b - k + 1]) if b - a >= k else windows(h[a:b], b - a) if b > a else h[:0]


def min_hashes(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        part = _A * x[None, i : i + 2048]
        part += _B
        np.minimum(out, part.min(axis=1), out=out)
    return out


def _node(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _digests(k: int):
    powers(1)
    fields = [("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.binary()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())]
    weights = np.array([pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) for j in range(ROWS)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node, bands, sig = [], [], [], []
            last, made = b"", None
            for _, s in shingle_sets(batch.column(1), k):
                n.append(len(s))
                if not len(s):
                    node.append(None), bands.append(None), sig.append(None)
                    continue
                node.append(_node(s))
                if node[-1] != last:
                    m = min_hashes(s)
                    keys = (m[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)
                    made = (mix(keys + np.arange(BANDS, dtype=np.uint64) * weights[1]).view(np.int64), m[BANDS * ROWS :].astype(np.uint16).tobytes())
                    last = node[-1]
                bands.append(made[0]), sig.append(made[1])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(v, t) for v, (_, t) in zip((n, node, bands, sig), fields[1:], strict=True))], names=[f for f, _ in fields])

    return trimmed(run)


def _sets(k: int, wanted: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, node, sets = batch.column(0).to_pylist(), [], []
            for row, s in shingle_sets(batch.column(1), k):
                if len(s) and in_bitmap(wanted, np.array([wanted_key(ids[row], d := _node(s))], np.int64))[0]:
                    node.append(d), sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(sets, pa.binary())], names=["digest", "s"])

    return trimmed(run)


def wanted_key(doc_id: int | None, node: bytes) -> int:
    """The first eight bytes of the node, turned by the document's id, so that only the node's first document is chosen."""
    return int(np.uint64(int.from_bytes(node[:8], "big") ^ ((doc_id or 0) & (1 << 64) - 1)).astype(np.int64))


def _wanted_key_sql() -> F.Column:
    high = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")
    return high.bitwiseXOR(F.col("node"))


def _pruned(percent: int, miss: float):
    """Pairs (a, b, sa, sb) of signatures: those that no batch prunes, with their matches."""
    least = least_matches(percent, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BATCH * BATCHES) for c in (2, 3))
            alive, got = np.arange(len(sa)), np.zeros(len(sa), np.int32)
            for i, need in enumerate(least):
                at = slice(i * BATCH, (i + 1) * BATCH)
                got[alive] += (sa[alive, at] == sb[alive, at]).sum(axis=1, dtype=np.int32)
                alive = alive[got[alive] >= need]
            idx = pa.array(alive)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(idx), batch.column(1).take(idx), pa.array(got[alive], pa.int32())], names=["a", "b", "m"])

    return trimmed(run)


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    return trimmed(run)


def _links(left: list[tuple], right: list[tuple], same: bool, percent: int, least: list[int]) -> list[tuple[int, int]]:
    """Links between members (node, label, sig, set) of two blocks (or of one) that join different components."""
    sl, sr = (np.frombuffer(b"".join(m[2] for m in x), np.uint16).reshape(-1, BATCH * BATCHES) for x in (left, right))
    cl, cr = (np.array([m[1] for m in x]) for x in (left, right))
    i, j = np.nonzero(np.triu(cl[:, None] != cr[None, :], 1) if same else cl[:, None] != cr[None, :])
    nl, nr = (np.array([len(m[3]) for m in x]) for x in (left, right))
    fits = 100 * np.minimum(nl[i], nr[j]) >= percent * np.maximum(nl[i], nr[j])
    i, j = i[fits], j[fits]
    got = np.zeros(len(i), np.int32)
    for t, need in enumerate(least):
        at = slice(t * BATCH, (t + 1) * BATCH)
        got += (sl[i, at] == sr[j, at]).sum(axis=1, dtype=np.int32)
        i, j, got = (x[got >= need] for x in (i, j, got))
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    sets, out = {}, []
    for k in np.argsort(-got, kind="stable"):
        a, b = left[i[k]], right[j[k]]
        if (x := find(a[1])) == (y := find(b[1])):
            continue
        for m in (a, b):
            if m[0] not in sets:
                sets[m[0]] = np.frombuffer(m[3], np.uint64)
        both = len(np.intersect1d(sets[a[0]], sets[b[0]], assume_unique=True))
        if 100 * both >= percent * (len(sets[a[0]]) + len(sets[b[0]]) - both):
            parent[x] = y
            out.append((a[0], b[0]))
    return out


def _block_links(percent: int, miss: float):
    """Over rows (key, ib, jb, side, node, label, sig, s) sorted by the first three; a group has two blocks' members at most."""
    least = least_matches(percent, miss)

    def flush(group: list[tuple]) -> list[tuple[int, int]]:
        left, right = [m[1:] for m in group if m[0] != 1], [m[1:] for m in group if m[0] != 0]
        return _links(left, right, any(m[0] == 2 for m in group), percent, least) if left and right else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last, out = [], None, []
        for batch in batches:
            keys = zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True)
            for key, *member in zip(keys, *(c.to_pylist() for c in batch.columns[3:]), strict=True):
                if key != last:
                    out += flush(group)
                    group, last = [], key
                group.append(tuple(member))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])
                out = []
        if out := flush(group):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])

    return trimmed(run)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for all nodes of edges (a, b): label is the least node of the component. Least-label propagation with
    pointer jumping; each round is cut, so lineage stays short; about log2(diameter) rounds."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"), F.lit(True).alias("changed")), "labels")
    while labels.filter("changed").limit(1).count():
        last, old = labels, labels.select("node", "label")
        near = both.join(old.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        step = near.join(old.withColumnRenamed("node", "a"), "a").select(F.col("a").alias("node"), F.col("label").alias("was"), F.least("m", "label").alias("m"))
        jump = step.join(old.select(F.col("node").alias("m"), F.col("label").alias("far")), "m")
        labels = cut(jump.select("node", F.least("m", "far").alias("label"), (F.least("m", "far") != F.col("was")).alias("changed")), "labels")
        remove(last)
    remove(both)
    return labels.select("node", "label")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, miss: float = 1e-5) -> DataFrame:
    """Per input row: doc_id, n_shingles, component_id (smallest doc_id of the component), kept (doc_id = component_id).

    Words are lower-cased (A-Z) runs without white space; links hold where 100 * intersection >= percent * union.
    Null texts and texts without words have no shingles and link with nothing; their component is their own doc_id.
    Repeated rows are copies like any other; rows that repeat a doc_id with another text are one document, which has the
    links of all its texts. Rows with a null doc_id take no part: their component_id is null and they are kept. Other
    columns are ignored. An empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = cut(src.mapInArrow(_digests(k), "doc_id long, n long, node binary, bands array<long>, sig binary"), "digests")
    # Equal sets are one node, called by its smallest doc_id.
    named = rows.filter("node is not null and doc_id is not null").select("node", "doc_id")
    firsts = cut(named.groupBy("node").agg(F.min("doc_id").alias("first")), "firsts")
    own = rows.select("node", "doc_id", "n", "bands", "sig").join(firsts.select("node", F.col("first").alias("doc_id")), ["node", "doc_id"], "left_semi")
    nodes = cut(own.dropDuplicates(["node", "doc_id"]), "nodes")
    member = nodes.select(F.col("doc_id").alias("node"), F.explode("bands").alias("key"))
    pivots = member.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).filter("pivot != last").select("key", "pivot")
    buckets = cut(member.join(pivots, "key").distinct(), "buckets")
    wanted = buckets.select("node").distinct()
    few = nodes.select(F.col("doc_id").alias("node"), F.col("node").alias("digest"), "n", "sig").join(wanted, "node", "left_semi")
    few = cut(few, "few")
    sigs = few.select("node", "sig")
    bitmap = bitmap_of(few.select(_wanted_key_sql().alias("h")), "h", bitmap_bits(few.count()))
    found = src.mapInArrow(_sets(k, bitmap), "digest binary, s binary")
    sets = cut(found.join(few.select("node", "digest"), "digest").dropDuplicates(["digest"]).select("node", "s"), "sets")

    def with_both(pairs: DataFrame, side: DataFrame, col: str) -> DataFrame:
        one = pairs.join(side.select(F.col("node").alias("a"), F.col(col).alias("x")), "a")
        return one.join(side.select(F.col("node").alias("b"), F.col(col).alias("y")), "b").select("a", "b", "x", "y")

    star = buckets.filter("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    alive = with_both(star, sigs, "sig").mapInArrow(_pruned(percent, miss), "a long, b long, m int")
    best = alive.groupBy("a").agg(F.max(F.struct("m", "b")).alias("t")).select("a", F.col("t.b").alias("b"))
    links = cut(with_both(best, sets, "s").mapInArrow(_verified(percent), "a long, b long, ok boolean").filter("ok").select("a", "b"), "links")
    labels = components(links)

    named = buckets.select("key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    mixed = sizes.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("key")
    # A node may have sets of several sizes, if texts share its id; each of them is in the class of its size.
    level = F.floor(F.log("n") / math.log(100 / percent) + 1e-9).cast("long").alias("level")
    levels = few.select("node", "n", level).groupBy("node", "level").agg(F.max("n").alias("n"))
    named = named.join(sizes.join(mixed, "key"), ["key", "label"]).join(levels, "node")
    own = F.when(F.col("c") >= BLOCK, F.col("label"))
    named = named.select("key", "node", "label", "n", "level", own.alias("own"))
    groups = named.groupBy("key", "level", "own").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    groups = groups.select(F.col("key").alias("k"), F.col("level").alias("l"), F.col("own").alias("o"), "blocks")
    named = named.join(groups, (F.col("key") == F.col("k")) & (F.col("level") == F.col("l")) & F.col("own").eqNullSafe(F.col("o")))
    block = F.xxhash64("level", F.coalesce("own", F.lit(0)), F.pmod(F.xxhash64("node"), F.col("blocks")))
    named = cut(named.select("key", "node", "label", "level", block.alias("block")), "blocks")
    # Many buckets hold the same members: one of them stands for all.
    info = named.groupBy("key", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("same"), F.count(F.lit(1)).alias("n"), F.first("level").alias("level"))
    left, right = (info.select("key", *[F.col(c).alias(f"{s}{c}") for c in ("block", "lo", "hi", "same", "n", "level")]) for s in "ij")
    tasks = left.join(right, "key").filter("iblock <= jblock and (ilo != jhi or ihi != jlo) and abs(ilevel - jlevel) <= 1")
    tasks = tasks.groupBy("isame", "jsame", "in", "jn").agg(F.min(F.struct("key", F.col("iblock").alias("ib"), F.col("jblock").alias("jb"))).alias("t")).select("t.*")
    sides = F.explode(F.when(F.col("ib") == F.col("jb"), F.array(F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1))))
    sided = tasks.withColumn("side", sides).withColumn("block", F.when(F.col("side") == 1, F.col("jb")).otherwise(F.col("ib")))
    work = named.join(sided, ["key", "block"]).select("key", "ib", "jb", "side", "node", "label")
    work = work.join(sigs, "node").join(sets, "node").select("key", "ib", "jb", "side", "node", "label", "sig", "s")
    work = work.repartition("key", "ib", "jb").sortWithinPartitions("key", "ib", "jb")
    more = cut(work.mapInArrow(_block_links(percent, miss), "a long, b long"), "more-links")
    labels = components(links.union(more)) if more.limit(1).count() else labels

    names = cut(firsts.join(labels.withColumnRenamed("node", "first"), "first", "left").select("node", F.coalesce("label", "first").alias("component_id")), "names")
    remove(firsts, nodes, buckets, few, sets, links, named, more)
    # Rows without a node stay out of the join, where all of them would be one key.
    lone = rows.filter("node is null").select("doc_id", F.col("n").alias("n_shingles"), "node", F.lit(None).cast("long").alias("component_id"))
    out = rows.filter("node is not null").select("doc_id", F.col("n").alias("n_shingles"), "node").join(names, "node", "left").select(lone.columns).union(lone)
    component = F.when(F.col("node").isNull() | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op1_near_dup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4)


#: All pairs of different sets that share a shingle, and the closure of their links.
OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END AS s FROM w),
g AS (SELECT s, min(doc_id) AS node, CAST(len(s) AS BIGINT) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM t WHERE len(s) > 0) x GROUP BY s),
u AS MATERIALIZED (SELECT node, n, unnest(s) AS h FROM g),
p AS MATERIALIZED (SELECT a.node AS a, b.node AS b FROM u a JOIN u b ON a.h = b.h AND a.node < b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r AS (SELECT node AS a, node AS b FROM g UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), c AS (SELECT a AS node, min(b) AS component FROM r GROUP BY a)
SELECT t.doc_id, CAST(len(t.s) AS BIGINT) AS n_shingles, coalesce(c.component, t.doc_id) AS component_id, coalesce(c.component, t.doc_id) = t.doc_id AS kept FROM t LEFT JOIN g ON g.s = list_sort(t.s) LEFT JOIN c ON c.node = g.node
"""
