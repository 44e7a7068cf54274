"""Cross-entropy difference of two word bigram models that share one vocabulary.

Events are the words of a text and its end, each after the word before it (the first after a start sign). With V the number
of distinct words of all documents, the end counted, both models are

    P(w)     = (c(w) + ADD) / (N + ADD * V)
    P(w | p) = (c(p, w) + MU * P(w)) / (c(p) + MU)

The target model counts the documents where `is_target` holds, the background model all documents. They are matched: same
order, same vocabulary, same smoothing and same mass, as the background's counts are scaled to the number of the target's
events. Each count of the corpus goes into it, and a model is not smoothed less for being larger. An event's loss is
-log P(w | p); a document's score is the mean over its events of target loss less background loss (lower: nearer to the
target). A document's own counts are left out of both models, so that a document of the target does not vouch for itself.

Counts are exact, up to keys that share a hash. Texts are cut into slices of some megabytes. A slice sends each reducer one packed block with its distinct
keys (words and pairs) and their counts, so a key, however frequent, has one entry a slice. The reducer sends the sums back in
the order of the block, and the slice's own entries, kept in one packed row, are scored with them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import LOWER, MIX, SPACE, STEP, bound_batches, chunks, mix, powers, spans, trimmed, word_hashes

START, END = np.uint64(0x51ED270B0B5C4E21), np.uint64(0x2545F4914F6CDD1D)
ADD, MU = 0.5, 2.0
SLICE = 1 << 22
#: Parts hold about so many events, whatever the size of the corpus.
LEAST_PARTS, PART_EVENTS = 8, 4_000_000
#: Bits of a key's hash. Of 10^12 keys some 10^-5 share theirs with another.
KEY_BITS = 56
LEVEL = 3


def word_slices(texts: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, first word of each row and the end)."""
    for lo, hi, data, offsets in chunks(texts, size):
        data = LOWER[data]
        starts, ends, first = spans(data, offsets, SPACE)
        yield lo, hi, word_hashes(data, starts, ends), first


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's distinct words, and its numbers of events in a row with a null word."""
    seen, parts, n_all, n_target = np.zeros(0, np.uint64), [], 0, 0
    for batch in batches:
        target = batch.column(1).to_numpy(zero_copy_only=False)
        for lo, hi, h, first in word_slices(batch.column(0), SLICE):
            n = np.diff(first)
            n += n > 0
            n_all += int(n.sum())
            n_target += int(n[target[lo:hi]].sum())
            parts.append(np.unique(h))
            if sum(map(len, parts)) > 1 << 21:
                seen, parts = np.unique(np.concatenate([seen, *parts])), []
    seen = np.unique(np.concatenate([seen, *parts]))
    for i in range(0, len(seen), 1 << 18):
        w = pa.array(seen[i : i + (1 << 18)].view(np.int64))
        yield pa.RecordBatch.from_arrays([w, pa.nulls(len(w), pa.int64()), pa.nulls(len(w), pa.int64())], names=["w", "n_all", "n_target"])
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([n_all]), pa.array([n_target])], names=["w", "n_all", "n_target"])


def packed(x: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes; the upper planes are mostly zero."""
    kind = np.dtype("<u8") if x.dtype == np.uint64 else np.dtype("<u4")
    raw = x.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T.tobytes()
    return pa.Codec("zstd", compression_level=LEVEL).compress(raw, asbytes=True)


def unpacked(b: bytes, n: int, width: int = 4) -> np.ndarray:
    raw = pa.Codec("zstd").decompress(b, n * width, asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(width, -1).T.copy().view(f"<u{width}").ravel()


def events(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a slice's rows: word and row of each event. Rows without words have none."""
    n = np.diff(first)
    some = np.flatnonzero(n)
    at = first[1:][some]
    return np.insert(h, at, END), np.insert(np.repeat(np.arange(len(n)), n), at, some)


def pair_key(prev: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(prev * STEP + word * MIX)


def word_key(word: np.ndarray) -> np.ndarray:
    """The key of a word as such; START stands for the number of texts."""
    return mix(word * MIX + np.uint64(1))


def by_frequency(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words, the most frequent first, and the place of each word among them: such places are small and pack well."""
    words, at, count = np.unique(word, return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return words[order], place[at]


def slice_keys(words: np.ndarray, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice's events, given as places in its distinct words: its sorted keys, and among these the places of each event's
    pair, of each distinct word and of START."""
    word = words[at]
    prev = np.empty_like(word)
    prev[1:], prev[first] = word[:-1], START
    keys = np.concatenate([pair_key(prev, word), word_key(words), word_key(np.array([START]))]) >> np.uint64(64 - KEY_BITS)
    used, place = np.unique(keys, return_inverse=True)
    return used, place[: len(at)], place[len(at) : -1], place[-1]


def _blocks(parts: int):
    """Of each slice, rows (slice, p, size, keys, counts in all rows and in target rows), one a part, and in one row of each
    slice what scoring it needs: ids, numbers of events, flags, its distinct words, and the place of each event's word there."""
    powers(1)
    names = ["slice", "p", "size", "keys", "c", "t", "doc_id", "n", "target", "d", "words", "m", "at"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
    inner = (np.arange(1, parts, dtype=object) * (1 << KEY_BITS) // parts).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 28
        for batch in batches:
            ids, target = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False)
            for lo, hi, h, first in word_slices(batch.column(1), SLICE):
                word, row = events(h, first)
                words, at = by_frequency(word)
                opens = np.flatnonzero(np.diff(row, prepend=-1))
                used, pair, of_word, start = slice_keys(words, at, opens)
                own = target[lo:hi][row]
                c, t = np.zeros(len(used), np.int64), np.zeros(len(used), np.int64)
                for counts, some in ((c, slice(None)), (t, own)):
                    counts += np.bincount(pair[some], minlength=len(used)) + np.bincount(of_word[at[some]], minlength=len(used))
                c[start], t[start] = len(opens), own[opens].sum()
                edges = [0, *np.searchsorted(used, inner), len(used)]
                about = [ids[lo:hi].to_pylist(), np.bincount(row, minlength=hi - lo), target[lo:hi], len(words), packed(words), len(at), packed(at)]
                cols: dict[str, list] = {k: [] for k in names}
                for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    home = p == zlib.crc32(str(number).encode()) % parts
                    if a < b or home:
                        block = [number, p, b - a, packed(np.diff(used[a:b], prepend=np.uint64(0))), packed(c[a:b]), packed(t[a:b])]
                        for k, v in zip(names, block + (about if home else [None] * 7), strict=True):
                            cols[k].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(cols[k], t) for k, t in zip(names, kinds, strict=True)], names=names)
                number += 1

    return trimmed(run)


ABOUT = "doc_id array<long>, n array<long>, target array<boolean>, d long, words binary, m long, at binary"


def _sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """Over the blocks of a part: the same blocks with the sums of all slices instead of their own counts."""
    size = pdf["size"].to_numpy()
    read = lambda k, w: [unpacked(b, n, w) for b, n in zip(pdf[k], size, strict=True)]
    _, at = np.unique(np.concatenate([np.cumsum(k, dtype=np.uint64) for k in read("keys", 8)]), return_inverse=True)
    ends = np.cumsum(size)[:-1]
    for k in ("c", "t"):
        total = np.bincount(at, weights=np.concatenate(read(k, 4))).astype(np.uint64)
        pdf[k] = [packed(x) for x in np.split(total[at], ends)]
    return pdf.drop(columns="keys")


def _scored(v: int, n_all: int, n_target: int):
    """A slice's documents, from its blocks in order of part."""
    scale = n_target / n_all if n_target and n_all else 1.0

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("p")
        c, t = (np.concatenate([unpacked(b, n, 8) for b, n in zip(pdf[k], pdf["size"], strict=True)]).astype(np.float64) for k in ("c", "t"))
        about = pdf[pdf["m"].notna()].iloc[0]
        n, target = np.asarray(about["n"], np.int64), np.asarray(about["target"], bool)
        m, words = int(about["m"]), unpacked(about["words"], int(about["d"]), 8)
        at = unpacked(about["at"], m)
        row, opens = np.repeat(np.arange(len(n)), n), (np.cumsum(n) - n)[n > 0]
        _, pair, of_word, start = slice_keys(words, at, opens)
        word = of_word[at]
        prev = np.empty_like(word)
        prev[1:], prev[opens] = word[:-1], start
        # The document's own counts; it has one start sign.
        key = lambda k: row * np.int64(len(c)) + k
        keys, own = np.unique(np.concatenate([key(pair), key(word)]), return_counts=True)
        own_pair, own_word = (own[np.searchsorted(keys, key(k))] for k in (pair, word))
        own_prev = np.empty_like(own_word)
        own_prev[1:], own_prev[opens] = own_word[:-1], 1
        losses = []
        for counts, total, mine, weight in ((t, n_target, target[row], 1.0), (c, n_all, np.ones(m, bool), scale)):
            less = lambda k, o: weight * (counts[k] - o * mine)  # noqa: B023, E731
            unigram = (less(word, own_word) + ADD) / (weight * (total - n[row] * mine) + ADD * v)
            p = (less(pair, own_pair) + MU * unigram) / (less(prev, own_prev) + MU)
            losses.append(np.bincount(row, weights=-np.log(p), minlength=len(n)) / np.maximum(n, 1))
        return pd.DataFrame({"doc_id": pd.array(list(about["doc_id"]), "Int64"), "n_events": n, "is_target": target, "loss_target": losses[0], "loss_background": losses[1]})

    return run


def cross_entropy_difference(docs: DataFrame, is_target, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Per input row: doc_id, n_tokens (words), is_target, loss_target, loss_background, score (their difference).

    Words are lower-cased (A-Z) runs without white space. Null texts and texts without words have n_tokens 0 and 0.0 in the
    three others. A null is_target counts as false. Null and repeated ids stay rows of their own; repeated rows count
    each. With an empty target its losses are those of the uniform model, and the background is not scaled. Texts of any length count
    whole. Empty tables give no rows. Other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    target = F.coalesce(is_target, F.lit(False))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), target.alias("target"))
    words = src.select("text", "target").mapInArrow(trimmed(_vocabulary), "w long, n_all long, n_target long")
    per_word = words.groupBy("w").agg(F.sum("n_all").alias("a"), F.sum("n_target").alias("t"))
    v, n_all, n_target = per_word.agg(F.count("w"), F.sum("a"), F.sum("t")).first()
    n_all, n_target = n_all or 0, n_target or 0
    parts = parts or max(LEAST_PARTS, n_all // PART_EVENTS)
    blocks = src.mapInArrow(_blocks(parts), f"slice long, p long, size long, keys binary, c binary, t binary, {ABOUT}")
    sums = blocks.groupBy("p").applyInPandas(_sums, f"slice long, p long, size long, c binary, t binary, {ABOUT}")
    one = sums.groupBy("slice").applyInPandas(_scored(v + 1, n_all, n_target), "doc_id long, n_events long, is_target boolean, loss_target double, loss_background double")
    out = one.select("doc_id", F.greatest(F.col("n_events") - 1, F.lit(0)).alias("n_tokens"), "is_target", "loss_target", "loss_background")
    return out.withColumn("score", F.col("loss_target") - F.col("loss_background"))


def op5_lm_score(spark, sf_dir: str) -> DataFrame:
    """Losses to six places."""
    out = cross_entropy_difference(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.col("source") == "src1")
    return out.select("doc_id", "n_tokens", "is_target", *[F.round(c, 6).alias(c) for c in ("loss_target", "loss_background", "score")])


#: Counts of words (the end is a blank), contexts (the start is empty) and pairs, less each document's own.
OP5_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(source = 'src1', false) AS t, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
e AS (SELECT doc_id, t, unnest(list_append(w, ' ')) AS x, unnest(list_prepend('', w)) AS p FROM w WHERE len(w) > 0),
u AS MATERIALIZED (SELECT doc_id, t, p, x, count(*) AS k FROM e GROUP BY ALL),
cp AS (SELECT p, x, sum(k) AS c, sum(CASE WHEN t THEN k ELSE 0 END) AS ct FROM u GROUP BY p, x), cw AS (SELECT x, sum(k) AS c, sum(CASE WHEN t THEN k ELSE 0 END) AS ct FROM u GROUP BY x), cc AS (SELECT p, sum(k) AS c, sum(CASE WHEN t THEN k ELSE 0 END) AS ct FROM u GROUP BY p),
ow AS (SELECT doc_id, x, sum(k) AS k FROM u GROUP BY ALL), oc AS (SELECT doc_id, p, sum(k) AS k FROM u GROUP BY ALL), n AS (SELECT doc_id, sum(k) AS n FROM u GROUP BY doc_id),
z AS (SELECT sum(k) AS n, sum(CASE WHEN t THEN k ELSE 0 END) AS nt, count(DISTINCT x) AS v FROM u), s AS (SELECT n, nt, v, CASE WHEN nt > 0 THEN nt / n ELSE 1.0 END AS r FROM (SELECT CAST(n AS DOUBLE) AS n, CAST(nt AS DOUBLE) AS nt, v FROM z) q),
m AS (SELECT u.doc_id, u.k, n.n AS len, u.t, CAST(u.t AS INTEGER) AS i, s.*, cp.c AS pa, cp.ct AS pt, cw.c AS wa, cw.ct AS wt, cc.c AS ca, cc.ct AS ctt, ow.k AS ok, oc.k AS ck, n.n AS own FROM u JOIN cp ON cp.p = u.p AND cp.x = u.x JOIN cw ON cw.x = u.x JOIN cc ON cc.p = u.p JOIN ow ON ow.doc_id = u.doc_id AND ow.x = u.x JOIN oc ON oc.doc_id = u.doc_id AND oc.p = u.p JOIN n ON n.doc_id = u.doc_id, s),
l AS (SELECT doc_id, len, k, ln((pt - i * k + 2.0 * (wt - i * ok + 0.5) / (nt - i * own + 0.5 * v)) / (ctt - i * ck + 2.0)) AS lt, ln((r * (pa - k) + 2.0 * (r * (wa - ok) + 0.5) / (r * (n - own) + 0.5 * v)) / (r * (ca - ck) + 2.0)) AS lb FROM m),
d AS (SELECT doc_id, -sum(k * lt) / any_value(len) AS a, -sum(k * lb) / any_value(len) AS b FROM l GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_tokens, w.t AS is_target, coalesce(round(d.a, 6), 0.0) AS loss_target, coalesce(round(d.b, 6), 0.0) AS loss_background, coalesce(round(d.a - d.b, 6), 0.0) AS score FROM w LEFT JOIN d ON d.doc_id = w.doc_id
"""
