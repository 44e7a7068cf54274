"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer numpy network.

Tokens are runs of word characters and runs of other visible characters, each with its shape (case, digits, punctuation).
Random indexing gives each token bucket a sparse ternary index vector; a bucket's word vector is its own index vector plus
the sum of those of its neighbours, normalised. A document is the mean of its tokens' vectors with a few counts. The
network's logits are divided by a temperature fitted on rows left out of its training, so that scores are probabilities.

Word vectors come from the texts of all documents, labelled or not: each task adds up its own, and the sums are added by
stripes of the table of buckets. The network is fitted on a bounded sample of labelled rows (`max_rows`, those with the
smallest hash of the id); their features are made on the executors, so that no text comes to the driver. The model's size does not
depend on the corpus. All rows are scored over their whole text.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import LOWER, bound_batches, chunks, trimmed, word_hashes
from millrace.llm.lang_id import fold

BUCKETS, DIM, NONZERO, WINDOW, HIDDEN = 1 << 14, 48, 6, 2, 24
MAX_ROWS = 4000
#: Stripes of the table of word vectors, for its distributed sum; tasks whose sums meet in one group first.
STRIPES, GROUP = 16, 32
SHAPES = ("lower", "upper", "title", "mixed", "digit", "sign")
FEATURES = DIM + len(SHAPES) + 5
WORD, SIGN = 1, 2
CLASS = np.full(256, SIGN, np.uint8)
CLASS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = WORD
CLASS[[*range(0x21), 0x7F]] = 0


def tokens(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """For about a MB of rows at once: bucket, shape and row of each token, and the number of rows.

    A token is a run of letters and digits (all bytes from 0x80 count as letters) or a run of other visible bytes."""
    for lo, hi, data, offsets in chunks(texts):
        kind = CLASS[data]
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = kind[1:] != kind[:-1]
        edge[offsets] = True
        at = np.flatnonzero(edge)
        keep = kind[at[:-1]] > 0 if len(data) else np.zeros(0, bool)
        starts, ends = at[:-1][keep], at[1:][keep]
        row = np.searchsorted(offsets, starts, "right") - 1
        bucket = (word_hashes(LOWER[data], starts, ends) % np.uint64(BUCKETS)).astype(np.int64)
        up, low, digit = (np.concatenate([[0], np.cumsum((data >= x) & (data <= y), dtype=np.int32)]) for x, y in ((65, 90), (97, 122), (48, 57)))
        n_up, n_low, n_digit = (c[ends] - c[starts] for c in (up, low, digit))
        first_up = (data[starts] >= 65) & (data[starts] <= 90) if len(starts) else np.zeros(0, bool)
        shape = np.where(n_up == 0, 0, np.where(n_low == 0, 1, np.where((n_up == 1) & first_up, 2, 3)))
        shape = np.where(n_digit == ends - starts, 4, np.where(kind[starts] == SIGN, 5, shape)) if len(starts) else shape
        yield bucket, shape, row, hi - lo


@functools.cache
def index_slots() -> np.ndarray:
    """Of each bucket, the places of its index vector's ones, those at odd positions positive, the others negative."""
    rng = np.random.Generator(np.random.PCG64(11))
    return np.stack([rng.integers(0, DIM, BUCKETS) for _ in range(NONZERO)], axis=1)


@functools.cache
def index_vectors() -> np.ndarray:
    out = np.zeros((BUCKETS, DIM), np.float32)
    for s, at in enumerate(index_slots().T):
        out[np.arange(BUCKETS), at] += 1 if s % 2 else -1
    return out


class QualityModel:
    def __init__(self, vectors, mean, scale, w1, b1, w2, b2, temperature):
        self.vectors, self.mean, self.scale, self.w1, self.b1, self.w2, self.b2, self.temperature = vectors, mean, scale, w1, b1, w2, b2, temperature

    def features(self, texts: pa.Array) -> np.ndarray:
        """Mean word vector, shares of shapes, log length, share of distinct tokens, weight of the most frequent, repeats."""
        out = [np.zeros((0, FEATURES), np.float32)]
        for bucket, shape, row, rows in tokens(texts):
            f = np.zeros((rows, FEATURES), np.float32)
            n = np.bincount(row, minlength=rows)
            some = np.maximum(n, 1)
            pair, counts = np.unique(row * BUCKETS + bucket, return_counts=True)
            at, r = pair % BUCKETS, pair // BUCKETS
            for i in range(0, len(pair), 1 << 15):
                s = slice(i, i + (1 << 15))
                new = np.concatenate([[0], np.flatnonzero(np.diff(r[s])) + 1])
                f[r[s][new], :DIM] += np.add.reduceat(self.vectors[at[s]] * counts[s, None].astype(np.float32), new, axis=0)
            f[:, :DIM] /= some[:, None]
            f[:, DIM : DIM + len(SHAPES)] = np.bincount(row * 8 + shape, minlength=rows * 8).reshape(rows, 8)[:, : len(SHAPES)] / some[:, None]
            most = np.zeros(rows, np.int64)
            np.maximum.at(most, r, counts)
            again = np.bincount(row[1:][(bucket[1:] == bucket[:-1]) & (row[1:] == row[:-1])], minlength=rows)
            f[:, -5:] = np.stack([np.log1p(n), np.bincount(r, minlength=rows) / some, np.log1p(most), most / some, again / some], axis=1)
            out.append(f)
        return np.concatenate(out)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self.features(texts)) / self.temperature, -30, 30)))


def neighbour_sums(texts: pa.Array, out: np.ndarray) -> None:
    """Add to out, for each bucket, the index vectors of its neighbours up to WINDOW tokens away. Sums are whole numbers: an index vector
    is a few ones, so each neighbour is as many counts."""
    slots, flat = index_slots(), out.reshape(-1)
    for bucket, _, row, _ in tokens(texts):
        for d in range(1, WINDOW + 1):
            near = row[d:] == row[:-d]
            a, b = bucket[d:][near], bucket[:-d][near]
            for one, other in ((a, b), (b, a)):
                at = one[:, None] * DIM + slots[other]
                flat += np.bincount(at[:, 1::2].ravel(), minlength=len(flat))
                flat -= np.bincount(at[:, ::2].ravel(), minlength=len(flat))


def normalised(sums: np.ndarray) -> np.ndarray:
    """Word vectors: a bucket's index vector plus its sum, of length 1."""
    out = index_vectors() + sums
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)).astype(np.float32)


def _task_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stripe, task, sums) of a task's texts."""
    out = np.zeros((BUCKETS, DIM))
    for batch in batches:
        neighbour_sums(batch.column(0), out)
    task = TaskContext.get().partitionId()
    some = [(i, part) for i, part in enumerate(np.split(out, STRIPES)) if part.any()]
    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int32()), pa.array([task] * len(some), pa.int64()), pa.array([_packed(p) for _, p in some], pa.binary())], names=["stripe", "task", "sums"])


def _packed(sums: np.ndarray) -> bytes:
    return zlib.compress(sums.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), np.uint8).reshape(8, -1).T.copy().view("<i8").reshape(-1, DIM)


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"stripe": pdf["stripe"][:1], "task": pdf["task"][:1] // GROUP, "sums": [_packed(sum(map(_unpacked, pdf["sums"])))]})


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Word vectors of all documents' texts. Sums of GROUP tasks meet in a group, then those of GROUP groups, and so on."""
    schema = "stripe int, task long, sums binary"
    sums = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(trimmed(_task_sums), schema)
    tasks = docs.rdd.getNumPartitions()
    while tasks > 1:
        sums = sums.groupBy("stripe", F.floor(F.col("task") / GROUP).alias("g")).applyInPandas(_added, schema)
        tasks = -(-tasks // GROUP)
    out = np.zeros((STRIPES, BUCKETS // STRIPES, DIM))
    for r in sums.select("stripe", "sums").collect():
        out[r["stripe"]] += _unpacked(r["sums"])
    return normalised(out.reshape(BUCKETS, DIM))


def train_model(vectors: np.ndarray, x: np.ndarray, labels: np.ndarray, steps: int = 600, seed: int = 3) -> QualityModel:
    """From word vectors and the features and labels of rows. Full-batch Adam with class weights of half strength; every fifth row is left out and sets the temperature."""
    rng = np.random.Generator(np.random.PCG64(seed))
    w1, w2 = rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), rng.normal(0, HIDDEN**-0.5, HIDDEN)
    model = QualityModel(vectors, np.zeros(FEATURES), np.ones(FEATURES), w1, np.zeros(HIDDEN), w2, 0.0, 1.0)
    if not len(labels):
        return QualityModel(model.vectors, model.mean, model.scale, w1, model.b1, w2 * 0, 0.0, 1.0)
    x, y = x.astype(float), labels.astype(float)
    held = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    model.mean, model.scale = x[~held].mean(axis=0), x[~held].std(axis=0) + 1e-3
    z, t = (x[~held] - model.mean) / model.scale, y[~held]
    p = {"w1": w1, "b1": model.b1, "w2": w2, "b2": np.array(np.log((t.sum() + 1) / (len(t) - t.sum() + 1)))}
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        h = np.tanh(z @ p["w1"] + p["b1"])
        err = (1 / (1 + np.exp(-np.clip(h @ p["w2"] + p["b2"], -30, 30))) - t) / len(t)
        back = np.outer(err, p["w2"]) * (1 - h * h)
        grad = {"w1": z.T @ back + 1e-4 * p["w1"], "b1": back.sum(axis=0), "w2": h.T @ err + 1e-4 * p["w2"], "b2": err.sum()}
        for k, g in grad.items():
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.999 * m2[k] + 0.001 * g * g
            p[k] = p[k] - 0.02 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = p["w1"], p["b1"], p["w2"], float(p["b2"])
    if held.any():
        raw, t = model.logits(x[held]), y[held]
        loss = lambda temp: np.mean(np.logaddexp(0, -np.clip(raw / temp, -500, 500) * (2 * t - 1)))
        model.temperature = min((float(v) for v in np.geomspace(0.25, 8, 60)), key=loss)
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> QualityModel:
    """Word vectors from all of docs; the network from the max_rows labelled rows with the smallest hash of the id (all, if
    fewer). Rows with a null id or label are left out; an id with several labels takes the smallest, one with several texts the
    smallest text. The driver gets FEATURES numbers for each row of that sample, and no text."""
    bound_batches(docs.sparkSession)
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.min(label_col).alias("y"))
    sample = known.orderBy(F.xxhash64("i"), "i").limit(max_rows)
    vectors = word_vectors(docs, text_col)
    blank = QualityModel(vectors, *[None] * 7)

    @F.pandas_udf("array<float>")
    def features(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(list(blank.features(pa.array([x if isinstance(x, str) else "" for x in t], pa.large_string()))))

    text = F.coalesce(F.col(text_col), F.lit("")).alias("t")
    rows = docs.select(F.col(id_col).alias("i"), text).join(F.broadcast(sample), "i").groupBy("i", "y").agg(F.min("t").alias("t"))
    rows = rows.orderBy(F.crc32(F.col("i").cast("string").cast("binary")), "i").select(features("t").alias("x"), F.col("y").eqNullSafe(F.lit(1)).alias("y")).collect()
    x = np.array([r["x"] for r in rows], np.float32).reshape(-1, FEATURES)
    return train_model(vectors, x, np.array([float(r["y"]) for r in rows]))


def quality_udf(model: QualityModel):
    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(model.scores(pa.array([x if isinstance(x, str) else "" for x in t], pa.large_string())))

    return score


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Per row: doc_id, score (probability of label 1), predicted (1 if score >= threshold).

    Null texts count as empty; empty texts have a score like all others; texts of any length are scored whole. A model without labelled rows scores 0.5. Null and
    repeated ids are kept as they are; an empty table gives an empty result; other columns are ignored.
    """
    out = docs.select(F.col(id_col).alias("doc_id"), quality_udf(model)(F.col(text_col)).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_quality(docs, labels.filter(fold("doc_id", 5) != 0))
    out = score_quality(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
