"""Language identification with language-bitmask n-gram filters.

For every language the character trigrams of its training text go into one bit-sliced Bloom filter: each slot holds a bit a
language, so that one look-up (the AND of the slots of a trigram) returns all languages that contain it. A document's
trigrams are looked up, counted for each language, and the counts are corrected for the filter's own false positive rate in
that language. The largest corrected count decides.

The filter is a model of bounded size: it has slots in proportion to its trigrams, and a trigram that makes up less than
`least_share` (one in two million, a parameter) of a language's training text is no feature. A language with up to two
million training trigrams keeps all of them. Above that it keeps two million at most; counts cover all training rows. What part of a
language's training text the features make up depends on its script and on the corpus, so the model has that part (`usual`),
and a text's score is to be judged against it. The bits are set by a distributed aggregation, so the driver gets slots, not
trigrams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import MIX, bound_batches, cut, mix, remove, trimmed

LEAST_SLOTS, MOST_SLOTS, SLOTS_PER_GRAM = 1 << 20, 1 << 23, 4
HASHES = 3
LEAST_SHARE = 5e-7
CODES = 0x110000
CHUNK_CHARS = 1 << 18
_alpha: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _alpha:
        _alpha.append(np.array([chr(i).isalpha() for i in range(CODES)]))
    return _alpha[0]


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, str]]:
    """(row, piece): lower-cased texts between spaces, long ones in pieces that share two characters."""
    for row, text in enumerate(texts):
        if text:
            low = f" {text.lower()} "
            for i in range(0, len(low) - 2, CHUNK_CHARS):
                yield row, low[i : i + CHUNK_CHARS + 2]


def trigrams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For about CHUNK_CHARS at once: hashes of trigrams of lower-cased letters (all else is a space), the row of each, and
    the rows that have a letter. No trigram reaches over two rows or holds two spaces in a row."""

    def made(group: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = np.frombuffer("".join(p for _, p in group).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _is_letter()[parts]
        code = np.where(letter, parts, 32).astype(np.uint64)
        piece = np.repeat(np.arange(len(group)), [len(p) for _, p in group])
        row = np.array([r for r, _ in group])[piece]
        ok = (letter[1:-1] | (letter[:-2] & letter[2:])) & (piece[:-2] == piece[2:])
        h = mix((code[:-2] * MIX + code[1:-1]) * MIX + code[2:])
        return h[ok], row[1:-1][ok], np.unique(row[letter])

    group, size = [], 0
    for row, piece in _pieces(texts):
        group.append((row, piece))
        size += len(piece)
        if size >= CHUNK_CHARS:
            yield made(group)
            group, size = [], 0
    if group:
        yield made(group)


def slots(h: np.ndarray, size: int) -> list[np.ndarray]:
    step = (h >> np.uint64(40)) | np.uint64(1)
    return [((h + np.uint64(k) * step) % np.uint64(size)).astype(np.int64) for k in range(HASHES)]


def filter_size(grams: int) -> int:
    """Slots for a filter whose largest language has so many trigrams: a power of two within fixed bounds."""
    return min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (SLOTS_PER_GRAM * max(1, grams) - 1).bit_length()))


class LanguageFilter:
    """languages (sorted by code point), their shares of training rows, usual: the share of a language's training trigrams
    that the filter has (1 if not given), and tables[l // 64][slot] with bit l % 64."""

    def __init__(self, languages: list[str], weight: list[float], tables: list[np.ndarray], usual: list[float] | None = None):
        self.languages, self.weight, self.tables, self.size = languages, np.array(weight), tables, len(tables[0])
        self.usual = dict(zip(languages, usual or [1.0] * len(languages), strict=True))
        fill = [float(np.mean(tables[n // 64] >> np.uint64(n % 64) & np.uint64(1))) for n in range(len(languages))]
        self.false_rate = np.array(fill) ** HASHES

    @classmethod
    def of(cls, languages: list[str], weight: list[float], grams: list[np.ndarray]) -> LanguageFilter:
        """From each language's trigram hashes."""
        size = filter_size(max(map(len, grams), default=0))
        tables = [np.zeros(size, np.uint64) for _ in range(0, max(1, len(languages)), 64)]
        for n, h in enumerate(grams):
            for s in slots(h, size):
                np.bitwise_or.at(tables[n // 64], s, np.uint64(1 << n % 64))
        return cls(languages, weight, tables)

    def held(self, h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Trigrams of each row, and of these those that the filter has in each language."""
        total = np.bincount(row, minlength=rows).astype(float)
        at, out = slots(h, self.size), np.zeros((rows, len(self.languages)))
        for t, table in enumerate(self.tables):
            mask = table[at[0]]
            for s in at[1:]:
                mask &= table[s]
            for n in range(t * 64, min(t * 64 + 64, len(self.languages))):
                out[:, n] = np.bincount(row[(mask >> np.uint64(n % 64) & np.uint64(1)).astype(bool)], minlength=rows)
        return total, out

    def corrected(self, total: np.ndarray, held: np.ndarray) -> np.ndarray:
        """Counts without the false positives to be expected among the trigrams that a language lacks."""
        return np.clip((held - total[:, None] * self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), 0, None)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        total, raw, has = np.zeros(n), np.zeros((n, len(self.languages))), np.zeros(n, bool)
        for h, row, some in trigrams(texts):
            has[some] = True
            if len(row):
                lo, hi = int(row[0]), int(row[-1]) + 1
                t, g = self.held(h, row - lo, hi - lo)
                total[lo:hi] += t
                raw[lo:hi] += g
        if not self.languages:
            return ["und"] * n, np.zeros(n)
        got = self.corrected(total, raw)
        best = np.argmax(np.round(got, 6) + 1e-7 * self.weight, axis=1)
        share = np.divide(got[np.arange(n), best], total, out=np.zeros(n), where=total > 0)
        return [self.languages[b] if x else "und" for b, x in zip(best, has, strict=True)], np.where(has, np.clip(share, 0, 1), 0.0)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, trigram, count) of a task's rows; trigrams are added up before they leave the task."""
    sums: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(parts):
        h, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        u, at = np.unique(h, return_inverse=True)
        return u, np.bincount(at, weights=c, minlength=len(u)).astype(np.int64)

    for batch in batches:
        lang, text = batch.column(0).to_pylist(), batch.column(1)
        for name in set(lang):
            rows = text.filter(pa.array([x == name for x in lang])).to_pylist()
            for h, _, _ in trigrams(rows):
                sums.setdefault(name, []).append(np.unique(h, return_counts=True))
                if len(sums[name]) > 32:
                    sums[name] = [merged(sums[name])]
    for name, parts in sums.items():
        u, c = merged(parts)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(u), pa.string()), pa.array(u.view(np.int64)), pa.array(c)], names=["lang", "gram", "n"])


def _bits(size: int):
    """(lang number, gram) to (table, slot, bits): a task's trigrams of a table are merged before they leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            number, h = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for t in np.unique(number // 64):
                table, mine = tables.setdefault(int(t), np.zeros(size, np.uint64)), number // 64 == t
                bit = np.uint64(1) << (number[mine] % 64).astype(np.uint64)
                for s in slots(h[mine], size):
                    np.bitwise_or.at(table, s, bit)
        for t, table in tables.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(at), pa.array(table[at].view(np.int64))], names=["t", "slot", "bits"])

    return run


def fit_languages(train: DataFrame, lang_col: str = "lang", text_col: str = "text", least_share: float = LEAST_SHARE) -> LanguageFilter:
    """Learn from all rows with a language. The driver gets the filter's slots, of which there are MOST_SLOTS for each 64
    languages at most, and one row a language."""
    bound_batches(train.sparkSession)
    src = train.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = src.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    names = sorted((r["lang"], r["n"]) for r in rows.collect())
    if not names:
        return LanguageFilter.of([], [], [])
    grams = cut(src.mapInArrow(trimmed(_gram_counts), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = grams.groupBy("lang").agg(F.sum("n").alias("total"))
    often = grams.join(totals, "lang").filter(F.col("n") >= F.col("total") * least_share)
    held = {r["lang"]: (r["grams"], r["usual"]) for r in often.groupBy("lang").agg(F.count(F.lit(1)).alias("grams"), (F.sum("n") / F.first("total")).alias("usual")).collect()}
    size = filter_size(max((g for g, _ in held.values()), default=0))
    numbers = train.sparkSession.createDataFrame([(name, i) for i, (name, _) in enumerate(names)], "lang string, number int")
    bits = often.join(numbers, "lang").select("number", "gram").mapInArrow(_bits(size), "t int, slot long, bits long").groupBy("t", "slot").agg(F.bit_or("bits").alias("bits"))
    tables = [np.zeros(size, np.uint64) for _ in range(0, len(names), 64)]
    t, slot, b = (c.to_numpy() for c in bits.toArrow().columns)
    for i, table in enumerate(tables):
        table[slot[t == i]] = b[t == i].view(np.uint64)
    remove(grams)
    all_rows = sum(n for _, n in names)
    return LanguageFilter([n for n, _ in names], [n / all_rows for _, n in names], tables, [min(1.0, held.get(n, (0, 0.0))[1]) for n, _ in names])


def language_udf(model: LanguageFilter):
    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            names, scores = model.predict([x if isinstance(x, str) else None for x in t])
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return predict


def fold(id_col: str, folds: int) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)), F.lit(-1))


def identify_languages(docs: DataFrame, model: LanguageFilter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score (share of its trigrams that the language contains).

    `und` with score 0 for null texts and texts without a letter; ties go to the language with more training rows, then to
    the smaller name; a text of unknown trigrams only gets the most frequent language and score 0. A model without training
    rows says `und` for all. Null and repeated ids are kept as they are; an empty table gives an empty result.
    """
    got = docs.select(F.col(id_col).alias("doc_id"), language_udf(model)(F.col(text_col)).alias("p"))
    return got.select("doc_id", "p.lang_pred", "p.score")


def op2_lang_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_languages(docs.filter(fold("doc_id", 4) != 2))
    out = identify_languages(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
