"""Benchmark decontamination by templates.

Texts are canonicalised: numbers, capitalised words inside a sentence and units after a number become typed placeholders,
other words are lower-cased letters and digits. Windows of eight template words of documents are hash-joined with those of
the benchmark items (an item of fewer words is one window). A document holds an item if one passage
has at least `coverage` of the item's windows that count, so questions with other numbers or names are caught as well.

A passage is a chain of matches in which the position in the document and that in the item both grow. A match that continues the
one just before it stays with it; another one joins the chain of most matches from which it is not further away than the item's
length, so inserted and dropped words do not end a passage. Slots are checked over the whole passage. Numbers and units are free: equal
ones of the item may be different quantities and different ones may become equal. A window counts if each name in it is the
item's own, or the one that stands for it at most of its places in the passage. If a name has no such majority, the passage
mixes up who is who, and only the windows with the item's own names (or none) count.

Windows have a second, case-blind reading in which names are plain words, so that copies in other case and short copies in the
middle of a sentence are found. The item's first window is indexed as well with its first word as a name that stands for
itself, as that word is capitalised in the middle of a sentence of the document.

A bitmap of the items' window hashes (of fixed size) is looked up before the join, so that few other windows are shuffled.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import LOWER, NOT_ALNUM, bitmap_of, bound_batches, chunks, cut, in_bitmap, powers, spans, trimmed, windows, word_hashes

WINDOW = 8
NUMBER, NAME, UNIT = (np.uint64(x) for x in (0xA1B2C3D4E5F60711, 0xB1C2D3E4F5061723, 0xC1D2E3F405162735))
UNITS = "mm cm m km in ft yd mi mg g kg t oz lb lbs ml l gal s sec min h hr hrs hour hours minute minutes second seconds day days week weeks month months year years percent usd eur gbp dollar dollars cent cents euro euros meter meters metre metres mile miles mph kmh degree degrees celsius fahrenheit inch inches foot feet pound pounds liter liters litre litres gram grams kilogram kilograms kilometer kilometers kilometre kilometres".split()


def _own_hash(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(w) for w in raw])
    return word_hashes(data, ends - [len(w) for w in raw], ends)


_units = np.sort(_own_hash(UNITS))


def canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk of texts: template hash and word hash of each word, and the first word of each row."""
    starts, ends, first = spans(data, offsets, NOT_ALNUM)
    low = LOWER[data]
    value = word_hashes(low, starts, ends)
    if not len(starts):
        return value, value, first
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57), dtype=np.int64)])
    number = digits[ends] > digits[starts]
    unit = np.zeros(len(starts), bool)
    unit[1:] = number[:-1] & ~number[1:] & (_units[np.minimum(np.searchsorted(_units, value[1:]), len(_units) - 1)] == value[1:])
    # A sentence ends at . ! ? : or a line end; the first word after one, and of a row, is no name.
    stops = np.concatenate([[0], np.cumsum(np.isin(data, np.frombuffer(b".!?:;\n\r\"", np.uint8)), dtype=np.int64)])
    opens = np.ones(len(starts), bool)
    opens[1:] = stops[starts[1:]] > stops[ends[:-1]]
    opens[first[:-1][first[:-1] < len(starts)]] = True
    letters = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122), dtype=np.int64)])
    upper = (data[starts] >= 65) & (data[starts] <= 90) & (letters[ends] > letters[starts])
    name = upper & ~opens & ~number
    template = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, value)))
    return template, value, first


def _readings(template: np.ndarray, word: np.ndarray) -> list[np.ndarray]:
    """The template, and the case-blind one with names as words if that differs."""
    name = template == NAME
    return [template, np.where(name, word, template)] if name.any() else [template]


def _window_rows(rows: Iterator[tuple[int, np.ndarray, np.ndarray]], sizes: list[int], keep) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in ("row", "h", "pos", "slots", "name_at")}
    for row, template, word in rows:
        for k in sizes:
            seen = None
            for reading in _readings(template, word):
                h = windows(reading, k).view(np.int64)
                at = np.flatnonzero(keep(h) if seen is None else keep(h) & (h != seen)) if len(h) else []
                seen = h
                for i in at:
                    _add(out, row, int(h[i]), reading, word, int(i), k)
    return out


def _add(out: dict[str, list], row: int, h: int, reading: np.ndarray, word: np.ndarray, i: int, k: int) -> None:
    part = reading[i : i + k]
    at = i + np.flatnonzero((part == NUMBER) | (part == UNIT) | (part == NAME))
    out["row"].append(row), out["h"].append(h), out["pos"].append(i)
    out["slots"].append(word[at].view(np.int64)), out["name_at"].append(np.where(reading[at] == NAME, at, -1))


def _rows(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for lo, _, data, offsets in chunks(texts):
        template, word, first = canonical(data, offsets)
        for i in range(len(offsets) - 1):
            yield lo + i, template[first[i] : first[i + 1]], word[first[i] : first[i + 1]]


def _item_windows(size: int):
    powers(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: dict[str, list] = {k: [] for k in ("item", "item_id", "n", "k", "h", "pos", "slots", "name_at", "first_fixed")}
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for row, template, word in _rows(batch.column(2)):
                k = min(size, len(template))
                if k:
                    got = _window_rows(iter([(row, template, word)]), [k], lambda h: np.ones(len(h), bool))
                    m, fixed = len(got["h"]), [False] * len(got["h"])
                    # Without a plain word the case-blind window is enough: NAME NAME stands in each text.
                    plain = ~np.isin(template[1:k], [NUMBER, UNIT, NAME])
                    if template[0] != NUMBER and plain.any():
                        reading = np.concatenate([[NAME], template[1:]])
                        _add(got, row, int(windows(reading[:k], k).view(np.int64)[0]), reading, word, 0, k)
                        m, fixed = m + 1, [*fixed, True]
                    n = len(template) - k + 1
                    for c, v in (("item", [keys[row]] * m), ("item_id", [ids[row]] * m), ("n", [n] * m), ("k", [k] * m), ("first_fixed", fixed)):
                        cols[c] += v
                    for c in ("h", "pos", "slots", "name_at"):
                        cols[c] += got[c]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[c], t) for c, t in zip(cols, kinds, strict=True)], names=list(cols))

    return trimmed(run)


def _doc_windows(sizes: list[int], bitmap: np.ndarray):
    powers(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            got = _window_rows(_rows(batch.column(1)), sizes, lambda h: in_bitmap(bitmap, h))
            at = np.array(got["row"], np.int64)
            cols = [pa.array(at + row), batch.column(0).take(pa.array(at)), pa.array(got["h"], pa.int64()), pa.array(got["pos"], pa.int64()), pa.array(got["slots"], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "doc_id", "h", "pos", "slots"])
            row += batch.num_rows

    return trimmed(run)


class Match:
    """A window of the item at a place of the document. ways: lists of (place of a name in the item or -1, item's slot, document's)."""

    __slots__ = ("at", "item_at", "before", "depth", "ways")

    def __init__(self, at: int, item_at: int, ways: list[list[tuple[int, int, int]]]):
        self.at, self.item_at, self.ways, self.before, self.depth = at, item_at, ways, None, 1


def chained(matches: list[Match], length: int, least: int) -> list[list[Match]]:
    """The passages with at least `least` matches. matches: in order of place, no place twice."""
    recent: list[Match] = []
    last: dict[tuple[int, int], Match] = {}
    inner = set()
    for m in matches:
        if recent and m.at - recent[0].at > 4 * length:
            recent = [r for r in recent if m.at - r.at <= 2 * length]
            last = {(r.at, r.item_at): r for r in recent}
        m.before = last.get((m.at - 1, m.item_at - 1))
        if m.before is None and m.item_at:
            drift = lambda r: abs(m.at - m.item_at - r.at + r.item_at)  # noqa: B023, E731
            fits = [r for r in recent if 0 < m.at - r.at <= m.item_at - r.item_at + length and r.item_at < m.item_at]
            m.before = max(fits, key=lambda r: (r.depth, -drift(r), r.at, r.item_at), default=None)  # noqa: B023
        if m.before is not None:
            m.depth = m.before.depth + 1
            inner.add(id(m.before))
        recent.append(m)
        last[m.at, m.item_at] = m
    out = []
    for m in matches:
        if m.depth >= least and id(m) not in inner:
            chain = [m]
            while chain[-1].before is not None:
                chain.append(chain[-1].before)
            out.append(chain)
    return out


def counted(chain: list[Match]) -> tuple[int, int]:
    """The windows of a passage that count, and the slot values of the item that differ in the document."""
    pairs = {p for m in chain for way in m.ways for p in way}
    stands, places, changed = defaultdict(set), defaultdict(set), {x for _, x, y in pairs if x != y}
    for place, x, y in pairs:
        if place >= 0:
            places[x].add((place, y))
            stands[x, y].add(place)
    fits = {(x, y) for (x, y), at in stands.items() if x == y or 2 * len(at) > len(places[x])}
    clear = {x for x, _ in fits} >= set(places)
    good = lambda p: p[0] < 0 or p[1] == p[2] or (clear and (p[1], p[2]) in fits)
    return sum(any(all(map(good, way)) for way in m.ways) for m in chain), len(changed)


def _passages(coverage: float):
    """Over hits sorted by row, item and places: the best passage of each row and item that reaches the coverage."""
    names = ["doc_id", "item_id", "n", "n_windows", "slots_changed"]

    def best(hits: list[tuple]) -> list[tuple]:
        doc_id, item_id, n, k = hits[0][2:6]
        ways: dict[tuple[int, int], list] = defaultdict(list)
        for h in hits:
            ways[h[6], h[7]].append(list(zip(h[10], h[9], h[8], strict=True)))
        matches = [Match(*place, w) for place, w in ways.items()]
        got = [counted(c) for c in chained(matches, n + k - 1, max(1, math.ceil(coverage * n - 1e-9)))]
        top = max(((w, -changed) for w, changed in got), default=(0, 0))
        return [(doc_id, item_id, n, top[0], -top[1])] if top[0] and top[0] >= coverage * n else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, out = [], []
        for batch in batches:
            for hit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and hit[:2] != group[0][:2]:
                    out += best(group)
                    group = []
                group.append(hit)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(5)], names=names)
            out = []
        out = best(group) if group else []
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(5)], names=names)

    return trimmed(run)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, coverage: float = 0.5) -> DataFrame:
    """A row for each document that holds a benchmark item: doc_id, item_id, n_windows (of the item that count, in the passage
    with most of them), coverage (n_windows / the item's windows), slots_changed (slot values of the item that differ there).

    Null and empty texts hold nothing; items without words are never held. Rows with a null id are left out. Rows that repeat
    an id are searched each, and the best passage of all rows with the two ids stands for them: most windows, then fewest
    changed slots. Texts of any length are searched whole. Empty tables give no rows. Other columns are ignored."""
    bound_batches(docs.sparkSession)
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text")).filter("item_id is not null")
    items = items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text")
    items = items.mapInArrow(_item_windows(window), "item long, item_id long, n long, k int, h long, pos long, slots array<long>, name_at array<long>, first_fixed boolean")
    items = cut(items, "items")
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())
    bitmap = bitmap_of(items, "h")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("doc_id is not null")
    found = src.mapInArrow(_doc_windows(sizes, bitmap), "row long, doc_id long, h long, pos long, slots array<long>")
    its = items.select("item", "item_id", "n", "k", "h", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"), "name_at", "first_fixed")
    hits = found.join(its, "h").filter((F.size("slots") == F.size("item_slots")) & (~F.col("first_fixed") | (F.get("slots", F.lit(0)) == F.get("item_slots", F.lit(0)))))
    hits = hits.select("row", "item", "doc_id", "item_id", "n", "k", "pos", "item_pos", "slots", "item_slots", "name_at")
    hits = hits.repartition("row", "item").sortWithinPartitions("row", "item", "pos", "item_pos")
    held = hits.mapInArrow(_passages(coverage), "doc_id long, item_id long, n long, n_windows long, slots_changed long")
    best = F.max_by(F.struct("n", "n_windows", "slots_changed"), F.struct(F.col("n_windows") / F.col("n"), -F.col("slots_changed"), "n"))
    out = held.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")
    return out.select("doc_id", "item_id", "n_windows", (F.col("n_windows") / F.col("n")).alias("coverage"), "slots_changed")


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))
