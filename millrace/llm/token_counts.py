"""Token counts of the documents in flat, unindexed token files, by a separator scan.

A file is a run of 16-bit big-endian ids; every document is five marker ids (its doc_id in 13-bit digits, counted from the
first id above the end-of-document id), its tokens, and the end-of-document id. Files are cut into blocks of equal size. Each block is searched for separators with
one vectorised comparison, knowing nothing of its neighbours; it reports the documents inside it and the pieces at its
ends. A prefix scan over a file's blocks numbers the separators and stitches pieces to documents across any number of blocks.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import bound_batches, new_path
from millrace.llm.flat_files import FILE_BYTES, SCHEMA, numbered, read_files, write_records

TOKENIZERS = "/opt/tokenizers"
#: The public pattern that splits a text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
EOD = 50256
ID = np.dtype(">u2")
MARK, DIGIT, DIGITS = EOD + 1, 13, 5
#: The last byte of the end-of-document id, written as the separator of records.
LAST = chr(EOD & 0xFF)
BLOCK_IDS = 1 << 18
#: A longer run of white space goes to the encoder as a piece of its own; the pattern would need a stack as deep as the run.
LONG_RUN = 4096
#: What \\s means in the pattern: the characters with Unicode's property White_Space (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def load_encoder(folder: str, ranks: str = "byte_bpe_50k.tiktoken"):
    import tiktoken

    with open(f"{folder}/{ranks}", "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def marker(doc_id: int | None) -> np.ndarray:
    n = (1 << 64) if doc_id is None else doc_id & (1 << 64) - 1
    return np.array([MARK + (n >> DIGIT * k & (1 << DIGIT) - 1) for k in reversed(range(DIGITS))], ID)


def from_marker(digits) -> int | None:
    n = sum((int(d) - MARK) << DIGIT * k for d, k in zip(digits, reversed(range(DIGITS)), strict=True))
    return None if n >> 64 else n - (1 << 64) if n >> 63 else n


def encoded(encoder, text: str, longest: int = LONG_RUN) -> list[int]:
    """The ids of encode_ordinary(), for runs of white space of any length.

    A run of two or more is a piece of the pattern without its last character, or whole at the end of the text. What stands
    before it and what begins with its last character is split by the pattern without looking at the run."""
    out, at = [], 0
    for run in re.finditer(f"[{WHITE}]{{{max(2, longest)},}}", text):
        end = run.end() - (run.end() < len(text))
        out += encoder.encode_ordinary(text[at : run.start()])
        out += encoder._encode_single_piece(run[0][: end - run.start()])
        at = end
    return out + encoder.encode_ordinary(text[at:])


def _records(folder: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(folder)
        if encoder.max_token_value >= EOD:
            raise ValueError("the vocabulary's ids reach the end-of-document id")
        end = np.array([EOD], ID).tobytes()[:-1]

        def records() -> Iterator[bytes]:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    yield marker(doc_id).tobytes() + np.array(encoded(encoder, text.as_py() or ""), ID).tobytes() + end

        return numbered(records(), file_bytes)

    return run


def write_token_files(docs: DataFrame, path: str, folder: str = TOKENIZERS, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> None:
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    write_records(src.mapInArrow(_records(folder, file_bytes), SCHEMA), path, LAST)


def scan_block(block: np.ndarray) -> tuple[int, list, list, list, list, int, int]:
    """Separators; marker ids and tokens of the piece before the first and after the last; whole documents between."""
    at = np.flatnonzero(block == EOD)
    mark = np.flatnonzero(block >= MARK)
    lo, hi = (at[0], at[-1] + 1) if len(at) else (len(block), len(block))
    head, tail = block[mark[mark < lo]].tolist(), block[mark[mark >= hi]].tolist()
    n_head, n_tail = int(lo) - len(head), max(0, len(block) - int(hi)) - len(tail)
    starts, ends = (at[:-1] + 1, at[1:]) if len(at) > 1 else (at[:0], at[:0])
    ids = [from_marker(block[s : s + DIGITS]) for s in starts]
    return len(at), head, tail, ids, (ends - starts - DIGITS).tolist(), n_head, n_tail


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "block", "n_sep", "head", "tail", "ids", "counts", "n_head", "n_tail"]
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 4, pa.int64(), pa.int64()]
    for batch in batches:
        rows = [scan_block(np.frombuffer(b.as_buffer(), ID).astype(np.uint16)) for b in batch.column(2)]
        cols = [batch.column(0).to_pylist(), batch.column(1).to_pylist(), *map(list, zip(*rows, strict=True))] if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)


def count_tokens(spark: SparkSession, path: str, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(doc_id, n_tokens) of every document in the token files under path; separators and markers are not tokens."""
    size = block_ids * ID.itemsize
    files = read_files(spark, path)
    n_blocks = F.greatest(F.ceil(F.col("length") / size), F.lit(1)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda i: F.struct(i.cast("long").alias("block"), F.substring(F.col("content"), i * size + 1, F.lit(size)).alias("ids")))
    blocks = files.select("path", F.explode(pieces).alias("b")).select("path", "b.block", "b.ids")
    schema = "path string, block long, n_sep long, head array<long>, tail array<long>, ids array<long>, counts array<long>, n_head long, n_tail long"
    scans = blocks.mapInArrow(_scan, schema)
    # Pieces: a head belongs to the separators before its block, a tail to those up to its end.
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scans = scans.withColumn("before", F.coalesce(F.sum("n_sep").over(before), F.lit(0)))
    inside = scans.select(F.explode(F.arrays_zip("ids", "counts")).alias("d")).select(F.col("d.ids").alias("doc_id"), F.col("d.counts").alias("n_tokens"))
    head = scans.select("path", "block", F.lit(0).alias("part"), F.col("before").alias("document"), F.col("head").alias("marks"), F.col("n_head").alias("n"), (F.col("n_sep") > 0).alias("closed"))
    tail = scans.filter("n_sep > 0").select("path", "block", F.lit(1).alias("part"), (F.col("before") + F.col("n_sep")).alias("document"), F.col("tail").alias("marks"), F.col("n_tail").alias("n"), F.lit(False).alias("closed"))
    pieces = head.union(tail).groupBy("path", "document").agg(
        F.sum("n").alias("n_tokens"), F.max("closed").alias("closed"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("block", "part", "marks"))), lambda p: p["marks"])).alias("m")
    )
    doc_id = F.lit(0).cast("long")
    for k in range(DIGITS):
        doc_id = F.shiftleft(doc_id, DIGIT).bitwiseOR(F.col("m")[k] - MARK)
    doc_id = F.when(F.col("m")[0] - MARK < (1 << 64 - DIGIT * (DIGITS - 1)), doc_id)
    stitched = pieces.filter("closed").select(doc_id.alias("doc_id"), "n_tokens")
    return inside.union(stitched)


def token_counts(docs: DataFrame, folder: str = TOKENIZERS, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(doc_id, n_tokens) per input row, by writing flat token files to the shared folder and scanning them.

    Null and empty texts have 0 tokens; null and repeated ids keep rows of their own; an empty table gives no rows. The
    tokenizer never takes text for a special token, so no text holds the separator. A text has fewer than 2^30 tokens, as
    its record is one value of a row; runs of white space may have any length. Other columns are ignored."""
    bound_batches(docs.sparkSession)
    path = new_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, folder, id_col, text_col, file_bytes)
    return count_tokens(docs.sparkSession, path, block_ids)


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
