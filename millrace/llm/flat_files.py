"""Writing files of raw bytes through Spark's text writer, to any store that Spark can write.

The writer puts a row's bytes and then the line separator. All records of a format end with one and the same ASCII byte, so
the row leaves that byte out and the separator supplies it: the files hold exactly the records, with Spark's commit
protocol behind them. binaryFile reads them back.

binaryFile makes one row of a file, and a row can hold 2 GB, so files are bounded by bytes: a task numbers its files, begins
the next one once a file has FILE_BYTES, and the number is a partition column of the folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

FILE_BYTES = 32 << 20
SCHEMA = "value binary, file int"
_BATCH_BYTES = 8 << 20


def numbered(records: Iterator[bytes], file_bytes: int = FILE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches (value, file) of a task's records: a file has file_bytes and one record more at most."""
    value, file, held, number, size = [], [], 0, 0, 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(value, pa.binary()), pa.array(file, pa.int32())], names=["value", "file"])

    for r in records:
        value.append(r), file.append(number)
        held, size = held + len(r), size + len(r) + 1
        if size >= file_bytes:
            number, size = number + 1, 0
        if held > _BATCH_BYTES:
            yield batch()
            value, file, held = [], [], 0
    yield batch()


def write_records(records: DataFrame, path: str, last: str = "\0") -> None:
    """records: (value, file) as of numbered(), the values without their last byte, which is `last`."""
    rows = records.selectExpr("cast(value as string) as value", "file")
    rows.write.partitionBy("file").option("lineSep", last).option("compression", "none").mode("errorifexists").text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of the files, one row each; none if there was nothing to write."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "content")
