"""Append-and-resume as a stream: new input files are answered once each, whatever fails meanwhile."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def answer_new(spark: SparkSession, source: str, schema: str, output: str, checkpoint: str, key: str, answer: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Process the files that the checkpoint has not seen and stop. Keys of earlier files are known from the stream's state, so no
    batch reads what others have written; a batch that runs again replaces its own folder `batch=<number>` of the output."""

    def batch(rows: DataFrame, number: int) -> None:
        answer(rows).write.mode("overwrite").parquet(f"{output}/batch={number}")

    stream = spark.readStream.schema(schema).json(source).dropDuplicates([key])
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
