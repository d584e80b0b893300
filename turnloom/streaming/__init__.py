"""The operators over streams.

Operators without state take a streaming table as they take any other.  Packing
goes batch by batch: each micro-batch is packed on its own, as a batch job would.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from turnloom.functions.checks import require_columns
from turnloom.operators.tokens import code_points, packed_blocks


def stream_jsonl(spark: SparkSession, folder: str, schema: T.StructType | str, per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    return (r.option("maxFilesPerTrigger", per_trigger) if per_trigger else r).json(folder)


def stream_text(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.text(folder).withColumnRenamed("value", "text")


def each_batch(stream: DataFrame, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Writes ``work`` of every micro-batch, each to a folder of its own number: a batch that runs again after a failure
    overwrites itself, so nothing comes twice."""

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def packed_stream(stream: DataFrame, key: str, text: str, block: int, eos: int, target: str, checkpoint: str) -> StreamingQuery:
    require_columns(stream, key, text)

    def work(batch: DataFrame) -> DataFrame:
        return packed_blocks(batch.select(key, code_points(batch[text]).alias("ids")), key, "ids", block, eos)

    return each_batch(stream, work, target, checkpoint)
