"""Incremental runs: what isn't done yet, as an anti-join or as a stream of new files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.operators.select import first_accepted, not_done
from reportloom.sources.io import exists


def resume(todo: DataFrame, out: str, key: str, work: Callable[[DataFrame], DataFrame], restart: bool = False) -> DataFrame:
    """Work on the rows whose key isn't in the Parquet table at out, appended to it; with restart on a table that is there, ValueError."""
    spark = todo.sparkSession
    there = exists(spark, out)
    if there and restart:
        raise ValueError(f"{out} holds results; remove it or resume")
    work(not_done(todo, spark.read.parquet(out).select(key), key) if there else todo).write.mode("append").parquet(out)
    return spark.read.parquet(out)


def results(spark: SparkSession, out: str) -> DataFrame:
    """What the streams below have put down at out."""
    return spark.read.parquet(out).drop("batch_id")


def _stream(spark: SparkSession, source: str, schema: str, checkpoint: str, put: Callable[[DataFrame, int], None], files_a_batch: int | None) -> None:
    reader = spark.readStream.schema(schema)
    rows = (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(source)
    rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def stream_new(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], files_a_batch: int | None = None) -> None:
    """Work on files that have come since the last call; returns when none is left. Each row's result is put down exactly once.

    The results of a batch stand in a folder of its number, written anew if the batch is: one that failed between its writing and
    its commit is read and worked on again, under the same number.
    """
    _stream(spark, source, schema, checkpoint, lambda batch, k: work(batch).write.mode("overwrite").parquet(f"{out}/batch_id={k}"), files_a_batch)


def stream_accepted(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], n: int, accepted: str, *order: str, files_a_batch: int | None = None) -> None:
    """As stream_new, but only accepted rows are put down, and no more than n in all batches: in the order of arrival, within a batch in that of `order`.

    What earlier batches have put down is the state, so it is that of a batch whether it runs once or again; when n are there, the
    rest is read over without work.
    """

    def put(batch: DataFrame, k: int) -> None:
        before = results_before(spark, out, k)
        if before < n:
            first_accepted(work(batch), n - before, accepted, *order).write.mode("overwrite").parquet(f"{out}/batch_id={k}")

    _stream(spark, source, schema, checkpoint, put, files_a_batch)


def results_before(spark: SparkSession, out: str, batch: int) -> int:
    """How many results the batches before one have put down."""
    return spark.read.parquet(out).where(F.col("batch_id") < batch).count() if batch and exists(spark, out) else 0
