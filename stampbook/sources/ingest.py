"""Resumable batch ingest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stampbook.session import checkpoint_dir
from stampbook.sources.commits import Batches


def pending_items(source: DataFrame, done: DataFrame | None, key: list[str]) -> DataFrame:
    """Source items not yet in the output; failed ones never reach the output, so they come again."""
    return source if done is None else source.join(done.select(*key).distinct(), key, "left_anti")


def loaded(spark: SparkSession, sink: str) -> DataFrame | None:
    """Rows of all committed loads, with the load's number as ``batch``; None before the first."""
    return Batches(spark, sink).read("data")


def open_errors(spark: SparkSession, sink: str, key: list[str]) -> DataFrame | None:
    """The latest error of every key that the output still lacks."""
    batches = Batches(spark, sink)
    failed = batches.read("errors")
    if failed is None:
        return None
    return pending_items(failed.groupBy(*key).agg(F.max_by("error", "batch").alias("error")), batches.read("data"), key)


def ingest_incremental(
    source: DataFrame, sink: str, key: list[str], process: Callable[[DataFrame], DataFrame], dead_letter: str
) -> dict[str, int]:
    """Process what the sink lacks and add it as one batch; rows whose ``error`` is set go to the dead-letter folder instead.

    ``process`` runs once: its result is checkpointed to the shared folder before both writes read it. Rows and errors count from
    one commit on, so a load that fails between its writes leaves nothing behind that a reader sees, and is repeated as a whole.
    """
    spark = source.sparkSession
    checkpoint_dir(spark)
    batches = Batches(spark, sink)
    todo = pending_items(source, batches.read("data"), key)
    made = process(todo).checkpoint()
    counts = made.agg(F.count_if(F.col("error").isNull()), F.count_if(F.col("error").isNotNull())).first()
    number, folders = batches.last() + 1, {}
    if counts[0]:
        folders["data"] = batches.folder(number, "data")
        made.where(F.col("error").isNull()).drop("error").write.mode("overwrite").parquet(folders["data"])
    if counts[1]:
        folders["errors"] = f"{dead_letter.rstrip('/')}/batch={number}"
        made.where(F.col("error").isNotNull()).select(*key, "error").write.mode("overwrite").parquet(folders["errors"])
    if folders:
        batches.publish(number, folders, {"data": counts[0], "errors": counts[1]})
    return {"procesadas": counts[0], "errores": counts[1]}
