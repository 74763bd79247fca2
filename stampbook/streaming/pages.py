"""Incremental page ingest: every micro-batch stores only its own rows, the snapshot is merged on read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from stampbook.operators.changes import PAGE_KEY, protected_upsert
from stampbook.sources.commits import Batches, latest


def _store(batch: DataFrame, batch_id: int, sink: str, dead_letter: str, key: list[str], order: str) -> None:
    rest = [c for c in batch.columns if c not in (*key, "error")]
    good = batch.where(F.col("error").isNull()).groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    batches = Batches(batch.sparkSession, sink)
    if batch_id <= batches.last():
        return  # committed before; only the stream's own checkpoint was missing
    folders = {"data": batches.folder(batch_id, "data"), "errors": f"{dead_letter.rstrip('/')}/batch={batch_id}"}
    batch.persist()  # both writes read the same rows
    # a repeated batch overwrites its own folder, so every key is stored once per batch; it counts from its commit on
    good.select(*key, "_r.*").write.mode("overwrite").parquet(folders["data"])
    failed = batch.where(F.col("error").isNotNull()).select(*key, "error")
    failed.write.mode("overwrite").parquet(folders["errors"])
    batches.publish(batch_id, folders, {})
    batch.unpersist()


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def stream_ingest(
    spark: SparkSession, source: str, schema: T.StructType, sink: str, checkpoint: str, dead_letter: str,
    key: list[str] | None = None, order: str = "orden", fmt: str = "json", files_per_batch: int | None = None,
) -> StreamingQuery:
    """Read new files of ``source`` until none is left. ``schema`` carries an ``error`` column for failed pages.

    ``checkpoint`` and ``sink`` belong together: batch folders are named by the checkpoint's batch numbers. A new checkpoint
    would start from batch 0 and overwrite stored batches, so it is refused where the sink holds any.
    """
    if Batches(spark, sink).last() >= 0 and not _exists(spark, checkpoint):
        raise ValueError(f"{sink} holds batches of another checkpoint")
    keys = key or PAGE_KEY
    reader = spark.readStream.schema(schema).format(fmt)
    stream = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(source)
    return (
        stream.writeStream.foreachBatch(lambda b, i: _store(b, i, sink, dead_letter, keys, order))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def ingested(spark: SparkSession, sink: str, key: list[str] | None = None) -> DataFrame:
    """The latest committed version of every key."""
    return latest(Batches(spark, sink).read("data"), key or PAGE_KEY).drop("batch")


def compact(spark: SparkSession, sink: str, key: list[str] | None = None, clean: bool = True) -> int:
    """Folds the committed batches into one, so that reads no longer grow with their number; between two runs of the stream."""
    return Batches(spark, sink).compact(key or PAGE_KEY, clean=clean)


def current_pages(snapshot: DataFrame, spark: SparkSession, sink: str) -> DataFrame:
    """A stored snapshot with the streamed rows merged in; hand-corrected rows keep their values."""
    return protected_upsert(snapshot, ingested(spark, sink))
