"""Shared plumbing of the training-data operators: intermediate tables, word counts, joins that tolerate missing ids."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stampbook.session import checkpoint_dir

#: Characters that end a word, as a class body and as text.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\x0c\r"
WORD = f"[^{SPACE_CLASS}]+"


_run: ContextVar[Scratch | None] = ContextVar("run", default=None)


#: Rows of an Arrow batch while a run is entered: whole texts are wide, and every task holds a batch on both sides.
ARROW_ROWS, ARROW_CONF = 2048, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: What a run sets while it is entered. Every step is written, so that none needs the shuffle files of one before: they go at
#: once, instead of whenever the driver's memory is cleared.
RUN_CONF = {ARROW_CONF: ARROW_ROWS, "spark.sql.classic.shuffleDependency.fileCleanup.enabled": True}


class Scratch:
    """The folder of one run: what the run writes while it is entered lies there, and its owner removes it as a whole.

    The run entered last counts, for each thread apart, so that runs side by side never touch each other's tables. Meanwhile
    ``RUN_CONF`` holds for the session (for all its threads; no result depends on it).
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, _new(spark, name)

    def __enter__(self) -> Scratch:
        self.token, self.before = _run.set(self), {key: self.spark.conf.get(key) for key in RUN_CONF}
        for key, value in RUN_CONF.items():
            self.spark.conf.set(key, value)
        return self

    def __exit__(self, *_) -> None:
        _run.reset(self.token)
        for key, value in self.before.items():
            self.spark.conf.set(key, value)

    def remove(self) -> None:
        """Only once nothing reads the run's tables any more."""
        remove(self.spark, self.path)


def _new(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/stampbook-llm/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def scratch_folder(spark: SparkSession) -> str:
    """Where the current run writes: its own folder, else the shared one."""
    run = _run.get()
    return run.path if run else f"{checkpoint_dir(spark).rstrip('/')}/stampbook-llm"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the current run's folder, which driver and executors share."""
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def tidy(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query that leaves its written result and nothing else in the shared folder."""

    @wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        with Scratch(spark, query.__name__) as scratch:
            out = query(spark, folder)
            path = _new(spark, f"{query.__name__}-result")
            out.write.parquet(path)
        scratch.remove()
        return spark.read.schema(out.schema).parquet(path)

    return run


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to hold at most ``max_rows`` rows; else left to a shuffled join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def words_of(text: Column) -> Column:
    """Words of a text (missing: none), in order."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE_CLASS}]+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words (missing: 0), without building the words twice."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE_CLASS}]+", " "))
    spaces = F.length(trimmed) - F.length(F.translate(trimmed, " ", ""))
    return F.when(trimmed == "", F.lit(0)).otherwise(spaces + 1).cast("long")
