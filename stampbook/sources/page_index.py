"""JSON-lines page index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stampbook.schemas import PAGINAS


def _raw(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    return spark.read.schema(full).json(path, columnNameOfCorruptRecord="_corrupt")


def read_page_index(spark: SparkSession, path: str, schema: T.StructType = PAGINAS) -> DataFrame:
    """Pages of the index; blank, unreadable and error lines are left out. Sort by (carpeta, orden) to list them."""
    ok = F.col("_corrupt").isNull() & F.col("error").isNull() & F.col("archivo").isNotNull()
    return _raw(spark, path, schema).where(ok).drop("_corrupt", "error")


def read_page_errors(spark: SparkSession, path: str, schema: T.StructType = PAGINAS) -> DataFrame:
    """Lines that report an error or cannot be read, to be tried again."""
    bad = F.col("_corrupt").isNotNull() | F.col("error").isNotNull()
    return _raw(spark, path, schema).where(bad).select("carpeta", "archivo", F.coalesce("error", F.lit("corrupt")).alias("error"))
