"""Name -> (Spark query, SQL check)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stampbook.operators.paging import Page
from stampbook.plans.bindings import bound, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


class Tables:
    """Registry tables (attributes) and given tables (``raw``) of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return bound(self.spark, self.folder, name)

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)


def query(name: str, check: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if check is not None:
            CHECKS[name] = check
        return fn

    return register


def page_frame(page: Page, *cols) -> DataFrame:
    """Rows of a page with the total as a column."""
    rows = page.rows.select(*cols) if cols else page.rows
    return rows.withColumn("total", F.lit(page.total).cast("long"))
