"""Numbering a whole table without bringing it into one task."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stampbook.session import checkpoint_dir

#: Rows that one partition can hold by the id function used below.
PLACES = 1 << 33


def joined_numbers(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """``df`` with ``name``: its place by the ``order`` columns (which tell its rows apart) after ``start``.

    Only the key is numbered; wide rows meet their number in a join.
    """
    places = numbered(df.select(*order), [F.col(c).asc_nulls_last() for c in order], "_place")
    places = places.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(order)], (F.col("_place") + start).alias("_place"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(order)])
    out = df.drop(name) if name not in order else df
    found = out.join(places, same).drop(*[f"_k{i}" for i in range(len(order))])
    return found.withColumn(name, F.col("_place")).drop("_place")


def numbered(keys: DataFrame, order: list[Column], name: str = "n", folder: str | None = None) -> DataFrame:
    """``keys`` (a narrow table: ids and sort keys only) with its 1-based place in ``order``, a total order.

    The table is partitioned by range, sorted in each partition, and written once, as a second evaluation could draw other
    range borders (to ``folder``, else to the checkpoint folder). A partition's rows are then shifted by the rows of the partitions before it: one small row per partition.
    """
    spark = keys.sparkSession
    placed = keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    path = f"{(folder or checkpoint_dir(spark)).rstrip('/')}/numbered-{uuid.uuid4().hex}"
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path).withColumn("_part", F.expr(f"_at div {PLACES}L"))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))  # one row per partition of the range exchange
    place = F.col("_before") + F.col("_at") - F.col("_part") * F.lit(PLACES) + 1
    return placed.join(F.broadcast(sizes), "_part").withColumn(name, place).drop("_at", "_part", "_before")
