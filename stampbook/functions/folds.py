"""Folds over an array held in one row (positions or boxes of one page), for rules whose state no window can carry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once per row, also where the body is used inside another lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def longest_regular_run(positions: Column, tolerance: float = 0.15) -> Column:
    """Longest stretch of evenly spaced positions; a stretch follows the first gap it opened with."""
    return let(F.array_sort(positions.cast("array<double>")), lambda pts: _longest_run(pts, tolerance))


def _longest_run(pts: Column, tolerance: float) -> Column:
    gaps = F.zip_with(F.slice(pts, 1, F.greatest(F.size(pts) - 1, F.lit(0))), F.slice(pts, 2, F.size(pts)), lambda a, b: b - a)
    # state: index of the current gap, start and base gap of the open run, start and length of the best closed run
    start = F.struct(
        F.lit(0).alias("i"), F.lit(0).alias("s"), F.lit(None).cast("double").alias("base"),
        F.lit(0).alias("bs"), F.lit(0).alias("bl"),
    )

    def step(acc: Column, gap: Column) -> Column:
        joins = acc["base"].isNotNull() & (F.abs(gap - acc["base"]) <= acc["base"] * tolerance)
        first = F.when(joins, acc["s"]).otherwise(acc["i"])
        length = acc["i"] - first + 1
        better = length > acc["bl"]
        return F.struct(
            (acc["i"] + 1).alias("i"), first.alias("s"), F.when(joins, acc["base"]).otherwise(gap).alias("base"),
            F.when(better, first).otherwise(acc["bs"]).alias("bs"),
            F.when(better, length).otherwise(acc["bl"]).alias("bl"),
        )

    run = F.aggregate(gaps, start, step, lambda acc: F.slice(pts, acc["bs"] + 1, acc["bl"] + 1))
    return F.when(F.size(pts) < 3, pts).otherwise(run)


def half_median(values: Column) -> Column:
    """Half of the upper median, the row tolerance used when none is given."""
    ordered = F.array_sort(values)
    return F.element_at(ordered, (F.floor(F.size(ordered) / 2) + 1).cast("int")) * 0.5


def half_true_median(values: Column) -> Column:
    """Half of the median, the middle two averaged when the count is even."""
    ordered, n = F.array_sort(values), F.size(values)
    low = F.element_at(ordered, F.floor((n - 1) / 2).cast("int") + 1)
    high = F.element_at(ordered, F.floor(n / 2).cast("int") + 1)
    return (low + high) / 4.0


def assign_rows(boxes: Column, level: str, tolerance: Column, descending: bool, reference: str | None = None) -> Column:
    """Number the rows of a page: a box joins the open row while it stays within the tolerance of the row's first box.

    ``boxes`` is an array of structs; ``level`` sorts them (top of page first when ``descending``) and ``reference`` is
    the field compared with the row's first box. The result is the array with ``fila`` added, in visiting order.
    """
    reference = reference or level
    sign = -1.0 if descending else 1.0
    ordered = F.transform(
        F.array_sort(F.transform(boxes, lambda b: F.struct((b[level] * sign).alias("k"), b["i"].alias("i"), b.alias("b")))),
        lambda x: x["b"],
    )
    start = F.struct(F.lit(None).cast("double").alias("anchor"), tolerance.cast("double").alias("tol"), F.lit(0).alias("k"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, value: Column) -> Column:
        joins = acc["anchor"].isNotNull() & (F.abs(value - acc["anchor"]) <= acc["tol"])
        return F.struct(
            F.when(joins, acc["anchor"]).otherwise(value).alias("anchor"), acc["tol"].alias("tol"), (acc["k"] + 1).alias("k"),
            F.when(joins, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(acc["k"]))).alias("starts"),
        )

    # the fold carries where rows start, not the boxes, so that its state grows with the rows only
    def numbered(both: Column) -> Column:
        return F.transform(both["b"], lambda b, i: b.withField("fila", F.size(F.filter(both["s"], lambda s: s <= i))))

    starts = F.aggregate(F.transform(ordered, lambda b: b[reference].cast("double")), start, step, lambda acc: acc["starts"])
    return let(F.struct(ordered.alias("b"), starts.alias("s")), numbered)
