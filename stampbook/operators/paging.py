"""Listings: pages with totals, keyset pages, samples and point lookups."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stampbook.operators.numbering import numbered
from stampbook.operators.ordering import Key, keys_of, sorts, top_n

# a top-k this small is cheap even when thousands of input partitions each offer their own
TAKE_ROWS = 2_000


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    total: int
    page: int
    last: int


def paginate(df: DataFrame, order, page: int, size: int, clamp: bool = True) -> Page:
    """One page of an ordered listing and the total. ``order`` needs a unique last key.

    Pages near either end are a bounded top-k. For a page deep in the middle only the sort keys are numbered, by range
    partitions; the rows of the page (``size`` at most) then meet their whole rows.
    """
    total = df.count()
    last = max(1, -(-total // size))
    page = max(1, page)
    if clamp:
        page = min(page, last)
    keys, skip = keys_of(order), (page - 1) * size
    here = max(0, min(size, total - skip))
    if not here:
        rows = df.limit(0)
    elif skip + here <= TAKE_ROWS:
        rows = df.orderBy(*sorts(keys)).offset(skip).limit(size)
    elif total - skip <= TAKE_ROWS:
        tail = df.orderBy(*sorts([k.reversed() for k in keys])).limit(total - skip)
        rows = tail.orderBy(*sorts(keys)).limit(size)
    else:
        names = [k.name for k in keys]
        places = numbered(df.select(*names), sorts(keys), "_n").where((F.col("_n") > skip) & (F.col("_n") <= skip + size))
        wanted = F.broadcast(places.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(names)]))  # size rows
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(names)])
        rows = df.join(wanted, same, "left_semi").orderBy(*sorts(keys))
    return Page(rows, total, page, last)


def in_order(rows: DataFrame, key: str) -> DataFrame:
    """The few rows of a page, joined after they were cut, by a key that tells them apart.

    A second sort above the joins was seen to be dropped at run time, as the cut below had the same order.
    """
    item = F.struct(F.col(key).alias("k"), F.struct(*rows.columns).alias("r"))
    return rows.agg(F.array_sort(F.collect_list(item)).alias("a")).select(F.explode("a").alias("x")).select("x.r.*")


def keyset_page(df: DataFrame, key: str, last, n: int) -> DataFrame:
    """The next ``n`` rows after ``last``; the key comparison reaches the scan."""
    return df.where(F.col(key) > F.lit(last)).orderBy(key).limit(n)


def get(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def stratified_sample(files: DataFrame, n: int, seed: int, path: str = "path") -> DataFrame:
    """``n`` files dealt evenly over their folders, the same ones for the same seed.

    Round ``k`` takes the k-th file of every folder in the order of a seeded hash. No folder can give more than ``n``, so each
    input partition forwards at most ``n`` rows per folder.
    """
    folder = F.regexp_replace(path, "/?[^/]*$", "")
    def draw(c):
        return F.md5(F.concat_ws("#", c, F.lit(str(seed))))

    drawn = files.withColumns({"_dir": folder, "_h": draw(F.col(path)), "_d": draw(folder)})
    dealt = top_n(drawn, ["_dir"], [Key("_h"), Key(path)], n, "_round")
    return dealt.orderBy("_round", "_d", "_dir", path).limit(n).select(*files.columns)
