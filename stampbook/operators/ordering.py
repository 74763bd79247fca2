"""Sort keys with the registry's null placement, and running computations that survive hot groups.

``scan`` evaluates row numbers, running sums, carried values and neighbours inside ordered groups. Small groups are
plain windows. A group too large for one task is cut into ordered pieces at sampled split values; every piece is its own
window partition and receives the state left by the pieces before it from a small broadcast frame.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT_ROWS_CONF = "stampbook.hotGroupRows"
HOT_ROWS = 2_000_000
MAX_PIECES = 10_000
SAMPLES_PER_PIECE = 8
FINE = 100


@dataclass(frozen=True)
class Key:
    """One sort key. Missing values go last ascending and first descending unless stated."""

    name: str
    desc: bool = False
    nulls_first: bool | None = None

    @property
    def _nulls_first(self) -> bool:
        return self.desc if self.nulls_first is None else self.nulls_first

    def sort(self) -> Column:
        c = F.col(self.name)
        if self.desc:
            return c.desc_nulls_first() if self._nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self._nulls_first else c.asc_nulls_last()

    def reversed(self) -> "Key":
        return Key(self.name, not self.desc, not self._nulls_first)

    def after(self, value: Column, pivot: Column) -> Column:
        """True when ``value`` sorts strictly after ``pivot`` under this key."""
        bigger = value < pivot if self.desc else value > pivot
        if self._nulls_first:
            return value.isNotNull() & (pivot.isNull() | F.coalesce(bigger, F.lit(False)))
        return pivot.isNotNull() & (value.isNull() | F.coalesce(bigger, F.lit(False)))


def keys_of(order) -> list[Key]:
    return [k if isinstance(k, Key) else Key(k) for k in order]


def sorts(order) -> list[Column]:
    return [k.sort() for k in keys_of(order)]


def _after(order: list[Key], row: Column, pivot: Column) -> Column:
    tests, tie = [], F.lit(True)
    for i, k in enumerate(order):
        v, p = row[f"c{i}"], pivot[f"c{i}"]
        tests.append(tie & k.after(v, p))
        tie = tie & v.eqNullSafe(p)
    return reduce(lambda a, b: a | b, tests)


def null_safe_join(left: DataFrame, right: DataFrame, names: list[str], how: str) -> DataFrame:
    """Null-safe equi-join that keeps the left copy of the key columns."""
    renamed = right.select(*[F.col(n).alias(f"_r_{n}") for n in names], *[c for c in right.columns if c not in names])
    cond = reduce(lambda a, b: a & b, [left[n].eqNullSafe(renamed[f"_r_{n}"]) for n in names])
    return left.join(renamed, cond, how).drop(*[f"_r_{n}" for n in names])


def _hot_limit(df: DataFrame, hot_rows: int | None) -> int:
    if hot_rows:
        return hot_rows
    return int(df.sparkSession.conf.get(HOT_ROWS_CONF, str(HOT_ROWS)))


def all_small(df: DataFrame, keys, hot_rows: int | None = None) -> bool:
    """True when no group of ``df`` exceeds the hot limit: one column-pruned count, combined before its shuffle.

    Operators ask it once of their widest input and pass the answer to every ``scan`` over groups that cannot be larger.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return (sizes.agg(F.max("_n")).first()[0] or 0) <= _hot_limit(df, hot_rows)


def _with_pieces(df: DataFrame, keys: list[str], order: list[Key], hot_rows: int | None) -> DataFrame | None:
    """``df`` plus ``_piece`` (-1 for groups left whole), or None when no group is hot.

    At most ``MAX_PIECES`` split values exist in total, whatever the input size, so both the driver list and the
    broadcast are bounded. Split values only balance the pieces: results do not depend on which were sampled.
    """
    spark, limit = df.sparkSession, _hot_limit(df, hot_rows)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total, largest = sizes.agg(F.sum("_n"), F.max("_n")).first()
    if not total or largest <= limit:
        return None
    target = max(limit, -(-total // MAX_PIECES))
    hot = sizes.where(F.col("_n") > target)
    sample = df.sample(fraction=min(1.0, SAMPLES_PER_PIECE / target), seed=17)
    names = [k.name for k in order]
    drawn = (
        null_safe_join(sample.select(*dict.fromkeys(keys + names)), F.broadcast(hot), keys, "inner")
        .groupBy(*keys, F.struct(*[F.col(n).alias(f"c{i}") for i, n in enumerate(names)]).alias("_v"), "_n")
        .agg(F.count(F.lit(1)).alias("_w"))
        .orderBy(*keys, *[_field_sort(k, i) for i, k in enumerate(order)])
        .collect()
    )
    groups: dict[tuple, tuple[int, list]] = {}
    for r in drawn:
        groups.setdefault(tuple(r[k] for k in keys), (r["_n"], []))[1].append((r["_v"], r["_w"]))
    rows = []
    for group, (n, values) in groups.items():
        step = sum(w for _, w in values) / max(1, n // target + 1)
        splits, seen, due = [], 0, step
        for value, weight in values:
            seen += weight
            if seen >= due:
                splits.append(value)
                due = seen + step
        fine = [splits[i : i + FINE] for i in range(0, len(splits), FINE)] or [[]]
        rows.append((*group, [f[-1] for f in fine if f], fine))
    types = {f.name: f.dataType for f in df.schema.fields}
    value_type = T.StructType([T.StructField(f"c{i}", types[n]) for i, n in enumerate(names)])
    schema = T.StructType(
        [T.StructField(k, types[k]) for k in keys]
        + [
            T.StructField("_coarse", T.ArrayType(value_type)),
            T.StructField("_fine", T.ArrayType(T.ArrayType(value_type))),
        ]
    )
    splits_frame = F.broadcast(spark.createDataFrame(rows, schema))
    row = F.struct(*[F.col(n).alias(f"c{i}") for i, n in enumerate(names)])
    block = F.size(F.filter("_coarse", lambda s: _after(order, row, s)))
    inside = F.coalesce(F.try_element_at("_fine", block + 1), F.array().cast(T.ArrayType(value_type)))
    piece = block * FINE + F.size(F.filter(inside, lambda s: _after(order, row, s)))
    tagged = null_safe_join(df, splits_frame, keys, "left")
    return tagged.withColumn("_piece", F.when(F.col("_coarse").isNull(), -1).otherwise(piece)).drop("_coarse", "_fine")


def split(df: DataFrame, keys, order, hot_rows: int | None = None, small: bool = False) -> tuple[DataFrame, bool]:
    """(frame, small) for several scans over the same groups: hot groups are cut once and every scan reuses ``_piece``."""
    pieces = None if small else _with_pieces(df, list(keys), keys_of(order), hot_rows)
    return (df, True) if pieces is None else (pieces, False)


def _field_sort(k: Key, i: int) -> Column:
    c = F.col("_v")[f"c{i}"]
    if k.desc:
        return c.desc_nulls_first() if k._nulls_first else c.desc_nulls_last()
    return c.asc_nulls_first() if k._nulls_first else c.asc_nulls_last()


def _local(kind: str, c: Column | None, w) -> Column:
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    through = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if kind == "row_number":
        return F.row_number().over(w).cast("long")
    if kind == "sum":
        return F.coalesce(F.sum(c).over(through), F.lit(0))
    if kind == "max":
        return F.max(c).over(through)
    if kind == "last":
        return F.last(c, ignorenulls=True).over(through)
    if kind == "last_before":
        return F.last(c, ignorenulls=True).over(before)
    if kind == "lag":
        return F.lag(c).over(w)
    if kind == "lead":
        return F.lead(c).over(w)
    raise ValueError(f"unknown scan kind {kind!r}")


def scan(df: DataFrame, keys, order, outputs: dict, hot_rows: int | None = None, small: bool = False) -> DataFrame:
    """Add ordered-group columns: ``outputs`` maps a new name to ``(kind, column)``.

    Kinds: row_number, sum and max (running, inclusive), last and last_before (last non-null value through / before the
    row), lag, lead. ``order`` must be unique inside a group for a defined result.
    """
    keys, order = list(keys), keys_of(order)
    added = []
    if not keys:
        df, keys, added = df.withColumn("_all", F.lit(0)), ["_all"], ["_all"]
    if "_piece" in df.columns:
        pieces = df
    else:
        pieces = None if small else _with_pieces(df, keys, order, hot_rows)
    if pieces is None:
        w = Window.partitionBy(*keys).orderBy(*sorts(order))
        return df.select("*", *[_local(k, c, w).alias(n) for n, (k, c) in outputs.items()]).drop(*added)

    w = Window.partitionBy(*keys, "_piece").orderBy(*sorts(order))
    local = pieces.select(
        "*",
        *[_local(k, c, w).alias(f"_l_{n}") for n, (k, c) in outputs.items()],
        *[_local("last", c, w).alias(f"_e_{n}") for n, (k, c) in outputs.items() if k == "last_before"],
        *[F.struct(c.alias("v")).alias(f"_e_{n}") for n, (k, c) in outputs.items() if k in ("lag", "lead")],
        F.row_number().over(w).alias("_rn"),
        F.lead(F.lit(1)).over(w).isNull().alias("_end"),
    )
    edge, state, carried = [], [], Window.partitionBy(*keys).orderBy("_piece")
    earlier = carried.rowsBetween(Window.unboundedPreceding, -1)
    for n, (k, _) in outputs.items():
        own = f"_e_{n}" if k in ("last_before", "lag", "lead") else f"_l_{n}"
        at = F.col("_rn") == 1 if k == "lead" else F.col("_end")
        edge.append(F.max(F.when(at, F.col(own))).alias(f"_s_{n}"))
        s = F.col(f"_s_{n}")
        if k in ("row_number", "sum"):
            state.append(F.sum(s).over(earlier).alias(f"_c_{n}"))
        elif k == "max":
            state.append(F.max(s).over(earlier).alias(f"_c_{n}"))
        elif k in ("last", "last_before"):
            state.append(F.last(s, ignorenulls=True).over(earlier).alias(f"_c_{n}"))
        elif k == "lag":
            state.append(F.lag(s).over(carried).alias(f"_c_{n}"))
        else:
            state.append(F.lead(s).over(carried).alias(f"_c_{n}"))
    edges = local.where((F.col("_piece") >= 0) & ((F.col("_rn") == 1) | F.col("_end"))).groupBy(*keys, "_piece").agg(*edge)
    carry = F.broadcast(edges.select(*keys, "_piece", *state))
    joined = null_safe_join(local, carry, keys + ["_piece"], "left")
    out = []
    for n, (k, _) in outputs.items():
        mine, given = F.col(f"_l_{n}"), F.col(f"_c_{n}")
        if k in ("row_number", "sum"):
            value = mine + F.coalesce(given, F.lit(0))
        elif k == "max":
            value = F.greatest(mine, given)
        elif k in ("last", "last_before"):
            value = F.coalesce(mine, given)
        else:
            value = F.when(F.col("_rn") == 1 if k == "lag" else F.col("_end"), given["v"]).otherwise(mine)
        out.append(value.alias(n))
    return joined.select(*[c for c in df.columns if c not in added], *out)


def ranked(
    df: DataFrame, keys, order, name: str = "posicion_n", hot_rows: int | None = None, small: bool = False
) -> DataFrame:
    """Row number inside each group (or over the whole frame when ``keys`` is empty)."""
    return scan(df, keys, order, {name: ("row_number", None)}, hot_rows, small)


def top_n(df: DataFrame, keys, order, n: int, name: str = "rn") -> DataFrame:
    """First ``n`` rows per group; Spark limits every input partition before the shuffle, so hot groups stay small."""
    w = Window.partitionBy(*keys).orderBy(*sorts(order))
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


MAX_DEALT = 10_000


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """``df`` dealt over tasks of about ``rows`` rows each, for costly work on narrow rows: a file of one row group is one task."""
    return df.repartition(max(1, min(MAX_DEALT, -(-df.count() // rows))))


NULL_SPREAD = 64


def lookup(left: DataFrame, right: DataFrame, key: str, spread_by: str) -> DataFrame:
    """Left join on ``key`` whose missing keys do not pile up in one partition.

    A missing key can match nothing, so those rows carry one of ``NULL_SPREAD`` salts derived from ``spread_by``; all
    others keep salt 0. The right side repeats salt 0 from its key column, which keeps the salt part of the shuffle key.
    """
    salt = F.when(left[key].isNull(), F.pmod(F.xxhash64(left[spread_by]), F.lit(NULL_SPREAD)) + 1).otherwise(F.lit(0).cast("long"))
    zero = F.when(right[key].isNotNull(), F.lit(0).cast("long")).otherwise(F.lit(-1).cast("long"))
    salted = left.withColumn("_salt", salt)
    return salted.join(right.withColumn("_salt", zero), [key, "_salt"], "left").drop("_salt")


def packed(df: DataFrame, keys, order, item: Column, size: int, name: str) -> DataFrame:
    """Ordered nested lists of at most ``size`` items; a longer group continues on further rows (``parte``)."""
    keys = list(keys)
    numbered = ranked(df, keys, order, "_n")
    return (
        numbered.groupBy(*keys, F.floor((F.col("_n") - 1) / size).cast("int").alias("parte"))
        .agg(F.array_sort(F.collect_list(F.struct(F.col("_n").alias("n"), item.alias("v")))).alias("_list"))
        .select(*keys, "parte", F.transform("_list", lambda x: x["v"]).alias(name))
    )


def read_order(df: DataFrame, name: str) -> DataFrame:
    """``df`` with ``name``, a sortable column: where its rows stand in the files they come from, however the table is partitioned.

    Parquet knows the row in the file; other files give the start of the split and the row in it (so order them before they are
    repartitioned). Frames that come from no file have no order of their own: their rows sort by their values.
    """
    for place in (["file_path", "row_index"], ["file_path", "file_block_start"]):
        try:
            df.select(*[F.col(f"_metadata.{c}") for c in place])
        except AnalysisException:
            continue
        parts = [F.col(f"_metadata.{c}").alias(c) for c in place]
        return df.select("*", F.struct(*parts, *([] if "row_index" in place else [F.monotonically_increasing_id().alias("at")])).alias(name))
    return df.withColumn(name, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))
