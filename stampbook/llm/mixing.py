"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stampbook.llm.common import n_words, small_broadcast, written
from stampbook.operators.numbering import numbered

#: Ranks are cut into so many bins at a time until the bin that holds a source's border is small.
BINS = 4096
BORDER_ROWS = 20_000
MAX_LEVELS = 4
BROADCAST_ROWS = 100_000


def shared_out(sources: DataFrame, ceiling: float) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target``: all sizes shared by weight; no target above ``ceiling`` times
    its source's size, the excess going to the others by weight until none is above."""
    capped = F.lit(False)
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    n_capped, level = -1, 0.0
    while True:
        row = sources.agg(F.sum(F.when(capped, 1).otherwise(0)).alias("n"), F.sum(F.when(capped, F.col("source_size")).otherwise(0)).alias("words"), F.sum(F.when(~capped, F.col("weight")).otherwise(0)).alias("weight")).first()
        if (row.n or 0) == n_capped:
            break
        n_capped = row.n or 0
        level = (total - ceiling * (row.words or 0)) / row.weight if row.weight else 0.0
        capped = capped | (F.col("weight") * F.lit(level) > F.col("source_size") * F.lit(float(ceiling)))
    return sources.withColumn("target", F.when(capped, F.col("source_size") * F.lit(float(ceiling))).otherwise(F.col("weight") * F.lit(float(level))))


def _cumulated(bins: DataFrame) -> DataFrame:
    """Per source the bin in which the words still wanted are reached, with the words of the bins before it."""
    w = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = bins.withColumn("up_to", F.sum("words").over(w))
    return bins.where("up_to >= wanted").groupBy("source", "wanted").agg(F.min_by(F.struct("bin", (F.col("up_to") - F.col("words")).alias("before"), "rows"), "bin").alias("x")).select("source", F.col("x.bin").alias("border"), (F.col("wanted") - F.col("x.before")).alias("left"), F.col("x.rows").alias("border_rows"))


def mix(docs: DataFrame, sources: DataFrame, ceiling: int = 3, seed: int = 17, sized: DataFrame | None = None) -> DataFrame:
    """How many words the mix takes of each document so that every source comes near its share.

    ``docs``: doc_id, source, text. ``sources``: source, weight (a missing source is a source of its own). A source's target over
    its size is the expected number of copies of each of its documents: the whole part is taken for certain, the fraction f is
    the inclusion probability of one more copy. Documents are ranked by u / (1 - u) over f / (1 - f), u uniform by a hash of
    id, text and seed, and taken in that order until the words come nearest to the target: the sample's size is fixed, not
    its expectation. As borders are found in histograms of ranks, level by level, no source is ever sorted in one task.

    Result: doc_id, size, source_size, target, taken, source, copies, text_hash; one row per input row. Sizes are numbers of words; a
    missing text has 0. Sources without words have target 0. Equal rows (same id and text) tie and are interchangeable.
    An empty table gives an empty result. Other columns are ignored.
    """
    if sized is None:
        sized = measured(docs)
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weights = sources.select("source", "weight").withColumnRenamed("source", "_of")
    per = per.join(weights, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    per = written(shared_out(written(per, "sources"), ceiling), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    per = per.withColumns({"whole": whole, "part": rate - whole, "wanted": F.col("target") - whole * F.col("source_size")})
    per = small_broadcast(per, BROADCAST_ROWS)

    known = per.withColumnRenamed("source", "_of")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), 11) + F.lit(0.5)) * F.lit(2.0**-53)
    odds = (u / (1 - u)) / (F.col("part") / (1 - F.col("part")))
    open_ = sized.join(known, F.col("source").eqNullSafe(F.col("_of"))).drop("_of").withColumn("rank", F.when(F.col("part") > 0, odds / (1 + odds)))
    decided = [open_.where("rank IS NULL").withColumn("more", F.lit(0))]
    open_ = open_.where("rank IS NOT NULL")
    for level in range(1, MAX_LEVELS + 1):
        open_ = open_.withColumn("bin", (F.floor(F.col("rank") * F.lit(float(BINS) ** level)) % BINS).cast("int"))
        bins = open_.groupBy(F.coalesce("source", F.lit("")).alias("source"), F.col("source").isNull().alias("none"), "bin", "wanted").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
        bins = bins.select(F.struct("source", "none").alias("source"), "bin", "wanted", "words", "rows")
        borders = written(_cumulated(bins), "borders")
        border = small_broadcast(borders.select(F.col("source.source").alias("_s"), F.col("source.none").alias("_n"), "border", "left"), BROADCAST_ROWS)
        same = (F.coalesce("source", F.lit("")) == F.col("_s")) & (F.col("source").isNull() == F.col("_n"))
        open_ = open_.join(border, same, "left").drop("_s", "_n")
        # without a border the whole source is wanted
        decided.append(open_.where("border IS NULL OR bin <> border").withColumn("more", F.when(F.col("border").isNull() | (F.col("bin") < F.col("border")), 1).otherwise(0)))
        open_ = open_.where("bin = border").withColumn("wanted", F.col("left")).drop("bin", "border", "left")
        if (borders.agg(F.max("border_rows")).first()[0] or 0) <= BORDER_ROWS:
            break
    w = Window.partitionBy("source").orderBy("rank", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    up_to = F.sum("size").over(w)
    near = up_to.cast("double") - F.col("wanted") <= F.col("wanted") - (up_to - F.col("size"))
    decided.append(open_.withColumn("more", F.when(near, 1).otherwise(0)))

    out = None
    for part in decided:
        copies = (F.col("whole") + F.col("more")).alias("copies")
        part = part.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), "source", copies, "text_hash")
        out = part if out is None else out.unionByName(part)
    return out


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and a hash of the text, written once: the text is read in one pass."""
    return written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")), "sizes")


def cycled_weights(sized: DataFrame, weights=(5, 2, 1)) -> DataFrame:
    """Every source by code point, missing last, with the weights in turn."""
    sources = sized.select("source").distinct()
    places = numbered(sources, [F.col("source").asc_nulls_last()], "place")
    turn = F.array(*[F.lit(w) for w in weights])
    return places.select("source", F.element_at(turn, ((F.col("place") - 1) % len(weights) + 1).cast("int")).alias("weight"))


def op1_pareto_mixing(spark, folder: str) -> DataFrame:
    """The whole of documents; sources weigh 5, 2, 1 in turn, targets stop at three times their source."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    sized = measured(docs)
    return mix(docs, cycled_weights(sized), sized=sized).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
