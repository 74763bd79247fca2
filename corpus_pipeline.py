"""Corpus pipeline: quality, near duplicates, benchmark leaks, mixing, token shards."""

from __future__ import annotations

import threading
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stampbook.llm.common import Scratch, free_name, shared_path, small_broadcast, written
from stampbook.llm.decontaminate import contaminated
from stampbook.llm.jaccard import near_classes
from stampbook.llm.language_model import classified
from stampbook.llm.mixing import cycled_weights, measured, mix
from stampbook.llm.token_shards import read_documents, write_shards

#: Rejected rows (two longs each) up to this number are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_left = threading.local()


def _tidied() -> None:
    """Removes the intermediate tables of this thread's last stage, whose result has been written by then."""
    scratch = getattr(_left, "scratch", None)
    _left.scratch = None
    if scratch:
        scratch.remove()


def _stage(function):
    """A stage with a folder of its own for intermediate tables, which the thread's next stage (or ``run``) removes."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _tidied()
        with Scratch(spark, function.__name__) as _left.scratch:
            return function(spark, docs, sf_dir)

    return run_stage


def _hashed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with the hash of its text, and that column's name."""
    name = free_name(docs, "_hash")
    return docs.withColumn(name, F.xxhash64(F.coalesce("text", F.lit("")))), name


def _keys(docs: DataFrame, judged: DataFrame, name: str, *more: str) -> tuple[DataFrame, DataFrame, Column, list[str]]:
    """``docs`` with its hash; the (doc_id, text_hash, ``more``) rows of ``judged``, written, by names that ``docs`` has not;
    the join of both; the names that the join adds."""
    rows, h = _hashed(docs)
    i, t, *m = names = [free_name(rows, c) for c in ("_id", "_text", *[f"_{c}" for c in more])]
    keys = written(judged.select(F.col("doc_id").alias(i), F.col("text_hash").alias(t), *[F.col(c).alias(n) for c, n in zip(more, m, strict=True)]), name)
    return rows, keys, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(h) == F.col(t)), [h, *names]


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id and text are rejected (doc_id, text_hash)."""
    rows, keys, same, _ = _keys(docs, rejected.select("doc_id", "text_hash").distinct(), "rejected")
    return rows.join(small_broadcast(keys, BROADCAST_ROWS), same, "left_anti").select(docs.columns)


def _one_of_each(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """``docs`` with rows that repeat both id and text reduced to one; ``judged`` has one (doc_id, text_hash) for each row."""
    repeated = judged.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows, keys, same, added = _keys(docs, repeated, "repeated")
    if keys.isEmpty():
        return docs
    keys = small_broadcast(keys, BROADCAST_ROWS)
    twice = rows.join(keys, same, "left_semi").dropDuplicates(["doc_id", added[0]])
    return rows.join(keys, same, "left_anti").unionByName(twice).select(docs.columns)


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    judged = written(classified(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), "judged")
    return _without(docs, judged.where("NOT kept"))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class (five-word shingles, similarity 0.8) stays: the smallest doc_id (of rows without one, the smallest text hash)."""
    judged = written(near_classes(docs, n=5, percent=80), "judged")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first")
    winners = written(judged.where("class IS NOT NULL").groupBy("class").agg(first), "winners")
    losers = judged.join(winners, "class").where(~(F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.text_hash") == F.col("text_hash"))))
    return _one_of_each(_without(docs, losers), judged.where("class IS NOT NULL"))


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    judged = written(contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "judged")
    return _without(docs, judged.where("contaminated"))


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    sized = measured(docs)
    taken = mix(docs, cycled_weights(sized), sized=sized)
    taken = taken.groupBy("doc_id", "text_hash").agg(F.sum("copies").alias("copies")).where("copies > 0")
    rows, keys, same, added = _keys(_one_of_each(docs, sized.select("doc_id", "text_hash")), taken, "taken", "copies")
    times = F.sequence(F.lit(1), F.col(added[-1]).cast("int"))
    return rows.join(keys, same).withColumn(free_name(rows, "_copy"), F.explode(times)).select(docs.columns)


@_stage
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of token ids, read back by their index: one row per document and copy."""
    import public_tokenizers

    folder = shared_path(spark, "shards")
    return read_documents(write_shards(docs, folder, public_tokenizers.path("byte_bpe_50k.json")), folder)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID / binary output", token_ids),
]

#: Training, hashing and tokenizing cannot be said in SQL; tests/llm checks every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            held = Scratch(spark, f"stage-{k + 1}")
            docs.write.parquet(held.path)
            _tidied()
            if before:
                before.remove()
            docs, before = spark.read.parquet(held.path), held
    return docs
