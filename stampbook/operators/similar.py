"""Image fingerprints: normalisation, similarity search and incremental signature backfill."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stampbook.functions.folds import let
from stampbook.operators.filters import MARK_FACETS, facets, visible
from stampbook.operators.nearest import clustered, nearest, unit_rows
from stampbook.operators.ordering import Key, top_n

TOP = 24
QUERIES_PER_PASS = 256
BROADCAST_QUERIES = 1_000  # times k winners, a few thousand narrow rows
BROADCAST_ROWS = 10_000


def unit(v: Column) -> Column:
    """Centred vector of length one; a constant vector becomes all zeros."""
    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda a, e: a + e)

    def centre(x: Column) -> Column:
        return let(total(x) / F.size(x), lambda mean: F.transform(x, lambda e: e - mean))

    def scale(x: Column) -> Column:
        norm = F.sqrt(total(F.transform(x, lambda e: e * e)))
        return let(norm, lambda n: F.transform(x, lambda e: F.when(n > 0, e / n).otherwise(0.0)))

    return let(let(F.transform(v, lambda e: e.cast("double")), centre), scale)


def aspect_of(byte: Column) -> Column:
    return F.greatest(byte, F.lit(1)) / 64.0


def fingerprint_vectors(df: DataFrame, key: str = "id", column: str = "huella") -> DataFrame:
    """(key, aspect, v) of stored fingerprints: one aspect byte followed by the pixels. Empty ones are left out."""
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size = b[column].str.len()
            for n in size.unique():  # prints of one size form a matrix
                part = b[size == n]
                raw = np.frombuffer(b"".join(part[column]), dtype=np.uint8).reshape(len(part), n)
                yield pd.DataFrame({key: part[key], "aspect": np.maximum(raw[:, 0], 1) / 64.0, "v": list(raw[:, 1:].astype(np.float32))})

    kind = df.schema[key].dataType.simpleString()
    stored = df.where(F.length(column) > 0).select(key, column)
    return stored.mapInPandas(decode, f"{key} {kind}, aspect double, v array<float>")


def _one_pass(asked: list, corpus: DataFrame, k: int, id_type: str, query_type: str) -> DataFrame:
    """Best ``k`` of the corpus for a bounded list of queries; every task forwards at most ``k`` rows per query."""
    names = [r["consulta"] for r in asked]
    q = unit_rows([r["v"] for r in asked])
    q_aspect = np.array([r["aspect"] for r in asked], dtype=np.float64)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[list] = [[] for _ in names]
        for b in batches:
            if not len(b):
                continue
            ids, aspect = b["id"].to_numpy(), b["aspect"].to_numpy(dtype=np.float64)
            ratio = np.minimum(aspect[:, None], q_aspect) / np.maximum(aspect[:, None], q_aspect)
            s = np.clip(unit_rows(b["v"]) @ q.T, 0.0, 1.0) * (0.75 + 0.25 * ratio) * 100.0
            s = np.round(s, 9)
            for j in range(len(names)):
                if len(ids) > k:
                    cut = np.partition(s[:, j], len(ids) - k)[len(ids) - k]
                    rows = np.nonzero(s[:, j] >= cut)[0]
                else:
                    rows = range(len(ids))
                best[j] = heapq.nsmallest(k, best[j] + [(-s[i, j], ids[i]) for i in rows])
        out = [(names[j], i, -neg) for j, top in enumerate(best) for neg, i in top]
        yield pd.DataFrame(out, columns=["consulta", "id", "exacto"])

    return corpus.select("id", "aspect", "v").mapInPandas(score, f"consulta {query_type}, id {id_type}, exacto double")


def similar(queries: DataFrame, corpus: DataFrame, k: int = TOP) -> DataFrame:
    """(consulta, id, puntaje, rn): the ``k`` most similar corpus rows of each query, score 0-100.

    ``queries`` (consulta, aspect, v), ``corpus`` (id, aspect, v). Up to ``QUERIES_PER_PASS`` queries travel to the corpus and take
    one pass over it; more stay a frame and visit the corpus by clusters (``nearest``).
    """
    id_type = corpus.schema["id"].dataType.simpleString()
    query_type = queries.schema["consulta"].dataType.simpleString()
    q = queries.select("consulta", F.col("aspect").cast("double").alias("aspect"), "v")
    asked = q.limit(QUERIES_PER_PASS + 1).collect()
    if len(asked) > QUERIES_PER_PASS:
        best = nearest(q, clustered(corpus), k)[0]
    else:
        if asked:
            found = _one_pass(asked, corpus, k, id_type, query_type)
        else:
            found = corpus.select(F.lit(None).cast(query_type).alias("consulta"), "id", F.lit(0.0).alias("exacto")).limit(0)
        best = top_n(found, ["consulta"], [Key("exacto", desc=True), Key("id")], k)
    return best.select("consulta", "id", F.round("exacto", 1).alias("puntaje"), "exacto", "rn")


def search_similar(
    queries: DataFrame, marks: DataFrame, owners: DataFrame, tipo: str | None = None, include_retired: bool = False, k: int = TOP
) -> DataFrame:
    """Visible marks most similar to each query, with code, type, state and owner name.

    ``marks`` carries its fingerprint as ``aspect`` and ``v`` (null without one), so vectors are filtered and compared
    where they are stored; only the few winners are joined with their details.
    """
    shown = facets(visible(marks), MARK_FACETS, tipo=tipo).where(F.col("v").isNotNull())
    if not include_retired:
        shown = shown.where(F.col("estado") != "baja")
    people = owners.select(F.col("id").alias("propietario_id"), F.col("nombre").alias("propietario"))
    details = marks.select("id", "codigo", "tipo", "estado", "propietario_id")
    won = similar(queries, shown, k)
    if queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES:
        won = F.broadcast(won)
    return (
        details.join(won, "id", "inner").join(people, "propietario_id", "left")
        .select("consulta", "rn", "id", "codigo", "tipo", "estado", "propietario", "puntaje")
    )


def pending(signature: str, source: str) -> Column:
    return F.col(signature).isNull() & F.col(source).isNotNull()


def backfill(
    df: DataFrame, fn: Callable[[DataFrame], DataFrame], signature: str = "huella", source: str = "archivo_png",
    sentinel: Column | None = None, limit: int | None = None, key: str = "id",
) -> DataFrame:
    """Compute missing signatures (of the first ``limit`` rows by key, if given); ``accion`` tells what happened to each row.

    ``fn`` maps the pending rows to ``(key, signature)``. A row it cannot compute receives ``sentinel`` and is not tried
    again. Actions: calculada, sin_tinta, pendiente, sin_cambio.
    """
    blank = sentinel if sentinel is not None else F.lit(b"")
    todo = df.where(pending(signature, source))
    if limit:
        todo = todo.orderBy(key).limit(limit)
    made = todo.select(key).join(fn(todo).select(key, F.col(signature).alias("_new")), key, "left").withColumn("_try", F.lit(True))
    action = (
        F.when(F.col("_try") & F.col("_new").isNotNull(), "calculada").when(F.col("_try"), "sin_tinta")
        .when(pending(signature, source), "pendiente").otherwise("sin_cambio")
    )
    value = F.when(F.col("_try"), F.coalesce(F.col("_new"), blank)).otherwise(F.col(signature))
    if limit and limit <= BROADCAST_ROWS:
        made = F.broadcast(made)
    joined = df.join(made, key, "left").withColumn("accion", action)
    return joined.withColumn(signature, value).drop("_new", "_try")
