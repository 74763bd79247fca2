"""Inputs that only large or odd tables hold, against the SQL checks and plain folds."""

import os
import re
import time

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
from stampbook.functions import text as txt
from stampbook.operators import extract, nearest, relations

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def compare(spark, folder, name, **tables):
    """Rows of a query over the given Arrow tables, and those of its SQL."""
    con = duckdb.connect()
    for table, rows in tables.items():
        pq.write_table(rows, f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = registered.queries()[name](spark, str(folder))
    cursor = con.execute(registered.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    return sorted(tuple(r) for r in df.select(*columns).collect()), sorted(cursor.fetchall())


@pytest.mark.parametrize("name", ["o5_reading_order", "o5_ordered_text"])
def test_box_places_round_in_single_precision(spark, tmp_path, name):
    rng = np.random.default_rng(0)
    v = rng.normal(0, 0.2, 400_000).astype(np.float32)
    one, two = v * np.float32(1000), v.astype(np.float64) * 1000
    apart = v[np.floor(np.abs(one) + np.float32(0.5)) != np.floor(np.abs(two) + 0.5)]  # halves only in single precision
    assert len(apart) >= 4
    rows = [np.concatenate([np.resize(apart, 32), np.resize(apart[::-1], 32)]).astype(np.float32), v[:64]]
    found, expected = compare(spark, tmp_path, name, embeddings=pa.table({
        "vec_id": pa.array([1, 2], pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32())), "label": pa.array([0, 1], pa.int32()),
    }))
    assert found == expected


def test_long_citation_lists_are_dealt_over_tasks(spark, tmp_path):
    people = pa.table({"c_custkey": pa.array(range(4_500), pa.int64())})  # one row group, so one task as read
    pq.write_table(people, f"{tmp_path}/customer.parquet")
    assert registered.queries()["x4_parse_citations_long"](spark, str(tmp_path)).rdd.getNumPartitions() == 3
    found, expected = compare(spark, tmp_path, "x4_parse_citations_long", customer=people.slice(0, 5))
    assert found == expected


def test_odd_citations(spark):
    texts = [None, "", "Rubro 4 Respaldo (G) ABC 27/01/2025 (G)A1B2 (B) 7 27/01/25 (B) 7 01/02/2025", "Rubro 4 (B) 1 Factura de venta Rubro 4 (B) 2"]
    rows = extract.parse_citations(spark.createDataFrame([(t,) for t in texts], "texto string")).collect()
    assert [[tuple(c) for c in r.respaldo] for r in rows] == [[], [], [("G", "A1B2", None), ("B", "7", None)], [("B", "1", None)]]


def test_folding_takes_one_lookup_a_character(spark):
    def seconds(column):
        began = time.time()
        df.select(F.md5(column)).write.format("noop").mode("overwrite").save()
        return time.time() - began

    df = spark.range(40).select(F.repeat(F.lit("canción — ñandú "), 3_000).alias("t")).coalesce(1).localCheckpoint()
    t = F.col("t")
    seconds(F.translate(t, "abcñ", "xyz"))
    assert seconds(txt.normalize_label(t)) < 4 + 10 * seconds(F.translate(t, "abcñ", "xyz"))


def test_folded_text_between_signs(spark):
    texts = ["--", "-a  -", "\x00 Ñu / ﬁn½", "—", "€ “a”… \x80Ω"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(txt.normalize_label(F.col("t")), txt.slug(F.col("t")), txt.restricted_text(F.col("t")))
    assert [tuple(r) for r in rows.collect()] == [
        ("", "HOJA", "--"), ("a", "A", "-a  -"), ("nu fin12", "NU-FIN12", "\x00 Ñu / n½"), ("", "HOJA", "-"), ("a", "A", '\x80 "a"... '),
    ]


def test_visits_of_many_queries_to_every_cluster_come_in_small_frames():
    rng = np.random.default_rng(0)
    heads = nearest.unit_rows(rng.normal(size=(200, 8)))
    figures = nearest.Figures(heads, np.append(np.full(200, 3.0), 0), np.full(201, 0.5), np.full(201, 1.4), np.append(np.full(200, 20), 0))
    asked = pd.DataFrame({"consulta": range(600), "aspect": 1.0, "v": list(rng.normal(size=(600, 8))), "reached": np.nan})
    first, second = (list(nearest._chosen(asked, figures, 24, later)) for later in (False, True))
    assert max(map(len, first + second)) <= nearest.VISIT_ROWS
    visits = pd.concat(first + second).groupby("consulta")["cluster"]
    assert (visits.count() == 200).all() and (visits.nunique() == 200).all()  # every cluster can matter here, each is visited once


def plan(spark, name, folder, **conf):
    """The physical plan of a query as first made."""
    for k, v in conf.items():
        spark.conf.set(f"spark.sql.{k}", v)
    try:
        return registered.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in conf:
            spark.conf.unset(f"spark.sql.{k}")


def test_opened_keys_are_not_broadcast(spark):
    assert "BroadcastHashJoin" not in plan(spark, "q4_near_pairs_unblocked", DATA)


def test_marks_are_not_sorted_to_lose_their_operation(spark):
    last = plan(spark, "u11_delete_operations", DATA, autoBroadcastJoinThreshold="-1")
    assert len(re.findall(r"ShuffledHashJoin.*(?:LeftOuter|LeftAnti)", last)) == 2


def test_batch_marks_are_dealt_by_operation_and_by_file_once(spark):
    found = plan(spark, "u4_batch_marks", DATA, autoBroadcastJoinThreshold="-1")
    assert not re.findall(r"Exchange hashpartitioning\(origen_archivo#\d+, \d+\), ENSURE_REQUIREMENTS[^\n]*\n[^\n]*SortAggregate", found)


def test_page_of_a_search_reads_whole_marks_of_its_codes_only(spark):
    marks = spark.createDataFrame(
        [(str(i), f"M-{i % 50:03d}", 1, 1, 1, "activa", "dominante", i < 50, "o") for i in range(60)] + [("x", None, 1, 1, 1, "activa", "dominante", True, "M-")],
        "id string, codigo string, operacion_id long, propietario_id long, escaneo_id long, estado string, tipo string, activo boolean, origen_etiqueta string",
    )
    owners = spark.createDataFrame([(1, "a", "b")], "id long, nombre string, documento string")
    ops = spark.createDataFrame([(1, "5", "f")], "id long, numero_guia string, fecha string")
    pages = spark.createDataFrame([(1, "6")], "id long, numero_guia string")
    found = relations.search_marks_page(marks, owners, ops, pages, page=2, size=20, text="M-")
    assert found.total == 51 and [r.id for r in found.rows.collect()] == [str(i) for i in range(20, 40)]
    last = relations.search_marks_page(marks, owners, ops, pages, page=3, size=20, text="M-")
    assert {r.id for r in last.rows.collect()} == {*map(str, range(40, 50)), "x"}
    wide = found.rows._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in wide
