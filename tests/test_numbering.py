"""Global numbers and pages without a task that holds the table."""

import random

from pyspark.sql import functions as F

from stampbook.operators import changes as chg
from stampbook.operators import guides, paging, relations
from stampbook.operators.numbering import joined_numbers, numbered
from stampbook.operators.ordering import Key


def test_numbered_is_dense_and_ordered(spark):
    values = random.Random(1).sample(range(10_000), 800)
    df = spark.createDataFrame([(v, "x" * 50) for v in values], "k int, wide string").repartition(6)
    want = {v: i + 1 for i, v in enumerate(sorted(values))}
    assert {r.k: r.n for r in numbered(df.select("k"), [F.col("k")]).collect()} == want
    wide = joined_numbers(df, ["k"], "n", 100)
    assert {r.k: r.n - 100 for r in wide.collect()} == want and wide.columns == ["k", "wide", "n"]
    assert numbered(df.select("k").limit(0), [F.col("k")]).count() == 0


def test_new_ids_follow_the_order(spark):
    df = spark.createDataFrame([(i, None if i % 3 else i, f"c{i:03d}") for i in range(90)], "n int, id long, codigo string").repartition(5)
    got = chg.with_new_ids(df, F.col("id").isNull(), 1000, ["codigo"])
    new = sorted((r.codigo, r.id) for r in got.collect() if r.n % 3)
    assert [i for _, i in new] == list(range(1001, 1061))
    assert {r.id for r in got.collect() if r.n % 3 == 0} == set(range(0, 90, 3))
    assert got.where("n % 3 <> 0").count() == 60


def test_every_page_of_a_listing(spark, monkeypatch):
    monkeypatch.setattr(paging, "TAKE_ROWS", 5)  # pages in the middle are cut by number
    rows = [(None if i % 10 == 0 else i // 3, f"k{i:03d}", i) for i in range(100)]
    df = spark.createDataFrame(rows, "a int, k string, v int").repartition(4)
    order = [Key("a", desc=True), Key("k")]
    want = [r.v for r in df.orderBy(*[k.sort() for k in order]).collect()]
    got = []
    for p in range(1, 16):
        page = paging.paginate(df, order, p, 7)
        got += [r.v for r in page.rows.collect()]
        assert (page.total, page.last) == (100, 15)
    assert got == want


def test_pages_cut_before_the_details_agree_with_the_whole_listing(spark):
    owners = spark.createDataFrame([(i, f"Dueño {i}", str(i)) for i in range(6)], "id int, nombre string, documento string")
    ops = spark.createDataFrame([(i, f"9000{i}", "2024-01-01") for i in range(4)], "id int, numero_guia string, fecha string")
    pages = spark.createDataFrame([(i, f"8000{i % 5}" if i % 4 else None, "SENACSA_CERTIFICADO", f"P{i}", None, None, None, f"texto {i % 3}", None, False, i, 1) for i in range(40)],
                                  "id int, numero_guia string, formato string, propietario string, propietario_documento string, numero_certificado string, cantidad_animales int, texto_ocr string, fecha_texto string, revisado boolean, orden int, carpeta_n int")
    pages = pages.withColumn("etiqueta", F.lit(None).cast("string"))
    marks = spark.createDataFrame([(i, f"M{i:02d}", "dominante", "activa", True, i % 7, i % 5, i, f"et {i}", None) for i in range(40)],
                                  "id int, codigo string, tipo string, estado string, activo boolean, propietario_id int, operacion_id int, escaneo_id int, origen_etiqueta string, motivo_calidad string")
    marks = marks.withColumn("origen_carpeta_n", F.lit(1))
    for text in (None, "Dueño 2", "90003", "80001", "M1", "et 3", "nothing"):
        whole = relations.search_marks(marks, owners, ops, pages, text=text).orderBy("codigo").collect()
        for p in (1, 2):
            page = relations.search_marks_page(marks, owners, ops, pages, p, 7, text=text)
            assert page.total == len(whole)
            assert [r.asDict(True) for r in page.rows.collect()] == [r.asDict(True) for r in whole[(page.page - 1) * 7 : page.page * 7]]
        listed = guides.list_guides(pages, marks, text=text).orderBy("numero_guia").collect()
        page = guides.list_guides_page(pages, marks, text=text, page=1, size=2)
        assert page.total == len(listed) and [r.asDict(True) for r in page.rows.collect()] == [r.asDict(True) for r in listed[:2]]
