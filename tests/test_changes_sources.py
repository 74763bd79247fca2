"""Change application, files, snapshot round trip, streaming and the page load end to end."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stampbook.operators import changes as chg
from stampbook.operators import guides, sequence
from stampbook.operators.aggregates import ingest_counts
from stampbook.operators.filters import validate_rows
from stampbook.operators import relations
from stampbook.operators.relations import link_pages, lookup_ordered, plan_retirement, retirement_counts, save_selection
from stampbook.sources.buckets import Buckets
from stampbook.sources.commits import Batches, latest
from stampbook.sources import delimited, export, ingest, page_index, snapshot
from stampbook.streaming import pages as stream


def rows(df, *cols):
    return sorted([tuple(r) for r in (df.select(*cols) if cols else df).collect()], key=str)


def test_merge_policies_and_idempotence(spark):
    cur = spark.createDataFrame([(1, "a", None, "x"), (2, "b", "", "x"), (3, "c", "z", "x")], "id int, p string, q string, r string")
    inc = spark.createDataFrame([(1, "A", "q1", "y"), (3, None, "", "y"), (4, "D", None, "y")], "id int, p string, q string, r string")
    def go(policy, **k):
        return rows(chg.merge(cur, inc, ["id"], ["p", "q"], policy, **k))
    assert go("replace") == [(1, "A", "q1", "x", "actualizada"), (2, "b", "", "x", "sin_cambio"), (3, None, "", "x", "actualizada"), (4, "D", None, "y", "nueva")]
    assert go("given")[2] == (3, "c", "", "x", "actualizada")
    assert go("filled")[2] == (3, "c", "z", "x", "actualizada")
    assert go("missing")[0] == (1, "a", "q1", "x", "actualizada")
    assert go("replace", protected=F.col("id") == 1)[0] == (1, "a", None, "x", "protegida")
    assert len(go("replace", insert=False)) == 3
    once = chg.merge(cur, inc, ["id"], ["p", "q"]).drop("accion")
    assert rows(chg.merge(once, inc, ["id"], ["p", "q"]).drop("accion")) == rows(once)


def test_last_per_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("b", 2, "y")], "k string, n int, v string")
    assert rows(chg.last_per_key(df, ["k"], "n"), "k", "v") == [("a", "z"), ("b", "y")]


def test_manifest(spark):
    cols = "codigo string, hoja string, fila int, columna int, png string, svg string, ancho_px int, alto_px int, aspecto double, tinta_pct double, componentes int, sha1 string, revisar boolean, observaciones string"
    man = spark.createDataFrame([(f"C0{i}", "h", i, 1, f"C0{i}.png", "", 10, 10, 1.0, 5.0, 3, f"s{i}", i == 3, "") for i in (1, 2, 3)] + [("C04", "h", 4, 1, "", "", 0, 0, 0.0, 0.0, 0, None, False, "")], cols)
    kept = "codigo string, descripcion string, propietario_id int, archivo_png string, archivo_svg string, hoja string, fila int, columna int, ancho_px int, alto_px int, aspecto double, tinta_pct double, componentes int, sha1 string, estado string, observaciones string"
    first, counts = chg.import_manifest(spark.createDataFrame([], kept), man)
    assert tuple(counts.first()) == (3, 0, 1)
    assert rows(first.groupBy("estado").count()) == [("activa", 2), ("revisar", 1)]
    edited = first.drop("accion").withColumns({"descripcion": F.lit("a mano"), "propietario_id": F.lit(9)})
    again, counts = chg.import_manifest(edited, man)
    assert tuple(counts.first()) == (0, 3, 1)
    assert rows(again, "descripcion", "propietario_id") == [("a mano", 9)] * 3
    lists = spark.createDataFrame([("l", ["C03", "C01", "falta", "C03"])], "lista string, codigos array<string>")
    assert [r.codigo for r in lookup_ordered(again.drop("accion"), lists).orderBy("posicion_pedida").collect()] == ["C03", "C01"]
    ids = again.drop("accion").withColumn("id", F.col("fila"))
    assert rows(save_selection(lists, ids), "marca_id", "posicion") == [(1, 2), (3, 1), (3, 4)]


def test_sheet_import(spark, tmp_path):
    path = tmp_path / "hoja.csv"
    path.write_bytes("Nº de Marca;Propietario;CI/RUC;Descripción;Estado;Peso\nM1;Ana;80020081;círculo;activa;1\nM2;Ána S.A.;80020081;;rara;2\n;;;;;\n;Beto;1;x;;\n".encode("latin-1"))
    df, report = delimited.map_columns(delimited.read_delimited(spark, str(path)))
    assert report["ignoradas"] == ["Peso"] and df.columns == ["codigo", "propietario", "documento", "descripcion", "estado"]
    numbered = df.withColumn("row", F.monotonically_increasing_id())
    valid, warnings = validate_rows(numbered, "row", required={"codigo": "sin código"}, enums={"estado": ("activa", "revisar", "baja")})
    assert sorted(r.problema for r in warnings.collect()) == ["estado 'rara' desconocido", "sin código"]
    marks = spark.createDataFrame([("M2", "vieja", "activa", None)], "codigo string, descripcion string, estado string, owner string")
    owners = spark.createDataFrame([], "id int, nombre string, documento string")
    new, people = chg.import_sheet(marks, owners, valid)
    assert rows(new, "codigo", "descripcion", "estado", "accion") == [("M1", "círculo", "activa", "nueva"), ("M2", "vieja", "activa", "actualizada")]
    assert people.count() == 1 and len({r.owner for r in new.collect()}) == 1
    with pytest.raises(ValueError):
        delimited.map_columns(df.drop("codigo"))


def test_delimited_utf8_bom(spark, tmp_path):
    path = tmp_path / "u.csv"
    path.write_bytes("﻿Código,Nota\nM1,\"a, \"\"b\"\"\"\nM2,ñ\n".encode("utf-8"))
    df, _ = delimited.map_columns(delimited.read_delimited(spark, str(path)))
    assert rows(df) == [("M1", 'a, "b"'), ("M2", "ñ")]


def test_retirement_and_undo(spark):
    marks = spark.createDataFrame([(1, "m1", "x1", "activa", False, None, None), (2, "m2", "x2", "revisar", True, "borde", None), (3, "m3", "x3", "activa", False, None, 7),
                                   (4, "m4", "x4", "baja", True, "no_es_marca:vacia", None), (5, "m5", "ok", "activa", False, None, None)],
                                  "id int, codigo string, origen_archivo string, estado string, sospechosa_calidad boolean, motivo_calidad string, operacion_id int")
    decisions = spark.createDataFrame([(f, "anulacion") for f in ("x1", "x2", "x3", "x4", "zz")], "origen_archivo string, categoria string")
    plan = plan_retirement(marks, decisions)
    assert retirement_counts(plan).first().asDict() == {"en_la_lista": 5, "no_estan_en_la_base": 1, "ya_de_baja": 1, "en_una_operacion": 1, "a_dar_de_baja": 2}
    after, before = chg.retire(marks, plan)
    assert rows(after.where("accion = 'actualizada'"), "id", "estado", "motivo_calidad") == [(1, "baja", "no_es_marca:anulacion"), (2, "baja", "no_es_marca:anulacion")]
    back = chg.undo_retire(after.drop("accion"), before).drop("accion")
    assert rows(back, *sorted(marks.columns)) == rows(marks, *sorted(marks.columns))
    changed = after.drop("accion").withColumn("motivo_calidad", F.when(F.col("id") == 1, "otra cosa").otherwise(F.col("motivo_calidad")))
    assert rows(chg.undo_retire(changed, before), "id", "estado")[:2] == [(1, "baja"), (2, "revisar")]


def test_state_visibility_and_undo(spark):
    cur = spark.createDataFrame([(1, "activa", True), (2, "revisar", False)], "id int, estado string, activo boolean")
    after, before = chg.apply_state(cur, cur.select("id"), "baja")
    assert rows(after, "estado") == [("baja",), ("baja",)]
    assert rows(chg.undo(after.drop("accion"), before).drop("accion"), *cur.columns) == rows(cur)
    assert rows(chg.set_visible(cur, cur.where("id = 2").select("id"), True), "id", "activo") == [(1, True), (2, True)]


def test_blocked_delete(spark):
    ops = spark.createDataFrame([(1,), (2,)], "id int")
    docs = spark.createDataFrame([(1,), (1,)], "operacion_id int")
    marks = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id int, operacion_id int")
    side = spark.createDataFrame([(2, "x"), (1, "y")], "operacion_id int, contenido string")
    out = chg.delete_operations(spark.createDataFrame([(1,), (2,), (99,)], "id int"), ops, docs, marks, side)
    assert rows(out["plan"]) == [(1, "bloqueada"), (2, "borrable")]
    assert rows(out["operaciones"]) == [(1,)] and rows(out["marcas"]) == [(10, 1), (11, None), (12, None)]
    assert rows(out["respaldos"], "contenido") == [("y",)]


def test_batch_with_colliding_numbers(spark):
    ops = spark.createDataFrame([(1, "90904503", "Ana", "111", 1), (2, "90904503", "Beto", "222", 1)], "id int, numero_guia string, vendedor_nombre string, vendedor_documento string, guia_colisionada int")
    marks = spark.createDataFrame([(1, 1, "dominante", "F1C1", "p1.png", "p1.svg", False), (2, 1, "complementaria", "F1C2", "p2.png", "p2.svg", True), (3, 2, "dominante", "F1C1", "p3.png", "nosvg.svg", False)],
                                  "id int, operacion_id int, tipo string, posicion string, archivo_imagen string, archivo_svg_nombre string, sospechosa_calidad boolean")
    files = spark.createDataFrame([(f, f"parte{n}/{f}", n) for f, n in (("p1.png", 1), ("p2.png", 1), ("p3.png", 2), ("p1.svg", 1), ("p2.svg", 1), ("p1.png", 2))], "nombre string, path string, carpeta_n int")
    o = spark.createDataFrame([], "origen string, origen_id bigint, numero_guia string, vendedor_nombre string, vendedor_documento string, guia_colisionada int")
    m = spark.createDataFrame([], "origen_archivo string, codigo string, tipo string, posicion string, archivo_png string, archivo_svg string, estado string, origen string, origen_id bigint, owner string")
    p = spark.createDataFrame([], "id int, nombre string, documento string")
    first = chg.import_batch(o, m, p, ops, marks, files, "lote")
    assert rows(first["operaciones"], "accion") == [("nueva",)] * 2 and rows(first["marcas"], "accion") == [("nueva",)] * 3
    assert rows(first["faltantes"]) == [("nosvg.svg",)]
    assert sorted(r.archivo_png for r in first["marcas"].collect()) == ["parte1/p1.png", "parte1/p2.png", "parte2/p3.png"]
    assert rows(first["marcas"].where("estado = 'revisar'"), "origen_archivo") == [("p2.png",)]
    renamed = first["marcas"].drop("accion").withColumn("codigo", F.when(F.col("origen_archivo") == "p1.png", "OFICIAL").otherwise(F.col("codigo")))
    second = chg.import_batch(first["operaciones"].drop("accion"), renamed, p, ops, marks, files, "lote")
    assert rows(second["operaciones"], "accion") == [("actualizada",)] * 2 and rows(second["marcas"], "accion") == [("actualizada",)] * 3
    assert {r.codigo for r in second["marcas"].collect()} == {"OFICIAL", "p2", "p3"}


def test_catalogue_load(spark):
    inc = spark.createDataFrame([(f"m{i}.png", i == 1) for i in range(3)] + [("falta.png", False), ("rota.png", False)], "origen_archivo string, sospechosa_calidad boolean")
    files = spark.createDataFrame([("m0.png", True), ("m1.png", True), ("m2.png", True), ("rota.png", False)], "nombre string, ok boolean")
    empty = spark.createDataFrame([], "origen_archivo string")
    plan = chg.insert_new(empty, inc, files)
    assert rows(plan.groupBy("accion").count()) == [("cargada", 3), ("danada", 1), ("sin_archivo", 1)]
    loaded = plan.where("accion = 'cargada'")
    assert rows(loaded.groupBy("estado").count()) == [("activa", 2), ("revisar", 1)]
    assert chg.insert_new(loaded, inc, files).where("accion = 'ya_estaba'").count() == 3


PAGE_COLS = "carpeta string, archivo string, orden int, formato string, numero_guia string, fuente_numero string, conf_numero double, propietario string, texto_ocr string"


def test_page_load_end_to_end(spark):
    inc = spark.createDataFrame([
        ("L1", "0001.jpg", 0, "GE2_PRINCIPAL", "10894231", "ocr", 0.9, None, "guia"), ("L1", "0002.jpg", 1, "GE2_ANEXO", None, None, None, None, "anexo"),
        ("L1", "0003.jpg", 2, "SENACSA_CERTIFICADO", "10894231", "ocr", 0.9, "FRANCO", "Aftosa"), ("L1", "0004.jpg", 3, "GE2_PRINCIPAL", "10895005", "ocr", 0.9, None, "otra"),
        ("L1", "0005.jpg", 4, "CIEFA_GO2", None, None, None, None, "x")], PAGE_COLS)
    inferred = sequence.infer_numbers(inc)
    assert inferred.where("inferida").count() == 1
    cur = spark.createDataFrame([], "id bigint, revisado boolean, etiqueta string, propietario_documento string, numero_certificado string, carpeta_n int, cantidad_animales int, fecha_texto string, " + PAGE_COLS)
    first = chg.protected_upsert(cur, inferred.drop("inferida"))
    counts = ingest_counts(first).first()
    assert (counts.paginas, counts.nuevas, counts.inferidas, counts.con_numero) == (5, 5, 1, 4)
    stored = chg.with_new_ids(first.drop("accion"), F.col("id").isNull(), 0, ["carpeta", "archivo"]).fillna({"revisado": False})
    fixed = chg.correct_pages(stored, spark.createDataFrame([(5, " 77777777 ")], "id bigint, numero_guia string")).drop("accion")
    third = chg.protected_upsert(fixed, inferred.drop("inferida"))
    assert rows(third.groupBy("accion").count()) == [("actualizada", 4), ("protegida", 1)]
    assert third.where("id = 5").first().numero_guia == "77777777" and third.where("id = 5").first().conf_numero == 1.0
    marks = spark.createDataFrame([(i, "L1", "0001.jpg", None, True, "activa") for i in (1, 2)] + [(3, None, None, None, True, "activa")],
                                  "id int, origen_carpeta string, origen_pagina string, escaneo_id bigint, activo boolean, estado string")
    linked = link_pages(marks, third)
    assert linked.where("vinculada").count() == 2 and linked.count() == 3
    found = guides.list_guides(third, linked, text="Aftosa").collect()
    assert [(r.numero_guia, r.paginas, r.marcas, r.propietario) for r in found] == [("10894231", 3, 2, "FRANCO")]
    bumped = chg.bump_counts(third.withColumn("n_marcas", F.lit(1)), linked.where("vinculada"))
    assert bumped.where("id = 1").first().n_marcas == 3


def test_versions(spark):
    cur = spark.createDataFrame([(1, "a", None, bytearray(b"h")), (2, None, None, bytearray(b"h"))], "id int, archivo_png string, archivo_svg string, huella binary")
    versions = spark.createDataFrame([], "id bigint, marca_id int, archivo_png string, archivo_svg string, motivo string, creado_por string, creado_en timestamp")
    new = spark.createDataFrame([(1, "b", None, "u"), (2, "c", None, "u")], "id int, archivo_png string, archivo_svg string, usuario string")
    marks, hist = chg.replace_with_history(cur, versions, new)
    assert rows(marks, "id", "archivo_png", "huella") == [(1, "b", None), (2, "c", None)] and rows(hist, "id", "marca_id", "archivo_png", "motivo") == [(1, 1, "a", "reemplazo")]
    asked = spark.createDataFrame([(1, 1, "u"), (1, 2, "u")], "version_id int, marca_id int, usuario string")
    back, hist2 = chg.restore_version(marks.drop("accion"), hist, asked)
    assert rows(back, "id", "archivo_png") == [(1, "a"), (2, "c")] and rows(hist2, "id", "archivo_png", "motivo") == [(1, "a", "reemplazo"), (2, "b", "restauracion")]


def test_evolve_and_split(spark):
    df = spark.createDataFrame([(1, "pdf"), (2, None), (3, "z")], "id int, respaldo string")
    wide = chg.evolve(df, T.StructType.fromDDL("id int, activo boolean"), {"activo": True})
    assert rows(wide, "id", "activo") == [(1, True), (2, True), (3, True)]
    light, side = chg.split_column(df, spark.createDataFrame([(3, "ya")], "operacion_id int, contenido string"), "operacion_id", "respaldo", "contenido")
    assert light.columns == ["id"] and rows(side) == [(1, "pdf"), (3, "ya")]


def test_snapshot_round_trip(spark, tmp_path):
    schemas = {"propietarios": "id bigint, nombre string", "marcas": "id bigint, codigo string, archivo_png binary, escaneo_id bigint, creado_en timestamp", "cambios_pendientes": "id bigint, cambios string",
               "documentos_emitidos": "id bigint, contenido binary"}
    data = {"propietarios": [(1, "Ñandú")], "marcas": [(i, f"M-{i:05d}", bytearray([0, i, 255]) if i else None, 5, None) for i in range(5)], "cambios_pendientes": [], "documentos_emitidos": [(1, bytearray(b"p")), (2, None)]}
    tables = {n: spark.createDataFrame(data[n], d) for n, d in schemas.items()}
    path = str(tmp_path / "respaldo")
    manifest = {r.tabla: (r.filas, r.partes) for r in snapshot.dump(tables, path, part_rows={"marcas": 2}).collect()}
    assert manifest["marcas"][0] == 5 and manifest["marcas"][1] >= 3 and manifest["cambios_pendientes"] == (0, 1)
    assert list((tmp_path / "respaldo" / "cambios_pendientes").glob("part-*"))
    types = {n: T.StructType.fromDDL(d) for n, d in schemas.items()}
    back, check = snapshot.restore(spark, path, types)
    got = {r.id: (r.codigo, r.archivo_png, r.escaneo_id) for r in back["marcas"].collect()}
    assert got[3] == ("M-00003", bytearray([0, 3, 255]), None) and got[0][1] is None
    assert {r.tabla: r.coincide for r in check.where("esperado is not null").collect()} == {"propietarios": True, "marcas": True, "cambios_pendientes": True, "documentos_emitidos": False}
    assert rows(snapshot.missing_binaries(snapshot.read_part(spark, path + "/documentos_emitidos", types["documentos_emitidos"]))) == [(2,)]
    with pytest.raises(snapshot.NotEmpty):
        snapshot.restore(spark, path, types, existing={"marcas": tables["marcas"]})
    forced, _ = snapshot.restore(spark, path, types, existing={"marcas": tables["marcas"].where("id < 3")}, force=True)
    assert sorted(r.id for r in forced["marcas"].collect()) == [3, 4]
    seq = snapshot.next_sequence(back["marcas"]).first()
    assert (seq.ultimo_codigo, seq.ultimo_id) == (4, 4)


def test_blob_sha(spark):
    import hashlib

    body = b"hola\n\x00\xff"
    df = spark.createDataFrame([(bytearray(body),)], "c binary").select(snapshot.blob_sha(F.col("c")).alias("s"))
    assert df.first().s == hashlib.sha1(b"blob %d\0" % len(body) + body).hexdigest()


def test_page_index(spark, tmp_path):
    lines = [json.dumps({"carpeta": "A", "archivo": "1", "orden": 1, "texto_ocr": "ñ"}), "", json.dumps({"carpeta": "A", "archivo": "2", "error": "roto"}), "{mal"]
    (tmp_path / "indice.jsonl").write_text("\n".join(lines), encoding="utf-8")
    assert rows(page_index.read_page_index(spark, str(tmp_path)), "archivo", "texto_ocr") == [("1", "ñ")]
    assert rows(page_index.read_page_errors(spark, str(tmp_path)), "archivo", "error") == [("2", "roto"), (None, "corrupt")]


def test_ingest_retries_failures(spark, tmp_path):
    sink, dead = str(tmp_path / "s"), str(tmp_path / "d")
    src = spark.range(10)
    bad = lambda d: d.withColumn("error", F.when(F.col("id") % 5 == 0, "mal"))
    good = lambda d: d.withColumn("error", F.lit(None).cast("string"))
    assert ingest.ingest_incremental(src, sink, ["id"], bad, dead) == {"procesadas": 8, "errores": 2}
    assert ingest.ingest_incremental(src, sink, ["id"], good, dead) == {"procesadas": 2, "errores": 0}
    assert ingest.ingest_incremental(src, sink, ["id"], good, dead) == {"procesadas": 0, "errores": 0}
    assert spark.read.parquet(sink).count() == 10 and spark.read.parquet(dead).count() == 2


def test_stream_ingest(spark, tmp_path):
    schema = T.StructType.fromDDL("carpeta string, archivo string, orden int, numero_guia string, error string")
    src, sink, ckpt, dead = (str(tmp_path / n) for n in ("in", "out", "ck", "dead"))
    batch = lambda rs: spark.createDataFrame(rs, schema).write.mode("append").json(src)
    batch([("A", "1", 1, "x", None), ("A", "1", 2, "y", None), ("A", "2", 1, None, "roto")])
    stream.stream_ingest(spark, src, schema, sink, ckpt, dead).awaitTermination()
    assert rows(stream.ingested(spark, sink), "archivo", "numero_guia") == [("1", "y")]
    batch([("A", "2", 3, "z", None), ("A", "1", 9, "w", None)])
    stream.stream_ingest(spark, src, schema, sink, ckpt, dead).awaitTermination()
    stream.stream_ingest(spark, src, schema, sink, ckpt, dead).awaitTermination()
    assert rows(stream.ingested(spark, sink), "archivo", "numero_guia") == [("1", "w"), ("2", "z")]
    assert spark.read.parquet(dead).count() == 1
    stored = spark.createDataFrame([("A", "1", 0, "mano", "manual", False)], "carpeta string, archivo string, orden int, numero_guia string, fuente_numero string, revisado boolean")
    assert rows(stream.current_pages(stored, spark, sink), "archivo", "numero_guia", "accion") == [("1", "mano", "protegida"), ("2", "z", "nueva")]


def test_batches_count_once_committed(spark, tmp_path):
    """A writer that stops between its writes or before its commit leaves nothing that a reader sees; a compaction changes no row."""
    sink = str(tmp_path / "sink")
    b = Batches(spark, sink)
    assert b.last() == -1 and b.read() is None
    want = {}
    for n in range(12):
        part = spark.createDataFrame([(k, n) for k in range(n % 5 + 1)], "k int, v int")
        part.write.parquet(b.folder(n, "data"))
        assert b.last() == n - 1
        assert b.publish(n, {"data": b.folder(n, "data")}, {"data": part.count()})
        assert not b.publish(n, {}, {})
        want |= {r.k: r.v for r in part.collect()}
    spark.createDataFrame([(0, 99)], "k int, v int").write.parquet(b.folder(12, "data"))  # never committed
    now = lambda: {r.k: r.v for r in latest(b.read(), ["k"]).collect()}
    assert now() == want
    before = len(b.read().inputFiles())
    assert b.compact(["k"]) == 11 and now() == want and b.compact(["k"]) == 11
    assert len(b.commits()) == 1 and len(b.read().inputFiles()) < before
    spark.createDataFrame([(3, 100)], "k int, v int").write.mode("overwrite").parquet(b.folder(12, "data"))
    b.publish(12, {"data": b.folder(12, "data")}, {})
    assert now() == {**want, 3: 100} and len(b.commits()) == 2
    assert b.compact(["k"]) == 12 and now() == {**want, 3: 100}


def test_ingest_that_stops_between_its_writes(spark, tmp_path, monkeypatch):
    src = spark.range(6)
    sink, dead = str(tmp_path / "sink"), str(tmp_path / "dead")
    work = lambda df: df.withColumn("error", F.when(F.col("id") > 3, "roto"))
    monkeypatch.setattr(Batches, "publish", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError):
        ingest.ingest_incremental(src, sink, ["id"], work, dead)
    monkeypatch.undo()
    assert ingest.loaded(spark, sink) is None and ingest.open_errors(spark, sink, ["id"]) is None
    assert ingest.ingest_incremental(src, sink, ["id"], work, dead) == {"procesadas": 4, "errores": 2}
    assert ingest.loaded(spark, sink).count() == 4 and ingest.open_errors(spark, sink, ["id"]).count() == 2
    assert ingest.ingest_incremental(src, sink, ["id"], lambda df: df.withColumn("error", F.lit(None).cast("string")), dead) == {"procesadas": 2, "errores": 0}
    assert ingest.open_errors(spark, sink, ["id"]).count() == 0


def test_bucketed_merge_touches_its_buckets_only(spark, tmp_path):
    """Same rows as a merge of whole snapshots; other buckets keep their folders; older versions stay readable."""
    cur = spark.createDataFrame([(i, f"v{i}", i % 3) for i in range(400)] + [(None, "sin", 0), (None, "clave", 1)], "k long, v string, n int")
    inc = spark.createDataFrame([(7, "x", 1), (7, "y", 2), (900, "z", 3), (None, "nueva", 4), (None, "sin", 0)], "k long, v string, n int")
    b = Buckets(spark, str(tmp_path / "b"))
    b.create(cur, ["k"], 32)
    assert rows(b.read()) == rows(cur)
    before = b.manifest()["buckets"]
    want = chg.merge(cur, inc, ["k"], ["v"], order="n")
    counts = {r.accion: r.n for r in b.merge(inc, ["v"], order="n").collect()}
    assert rows(b.read(), "k", "v", "n") == rows(want, "k", "v", "n") and counts["nueva"] == 3 and counts["actualizada"] == 1
    after = b.manifest()["buckets"]
    changed = [x for x in after if after[x] != before.get(x)]
    assert len(changed) <= 4 and sum(x[1] for x in after.values()) == b.read().count() and len(before) > 25
    assert rows(b.read(0)) == rows(cur)
    with pytest.raises(ValueError):
        b.create(cur, ["k"])


def test_last_as_read_does_not_depend_on_partitions(spark, tmp_path):
    """The same row wins at any number of partitions, from one file or several, and for frames that come from no file."""
    from stampbook.operators.ordering import read_order

    made = spark.createDataFrame([(i % 20, i) for i in range(2000)], "k int, v int").coalesce(1)
    made.write.parquet(str(tmp_path / "p"))
    made.write.csv(str(tmp_path / "c"))
    last = lambda df: {r.k: r.v for r in chg.last_per_key(read_order(df, "_o"), ["k"], "_o").collect()}
    want = {k: 1980 + k for k in range(20)}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            for n in (1, 4, 211):
                assert last(spark.read.parquet(str(tmp_path / "p")).repartition(n)) == want
            assert last(spark.read.schema("k int, v int").csv(str(tmp_path / "c"))) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    loose = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    assert {tuple(sorted(r.v for r in chg.last_per_key(read_order(loose.repartition(n), "_o"), ["k"], "_o").collect())) for n in (1, 4, 211)} == {("b",)}


def test_export_frame(spark, tmp_path):
    df = spark.sql("select 'compra' tipo_operacion, true guia_colisionada, timestamp'2024-07-01 12:00:00' creado_en, cast(null as int) cantidad")
    heads = {"tipo_operacion": "Tipo", "guia_colisionada": "Colisiona", "creado_en": "Creado", "cantidad": "Cantidad"}
    assert tuple(export.export_frame(df, heads).first()) == ("Compra", "Sí", "01/07/2024 12:00", "")
    assert export.export_frame(df, heads, zone="America/Asuncion").first()["Creado"] == "01/07/2024 08:00"
    export.write_export(export.export_frame(df, heads), str(tmp_path / "x"))
    assert spark.read.csv(str(tmp_path / "x"), header=True).columns == list(heads.values())


def test_dry_run_writes_nothing(spark, tmp_path):
    cur = spark.createDataFrame([(1, "a")], "id int, p string")
    plan = chg.merge(cur, cur, ["id"], ["p"])
    target = tmp_path / "v1"
    assert rows(chg.write_snapshot(plan, str(target), dry_run=True)) == [("actualizada", 1)] and not target.exists()
    chg.write_snapshot(plan, str(target))
    assert rows(spark.read.parquet(str(target))) == [(1, "a")]


def test_merge_missing_and_repeated_keys(spark):
    cur = spark.createDataFrame([(None, "x"), (None, "y"), ("a", "z")], "k string, v string")
    inc = spark.createDataFrame([(None, "p", 1), (None, "q", 2), ("a", "first", 3), ("a", "last", 4), ("b", "new", 5)], "k string, v string, n int")
    got = rows(chg.merge(cur, inc, ["k"], ["v"], order="n"), "k", "v", "accion")
    assert sorted(got, key=str) == sorted([(None, "x", "sin_cambio"), (None, "y", "sin_cambio"), (None, "p", "nueva"), (None, "q", "nueva"), ("a", "last", "actualizada"), ("b", "new", "nueva")], key=str)
    assert "<=>" not in chg.merge(cur, inc, ["k"], ["v"], order="n")._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="repeated incoming key"):
        chg.merge(cur, inc, ["k"], ["v"]).collect()


def test_awkward_sheets(spark, tmp_path):
    def read(text):
        path = tmp_path / f"s{len(list(tmp_path.iterdir()))}.csv"
        path.write_bytes(text.encode())
        return delimited.map_columns(delimited.read_delimited(spark, str(path)))

    df, report = read(';;;\nCódigo;Código;;Dueño;Otro\nA1;A2;x;"Ana\nMaría; ""la"" vieja";o\n;;;;\nB1;;;Luis;\n')
    assert sorted(map(tuple, df.select("codigo", "propietario").collect())) == [("A1", 'Ana\nMaría; "la" vieja'), ("B1", "Luis")]
    assert report == {"reconocidas": {"codigo": "Código", "propietario": "Dueño"}, "ignoradas": ["Otro"]}
    df, _ = read("codigo, nombre\tpropietario\nx\ty\nz\tw\n".replace("codigo, nombre", "codigo"))
    assert df.count() == 2
    df, _ = read("codigo,detalle\nM-1,a;b;c\nM-2,d\n")
    assert sorted(map(tuple, df.collect())) == [("M-1", "a;b;c"), ("M-2", "d")]


def test_sheets_of_one_folder_differ(spark, tmp_path):
    """Encoding, separator and header are each file's own; the second file's header is no row."""
    (tmp_path / "a.csv").write_bytes("Nº de Marca;Dueño;Peso\nA1;Ñandú;1\nA2;\"dos\nlíneas; con punto\";2\n".encode("latin-1"))
    (tmp_path / "b.csv").write_bytes("\n,,\nPropietario,Código,Otro\nÓscar,B1,x\n\"a \"\"b\"\", c\",B2,\n".encode())
    (tmp_path / "c.csv").write_bytes("\ufeffNº de Marca;Dueño;Peso\nC1;ñ;3\n".encode())
    (tmp_path / "d.csv").write_bytes(b"\n \n;;\n")
    df = delimited.read_delimited(spark, str(tmp_path))
    assert df.columns == ["Nº de Marca", "Dueño", "Peso", "Otro"]
    mapped, report = delimited.map_columns(df)
    assert sorted(map(tuple, mapped.collect())) == [("A1", "Ñandú"), ("A2", "dos\nlíneas; con punto"), ("B1", "Óscar"), ("B2", 'a "b", c'), ("C1", "ñ")]
    assert report["ignoradas"] == ["Peso", "Otro"]
    assert sorted(map(tuple, df.select("Nº de Marca", "Peso", "Otro").collect()), key=str) == [("A1", "1", None), ("A2", "2", None), ("B1", None, "x"), ("B2", None, None), ("C1", "3", None)]


def test_quoted_breaks_across_splits(spark, tmp_path):
    """A file in many splits: most begin inside a quoted value, some hold no start of a row at all."""
    want = [(f"M{i}", "\n".join(f'línea {k} de {i}; "{k}"' for k in range(i % 7 * i % 40))) for i in range(24)]
    text = "codigo;detalle\n" + "".join(f'{c};"{d.replace(chr(34), chr(34) * 2)}"\n' for c, d in want)
    path = tmp_path / "s.csv"
    path.write_bytes(text.encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (200, 997, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            df = delimited.read_delimited(spark, str(path))
            assert sorted((r.codigo, r.detalle or "") for r in df.collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert delimited.read_lines(spark, str(path)).count() == text.count("\n")


def test_folding_covers_unicode(spark):
    from stampbook.functions.text import ascii_fold

    df = spark.createDataFrame([("Ⅷ ① m⁴ ⑩ ﬁ 𝐀 ñ 中 ㎏",)], "t string")
    assert df.select(ascii_fold(F.col("t"))).first()[0] == "VIII 1 m4 10 fi A n  kg"


def test_a_code_that_all_ask_for_is_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(relations, "HOT_CODE_ROWS", 5, raising=False)
    marks = spark.createDataFrame([(k, f"C{k}") for k in range(1, 9)] + [(9, None)], "id long, codigo string")
    asked = [(f"L{i}", ["falta", "C1", f"C{i}", None, "C1"]) for i in range(1, 13)]
    lists = spark.createDataFrame(asked, "lista string, codigos array<string>")
    got = lookup_ordered(marks, lists)
    want = sorted({(name, c, codes.index(c)) for name, codes in asked for c in codes if c in {f"C{k}" for k in range(1, 9)}})
    assert sorted((r.lista, r.codigo, r.posicion_pedida) for r in got.collect()) == want
    saved = sorted((r.lista, r.marca_id, r.posicion) for r in save_selection(lists, marks).collect())
    assert saved == sorted((name, int(c[1:]), p + 1) for name, codes in asked for p, c in enumerate(codes) if c in {f"C{k}" for k in range(1, 9)})
    plain = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plain and "LeftSemi" in plain
