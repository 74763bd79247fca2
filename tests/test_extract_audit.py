"""Extraction, votes, audit, citations and similarity against literal expectations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stampbook.operators import audit, extract, guides, sequence, similar
from stampbook.operators.relations import assign_codes

LINES = "id int, formato string, alto int, lineas array<struct<texto:string,caja:array<array<double>>,conf:double>>"


def line(text, x, y, conf=0.9):
    return (text, [[x - 5.0, y - 5.0], [x + 5.0, y - 5.0], [x + 5.0, y + 5.0], [x - 5.0, y + 5.0]], conf)


def test_certificate_fields(spark):
    page = [line("los datos 10894231 del anverso", 400, 900), line("PROPIETARIO 4304490", 100, 200), line("HUGO ALBERTO FRANCO", 300, 201),
            line("****16", 100, 1000), line("****21", 200, 1000), line("03/02/2025", 10, 1200)]
    r = extract.extract_fields(spark.createDataFrame([(1, "SENACSA_CERTIFICADO", 1600, page)], LINES)).first()
    assert (r.numero_guia, r.fuente_numero, r.conf_numero) == ("10894231", "certificado:anverso", 0.9)
    assert (r.propietario_documento, r.propietario, r.cantidad_animales, r.fecha_texto) == ("4304490", "HUGO ALBERTO FRANCO", 21, "03/02/2025")


def test_certificate_cascade_and_guides(spark):
    excluded = "80000001"
    pages = [
        (1, "SENACSA_CERTIFICADO", 1600, [line("80000001 DEL ANVERSO", 0, 0), line("DATOS 80000001 11111111", 0, 10, 0.5)]),
        (2, "SENACSA_CERTIFICADO", 1600, [line("22222222", 0, 100, 0.5), line("33333333", 0, 400, 0.5), line("ANVERSO", 0, 420)]),
        (3, "GE2_ANEXO", 1600, [line("44444444", 0, 0, 0.3), line("55555555", 500, 90, 0.7), line("N° de Orden", 480, 100)]),
        (4, "CIEFA_GO2", 1600, [line("66666666", 9, 9, 0.2), line("77777777", 1, 1, 0.2)]),
        (5, "NOTA_REMISION", 1600, [line("66666666", 9, 9, 0.2)]),
    ]
    got = {r.id: (r.numero_guia, r.fuente_numero, round(r.conf_numero, 3)) for r in extract.extract_fields(spark.createDataFrame(pages, LINES), excluded=excluded).collect()}
    assert got == {1: ("11111111", "certificado:linea", 0.5), 2: ("33333333", "certificado:cercano", 0.4), 3: ("55555555", "ge2_anexo:orden", 0.7),
                   4: ("66666666", "ciefa_go2:orden", 0.2), 5: (None, None, 0.0)}


def test_header(spark):
    def text(buyer):
        return "\n".join(["GUIA", "N° de Orden CI / RUC DV", "91181756 80020081 0", "Nombre y Apellido / Razón Social", "ESTANCIA UNO S.A.",
                          "Total ***** 66", "SON: SESENTA Y SEIS ANIMALES Y DIEZ MARCAS", "Rubro 7 - Identificación del Adquiriente",
                          "Nombre y Apellido / Razón Social CI / RUC DV", buyer])
    df = spark.createDataFrame([(text("FRIGORIFICO X 80083402 0"),), (text("CLEDSON DAL TOE MARCELINO 3712507"),), ("nada",)], "texto string")
    a, b, c = extract.extract_header(df).collect()
    assert (a.numero_orden, a.vendedor_ci_ruc, a.vendedor_dv, a.vendedor_nombre) == ("91181756", "80020081", "0", "ESTANCIA UNO S.A.")
    assert (a.comprador_nombre, a.comprador_ci_ruc, a.comprador_dv, a.cantidad_animales, a.marcas_declaradas) == ("FRIGORIFICO X", "80083402", "0", 66, 10)
    assert (b.comprador_nombre, b.comprador_ci_ruc, b.comprador_dv) == ("CLEDSON DAL TOE MARCELINO", "3712507", None)
    assert (c.numero_orden, c.comprador_nombre, c.cantidad_animales) == (None, None, None)


def test_citations(spark):
    text = ("Rubro 4 Boleta (B) y/o Guía (G)\nRespaldo\n(B) ACX492\n(G) 90947260 27/01/2025 (G) 90959498 13/02/2025\n(G)90959493 13/02/2025 (G) 90947260 01/01/2025"
            " (G) sinnumero\nFactura de venta (G) 99999999")
    rows = extract.parse_citations(spark.createDataFrame([(text,), ("Rubro 5 (G) 12345678",), ("Rubro 4 Respaldo (G) 1 " + "x" * 4000 + "(G) 2",)], "texto string")).collect()
    assert [tuple(c) for c in rows[0].respaldo] == [("B", "ACX492", None), ("G", "90947260", "27/01/2025"), ("G", "90959498", "13/02/2025"), ("G", "90959493", "13/02/2025")]
    assert rows[1].respaldo == [] and [c.numero for c in rows[2].respaldo] == ["1", "2"]
    long = "Rubro 4 Respaldo " + " ".join(f"(G) {90000000 + i % 500} 27/01/2025" for i in range(600))
    once, cut = (extract.parse_citations(spark.createDataFrame([(long,)], "texto string"), window=w).first().respaldo for w in (None, 4000))
    assert [c.numero for c in once] == [str(90000000 + i) for i in range(500)] and 100 < len(cut) < 400


def test_validate_citations_and_cited_marks(spark):
    cited = spark.createDataFrame([("1", 0, "G", "95000001", None), ("1", 1, "G", "95000002", None), ("1", 2, "B", "ZZZ123", None)], "doc string, posicion int, cod string, numero string, fecha string")
    pages = spark.createDataFrame([(5, "95000001"), (6, None)], "id int, numero_guia string")
    ops = spark.createDataFrame([(9, "95000009", "compra", True)], "id int, numero_guia string, tipo_operacion string, activo boolean")
    marks = spark.createDataFrame([(1, "M-1", "dominante", "activa", True, "x", 5, None), (2, "M-2", "dominante", "baja", True, "x", 5, None), (3, "M-3", None, "activa", True, None, 5, None),
                                   (4, "M-0", None, "revisar", True, "x", 5, 9)],
                                  "id int, codigo string, tipo string, estado string, activo boolean, archivo_png string, escaneo_id int, operacion_id int")
    got = {r.numero: (r.encontrada, r.paginas, r.primer_escaneo) for r in audit.validate_citations(cited, pages, ops).collect()}
    assert got == {"95000001": (True, 1, 5), "95000002": (False, 0, None), "ZZZ123": (None, 0, None)}
    assert [(r.numero_guia, r.codigo) for r in audit.cited_marks(cited, marks, pages, ops).orderBy("posicion").collect()] == [("95000001", "M-1"), ("95000001", "M-0")]
    assert audit.cited_marks(cited, marks, pages, ops, n=1).count() == 1


def test_votes_and_reconciliation(spark):
    first = spark.createDataFrame([("a", "90947260"), ("b", "90947260")], "item string, valor string")
    extras = spark.createDataFrame([("a", "90947268", 0), ("a", "90947268", 1), ("a", "90947260", 2), ("b", "90947268", 0), ("b", "90947268", 1)], "item string, valor string, pos int")
    got = {r.item: (r.ganador, r.votos) for r in audit.vote(audit.weighted_readings(first, extras)).collect()}
    assert got == {"a": ("90947260", 3), "b": ("90947260", 2)}
    pages = spark.createDataFrame([(1, "A"), (2, "A"), (3, None), (4, "A"), (5, None), (6, "A")], "pagina int, primera string")
    won = spark.createDataFrame([(1, "A"), (2, "A"), (2, "B"), (5, "B"), (6, "A"), (6, "A")], "pagina int, ganador string")
    assert {r.pagina: (r.estado, r.segunda) for r in audit.reconcile(pages, won).collect()} == {
        1: ("coincide", "A"), 2: ("distinto", None), 3: ("sin_numero_en_ninguna", None), 4: ("primera_sin_segunda", None), 5: ("encontro_numero_nuevo", "B"), 6: ("coincide", None)}


def test_near_pairs_match_brute_force(spark):
    import random

    rnd = random.Random(8)
    numbers = sorted({"".join(rnd.choice("0123") for _ in range(rnd.choice([3, 4, 5]))) for _ in range(150)})

    def near(a, b):
        if len(a) != len(b) or a == b:
            return False
        d = [i for i in range(len(a)) if a[i] != b[i]]
        return len(d) == 1 or (len(d) == 2 and d[1] - d[0] == 1 and a[d[0]] + a[d[1]] == b[d[1]] + b[d[0]])

    df = spark.createDataFrame([(n,) for n in numbers], "n string")
    want = {(a, b) for a in numbers for b in numbers if near(a, b)}
    rows = [tuple(r) for r in audit.near_pairs(df, "n").collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert {tuple(r) for r in audit.near_pairs(df, "n", 2).collect()} == {(a, b) for a, b in want if a[:2] == b[:2]}


def test_rule_classifier(spark):
    base = dict(cobertura=0.02, n_comp=1, n_puntos=0, mayor=1.0, lineas=0.0, largo=0.0, diagonal=0.0, altura_uniforme=0.0, altura_rel=0.0, filas=1, max_alto=0.9, max_ancho=0.9, vertices=50)
    cases = [dict(cobertura=0.0), dict(lineas=0.9, largo=0.8, diagonal=0.9), dict(lineas=0.9, largo=0.8), dict(n_comp=7, altura_uniforme=1.0, max_alto=0.14), dict(lineas=0.3),
             dict(n_puntos=120), dict(cobertura=0.003), dict(lineas=0.7, largo=0.5, vertices=10, n_comp=8)]
    df = spark.createDataFrame([{"i": i, **base, **c} for i, c in enumerate(cases)])
    got = [(r.categoria, r.razon) for r in audit.classify(df).orderBy("i").collect()]
    assert [g[0] for g in got] == ["vacia", "anulacion", "linea_de_tabla", "texto_o_sello", None, "fragmento", "fragmento", "linea_de_tabla"]
    assert got[1][1] == "90% de la tinta es recta e inclinada" and got[3][1] == "7 letras parejas en 1 fila(s)" and got[4][1] == ""


def test_reading_order_and_text(spark):
    boxes = [(10.0, 103.0, 5.0, 10.0), (50.0, 100.0, 5.0, 10.0), (30.0, 96.0, 5.0, 10.0), (10.0, 80.0, 5.0, 10.0)]
    df = spark.createDataFrame([(1, boxes)], "page int, cajas array<struct<x:double,y:double,w:double,h:double>>")
    assert {(r.x, r.y): (r.fila, r.columna) for r in sequence.reading_order(df).collect()} == {(10, 103): (1, 1), (50, 100): (1, 2), (30, 96): (2, 1), (10, 80): (3, 1)}
    pieces = spark.createDataFrame([(1, [(50.0, 99.0, "mundo"), (10.0, 100.0, " hola "), (5.0, 50.0, "fin"), (6.0, 50.0, "  ")])], "page int, piezas array<struct<x:double,y:double,texto:string>>")
    assert sequence.ordered_text(pieces).first().texto == "hola mundo\nfin"
    down = spark.createDataFrame([(1, [(0.0, 0.0, 1.0, 10.0), (9.0, 4.0, 1.0, 10.0), (0.0, 30.0, 1.0, 10.0)])], "page int, cajas array<struct<x:double,y:double,w:double,h:double>>")
    assert sorted((r.fila, r.columna) for r in sequence.reading_order(down, y_up=False, centres=True).collect()) == [(1, 1), (1, 2), (2, 1)]


def test_a_page_of_20000_boxes(spark):
    made = spark.range(1).selectExpr("transform(sequence(0, 19999), i -> named_struct('x', double((i * 7919) % 20000), 'y', double(i div 100 * 30 + i % 3), 'w', 1D, 'h', 10D)) AS cajas", "1 AS page")
    rows = sequence.reading_order(made).selectExpr("fila", "columna", "x", "y").collect()
    assert len(rows) == 20_000 and {(r.fila, r.columna) for r in rows} == {(f, c) for f in range(1, 201) for c in range(1, 101)}
    assert all(r.fila == 200 - int(r.y) // 30 for r in rows)
    first = sorted((r for r in rows if r.fila == 1), key=lambda r: r.columna)
    assert [r.x for r in first] == sorted(r.x for r in first)


def test_code_overrides(spark):
    cells = spark.createDataFrame([("h01", 1, 1), ("h01", 1, 2)], "hoja string, fila int, columna int")
    listed = spark.createDataFrame([("h01 ", 1, 2, " M-7 ")], "hoja string, fila int, columna int, codigo string")
    assert [r.codigo for r in assign_codes(cells, listed).orderBy("columna").collect()] == ["H01-F01C01", "M-7"]


PAGE = ("id int, carpeta string, archivo string, formato string, numero_guia string, fuente_numero string, conf_numero double, numero_certificado string,"
        " propietario string, texto_ocr string, imagen string")


def test_page_audit(spark):
    rows = [
        (1, "A", "1", "GE2_PRINCIPAL", "91000001", "ocr", 0.5, None, "P", "GE2 91000002 cita 91000009", "i"),
        (2, "A", "2", "SENACSA_CERTIFICADO", "91000001", "inferido:anexo", 0.5, "C1", None, None, None),
        (3, "A", "3", None, "", None, None, None, None, None, None),
        (4, "A", "4", "GE2_ANEXO", "123", "ocr", 0.9, None, None, "80000001", None),
        (5, "A", "5", "GE2_ANEXO", "70000000", "ocr", 0.9, None, None, None, None),
        (6, "A", "6", "CIEFA_GO2", "91000003", "ocr", 0.9, None, None, None, None),
    ]
    got = {(r.archivo, r.numero_guia): r.motivos for r in audit.audit_pages(spark.createDataFrame(rows, PAGE), "80000001").collect()}
    assert got == {
        ("1", "91000001"): "lectura poco segura (0.50); casi igual a 91000003; el «GE2…» impreso dice 91000002",
        ("2", "91000001"): "el mismo número en certificados distintos; número inferido por vecindad; lectura poco segura (0.50); casi igual a 91000003",
        ("3", ""): "sin número", ("4", "123"): "no tiene 8 dígitos", ("5", "70000000"): "prefijo raro (70)",
        ("", "91000002"): "citado en el Respaldo de una guía y no está cargado (¿91000001, 91000003?)",
        ("", "91000009"): "citado en el Respaldo de una guía y no está cargado (¿91000001, 91000003?)",
    }


def test_null_format_sorts_before_certificate(spark):
    rows = [(1, "n", "SENACSA_CERTIFICADO", "cert"), (2, "n", None, "nadie"), (3, "n", "X", ""), (4, "m", "X", ""), (5, "m", "SENACSA_CERTIFICADO", None), (6, "m", None, "ultimo")]
    g = spark.createDataFrame(rows, "id int, k string, formato string, v string").groupBy("k")
    r = {x.k: (x.a, x.b) for x in g.agg(guides.pick_first("v").alias("a"), guides.pick_first_filled("v").alias("b")).collect()}
    assert r == {"n": ("nadie", "cert"), "m": ("ultimo", "ultimo")}


def brute_scores(q, qa, corpus):
    def unit(v):
        v = np.asarray(v, dtype=float) - np.mean(v)
        n = np.linalg.norm(v)
        return v / n if n else v
    return {i: max(0.0, float(unit(q) @ unit(v))) * (0.75 + 0.25 * min(a, qa) / max(a, qa)) * 100 for i, a, v in corpus}


@pytest.mark.parametrize("per_pass", [256, 2])
def test_similar(spark, monkeypatch, per_pass):
    monkeypatch.setattr(similar, "QUERIES_PER_PASS", per_pass)
    rnd = np.random.RandomState(0)
    corpus = [(i, float(rnd.choice([0.5, 1.0, 2.0])), rnd.rand(16).astype(float).tolist()) for i in range(80)] + [(80, 1.0, [1.0] * 16)]
    queries = [(f"q{i}", 1.0, corpus[i][2]) for i in range(5)]
    out = similar.similar(spark.createDataFrame(queries, "consulta string, aspect double, v array<float>"),
                          spark.createDataFrame(corpus, "id int, aspect double, v array<float>").repartition(4), k=6).collect()
    for name, aspect, v in queries:
        want = brute_scores(v, aspect, corpus)
        got = sorted([r for r in out if r.consulta == name], key=lambda r: r.rn)
        assert len(got) == 6
        assert [r.id for r in got] == sorted(want, key=lambda i: (-round(want[i], 4), i))[:6]
        assert all(abs(r.puntaje - want[r.id]) < 0.06 for r in got)


def test_fingerprints_and_backfill(spark):
    df = spark.createDataFrame([(1, bytearray([64] + [0] * 1023 + [9])), (2, bytearray()), (3, None)], "id int, huella binary")
    rows = similar.fingerprint_vectors(df).collect()
    assert [(r.id, r.aspect, len(r.v), r.v[-1]) for r in rows] == [(1, 1.0, 1024, 9.0)]
    zero = spark.createDataFrame([([2.0, 2.0],), ([1.0, 3.0],)], "v array<double>").select(similar.unit(F.col("v")).alias("u")).collect()
    assert zero[0].u == [0.0, 0.0] and abs(zero[1].u[1] - 0.5 ** 0.5) < 1e-12
    src = spark.createDataFrame([(i, None if i else "ya", None if i == 4 else f"p{i}") for i in range(7)], "id int, huella string, png string")
    fn = lambda d: d.where("id <> 2").select("id", F.upper("png").alias("huella"))
    out = {r.id: (r.huella, r.accion) for r in similar.backfill(src, fn, source="png", sentinel=F.lit(""), limit=3).collect()}
    assert out == {0: ("ya", "sin_cambio"), 1: ("P1", "calculada"), 2: ("", "sin_tinta"), 3: ("P3", "calculada"), 4: (None, "sin_cambio"), 5: (None, "pendiente"), 6: (None, "pendiente")}
