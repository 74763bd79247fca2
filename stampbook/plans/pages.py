"""Queries over pages: guides, order, extraction, audit, citations, text and number functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from stampbook.functions import numbers as num
from stampbook.functions import text as txt
from stampbook.operators import aggregates as agg
from stampbook.operators import audit, extract, guides, sequence
from stampbook.operators.ordering import dealt
from stampbook.operators.relations import groups_matching
from stampbook.plans.bindings import with_bindings as w
from stampbook.plans.registry import page_frame, query

# --- guides -----------------------------------------------------------------------------------
_G1 = """
    , g AS (SELECT numero_guia, count(*) AS paginas,
        (SELECT string_agg(f, ',' ORDER BY f) FROM (SELECT DISTINCT coalesce(formato, '-') AS f FROM escaneos i WHERE i.numero_guia = e.numero_guia)) AS formatos,
        arg_min(propietario, {rank}) FILTER (WHERE propietario IS NOT NULL) AS propietario,
        arg_min(propietario_documento, {rank}) FILTER (WHERE propietario_documento IS NOT NULL) AS documento,
        max(cantidad_animales) AS cantidad_animales, min(fecha_texto) AS fecha_texto, bool_and(revisado) AS revisada, min(orden) AS orden,
        arg_min(id, orden * 1000000 + id) AS primera_pagina
      FROM {source} e WHERE numero_guia IS NOT NULL GROUP BY numero_guia)""".replace(
    "{rank}", "CASE WHEN formato IS NULL THEN 0 WHEN formato = 'SENACSA_CERTIFICADO' THEN 1 ELSE 2 END * 1000000000 + id"
)
_GUIDE_COLS = "numero_guia, paginas, formatos, propietario, documento, cantidad_animales, fecha_texto, revisada, orden, primera_pagina"


def _flat_formats(df):
    named = F.transform("formatos", lambda f: F.coalesce(f, F.lit("-")))
    return df.withColumn("formatos", F.array_join(F.array_sort(named), ","))


@query("g1_consolidate_guides", w("escaneos", _G1.replace("{source}", "escaneos") + f" SELECT {_GUIDE_COLS} FROM g"))
def _(t):
    return _flat_formats(guides.consolidate_guides(t.escaneos)).select(*_GUIDE_COLS.split(", "))


_LISTING = (
    ", k AS (SELECT DISTINCT numero_guia FROM escaneos WHERE numero_guia IS NOT NULL AND (numero_guia ILIKE '%en%' OR propietario ILIKE '%en%'"
    " OR propietario_documento ILIKE '%en%' OR numero_certificado ILIKE '%en%' OR texto_ocr ILIKE '%en%' OR etiqueta ILIKE '%en%')"
    " AND formato = 'SENACSA_CERTIFICADO'), sel AS (SELECT * FROM escaneos WHERE numero_guia IN (SELECT numero_guia FROM k))"
    + _G1.replace("{source}", "sel").replace("FROM escaneos i", "FROM sel i")
    + ", c AS (SELECT e.numero_guia, count(*) AS marcas FROM escaneos e JOIN marcas m ON m.escaneo_id = e.id AND m.activo AND m.estado <> 'baja' GROUP BY 1)"
    f" SELECT {_GUIDE_COLS}, coalesce(marcas, 0) AS marcas, (SELECT count(*) FROM g) AS total FROM g LEFT JOIN c USING (numero_guia)"
    " ORDER BY numero_guia LIMIT 24"
)


@query("g1_list_guides_page", w("escaneos marcas", _LISTING))
def _(t):
    found = guides.list_guides_page(t.escaneos, t.marcas, text="en", formato="SENACSA_CERTIFICADO")
    return _flat_formats(page_frame(found)).select(*_GUIDE_COLS.split(", "), "marcas", "total")


@query("g1_guide_pages", w("escaneos", """
    SELECT numero_guia, id, row_number() OVER (PARTITION BY numero_guia ORDER BY orden, id) AS posicion FROM escaneos WHERE numero_guia IS NOT NULL"""))
def _(t):
    return guides.guide_pages(t.escaneos)


@query("g2_pick_first", w("escaneos", """
    SELECT carpeta, arg_min(propietario, CASE WHEN formato IS NULL THEN 0 WHEN formato = 'SENACSA_CERTIFICADO' THEN 1 ELSE 2 END * 1000000000 + id)
      FILTER (WHERE propietario IS NOT NULL) AS propietario FROM escaneos GROUP BY carpeta"""))
def _(t):
    return t.escaneos.groupBy("carpeta").agg(guides.pick_first("propietario").alias("propietario"))


@query("g3_marks_per_guide", w("escaneos marcas", """
    SELECT g.numero_guia, count(m.id) AS marcas FROM escaneos g LEFT JOIN marcas m ON m.escaneo_id = g.id AND m.activo AND m.estado <> 'baja'
    WHERE g.numero_guia IS NOT NULL GROUP BY 1"""))
def _(t):
    numbers = t.escaneos.where("numero_guia IS NOT NULL").select("numero_guia").distinct()
    return guides.marks_per_guide(numbers, t.escaneos, t.marcas)


_PICK = "arg_min({c}, CASE WHEN formato = 'SENACSA_CERTIFICADO' THEN 0 ELSE 1 END * 1000000000 + id) FILTER (WHERE {c} <> '') AS {a}"


@query("g4_guide_detail", w("escaneos marcas operaciones", f"""
    , h AS (SELECT numero_guia, {_PICK.format(c='propietario', a='propietario')}, {_PICK.format(c='propietario_documento', a='documento')},
        {_PICK.format(c='establecimiento', a='establecimiento')}, nullif(max(coalesce(cantidad_animales, 0)), 0) AS cantidad_animales,
        {_PICK.format(c='fecha_texto', a='fecha_texto')}, count(DISTINCT nullif(numero_certificado, '')) AS certificados
      FROM escaneos WHERE numero_guia IS NOT NULL GROUP BY 1)
    SELECT h.*, (SELECT count(*) FROM escaneos e JOIN marcas m ON m.escaneo_id = e.id AND m.activo WHERE e.numero_guia = h.numero_guia) AS marcas,
      (SELECT count(*) FROM operaciones o WHERE o.numero_guia = h.numero_guia AND o.activo) AS operaciones FROM h"""))
def _(t):
    d = guides.guide_detail(t.escaneos, t.marcas, t.operaciones)
    out = d["guia"].drop("respaldo")
    for name in ("certificados", "marcas", "operaciones"):
        out = out.join(d[name].groupBy("numero_guia").agg(F.count(F.lit(1)).alias(name)), "numero_guia", "left")
        out = out.withColumn(name, F.coalesce(name, F.lit(0)))
    return out


@query("g4_guide_detail_pages", w("escaneos", """
    SELECT numero_guia, id, archivo, row_number() OVER (PARTITION BY numero_guia ORDER BY carpeta_n NULLS LAST, parte NULLS FIRST, pagina_n, id) AS posicion_lectura
    FROM escaneos WHERE numero_guia IS NOT NULL"""))
def _(t):
    return guides.guide_detail(t.escaneos, t.marcas, t.operaciones)["paginas"].select("numero_guia", "id", "archivo", "posicion_lectura")


@query("j4_groups_matching", w("escaneos", """
    SELECT id, numero_guia, formato FROM escaneos WHERE numero_guia IN (SELECT numero_guia FROM escaneos WHERE fuente_numero = 'manual')"""))
def _(t):
    return groups_matching(t.escaneos, F.col("fuente_numero") == "manual").select("id", "numero_guia", "formato")


_CITED = ", cit AS (SELECT id, {n} AS numero, {c} AS cod, p AS posicion FROM documentos_emitidos CROSS JOIN (VALUES (0), (1)) v(p))".replace(
    "{n}", "CASE WHEN p = 0 THEN CAST(90000000 + operacion_id * 250 AS STRING) ELSE concat('ACX', CAST(id AS STRING)) END"
).replace("{c}", "CASE WHEN p = 0 THEN 'G' ELSE 'B' END")


@query("c1_citations", w("documentos_emitidos", _CITED + """
    SELECT id, posicion, cod, numero, CASE WHEN posicion = 0 THEN '27/01/2025' END AS fecha FROM cit"""))
def _(t):
    return extract.citations(t.documentos_emitidos, "id")


@query("g5_cited_facts", w("documentos_emitidos escaneos operaciones", _CITED + """
    SELECT n.numero AS numero_guia, coalesce(p.paginas, 0) AS paginas, p.primer_escaneo, coalesce(o.operaciones, 0) AS operaciones, o.primera_operacion
    FROM (SELECT DISTINCT numero FROM cit WHERE cod = 'G') n
    LEFT JOIN (SELECT numero_guia, count(*) AS paginas, min(id) AS primer_escaneo FROM escaneos GROUP BY 1) p ON p.numero_guia = n.numero
    LEFT JOIN (SELECT numero_guia, count(*) AS operaciones, min(id) AS primera_operacion FROM operaciones WHERE activo GROUP BY 1) o ON o.numero_guia = n.numero"""))
def _(t):
    return guides.cited_facts(extract.citations(t.documentos_emitidos, "id"), t.escaneos, t.operaciones)


@query("g5_cited_operations", w("documentos_emitidos operaciones", _CITED + """
    SELECT numero_guia, row_number() OVER (PARTITION BY numero_guia ORDER BY id) AS posicion, id AS operacion_id
    FROM operaciones WHERE activo AND numero_guia IN (SELECT numero FROM cit WHERE cod = 'G')"""))
def _(t):
    return guides.cited_operations(extract.citations(t.documentos_emitidos, "id"), t.operaciones)


@query("c2_validate_citations", w("documentos_emitidos escaneos operaciones", _CITED + """
    , p AS (SELECT numero_guia, count(*) AS paginas, min(id) AS primer_escaneo FROM escaneos WHERE numero_guia IS NOT NULL GROUP BY 1),
      o AS (SELECT numero_guia, count(*) AS operaciones, min(id) AS primera_operacion FROM operaciones WHERE activo GROUP BY 1)
    SELECT c.id, c.posicion, c.cod, c.numero, CASE WHEN cod = 'G' THEN p.numero_guia IS NOT NULL OR o.numero_guia IS NOT NULL END AS encontrada,
      CASE WHEN cod = 'G' THEN coalesce(p.paginas, 0) ELSE 0 END AS paginas, CASE WHEN cod = 'G' THEN primer_escaneo END AS primer_escaneo,
      CASE WHEN cod = 'G' THEN coalesce(o.operaciones, 0) ELSE 0 END AS operaciones, CASE WHEN cod = 'G' THEN primera_operacion END AS primera_operacion
    FROM cit c LEFT JOIN p ON p.numero_guia = c.numero LEFT JOIN o ON o.numero_guia = c.numero"""))
def _(t):
    cited = extract.citations(t.documentos_emitidos, "id")
    return audit.validate_citations(cited, t.escaneos, t.operaciones).drop("fecha")


@query("c3_cited_marks", w("documentos_emitidos escaneos operaciones marcas", _CITED + """
    , n AS (SELECT DISTINCT numero AS numero_guia FROM cit WHERE cod = 'G'),
      u AS (SELECT * FROM marcas WHERE activo AND estado <> 'baja' AND archivo_png IS NOT NULL),
      r AS (SELECT e.numero_guia, u.id, u.codigo, u.tipo, u.estado, u.descripcion FROM u JOIN escaneos e ON e.id = u.escaneo_id
        UNION SELECT o.numero_guia, u.id, u.codigo, u.tipo, u.estado, u.descripcion FROM u JOIN operaciones o ON o.id = u.operacion_id)
    SELECT numero_guia, id, codigo, tipo, estado, descripcion, posicion FROM (SELECT r.*, row_number() OVER (PARTITION BY numero_guia
      ORDER BY CASE WHEN tipo = 'dominante' THEN 0 ELSE 1 END, codigo) AS posicion FROM r JOIN n USING (numero_guia))"""))
def _(t):
    cited = extract.citations(t.documentos_emitidos, "id")
    return audit.cited_marks(cited, t.marcas, t.escaneos, t.operaciones)


# --- order ------------------------------------------------------------------------------------
_INFER = """
    , a AS (SELECT *, count(numero_guia) OVER w AS seg, lag(formato) OVER w AS antes, lead(numero_guia) OVER w AS sig,
        last_value(numero_guia IGNORE NULLS) OVER (PARTITION BY carpeta ORDER BY orden, archivo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cand
      FROM {source} WINDOW w AS (PARTITION BY carpeta ORDER BY orden, archivo)),
      b AS (SELECT *, coalesce(formato = 'GE2_ANEXO' AND antes IN ('GE2_PRINCIPAL', 'GE2_ANEXO'), false) AS anexo, coalesce(cand = sig, false) AS acuerdo FROM a),
      c AS (SELECT *, sum(CASE WHEN numero_guia IS NULL AND NOT anexo AND NOT acuerdo THEN 1 ELSE 0 END)
        OVER (PARTITION BY carpeta, seg ORDER BY orden, archivo) AS rotas FROM b),
      d AS (SELECT *, numero_guia IS NULL AND seg > 0 AND rotas = 0 AS inferida FROM c)
    SELECT carpeta, archivo, CASE WHEN inferida THEN cand ELSE numero_guia END AS numero_guia, inferida,
      CASE WHEN inferida AND anexo THEN 'inferido:anexo' WHEN inferida THEN 'inferido:vecinas' ELSE fuente_numero END AS fuente_numero,
      CAST(CASE WHEN inferida AND anexo THEN 0.5 WHEN inferida THEN 0.4 ELSE conf_numero END AS DOUBLE) AS conf_numero FROM d"""
_INFER_COLS = ["carpeta", "archivo", "numero_guia", "inferida", "fuente_numero", "conf_numero"]


@query("o1_infer_numbers", w("secuencia", _INFER.replace("{source}", "secuencia")))
def _(t):
    return sequence.infer_numbers(t.secuencia).select(*_INFER_COLS)


@query("o1_infer_numbers_documents", w("escaneos", _INFER.replace("{source}", "escaneos")))
def _(t):
    return sequence.infer_numbers(t.escaneos).select(*_INFER_COLS)


@query("o2_neighbours", w("escaneos", """
    , p AS (SELECT carpeta, orden, max(id) AS hi, min(id) AS lo FROM escaneos GROUP BY 1, 2),
      q AS (SELECT carpeta, orden, lag(hi) OVER w AS anterior_id, lead(lo) OVER w AS siguiente_id FROM p WINDOW w AS (PARTITION BY carpeta ORDER BY orden))
    SELECT e.id, anterior_id, siguiente_id FROM escaneos e JOIN q USING (carpeta, orden)"""))
def _(t):
    return sequence.neighbours(t.escaneos).select("id", "anterior_id", "siguiente_id")


@query("o3_gap_clusters", """
    WITH p AS (SELECT user_id, value AS v, CASE WHEN value - lag(value) OVER (PARTITION BY user_id ORDER BY value) > 2 THEN 1 ELSE 0 END AS abre FROM events),
      q AS (SELECT user_id, v, sum(abre) OVER (PARTITION BY user_id ORDER BY v ROWS UNBOUNDED PRECEDING) AS grupo FROM p)
    SELECT user_id, CAST(grupo AS BIGINT) AS grupo, round(avg(v), 6) AS media, count(*) AS valores FROM q GROUP BY 1, 2""")
def _(t):
    c = sequence.gap_clusters(t.raw("events"), ["user_id"], "value", 2.0)
    return c.withColumn("media", F.round("media", 6))


@query("o4_regular_lines", """
    WITH RECURSIVE p AS (SELECT vec_id AS id, list_sort(list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) * 40))) AS pts FROM embeddings),
      f AS (SELECT id, pts, 1 AS i, 0 AS s, CAST(NULL AS DOUBLE) AS base, 0 AS bs, 0 AS bl FROM p
        UNION ALL SELECT id, pts, i + 1, s2, base2, CASE WHEN i - s2 > bl THEN s2 ELSE bs END, greatest(bl, i - s2) FROM (
          SELECT *, CASE WHEN sigue THEN s ELSE i - 1 END AS s2, CASE WHEN sigue THEN base ELSE pts[i + 1] - pts[i] END AS base2 FROM (
            SELECT *, coalesce(abs(pts[i + 1] - pts[i] - base) <= base * 0.15, false) AS sigue FROM f WHERE i < len(pts))))
    SELECT id, array_to_string(list_transform(pts[bs + 1 : bs + bl + 1], lambda x: CAST(CAST(x AS BIGINT) AS STRING)), ',') AS lineas FROM f WHERE i = len(pts)""")
def _(t):
    places = F.transform("v", lambda x: F.round(x.cast("double") * 40, 0))
    rows = t.huellas.select("id", places.alias("posiciones"))
    text = F.transform("lineas_regulares", lambda x: x.cast("long").cast("string"))
    return sequence.regular_lines(rows).select("id", F.array_join(text, ",").alias("lineas"))


def _thousandths(vector, k):
    """Box place of a component; the product is single precision like the vectors, so that halves round as in the SQL."""
    return F.round(F.element_at(vector, k).cast("float") * F.lit(1000).cast("float")).cast("long")


@query("o5_reading_order", """
    WITH RECURSIVE b AS (SELECT vec_id AS id, k AS caja, CAST(round(embedding[k] * 1000) AS BIGINT) AS x,
        CAST(round(embedding[k + 32] * 1000) AS BIGINT) AS y FROM embeddings CROSS JOIN range(1, 33) r(k)),
      s AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY y DESC, caja) AS n FROM b),
      f AS (SELECT id, caja, x, y, n, y AS ancla, 1 AS fila FROM s WHERE n = 1
        UNION ALL SELECT s.id, s.caja, s.x, s.y, s.n, CASE WHEN abs(s.y - f.ancla) <= 20 THEN f.ancla ELSE s.y END,
          CASE WHEN abs(s.y - f.ancla) <= 20 THEN f.fila ELSE f.fila + 1 END FROM f JOIN s ON s.id = f.id AND s.n = f.n + 1)
    SELECT id, caja, x, y, fila, row_number() OVER (PARTITION BY id, fila ORDER BY x, caja) AS columna FROM f""")
def _(t):
    v = t.raw("embeddings")
    box = F.transform(
        F.sequence(F.lit(1), F.lit(32)),
        lambda k: F.struct(
            k.alias("caja"), _thousandths("embedding", k).alias("x"),
            _thousandths("embedding", k + 32).alias("y"),
            F.lit(40.0).alias("w"), F.lit(40.0).alias("h"),
        ),
    )
    return sequence.reading_order(v.select(F.col("vec_id").alias("id"), box.alias("cajas"))).select("id", "caja", "x", "y", "fila", "columna")


_SLOTS = """
    , cas AS (SELECT operacion_id AS doc, tipo AS copia, origen_carpeta_n AS orden, codigo AS slot, archivo_svg IS NOT NULL AS ocupada FROM marcas),
      porc AS (SELECT doc, copia, orden, count(*) FILTER (WHERE NOT ocupada) AS libres FROM cas GROUP BY 1, 2, 3),
      hoja AS (SELECT doc, orden, min(libres) AS cupo FROM porc GROUP BY 1, 2),
      acum AS (SELECT *, sum(cupo) OVER (PARTITION BY doc ORDER BY orden) AS hasta FROM hoja),
      lugar AS (SELECT c.*, row_number() OVER (PARTITION BY doc, copia, orden ORDER BY slot) AS rn FROM cas c WHERE NOT ocupada),
      sitio AS (SELECT l.doc, l.copia, l.orden, l.slot, a.hasta - a.cupo + l.rn AS k FROM lugar l JOIN acum a USING (doc, orden) WHERE l.rn <= a.cupo),
      cola AS (SELECT operacion_id AS doc, codigo AS item, row_number() OVER (PARTITION BY operacion_id ORDER BY codigo) AS k FROM marcas WHERE estado = 'activa')"""


@query("o5_ordered_text", """
    WITH RECURSIVE b AS (SELECT vec_id AS id, k AS caja, CAST(round(embedding[k] * 1000) AS BIGINT) AS x,
        CAST(round(embedding[k + 32] * 1000) AS BIGINT) AS y FROM embeddings CROSS JOIN range(1, 33) r(k)),
      s AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY y DESC, caja) AS n FROM b),
      f AS (SELECT id, caja, x, y, n, y AS ancla, 1 AS fila FROM s WHERE n = 1
        UNION ALL SELECT s.id, s.caja, s.x, s.y, s.n, CASE WHEN abs(s.y - f.ancla) <= 20 THEN f.ancla ELSE s.y END,
          CASE WHEN abs(s.y - f.ancla) <= 20 THEN f.fila ELSE f.fila + 1 END FROM f JOIN s ON s.id = f.id AND s.n = f.n + 1)
    SELECT id, string_agg(linea, chr(10) ORDER BY fila) AS texto FROM (SELECT id, fila, string_agg('t' || caja, ' ' ORDER BY x, caja) AS linea FROM f GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    v = t.raw("embeddings")
    piece = F.transform(
        F.sequence(F.lit(1), F.lit(32)),
        lambda k: F.struct(
            _thousandths("embedding", k).alias("x"),
            _thousandths("embedding", k + 32).alias("y"),
            F.concat(F.lit(" t"), k.cast("string"), F.lit(" ")).alias("texto"),
        ),
    )
    return sequence.ordered_text(v.select(F.col("vec_id").alias("id"), piece.alias("piezas")), tolerance=20.0).select("id", "texto")


@query("o8_allocate", w("marcas", _SLOTS + """
    SELECT cola.doc, cola.item, s.copia, s.orden, s.slot FROM cola JOIN sitio s ON s.doc = cola.doc AND s.k = cola.k
    UNION ALL SELECT cola.doc, cola.item, 'sobra', NULL, NULL FROM cola LEFT JOIN (SELECT doc, max(hasta) AS n FROM acum GROUP BY 1) a USING (doc)
      WHERE cola.k > coalesce(a.n, 0)"""))
def _(t):
    m = t.marcas
    slots = m.select(
        F.col("operacion_id").alias("doc"), F.col("tipo").alias("copia"), F.col("origen_carpeta_n").alias("orden"),
        F.col("codigo").alias("slot"), F.col("archivo_svg").isNotNull().alias("ocupada"),
    )
    items = m.where("estado = 'activa'").select(F.col("operacion_id").alias("doc"), F.col("codigo").alias("item"), F.col("codigo").alias("pos"))
    placed, over = sequence.allocate(items, slots)
    return placed.unionByName(over.select("doc", "item", F.lit("sobra").alias("copia"), F.lit(None).cast("int").alias("orden"), F.lit(None).cast("string").alias("slot")))


@query("o8_annex_capacity", w("marcas", """
    SELECT operacion_id AS doc, min(n) AS cupo FROM (SELECT operacion_id, tipo, count(*) FILTER (WHERE archivo_svg IS NULL) AS n FROM marcas GROUP BY 1, 2) GROUP BY 1"""))
def _(t):
    return sequence.annex_capacity(t.marcas.select(
        F.col("operacion_id").alias("doc"), F.col("tipo").alias("copia"), F.col("archivo_svg").isNotNull().alias("ocupada")
    ))


# --- extraction -------------------------------------------------------------------------------
_OWNER = "concat('OWNER ', translate(CAST(o_custkey AS STRING), '0123456789', 'ABCDEFGHIJ'))"
_ANIMALS = "(o_orderkey % 900 + 10)"


def _line(text: str, x: int, y: int, conf: float) -> str:
    return f"named_struct('texto', {text}, 'caja', array(array({x - 5}D, {y - 5}D), array({x + 5}D, {y - 5}D), array({x + 5}D, {y + 5}D), array({x - 5}D, {y + 5}D)), 'conf', {conf}D)"


_CERT_LINES = ", ".join([
    _line("CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'leyenda' ELSE 'pie' END", 10, 10, 0.99),
    _line("CASE WHEN o_orderpriority = '1-URGENT' THEN 'ver anverso' WHEN o_orderpriority = '2-HIGH' THEN concat('datos: ', numero, ' x')"
          " ELSE concat('los datos ', numero, ' del anverso') END", 300, 900, 0.75),
    _line("CASE WHEN o_orderpriority = '1-URGENT' THEN concat('Nro ', numero) ELSE 'sello' END", 900, 930, 0.5),
    _line("'12345678'", 50, 1500, 0.5),
    _line("concat('PROPIETARIO: ', CAST(o_custkey + 1000000 AS STRING))", 100, 200, 0.9),
    _line("'DISTRITO CENTRAL'", 250, 202, 0.9), _line(f"concat(' ', {_OWNER}, ' ')", 300, 201, 0.9), _line("'OTRA FILA NOMBRES'", 300, 400, 0.9),
    _line("concat('ESTABLECIMIENTO ', CAST(o_custkey + 5000000 AS STRING))", 100, 300, 0.9),
    _line(f"concat('****', CAST({_ANIMALS} - 5 AS STRING))", 100, 1000, 0.9), _line(f"concat('*** *', CAST({_ANIMALS} AS STRING))", 200, 1000, 0.9),
    _line("concat('fecha ', fecha)", 100, 1200, 0.9), _line("concat('1000 000', CAST(1000000 + o_orderkey % 1000000 AS STRING))", 100, 1400, 0.9),
])
_GUIDE_LINES = ", ".join([
    _line("'12345678'", 100, 1500, 0.4), _line("CASE WHEN o_orderpriority = '5-LOW' THEN 'nada' ELSE 'N° de Orden' END", 500, 100, 0.9),
    _line("concat('GE ', numero)", 600, 105, 0.8), _line("'ESTANCIA LA LOMA S.A.'", 100, 300, 0.9), _line("concat('AGRO ', CAST(o_custkey AS STRING), ' LTDA')", 100, 400, 0.9),
    _line("concat('emitida ', fecha, ' y 01/01/2000')", 100, 1200, 0.9),
])
_NUMBER = "CAST(20000000 + o_orderkey % 10000000 AS STRING)"
_DAY = "concat(lpad(CAST(o_orderkey % 28 + 1 AS STRING), 2, '0'), '/0', CAST(o_orderkey % 9 + 1 AS STRING), '/2025')"


@query("x1_extract_fields", f"""
    WITH p AS (SELECT *, {_NUMBER} AS n, {_DAY} AS d, o_orderstatus = 'F' AS c, o_orderpriority AS p FROM orders)
    SELECT o_orderkey AS id, CASE WHEN NOT c AND p = '5-LOW' THEN '12345678' ELSE n END AS numero_guia,
      CASE WHEN NOT c THEN CASE o_orderstatus WHEN 'O' THEN 'ge2_principal:orden' ELSE 'ciefa_go2:orden' END
        WHEN p = '1-URGENT' THEN 'certificado:cercano' WHEN p = '2-HIGH' THEN 'certificado:linea' ELSE 'certificado:anverso' END AS fuente_numero,
      CAST(CASE WHEN NOT c THEN CASE WHEN p = '5-LOW' THEN 0.4 ELSE 0.8 END WHEN p = '1-URGENT' THEN 0.4 ELSE 0.75 END AS DOUBLE) AS conf_numero,
      CASE WHEN c THEN concat('1000000', CAST(1000000 + o_orderkey % 1000000 AS STRING)) END AS numero_certificado,
      CASE WHEN c THEN {_OWNER} WHEN o_orderstatus = 'O' THEN concat('AGRO ', CAST(o_custkey AS STRING), ' LTDA') END AS propietario,
      CASE WHEN c THEN CAST(o_custkey + 1000000 AS STRING) END AS propietario_documento,
      CASE WHEN c THEN concat('ESTABLECIMIENTO ', CAST(o_custkey + 5000000 AS STRING)) END AS establecimiento,
      CASE WHEN c THEN {_ANIMALS} END AS cantidad_animales, d AS fecha_texto FROM p""")
def _(t):
    return extract.extract_fields(_ocr_pages(t), excluded="80000001").drop("alto", "formato", "lineas")


@query("x1_owner_box", f"""
    SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN {_OWNER} WHEN o_orderstatus = 'O' THEN concat('AGRO ', CAST(o_custkey AS STRING), ' LTDA') END AS propietario,
      CASE WHEN o_orderstatus = 'F' THEN '295,196 305,196 305,206 295,206' END AS caja FROM orders""")
def _(t):
    found = extract.extract_fields(_ocr_pages(t), excluded="80000001", owner_box=True)
    corners = F.transform("caja_propietario", lambda p: F.concat_ws(",", *[F.format_string("%d", p[i].cast("long")) for i in range(2)]))
    return found.select("id", "propietario", F.when(F.col("caja_propietario").isNotNull(), F.array_join(corners, " ")).alias("caja"))


def _ocr_pages(t):
    return t.raw("orders").selectExpr("*", f"{_NUMBER} AS numero", f"{_DAY} AS fecha").selectExpr(
        "o_orderkey AS id", "1600 AS alto",
        "CASE o_orderstatus WHEN 'F' THEN 'SENACSA_CERTIFICADO' WHEN 'O' THEN 'GE2_PRINCIPAL' ELSE 'CIEFA_GO2' END AS formato",
        f"CASE WHEN o_orderstatus = 'F' THEN array({_CERT_LINES}) ELSE array({_GUIDE_LINES}) END AS lineas",
    )


@query("x2_nearest_label", """
    WITH c AS (SELECT vec_id AS id, k, embedding[k] * 1 AS cx, embedding[k + 16] * 1 AS cy FROM embeddings CROSS JOIN range(1, 17) r(k)),
      l AS (SELECT vec_id AS id, embedding[k + 32] * 1 AS cx, embedding[k + 48] * 1 AS cy FROM embeddings CROSS JOIN range(1, 17) r(k)),
      d AS (SELECT c.id, c.k, min(abs(CAST(l.cy AS DOUBLE) - CAST(c.cy AS DOUBLE)) + abs(CAST(l.cx AS DOUBLE) - CAST(c.cx AS DOUBLE)) * 0.2) AS d FROM c JOIN l USING (id) GROUP BY 1, 2)
    SELECT id, arg_min(k, d) AS elegido FROM d GROUP BY 1""")
def _(t):
    def points(a: int, b: int):
        return F.transform(
            F.sequence(F.lit(1), F.lit(16)),
            lambda k: F.struct(
                k.alias("k"), F.element_at("embedding", k + a).cast("double").alias("cx"),
                F.element_at("embedding", k + b).cast("double").alias("cy"),
            ),
        )

    return t.raw("embeddings").select(
        F.col("vec_id").alias("id"), extract.nearest_label(points(0, 16), points(32, 48))["k"].alias("elegido")
    )


_WORDS = "CASE o_orderkey % 4 WHEN 0 THEN 'SESENTA Y SEIS' WHEN 1 THEN 'CIENTO VEINTITRÉS' WHEN 2 THEN 'ALGO RARO' ELSE 'DIEZ' END"
_WORD_VALUE = "CASE o_orderkey % 4 WHEN 0 THEN 66 WHEN 1 THEN 123 WHEN 2 THEN NULL ELSE 10 END"


@query("x3_extract_header", f"""
    SELECT o_orderkey AS id, CAST(o_orderkey + 91000000 AS STRING) AS numero_orden, CAST(o_custkey AS STRING) AS vendedor_ci_ruc, '0' AS vendedor_dv,
      concat('Estancia ', o_orderpriority) AS vendedor_nombre, concat('COMPRADOR ', o_orderpriority) AS comprador_nombre,
      CAST(o_custkey + 3000000 AS STRING) AS comprador_ci_ruc, CASE WHEN o_orderstatus = 'O' THEN '7' END AS comprador_dv,
      CASE WHEN o_orderstatus = 'F' THEN 52 ELSE o_orderkey % 500 END AS cantidad_animales, {_WORD_VALUE} AS marcas_declaradas FROM orders""")
def _(t):
    text = (
        "concat_ws(chr(10), 'GUIA DE TRASLADO', 'N° de Orden CI / RUC DV', concat(CAST(o_orderkey + 91000000 AS STRING), ' ', CAST(o_custkey AS STRING), ' 0'),"
        " 'Nombre y Apellido / Razón Social', concat('Estancia ', o_orderpriority, ' '),"
        " CASE WHEN o_orderstatus = 'F' THEN 'sin total' ELSE concat('Total ****** ', CAST(o_orderkey % 500 AS STRING)) END,"
        f" concat('SON: cincuenta y dos animales y ', {_WORDS}, ' MARCAS'), 'Rubro 7 - Identificación del Adquiriente',"
        " 'Nombre y Apellido / Razón Social CI / RUC DV', concat('COMPRADOR ', o_orderpriority, ' ', CAST(o_custkey + 3000000 AS STRING),"
        " CASE WHEN o_orderstatus = 'O' THEN ' 7' ELSE '' END)) AS texto"
    )
    return extract.extract_header(t.raw("orders").selectExpr("o_orderkey AS id", text)).drop("texto")


@query("x4_parse_citations", """
    SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN '' ELSE concat('B ACX', CAST(o_custkey AS STRING), ' -;G ', CAST(90000000 + o_orderkey AS STRING),
      ' 27/01/2025;G ', CAST(80000000 + o_orderkey AS STRING), ' -') END AS citas FROM orders""")
def _(t):
    text = (
        "concat(CASE WHEN o_orderstatus = 'P' THEN 'Rubro 3 ' ELSE 'Rubro 4 boleta (B) y/o (G) 999 ' END, 'Respaldo (B) ACX', CAST(o_custkey AS STRING),"
        " chr(10), '(G) ', CAST(90000000 + o_orderkey AS STRING), ' 27/01/2025 (G) ', CAST(90000000 + o_orderkey AS STRING), ' 28/01/2025 (G)',"
        " CAST(80000000 + o_orderkey AS STRING), ' (G) nada Factura de venta (G) 70000000') AS texto"
    )
    parsed = extract.parse_citations(t.raw("orders").selectExpr("o_orderkey AS id", text))
    flat = F.transform("respaldo", lambda c: F.concat_ws(" ", c["cod"], c["numero"], F.coalesce(c["fecha"], F.lit("-"))))
    return parsed.select("id", F.array_join(flat, ";").alias("citas"))


@query("x4_parse_citations_long", """
    SELECT c_custkey AS id, 500 AS citas, CAST(90000500 + c_custkey AS STRING) AS ultima FROM customer""")
def _(t):
    listed = "array_join(transform(sequence(1, 600), i -> concat('(G) ', CAST(90000001 + (i - 1) % 500 + c_custkey AS STRING), ' 27/01/2025')), ' ')"
    people = dealt(t.raw("customer").select("c_custkey"), 2_000)  # a few bytes each, 14 KB of text once made
    parsed = extract.parse_citations(people.selectExpr("c_custkey AS id", f"concat('Rubro 4 Respaldo ', {listed}) AS texto"))
    return parsed.select("id", F.size("respaldo").alias("citas"), F.element_at("respaldo", -1)["numero"].alias("ultima"))


_ROLE_TEXT = (
    "concat(CASE role WHEN 'system' THEN 'Guia de Traslado y Transferencia de Ganado ' WHEN 'user' THEN 'Anexo ' ELSE 'Boleta ' END,"
    " CASE turn % 3 WHEN 0 THEN 'TRIPLICADO' WHEN 1 THEN 'sin nombre' ELSE 'hoja duplicado y original' END)"
)


@query("x6_page_roles", """
    WITH p AS (SELECT conv_id AS doc, turn AS page, role = 'system' AS principal, role = 'user' AS anexo,
        CASE turn % 3 WHEN 0 THEN 'Triplicado' WHEN 1 THEN 'Original' ELSE 'Duplicado' END AS copia FROM conversations)
    SELECT doc, page, principal, anexo, copia, CASE WHEN anexo THEN count(*) FILTER (WHERE anexo) OVER (PARTITION BY doc, copia ORDER BY page) - 1 END AS orden_anexo FROM p""")
def _(t):
    return sequence.page_roles(t.raw("conversations").selectExpr("conv_id AS doc", "turn AS page", f"{_ROLE_TEXT} AS text")).drop("text")


# --- quality and audit ------------------------------------------------------------------------
_FEATURES = (
    "l_discount / 10 AS cobertura, l_linenumber AS n_comp, CAST(l_quantity * 3 AS INT) AS n_puntos, l_tax * 12 AS lineas,"
    " l_discount * 8 AS largo, l_quantity / 50 AS diagonal, l_quantity / 50 AS altura_uniforme, l_tax * 5 AS max_alto,"
    " l_linenumber - 2 AS filas, CAST(l_quantity AS INT) % 15 AS vertices"
)


@query("q1_classify", f"""
    WITH f AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {_FEATURES} FROM lineitem), r AS (SELECT *,
        (lineas >= 0.82 AND largo >= 0.30 AND n_comp <= 6) OR (lineas >= 0.65 AND largo >= 0.40 AND vertices <= 10 AND n_comp <= 8) AS recta FROM f)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN cobertura < 0.0012 OR n_comp = 0 THEN 'vacia' WHEN n_puntos >= 120 THEN 'fragmento' WHEN recta AND diagonal >= 0.5 THEN 'anulacion'
      WHEN recta THEN 'linea_de_tabla' WHEN n_comp >= 5 AND altura_uniforme >= 0.8 AND max_alto < 0.30 AND filas <= 3 THEN 'texto_o_sello'
      WHEN cobertura < 0.004 THEN 'fragmento' END AS categoria,
      CASE WHEN cobertura < 0.0012 OR n_comp = 0 THEN 'casi sin tinta' WHEN n_puntos >= 120 THEN concat('trama de puntos (', n_puntos, ' puntitos)')
      WHEN recta AND diagonal >= 0.5 THEN concat(CAST(round_even(lineas * 100, 0) AS BIGINT), '% de la tinta es recta e inclinada')
      WHEN recta THEN concat(CAST(round_even(lineas * 100, 0) AS BIGINT), '% de la tinta es una línea recta')
      WHEN n_comp >= 5 AND altura_uniforme >= 0.8 AND max_alto < 0.30 AND filas <= 3 THEN concat(n_comp, ' letras parejas en ', filas, ' fila(s)')
      WHEN cobertura < 0.004 THEN 'muy poca tinta' ELSE '' END AS razon FROM r""")
def _(t):
    f = t.raw("lineitem").selectExpr("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *_split(_FEATURES))
    return audit.classify(f).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "categoria", "razon")


def _split(exprs: str) -> list[str]:
    return [e.strip() for e in exprs.split(", ")]


@query("q2_quality_flags", """
    WITH f AS (SELECT p_partkey AS id, p_size * 0.75 AS t, p_size % 20 AS c, p_partkey % 120 AS a, p_partkey % 90 AS h FROM part)
    SELECT id, CASE WHEN a = 0 AND h = 0 THEN 'casilla vacía o trazo no detectado' ELSE concat_ws('|', CASE WHEN t < 0.8 THEN printf('muy poca tinta (%.1f%%): trazo débil o ruido', t) END,
      CASE WHEN t > 35 THEN printf('demasiada tinta (%.1f%%): sombra o borrón', t) END, CASE WHEN c > 12 THEN concat(c, ' trazos sueltos: posible suciedad') END,
      CASE WHEN least(a, h) < 40 THEN printf('trazo diminuto (%dx%d px): revisar resolución', a, h) END) END AS observaciones,
      (a = 0 AND h = 0) OR t < 0.8 OR t > 35 OR c > 12 OR least(a, h) < 40 AS revisar FROM f""".replace("p_size * 0.75", "p_size + 0.0"))
def _(t):
    f = t.raw("part").selectExpr(
        "p_partkey AS id", "CAST(p_size AS DOUBLE) AS tinta_pct", "p_size % 20 AS componentes", "p_partkey % 120 AS ancho_px", "p_partkey % 90 AS alto_px"
    )
    return audit.quality_flags(f).select("id", F.array_join("observaciones", "|").alias("observaciones"), "revisar")


_NEAR = "(length({a}) = length({b}) AND {a} <> {b} AND damerau_levenshtein({a}, {b}) = 1)"


@query("q4_near_pairs", w("operaciones", f"""
    , n AS (SELECT DISTINCT numero_guia AS n, substr(numero_guia, 1, 4) AS b FROM operaciones)
    SELECT a.n, c.n AS m FROM n a JOIN n c ON a.b = c.b AND {_NEAR.format(a='a.n', b='c.n')}"""))
def _(t):
    return audit.near_pairs(t.operaciones, "numero_guia", block=4)


@query("q4_near_pairs_unblocked", f"""
    WITH a AS (SELECT CAST(8000 + p_partkey AS STRING) AS n FROM part), b AS (SELECT CAST(8000 + c_custkey * 3 AS STRING) AS m FROM customer)
    SELECT DISTINCT n, m FROM a JOIN b ON {_NEAR.format(a='n', b='m')}""")
def _(t):
    a = t.raw("part").selectExpr("CAST(8000 + p_partkey AS STRING) AS n")
    return audit.near_between(a, t.raw("customer").selectExpr("CAST(8000 + c_custkey * 3 AS STRING) AS m"))


_EXCLUDED = "90000125"
_CITED_NUMBERS = f"""
    , cita AS (SELECT DISTINCT n AS numero_guia FROM (SELECT unnest(regexp_extract_all(texto_ocr, '[0-9]+')) AS n FROM escaneos
        WHERE formato IN ('GE2_PRINCIPAL', 'GE2_ANEXO')) WHERE length(n) = 8 AND n <> '{_EXCLUDED}'),
      asig AS (SELECT DISTINCT numero_guia FROM escaneos WHERE numero_guia <> ''),
      falta AS (SELECT numero_guia FROM cita WHERE numero_guia NOT IN (SELECT numero_guia FROM asig))"""


@query("e1_uncovered_citations", w("escaneos", _CITED_NUMBERS + " SELECT numero_guia FROM falta"))
def _(t):
    return audit.uncovered_citations(t.escaneos, _EXCLUDED)


_AUDIT = _CITED_NUMBERS + f"""
    , cerca AS (SELECT a.numero_guia, b.numero_guia AS m FROM asig a JOIN asig b ON substr(a.numero_guia, 1, 4) = substr(b.numero_guia, 1, 4)
        AND {_NEAR.format(a='a.numero_guia', b='b.numero_guia')}),
      tres AS (SELECT numero_guia, string_agg(m, ', ' ORDER BY m) AS m FROM cerca GROUP BY 1),
      cert AS (SELECT numero_guia, count(DISTINCT coalesce(nullif(numero_certificado, ''), archivo)) AS c FROM escaneos WHERE numero_guia <> '' GROUP BY 1),
      imp AS (SELECT id, list_sort(list_distinct(regexp_extract_all(texto_ocr, 'GE2\\s*([0-9]{{8}})', 1))) AS l FROM escaneos),
      rep AS (SELECT carpeta, archivo, formato, coalesce(e.numero_guia, '') AS numero_guia, fuente_numero AS fuente, nullif(conf_numero, 0) AS conf,
        coalesce(propietario, '') AS propietario, imagen, CASE WHEN e.numero_guia IS NULL THEN 'sin número' ELSE concat_ws('; ',
          CASE WHEN NOT regexp_full_match(e.numero_guia, '[0-9]{{8}}') THEN 'no tiene 8 dígitos' WHEN substr(e.numero_guia, 1, 2) NOT IN ('10', '90', '91', '80') THEN concat('prefijo raro (', substr(e.numero_guia, 1, 2), ')') END,
          CASE WHEN formato = 'SENACSA_CERTIFICADO' AND c > 1 THEN 'el mismo número en certificados distintos' END,
          CASE WHEN starts_with(fuente_numero, 'inferido') THEN 'número inferido por vecindad' END,
          CASE WHEN conf_numero > 0 AND conf_numero < 0.6 THEN printf('lectura poco segura (%.2f)', conf_numero) END,
          CASE WHEN conf_numero < 0.75 AND tres.m IS NOT NULL THEN concat('casi igual a ', tres.m) END,
          CASE WHEN formato = 'GE2_PRINCIPAL' AND len(l) > 0 AND NOT list_contains(l, e.numero_guia) THEN concat('el «GE2…» impreso dice ', array_to_string(l, '/')) END) END AS motivos
        FROM escaneos e LEFT JOIN cert USING (numero_guia) LEFT JOIN tres USING (numero_guia) JOIN imp ON imp.id = e.id),
      parec AS (SELECT f.numero_guia, string_agg(a.numero_guia, ', ' ORDER BY a.numero_guia) AS m FROM falta f JOIN asig a ON {_NEAR.format(a='f.numero_guia', b='a.numero_guia')} GROUP BY 1),
      informe AS (SELECT * FROM rep WHERE motivos <> '' UNION ALL BY NAME
        SELECT '' AS carpeta, '' AS archivo, 'CITADO_EN_RESPALDO' AS formato, f.numero_guia, '' AS fuente, NULL AS conf, '' AS propietario, '' AS imagen,
          concat('citado en el Respaldo de una guía y no está cargado', coalesce(' (¿' || parec.m || '?)', '')) AS motivos FROM falta f LEFT JOIN parec USING (numero_guia))"""


@query("q3_audit_pages", w("escaneos", _AUDIT + " SELECT carpeta, archivo, formato, numero_guia, fuente, conf, propietario, motivos, imagen FROM informe"))
def _(t):
    return audit.audit_pages(t.escaneos, _EXCLUDED)


@query("a7_audit_histogram", w("escaneos", _AUDIT + """
    SELECT split_part(split_part(trim(m), ' (', 1), ' a ', 1) AS motivo, count(*) AS n FROM (SELECT unnest(string_split(motivos, ';')) AS m FROM informe) GROUP BY 1"""))
def _(t):
    return agg.audit_histogram(audit.audit_pages(t.escaneos, _EXCLUDED))


_READINGS = """
    WITH e AS (SELECT concat(CAST(user_id AS STRING), '-', event_type) AS item, user_id AS pagina, event_id AS pos, CAST(CAST(floor(value) AS BIGINT) % 3 AS STRING) AS valor FROM events),
      p AS (SELECT item, arg_min(valor, pos) AS valor, 2 AS peso, -1 AS pos FROM e GROUP BY 1),
      v AS (SELECT item, valor, sum(peso) AS votos, min(pos) AS pos FROM (SELECT item, valor, peso, pos FROM p UNION ALL SELECT item, valor, 1, pos FROM e) GROUP BY 1, 2),
      g AS (SELECT item, valor AS ganador, CAST(votos AS BIGINT) AS votos FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY votos DESC, pos) AS rn FROM v) WHERE rn = 1)"""


def _readings(t):
    e = t.raw("events").selectExpr(
        "concat(CAST(user_id AS STRING), '-', event_type) AS item", "event_id AS pos", "CAST(CAST(floor(value) AS BIGINT) % 3 AS STRING) AS valor"
    )
    first = e.groupBy("item").agg(F.min_by("valor", "pos").alias("valor"))
    return audit.weighted_readings(first, e)


@query("q5_vote", _READINGS + " SELECT item, ganador, votos FROM g")
def _(t):
    return audit.vote(_readings(t))


@query("q5_candidates", """
    SELECT user_id AS pagina, event_id AS pos FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k <= 6""")
def _(t):
    return audit.candidates(t.raw("events").selectExpr("user_id AS pagina", "event_id AS pos"), n=6)


@query("q6_reconcile", _READINGS + """
    , u AS (SELECT DISTINCT user_id FROM events UNION SELECT c_custkey FROM customer), f AS (SELECT user_id AS pagina, CASE user_id % 4 WHEN 0 THEN NULL ELSE CAST(user_id % 3 AS STRING) END AS primera FROM u),
      a AS (SELECT CAST(split_part(item, '-', 1) AS BIGINT) AS pagina, count(*) AS n, count(DISTINCT ganador) AS d, min(ganador) AS x FROM g WHERE split_part(item, '-', 2) IN ('click', 'view') GROUP BY 1)
    SELECT f.pagina, f.primera, CASE WHEN n = 1 THEN x END AS segunda, CASE WHEN primera IS NOT NULL AND d = 1 AND x = primera THEN 'coincide'
      WHEN primera IS NULL AND n IS NULL THEN 'sin_numero_en_ninguna' WHEN primera IS NOT NULL AND n IS NULL THEN 'primera_sin_segunda'
      WHEN primera IS NULL THEN 'encontro_numero_nuevo' ELSE 'distinto' END AS estado FROM f LEFT JOIN a USING (pagina)""")
def _(t):
    won = audit.vote(_readings(t)).where(F.split_part("item", F.lit("-"), F.lit(2)).isin("click", "view")).select(
        F.split_part("item", F.lit("-"), F.lit(1)).cast("long").alias("pagina"), "ganador"
    )
    users = t.raw("events").select("user_id").union(t.raw("customer").select("c_custkey")).distinct()
    first = users.selectExpr("user_id AS pagina", "CASE user_id % 4 WHEN 0 THEN NULL ELSE CAST(user_id % 3 AS STRING) END AS primera")
    return audit.reconcile(first, won)


# --- text and number functions ----------------------------------------------------------------
@query("s1_s2_labels", """
    WITH d AS (SELECT doc_id, regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g') AS a FROM documents)
    SELECT doc_id, md5(trim(lower(regexp_replace(a, '[^a-zA-Z0-9]+', ' ', 'g')))) AS etiqueta,
      md5(coalesce(nullif(trim(upper(regexp_replace(a, '[^A-Za-z0-9]+', '-', 'g')), '-'), ''), 'HOJA')) AS codigo FROM d""")
def _(t):
    c = F.col("text")
    return t.raw("documents").select("doc_id", F.md5(txt.normalize_label(c)).alias("etiqueta"), F.md5(txt.slug(c)).alias("codigo"))


@query("s3_eight_digits", w("escaneos", """
    SELECT id, array_to_string(list_filter(regexp_extract_all(texto_ocr, '[0-9]+'), lambda x: length(x) = 8 AND x <> '90000125'), ',') AS numeros FROM escaneos"""))
def _(t):
    return t.escaneos.select("id", F.array_join(txt.eight_digit_numbers(F.col("texto_ocr"), _EXCLUDED), ",").alias("numeros"))


@query("s4_digits_only", "SELECT doc_id, md5(regexp_replace(translate(text, 'OoDQIl|ZSBG', '00001112586'), '[^0-9]', '', 'g')) AS digitos FROM documents")
def _(t):
    return t.raw("documents").select("doc_id", F.md5(txt.digits_only(F.col("text"))).alias("digitos"))


@query("s5_number_words", """
    SELECT o_orderkey AS id, CASE WHEN o_custkey % 10 = 9 THEN NULL ELSE (o_custkey % 9 + 1) * 100 * CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END + 30 + o_custkey % 10 END AS numero FROM orders""")
def _(t):
    words = (
        "concat(CASE WHEN o_orderstatus = 'O' THEN element_at(array('ciento','DOSCIENTOS','trescientos','Cuatrocientos','QUINIENTOS','SEISCIENTOS','setecientos','OCHOCIENTOS','NOVECIENTOS'), CAST(o_custkey % 9 + 1 AS INT)) ELSE '' END,"
        " ' Treinta-y ', element_at(array('cero','uno','DOS','tres','cuatro','CINCO','seis','siete','ocho','y pico'), CAST(o_custkey % 10 + 1 AS INT)))"
    )
    return t.raw("orders").selectExpr("o_orderkey AS id", f"{words} AS w").select("id", num.words_to_number(F.col("w")).alias("numero"))


@query("s6_near_equal", f"""
    WITH p AS (SELECT o_orderkey AS id, CAST(o_orderkey + 1000 AS STRING) AS a, CASE o_custkey % 3 WHEN 0 THEN CAST(o_orderkey + 1001 AS STRING)
      WHEN 1 THEN reverse(CAST(o_orderkey + 1000 AS STRING)) ELSE CAST(o_orderkey * 10 AS STRING) END AS b FROM orders)
    SELECT id, {_NEAR.format(a='a', b='b')} AS casi FROM p""")
def _(t):
    p = t.raw("orders").selectExpr(
        "o_orderkey AS id", "CAST(o_orderkey + 1000 AS STRING) AS a",
        "CASE o_custkey % 3 WHEN 0 THEN CAST(o_orderkey + 1001 AS STRING) WHEN 1 THEN reverse(CAST(o_orderkey + 1000 AS STRING)) ELSE CAST(o_orderkey * 10 AS STRING) END AS b",
    )
    return p.select("id", num.near_equal(F.col("a"), F.col("b")).alias("casi"))


@query("s7_same_text", """
    SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN upper(p_name) WHEN p_size % 3 = 1 THEN replace(p_name, ' ', '') ELSE p_name END AS aceptado FROM part""")
def _(t):
    p = t.raw("part").selectExpr(
        "p_partkey AS id", "p_name AS a",
        "CASE WHEN p_size % 3 = 0 THEN upper(p_name) WHEN p_size % 3 = 1 THEN replace(p_name, ' ', '') ELSE concat('x', p_name, 'yz') END AS b",
    )
    return p.select("id", txt.accept_rereading(F.col("a"), F.col("b")).alias("aceptado"))


_FOLDER = "CASE doc_id % 5 WHEN 0 THEN 'L3210' WHEN 1 THEN 'L5290' WHEN 2 THEN 'PARTE1' WHEN 3 THEN 'PARTE2' ELSE 'OTRA' END"
_FILE = "CASE WHEN doc_id % 7 = 0 THEN 'suelta.jpg' ELSE concat('p1_', lpad(CAST(doc_id % 1000 AS STRING), 4, '0'), '.jpg') END"


@query("s8_origin_label", """
    SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 1 WHEN 4 THEN NULL ELSE 2 END AS carpeta_n, CASE doc_id % 5 WHEN 2 THEN 1 WHEN 3 THEN 2 END AS parte,
      CASE WHEN doc_id % 7 <> 0 THEN CAST(doc_id % 1000 AS INT) END AS pagina_n,
      CASE WHEN doc_id % 5 <> 4 THEN concat(CASE doc_id % 5 WHEN 0 THEN 'Carpeta 1' WHEN 1 THEN 'Carpeta 2' WHEN 2 THEN 'Carpeta 2 · Parte 1' ELSE 'Carpeta 2 · Parte 2' END,
        ' · pág. ', CASE WHEN doc_id % 7 = 0 THEN 'suelta.jpg' ELSE CAST(doc_id % 1000 AS STRING) END) END AS etiqueta FROM documents""")
def _(t):
    folder, name = F.expr(_FOLDER), F.expr(_FILE)
    return t.raw("documents").select(
        "doc_id", txt.folder_number(folder).alias("carpeta_n"), txt.folder_part(folder).alias("parte"),
        txt.trailing_page(name).alias("pagina_n"), txt.origin_label(folder, name).alias("etiqueta"),
    )


@query("s9_grid_position", """
    SELECT p_partkey AS id, nullif(concat_ws(' · ', nullif(concat(substr(p_type, 1, 1), lower(substr(p_type, 2))), ''),
      CASE WHEN p_size % 4 <> 0 THEN concat('casilla ', p_size + 1, '·', p_partkey % 7 + 1) END), '') AS posicion FROM part""")
def _(t):
    p = t.raw("part").selectExpr("p_partkey AS id", "p_type", "CASE WHEN p_size % 4 <> 0 THEN p_size END AS f", "p_partkey % 7 AS c")
    return p.select("id", txt.grid_position(F.col("p_type"), F.col("f"), F.col("c")).alias("posicion"))


@query("s10_local_time", "SELECT event_id, strftime(timezone('America/Asuncion', timezone('UTC', ts)), '%d/%m/%Y %H:%M') AS hora FROM events")
def _(t):
    return t.raw("events").select("event_id", txt.local_time(F.col("ts").cast("timestamp")).alias("hora"))


@query("s11_s12_parsing", """
    SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_custkey END AS entero, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END AS dia,
      o_orderpriority LIKE '1%' AS verdad, CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(CAST(o_totalprice AS BIGINT) AS STRING) ELSE CAST(o_totalprice AS STRING) END = texto2 AS igual,
      CAST(o_custkey AS STRING) AS documento FROM (SELECT *, CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(CAST(o_totalprice AS BIGINT) AS STRING) ELSE CAST(o_totalprice AS STRING) END AS texto2 FROM orders)""")
def _(t):
    o = t.raw("orders")
    number = F.when(F.col("o_orderstatus") == "O", F.concat(F.col("o_custkey").cast("string"), F.lit("x"))).otherwise(F.concat(F.lit(" "), F.col("o_custkey").cast("string")))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    day = F.when(F.col("o_orderstatus") == "F", day).when(F.col("o_orderstatus") == "P", F.lit("2024-02-31")).otherwise(F.lit("ayer"))
    word = F.when(F.col("o_orderpriority").startswith("1"), " Sí").otherwise("no")
    price = F.col("o_totalprice")
    return o.select(
        F.col("o_orderkey").alias("id"), num.safe_int(number).alias("entero"), num.safe_date(day).alias("dia"), num.truth_word(word).alias("verdad"),
        (num.integral_text(price).cast("double") == price).alias("igual"), num.integral_text(F.col("o_custkey").cast("double")).alias("documento"),
    )


@query("s13_mark_codes", """
    SELECT o_orderkey AS id, concat('M-', lpad(CAST(o_orderkey * 97 AS STRING), greatest(5, CAST(length(CAST(o_orderkey * 97 AS STRING)) AS INT)), '0')) AS codigo,
      o_orderkey * 97 AS sufijo, o_orderpriority <> '4-NOT SPECIFIED' AS valido FROM orders""")
def _(t):
    code = num.mark_code(F.col("o_orderkey") * 97)
    return t.raw("orders").select(
        F.col("o_orderkey").alias("id"), code.alias("codigo"), num.code_suffix(code).alias("sufijo"), num.valid_code(F.col("o_orderpriority")).alias("valido")
    )


_KIND_TEXT = (
    "concat(text, CASE doc_id % 6 WHEN 0 THEN ' Anexo 3' WHEN 1 THEN ' rubro 2 anexo' WHEN 2 THEN ' Guía de traslado' WHEN 3 THEN ' certificado sanitario'"
    " WHEN 4 THEN ' certificado' ELSE '' END)"
)


@query("s14_page_kind", """
    WITH d AS (SELECT doc_id, upper(concat(text, CASE doc_id % 6 WHEN 0 THEN ' Anexo 3' WHEN 1 THEN ' rubro 2 anexo' WHEN 2 THEN ' Guía de traslado' WHEN 3 THEN ' certificado sanitario'
      WHEN 4 THEN ' certificado' ELSE '' END)) AS t FROM documents)
    SELECT doc_id, CASE WHEN contains(t, 'ANEXO') AND NOT contains(t, 'RUBRO') THEN 'GE2_ANEXO' WHEN contains(t, 'RUBRO 2') OR contains(t, 'GUÍA DE TRASLADO') OR contains(t, 'GUIA DE TRASLADO')
      THEN 'GE2_PRINCIPAL' WHEN contains(t, 'CERTIFICADO') AND contains(t, 'SANITARIO') THEN 'SENACSA_CERTIFICADO' ELSE 'DESCONOCIDO' END AS formato FROM d""")
def _(t):
    return t.raw("documents").select("doc_id", txt.page_kind(F.expr(_KIND_TEXT)).alias("formato"))


@query("s15_number_from_file_name", """
    SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN CAST(o_orderkey + 100000 AS STRING) WHEN 'F' THEN CAST(o_orderkey + 9000000 AS STRING) END AS numero FROM orders""")
def _(t):
    name = F.expr(
        "CASE o_orderstatus WHEN 'O' THEN concat('1234567 ge ', CAST(o_orderkey + 100000 AS STRING), '.pdf') WHEN 'F' THEN concat('escaneo ', CAST(o_orderkey + 9000000 AS STRING), '_2.pdf')"
        " ELSE concat('hoja ', CAST(o_orderkey % 100000 AS STRING)) END"
    )
    return t.raw("orders").select(F.col("o_orderkey").alias("id"), txt.number_from_file_name(name).alias("numero"))


@query("s16_restricted_text", """
    SELECT doc_id, md5(replace(replace(translate(text, '—–‘’“”', '--''''""'), '…', '...'), 'Ω', '')) AS limpio FROM documents""")
def _(t):
    return t.raw("documents").select("doc_id", F.md5(txt.restricted_text(F.concat("text", F.lit("Ω")))).alias("limpio"))
