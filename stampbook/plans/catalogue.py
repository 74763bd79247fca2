"""Queries over marks, owners, operations and issued documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from stampbook.operators import aggregates as agg
from stampbook.operators import audit
from stampbook.operators import filters as flt
from stampbook.operators import guides
from stampbook.operators import paging
from stampbook.operators import relations as rel
from stampbook.operators.extract import SNAPSHOT_FIELDS, snapshot
from stampbook.operators.ordering import Key
from stampbook.plans.bindings import with_bindings as w
from stampbook.plans.registry import page_frame, query

MARK_COLS = "id, codigo, tipo, estado, posicion, operacion_id"


# --- filters ----------------------------------------------------------------------------------
@query("f1_facets", w("marcas", f"SELECT {MARK_COLS} FROM marcas WHERE estado = 'revisar' AND tipo = 'dominante'"))
def _(t):
    found = flt.facets(t.marcas, flt.MARK_FACETS, estado="revisar", tipo="dominante", carpeta=9)
    return found.select(*MARK_COLS.split(", "))


@query("f2_hidden_view", w("marcas", f"SELECT {MARK_COLS} FROM marcas WHERE NOT activo"))
def _(t):
    return flt.visible(t.marcas, hidden=True).select(*MARK_COLS.split(", "))


@query("f3_text_search", w("propietarios", """
    SELECT id, nombre, documento, establecimiento FROM propietarios
    WHERE nombre ILIKE '%0_1%' OR documento ILIKE '%0_1%' OR establecimiento ILIKE '%0_1%'"""))
def _(t):
    return flt.text_search(t.propietarios, " 0_1 ", ["nombre", "documento", "establecimiento"]).select(
        "id", "nombre", "documento", "establecimiento"
    )


@query("f3_text_search_documents", "SELECT doc_id, n_chars FROM documents WHERE text ILIKE '%license%' OR source ILIKE '%license%'")
def _(t):
    return flt.text_search(t.raw("documents"), "license", ["text", "source"]).select("doc_id", "n_chars")


@query("f4_operation_status", w("operaciones", """
    SELECT id, 'revisar' AS situacion FROM operaciones WHERE revisar IS NOT NULL AND revisar <> ''
    UNION ALL SELECT id, 'colisiona' FROM operaciones WHERE guia_colisionada
    UNION ALL SELECT id, 'al_dia' FROM operaciones WHERE NOT guia_colisionada AND (revisar IS NULL OR revisar = '')"""))
def _(t):
    ops = t.operaciones
    parts = [flt.operation_status(ops, s).select("id", F.lit(s).alias("situacion")) for s in ("revisar", "colisiona", "al_dia")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("f5_between_days", w("operaciones documentos_emitidos", """
    SELECT 'operacion' AS clase, id FROM operaciones
      WHERE creado_en >= TIMESTAMP '1996-02-01' AND creado_en <= TIMESTAMP '1997-03-31 23:59:59'
    UNION ALL SELECT 'documento', id FROM documentos_emitidos
      WHERE emitido_en >= TIMESTAMP '2024-01-03' AND emitido_en < TIMESTAMP '2024-01-06'"""))
def _(t):
    a = flt.between_days(t.operaciones, "creado_en", "1996-02-01", "1997-03-31")
    a = flt.between_days(a, "creado_en", "no es fecha", None)
    b = flt.between_days(t.documentos_emitidos, "emitido_en", "2024-01-03", "2024-01-05", mode="next_day")
    return a.select(F.lit("operacion").alias("clase"), "id").unionByName(b.select(F.lit("documento").alias("clase"), "id"))


@query("f6_reason_prefix", w("marcas", "SELECT id, motivo_calidad FROM marcas WHERE starts_with(motivo_calidad, 'no_es_marca:tipo_3')"))
def _(t):
    return flt.reason_prefix(t.marcas, "no_es_marca:tipo_3%").select("id", "motivo_calidad")


@query("f7_by_keys", w("marcas operaciones", """
    SELECT m.id, m.operacion_id FROM marcas m WHERE operacion_id IN (SELECT id FROM operaciones WHERE tipo_operacion = 'venta')"""))
def _(t):
    sales = flt.facets(t.operaciones, flt.OPERATION_FACETS, tipo_operacion="venta")
    return flt.by_keys(t.marcas, "operacion_id", sales.select(F.col("id").alias("operacion_id"))).select("id", "operacion_id")


@query("f8_presence", w("marcas", """
    SELECT archivo_png, archivo_svg, count(*) AS n FROM (
      SELECT archivo_png IS NOT NULL AND archivo_png <> '' AS archivo_png, archivo_svg IS NOT NULL AND archivo_svg <> '' AS archivo_svg
      FROM marcas) GROUP BY ALL"""))
def _(t):
    flags = flt.presence(t.marcas, ["archivo_png", "archivo_svg"], blank_is_missing=True)
    return flags.groupBy("archivo_png", "archivo_svg").agg(F.count(F.lit(1)).alias("n"))


@query("f9_archive_search", w("documentos_emitidos usuarios", """
    , hit AS (SELECT d.*, u.nombre AS emitido_por_nombre FROM documentos_emitidos d LEFT JOIN usuarios u ON u.id = d.emitido_por
      WHERE tipo = 'venta' AND (numero_guia ILIKE '%or 1%' OR datos->>'$.vendedor_nombre' ILIKE '%or 1%'
        OR datos->>'$.comprador_nombre' ILIKE '%or 1%' OR d.nombre ILIKE '%or 1%') AND emitido_en < TIMESTAMP '2024-02-01')
    SELECT id, operacion_id, tipo, numero_guia, emitido_en, nombre, datos, CAST(json_array_length(marcas) AS INT) AS cantidad_marcas,
      emitido_por_nombre, (SELECT count(*) FROM hit) AS total
    FROM hit ORDER BY emitido_en DESC, id DESC LIMIT 30 OFFSET 30"""))
def _(t):
    page = rel.archive_page(t.documentos_emitidos, t.usuarios, page=2, text="or 1", tipo="venta", hi="2024-01-31")
    return page_frame(page)


@query("f10_validate_rows", w("operaciones", """
    SELECT id, 'valida' AS clase, CAST(NULL AS STRING) AS problema
    FROM operaciones WHERE revisar IS NOT NULL AND revisar <> '' AND cantidad_animales - 100 >= 0
    UNION ALL SELECT id, 'aviso', 'sin revisar' FROM operaciones WHERE revisar IS NULL OR revisar = ''
    UNION ALL SELECT id, 'aviso', 'saldo negativa' FROM operaciones WHERE revisar IS NOT NULL AND revisar <> '' AND cantidad_animales - 100 < 0
    UNION ALL SELECT id, 'aviso', concat('categoria_animales ''', categoria_animales, ''' desconocido') FROM operaciones
      WHERE revisar IS NOT NULL AND revisar <> '' AND cantidad_animales - 100 >= 0 AND lower(categoria_animales) <> '2-high'"""))
def _(t):
    rows = t.operaciones.select("id", "revisar", "categoria_animales", (F.col("cantidad_animales") - 100).alias("saldo"))
    valid, warnings = flt.validate_rows(
        rows, "id", required={"revisar": "sin revisar"}, enums={"categoria_animales": ("2-high",)}, not_negative=["saldo"]
    )
    return valid.select("id", F.lit("valida").alias("clase"), F.lit(None).cast("string").alias("problema")).unionByName(
        warnings.select("id", F.lit("aviso").alias("clase"), "problema")
    )


@query("f11_changed_fields", w("operaciones", """
    , nueva AS (SELECT id, CASE WHEN tipo_operacion = 'venta' THEN concat(' ', numero_guia, ' ') ELSE concat(numero_guia, '9') END AS numero_guia,
        CASE WHEN guia_colisionada THEN '' ELSE revisar END AS revisar FROM operaciones)
    SELECT o.id, 'numero_guia' AS campo, o.numero_guia AS anterior, trim(n.numero_guia) AS nuevo FROM operaciones o JOIN nueva n USING (id)
      WHERE trim(n.numero_guia) IS DISTINCT FROM o.numero_guia
    UNION ALL SELECT o.id, 'revisar', o.revisar, nullif(trim(n.revisar), '') FROM operaciones o JOIN nueva n USING (id)
      WHERE nullif(trim(n.revisar), '') IS DISTINCT FROM o.revisar"""))
def _(t):
    ops = t.operaciones
    new = ops.select(
        "id",
        F.when(F.col("tipo_operacion") == "venta", F.concat(F.lit(" "), "numero_guia", F.lit(" ")))
        .otherwise(F.concat("numero_guia", F.lit("9"))).alias("numero_guia"),
        F.when(F.col("guia_colisionada"), "").otherwise(F.col("revisar")).alias("revisar"),
    )
    return flt.changed_fields(t.operaciones, new, "id", ["numero_guia", "revisar"])


# --- paging and listings ----------------------------------------------------------------------
@query("p1_last_page", w("marcas", """
    , f AS (SELECT id, codigo, estado FROM marcas WHERE activo AND estado = 'activa'), n AS (SELECT count(*) AS total FROM f)
    SELECT id, codigo, estado, total FROM (SELECT f.*, row_number() OVER (ORDER BY codigo) AS rn FROM f), n
    WHERE rn > (CAST(ceil(total / 40.0) AS BIGINT) - 1) * 40"""))
def _(t):
    found = flt.facets(flt.visible(t.marcas), flt.MARK_FACETS, estado="activa")
    return page_frame(rel.mark_page(found, page=10**9), "id", "codigo", "estado")


@query("p2_keyset_page", "SELECT event_id, user_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100")
def _(t):
    return paging.keyset_page(t.raw("events"), "event_id", 500, 100).select("event_id", "user_id", "event_type")


@query("p3_top_children", w("marcas", """
    SELECT operacion_id, codigo, tipo, rn FROM (SELECT *, row_number() OVER (PARTITION BY operacion_id
      ORDER BY CASE WHEN tipo = 'dominante' THEN 0 ELSE 1 END, codigo) AS rn FROM marcas) WHERE rn <= 2"""))
def _(t):
    from stampbook.operators.ordering import top_n

    m = t.marcas.withColumn("_d", F.when(F.col("tipo") == "dominante", 0).otherwise(1))
    return top_n(m, ["operacion_id"], [Key("_d"), Key("codigo")], 2).select("operacion_id", "codigo", "tipo", "rn")


@query("p4_stratified_sample", w("archivos", """
    , f AS (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS dir FROM archivos),
      r AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY md5(concat(path, '#7')), path) AS vuelta FROM f)
    SELECT path, bytes FROM r ORDER BY vuelta, md5(concat(dir, '#7')), dir, path LIMIT 60"""))
def _(t):
    return paging.stratified_sample(t.archivos, 60, seed=7)


@query("p5_unnumbered_pages", w("escaneos", """
    , s AS (SELECT * FROM escaneos WHERE numero_guia IS NULL AND (texto_ocr ILIKE '%en%' OR propietario ILIKE '%en%'))
    SELECT id, carpeta, archivo, orden, formato, propietario, n_marcas, etiqueta, (SELECT count(*) FROM s) AS total FROM s
    ORDER BY carpeta_n ASC NULLS LAST, parte ASC NULLS FIRST, pagina_n, id LIMIT 36 OFFSET 36"""))
def _(t):
    page = guides.unnumbered_listing_page(guides.unnumbered_pages(t.escaneos, "en"), page=2)
    return page_frame(page, "id", "carpeta", "archivo", "orden", "formato", "propietario", "n_marcas", "etiqueta")


@query("p6_list_operations", w("operaciones", """
    , f AS (SELECT * FROM operaciones WHERE activo AND tipo_operacion = 'compra' AND guia_colisionada = false
      AND (revisar IS NULL OR revisar = '') AND (vendedor_nombre ILIKE '%00%' OR comprador_nombre ILIKE '%00%'))
    SELECT id, numero_guia, vendedor_nombre, creado_en, (SELECT count(*) FROM f) AS total FROM f
    ORDER BY creado_en DESC NULLS FIRST, id DESC LIMIT 40 OFFSET 80"""))
def _(t):
    found = rel.list_operations(t.operaciones, text="00", estado="al_dia", tipo_operacion="compra")
    return page_frame(rel.operation_page(found, 3), "id", "numero_guia", "vendedor_nombre", "creado_en")


@query("p6_list_owners", w("propietarios", """
    , f AS (SELECT * FROM propietarios WHERE activo AND (nombre ILIKE '%1%' OR documento ILIKE '%1%' OR establecimiento ILIKE '%1%'))
    SELECT id, nombre, documento, establecimiento, localidad, departamento, (SELECT count(*) FROM f) AS total
    FROM f ORDER BY nombre, id LIMIT 40"""))
def _(t):
    page = rel.owner_page(rel.list_owners(t.propietarios, "1"))
    return page_frame(page, "id", "nombre", "documento", "establecimiento", "localidad", "departamento")


@query("p6_marks_of_operations", w("marcas operaciones", """
    SELECT m.operacion_id, m.id, m.codigo, m.tipo, m.posicion FROM marcas m
    WHERE m.activo AND m.operacion_id IN (SELECT id FROM operaciones WHERE guia_colisionada)"""))
def _(t):
    asked = t.operaciones.where("guia_colisionada").select(F.col("id").alias("operacion_id"))
    return rel.marks_of(t.marcas, "operacion_id", asked).select("operacion_id", "id", "codigo", "tipo", "posicion")


@query("p7_export_operations", w("operaciones", """
    SELECT numero_guia, fecha, vendedor_nombre, vendedor_documento, comprador_nombre, comprador_documento, cantidad_animales,
      categoria_animales, revisar, guia_colisionada, creado_en, tipo_operacion FROM operaciones
    WHERE activo AND creado_en >= TIMESTAMP '1996-01-01' AND creado_en <= TIMESTAMP '1996-12-31 23:59:59'"""))
def _(t):
    return rel.export_operations(t.operaciones, lo="1996-01-01", hi="1996-12-31")


@query("p7_export_marks", w("marcas propietarios operaciones", """
    SELECT m.codigo, m.tipo, m.estado, m.vence_en, CASE WHEN p.id IS NULL THEN NULL ELSE p.nombre END AS propietario, p.documento,
      o.numero_guia, o.fecha
    FROM marcas m LEFT JOIN propietarios p ON p.id = m.propietario_id LEFT JOIN operaciones o ON o.id = m.operacion_id
    WHERE m.activo AND m.estado = 'activa' AND (m.codigo ILIKE '%777%' OR o.numero_guia ILIKE '%777%' OR p.nombre ILIKE '%777%'
      OR p.documento ILIKE '%777%')"""))
def _(t):
    e = rel.export_marks(t.marcas, t.propietarios, t.operaciones, text="777", estado="activa")
    return e.select(
        "codigo", "tipo", "estado", "vence_en", F.col("propietarios.nombre").alias("propietario"), "propietarios.documento",
        "operaciones.numero_guia", "operaciones.fecha",
    )


@query("p8_point_lookup", w("operaciones", "SELECT id, numero_guia, fecha, cantidad_animales FROM operaciones WHERE id = 77"))
def _(t):
    return paging.get(t.operaciones, "id", 77).select("id", "numero_guia", "fecha", "cantidad_animales")


# --- joins ------------------------------------------------------------------------------------
@query("j1_with_relations", w("marcas propietarios operaciones", """
    SELECT p.nombre, p.documento, o.numero_guia, count(*) AS n, count(p.id) AS con_duenio
    FROM marcas m LEFT JOIN propietarios p ON p.id = m.propietario_id LEFT JOIN operaciones o ON o.id = m.operacion_id GROUP BY 1, 2, 3"""))
def _(t):
    m = rel.with_relations(t.marcas, t.propietarios, t.operaciones)
    return m.groupBy("propietarios.nombre", "propietarios.documento", "operaciones.numero_guia").agg(
        F.count(F.lit(1)).alias("n"), F.count("propietarios").alias("con_duenio")
    )


_SEARCH = """
    , f AS (SELECT m.id, m.codigo, m.estado, m.tipo, p.nombre AS propietario, o.numero_guia
      FROM marcas m LEFT JOIN propietarios p ON p.id = m.propietario_id LEFT JOIN operaciones o ON o.id = m.operacion_id
      WHERE m.activo AND m.estado <> 'baja' AND m.tipo = 'dominante' AND (m.codigo ILIKE '%250%' OR o.numero_guia ILIKE '%250%'
        OR p.nombre ILIKE '%250%' OR p.documento ILIKE '%250%' OR m.origen_etiqueta ILIKE '%250%'
        OR EXISTS (SELECT 1 FROM escaneos e WHERE e.id = m.escaneo_id AND e.numero_guia ILIKE '%250%')))
    SELECT *, (SELECT count(*) FROM f) AS total FROM f ORDER BY codigo LIMIT 40 OFFSET 40"""


@query("j2_search_marks", w("marcas propietarios operaciones escaneos", _SEARCH))
def _(t):
    found = rel.search_marks_page(t.marcas, t.propietarios, t.operaciones, t.escaneos, page=2, text="250", tipo="dominante", sin_baja=True)
    return page_frame(
        found, "id", "codigo", "estado", "tipo", F.col("propietarios.nombre").alias("propietario"),
        "operaciones.numero_guia",
    )


def _dealt_codes(t):
    """Codes dealt by operation: Spark sorts rows for a smallest text, here those of a small partition instead of a whole file split."""
    return t.marcas.select("operacion_id", "codigo").repartition("operacion_id")


@query("j3_lookup_ordered", w("marcas operaciones", """
    SELECT CAST(o.id AS STRING) AS lista, m.codigo, m.estado, 1 AS posicion_pedida FROM operaciones o JOIN (SELECT operacion_id, min(codigo) AS codigo FROM marcas GROUP BY 1) f
      ON f.operacion_id = o.id JOIN marcas m ON m.codigo = f.codigo WHERE m.activo AND m.estado <> 'baja' AND m.archivo_png IS NOT NULL"""))
def _(t):
    first = _dealt_codes(t).groupBy("operacion_id").agg(F.min("codigo").alias("c"))
    lists = first.select(F.col("operacion_id").cast("string").alias("lista"), F.array(F.lit("falta"), "c", "c").alias("codigos"))
    return rel.lookup_ordered(t.marcas, lists, usable_only=True).select("lista", "codigo", "estado", "posicion_pedida")


@query("j5_operations_of_owner", w("operaciones propietarios", """
    SELECT p.id AS propietario_id, o.id, o.numero_guia, o.creado_en FROM operaciones o JOIN propietarios p
      ON p.documento = o.vendedor_documento OR p.documento = o.comprador_documento WHERE o.activo"""))
def _(t):
    return rel.operations_of_owner(t.operaciones, t.propietarios).select("propietario_id", "id", "numero_guia", "creado_en")


@query("j6_link_pages", w("marcas escaneos", """
    SELECT m.id, coalesce(m.escaneo_id, e.id) AS escaneo_id, m.escaneo_id IS NULL AND e.id IS NOT NULL AS vinculada FROM marcas m
    LEFT JOIN escaneos e ON e.carpeta = m.origen_carpeta AND e.archivo = m.origen_pagina"""))
def _(t):
    return rel.link_pages(t.marcas, t.escaneos).select("id", "escaneo_id", "vinculada")


@query("j7_provenance", w("marcas escaneos", """
    SELECT m.codigo, e.id AS escaneo_id, e.carpeta, e.archivo, e.formato, e.numero_guia AS numero_pagina, e.etiqueta
    FROM marcas m JOIN escaneos e ON e.id = m.escaneo_id"""))
def _(t):
    return rel.provenance(t.marcas, t.escaneos)


@query("j8_deletion_plan", w("operaciones documentos_emitidos", """
    SELECT id, CASE WHEN id IN (SELECT operacion_id FROM documentos_emitidos) THEN 'bloqueada' ELSE 'borrable' END AS accion
    FROM operaciones WHERE guia_colisionada"""))
def _(t):
    return rel.deletion_plan(t.operaciones.where("guia_colisionada").select("id"), t.operaciones, t.documentos_emitidos)


_DECISIONS = """
    , decisiones AS (SELECT origen_archivo, concat('cat', CAST(origen_carpeta_n AS STRING)) AS categoria FROM marcas WHERE estado <> 'activa'
        UNION ALL SELECT concat('x', origen_archivo), 'vacia' FROM marcas WHERE estado = 'activa'),
      base AS (SELECT id, origen_archivo, estado, CASE WHEN activo THEN NULL ELSE operacion_id END AS operacion_id FROM marcas)"""


def _decisions(t):
    m = t.marcas
    listed = m.where("estado <> 'activa'").select("origen_archivo", F.concat(F.lit("cat"), F.col("origen_carpeta_n").cast("string")).alias("categoria"))
    unknown = m.where("estado = 'activa'").select(F.concat(F.lit("x"), "origen_archivo").alias("origen_archivo"), F.lit("vacia").alias("categoria"))
    base = m.withColumn("operacion_id", F.when(~F.col("activo"), F.col("operacion_id")))
    return base, listed.unionByName(unknown)


@query("j9_plan_retirement", w("marcas", _DECISIONS + """
    SELECT d.origen_archivo, d.categoria, CASE WHEN b.id IS NULL THEN 'no_esta' WHEN b.estado = 'baja' THEN 'ya_de_baja'
      WHEN b.operacion_id IS NOT NULL THEN 'en_operacion' ELSE 'dar_de_baja' END AS accion
    FROM decisiones d LEFT JOIN base b USING (origen_archivo)"""))
def _(t):
    return rel.plan_retirement(*_decisions(t)).select("origen_archivo", "categoria", "accion")


@query("j9_retirement_counts", w("marcas", _DECISIONS + """
    SELECT count(DISTINCT origen_archivo) AS en_la_lista, count(*) FILTER (WHERE b.id IS NULL) AS no_estan_en_la_base,
      count(*) FILTER (WHERE b.estado = 'baja') AS ya_de_baja,
      count(*) FILTER (WHERE b.estado <> 'baja' AND b.operacion_id IS NOT NULL) AS en_una_operacion,
      count(*) FILTER (WHERE b.estado <> 'baja' AND b.operacion_id IS NULL) AS a_dar_de_baja
    FROM decisiones d LEFT JOIN base b USING (origen_archivo)"""))
def _(t):
    return rel.retirement_counts(rel.plan_retirement(*_decisions(t)))


@query("j10_match_files", """
    WITH f AS (SELECT concat('doc_', CAST(page_id % 200 AS STRING), '.pdf') AS nombre, page_id % 3 AS carpeta_n, url AS path FROM pages),
      best AS (SELECT nombre, arg_min(path, concat(CAST(carpeta_n AS STRING), path)) AS ruta FROM f GROUP BY 1)
    SELECT event_id AS id, concat('doc_', CAST(event_id AS STRING), '.pdf') AS archivo, ruta, ruta IS NULL AS falta
    FROM events LEFT JOIN best ON best.nombre = concat('doc_', CAST(event_id AS STRING), '.pdf')""")
def _(t):
    files = t.raw("pages").select(
        F.concat(F.lit("doc_"), (F.col("page_id") % 200).cast("string"), F.lit(".pdf")).alias("nombre"),
        (F.col("page_id") % 3).alias("carpeta_n"), F.col("url").alias("path"),
    )
    rows = t.documentos_emitidos.select("id", F.col("nombre").alias("archivo"))
    return rel.match_files(rows, files).select("id", "archivo", "ruta", "falta")


@query("j11_assign_codes", """
    WITH c AS (SELECT concat(' Hoja ', p_brand, ' – ', p_name) AS hoja, p_size AS fila, p_partkey AS columna, p_type FROM part)
    SELECT hoja, fila, columna, CASE WHEN p_type = 'PROMO' THEN concat('M-', CAST(columna AS STRING)) ELSE
      concat(trim(regexp_replace(upper(hoja), '[^A-Z0-9]+', '-', 'g'), '-'), '-F', lpad(CAST(fila AS STRING), greatest(2, CAST(length(CAST(fila AS STRING)) AS INT)), '0'),
        'C', lpad(CAST(columna AS STRING), greatest(2, CAST(length(CAST(columna AS STRING)) AS INT)), '0')) END AS codigo FROM c""")
def _(t):
    p = t.raw("part")
    cells = p.select(
        F.concat(F.lit(" Hoja "), "p_brand", F.lit(" – "), "p_name").alias("hoja"), F.col("p_size").alias("fila"),
        F.col("p_partkey").alias("columna"), "p_type",
    )
    listed = cells.where("p_type = 'PROMO'").select("hoja", "fila", "columna", F.concat(F.lit("M-"), F.col("columna").cast("string"), F.lit(" ")).alias("codigo"))
    cells = cells.withColumn("hoja", F.trim("hoja"))
    return rel.assign_codes(cells, listed).select(F.concat(F.lit(" "), "hoja").alias("hoja"), "fila", "columna", "codigo")


@query("o6_companions", w("marcas", """
    , pedido AS (SELECT operacion_id, min(codigo) AS codigo_pedido FROM marcas GROUP BY 1)
    SELECT p.codigo_pedido, m.codigo, m.tipo, m.posicion, CASE WHEN m.tipo = 'dominante' THEN 0 ELSE 1 END AS dominante_primero
    FROM pedido p JOIN marcas m ON m.operacion_id = p.operacion_id WHERE m.codigo <> p.codigo_pedido"""))
def _(t):
    asked = t.marcas.groupBy("operacion_id").agg(F.min("codigo").alias("codigo"))
    return rel.companions(t.marcas, asked).select("codigo_pedido", "codigo", "tipo", "posicion", "dominante_primero")


@query("o6_companion_groups", w("marcas", """
    SELECT 'miembro' AS parte, operacion_id, codigo, CASE WHEN tipo = 'dominante' THEN 0 ELSE 1 END AS dominante_primero FROM marcas WHERE operacion_id IS NOT NULL
    UNION ALL SELECT 'pedido', operacion_id, codigo, NULL FROM marcas WHERE operacion_id IS NOT NULL"""))
def _(t):
    of, members = rel.companion_groups(t.marcas, t.marcas)  # every mark is asked for
    columns = ["parte", "operacion_id", "codigo", "dominante_primero"]
    asked = of.select(F.lit("pedido").alias("parte"), "operacion_id", F.col("codigo_pedido").alias("codigo"), F.lit(None).cast("int").alias("dominante_primero"))
    return members.withColumn("parte", F.lit("miembro")).select(columns).unionByName(asked)


_VERSIONS = """
    , v AS (SELECT event_id AS id, user_id AS marca_id, CASE WHEN event_type = 'error' THEN 'restauracion' ELSE 'reemplazo' END AS motivo,
        ts AS creado_en, user_id % 10 AS creado_por, CASE WHEN value > 20 THEN 'x' ELSE NULL END AS archivo_png,
        CASE WHEN event_type = 'view' THEN 'x' ELSE NULL END AS archivo_svg FROM events)"""


def _versions(t):
    return t.raw("events").selectExpr(
        "event_id AS id", "user_id AS marca_id", "CASE WHEN event_type = 'error' THEN 'restauracion' ELSE 'reemplazo' END AS motivo",
        "ts AS creado_en", "user_id % 10 AS creado_por", "CASE WHEN value > 20 THEN 'x' ELSE NULL END AS archivo_png",
        "CASE WHEN event_type = 'view' THEN 'x' ELSE NULL END AS archivo_svg",
    )


@query("o7_history", w("usuarios", _VERSIONS + """
    SELECT v.id, marca_id, motivo, creado_en, creado_por, archivo_png IS NOT NULL AS tiene_png, archivo_svg IS NOT NULL AS tiene_svg,
      u.nombre AS creado_por_nombre, row_number() OVER (PARTITION BY marca_id ORDER BY creado_en DESC, v.id DESC) AS version_n
    FROM v LEFT JOIN usuarios u ON u.id = v.creado_por"""))
def _(t):
    return rel.history(_versions(t), t.usuarios)


@query("o9_save_selection", w("marcas", """
    , f AS (SELECT operacion_id, min(codigo) AS a, max(codigo) AS b FROM marcas GROUP BY 1)
    SELECT CAST(f.operacion_id AS STRING) AS lista, m.id AS marca_id, CASE WHEN p.k = 1 THEN 1 ELSE 3 END AS posicion
    FROM f CROSS JOIN (VALUES (1), (2)) p(k) JOIN marcas m ON m.codigo = CASE WHEN p.k = 1 THEN f.b ELSE f.a END"""))
def _(t):
    f = _dealt_codes(t).groupBy("operacion_id").agg(F.min("codigo").alias("a"), F.max("codigo").alias("b"))
    lists = f.select(F.col("operacion_id").cast("string").alias("lista"), F.array("b", F.lit("falta"), "a").alias("codigos"))
    return rel.save_selection(lists, t.marcas)


# --- counters ---------------------------------------------------------------------------------
@query("a1_breakdown", w("marcas", """
    SELECT count(*) FILTER (WHERE estado = 'activa') AS activa, count(*) FILTER (WHERE estado = 'revisar') AS revisar,
      count(*) FILTER (WHERE estado = 'baja') AS baja, count(*) FILTER (WHERE tipo = 'dominante') AS dominante,
      count(*) FILTER (WHERE tipo = 'complementaria') AS complementaria FROM marcas"""))
def _(t):
    return agg.breakdown(t.marcas)


@query("a2_page_summary", w("escaneos", """
    SELECT count(*) AS paginas, count(DISTINCT numero_guia) AS guias, count(*) FILTER (WHERE numero_guia IS NULL) AS sin_numero,
      count(*) FILTER (WHERE revisado) AS revisadas FROM escaneos"""))
def _(t):
    return agg.page_summary(t.escaneos)


@query("a3_reason_histogram", w("marcas", """
    SELECT split_part(motivo_calidad, ' (', 1) AS motivo, count(*) AS n FROM marcas
    WHERE estado = 'revisar' AND activo AND motivo_calidad IS NOT NULL GROUP BY 1"""))
def _(t):
    return agg.reason_histogram(t.marcas)


@query("a4_review_counters", w("marcas", """
    SELECT count(*) FILTER (WHERE estado = 'revisar') AS pendientes,
      count(*) FILTER (WHERE estado = 'baja' AND starts_with(motivo_calidad, 'no_es_marca:')) AS bajas_automaticas
    FROM marcas WHERE activo"""))
def _(t):
    return agg.review_counters(t.marcas)


@query("a5_catalog_stats", w("marcas propietarios", """
    SELECT count(*) AS marcas, count(*) FILTER (WHERE estado = 'activa') AS activa, count(*) FILTER (WHERE estado = 'revisar') AS revisar,
      count(*) FILTER (WHERE estado = 'baja') AS baja, count(*) FILTER (WHERE propietario_id IS NULL) AS sin_propietario,
      count(*) FILTER (WHERE archivo_png IS NULL OR archivo_png = '') AS sin_imagen,
      (SELECT count(*) FROM (SELECT sha1 FROM marcas GROUP BY 1 HAVING count(*) > 1)) AS imagenes_duplicadas,
      (SELECT count(*) FROM propietarios) AS propietarios FROM marcas"""))
def _(t):
    return agg.catalog_stats(t.marcas, t.propietarios)


@query("a6_duplicate_groups", """
    WITH h AS (SELECT doc_id, sha1(text) AS huella FROM documents), g AS (SELECT huella, count(*) AS n FROM h GROUP BY 1 HAVING count(*) > 1)
    SELECT h.doc_id, g.huella, g.n FROM h JOIN g USING (huella)""")
def _(t):
    h = t.raw("documents").select("doc_id", F.sha1("text").alias("huella"))
    return h.join(agg.duplicate_groups(h, "huella"), "huella", "inner").select("doc_id", "huella", "n")


@query("a6_duplicate_rows", """
    SELECT doc_id, sha1(text) AS huella FROM documents WHERE sha1(text) IN (SELECT sha1(text) FROM documents GROUP BY 1 HAVING count(*) > 1)""")
def _(t):
    return agg.duplicate_rows(t.raw("documents").select("doc_id", F.sha1("text").alias("huella")), "huella")


@query("a8_batch_summary", w("marcas escaneos", """
    SELECT (SELECT count(*) FROM escaneos) AS hojas, (SELECT count(*) FROM escaneos WHERE formato IS NULL) AS hojas_con_error,
      count(*) AS marcas_detectadas, count(*) FILTER (WHERE archivo_png <> '') AS marcas_generadas,
      count(*) FILTER (WHERE estado = 'revisar') AS a_revisar FROM marcas"""))
def _(t):
    sheets = t.escaneos.select(F.when(F.col("formato").isNull(), "sin casillas").alias("error"))
    marks = t.marcas.select(F.col("archivo_png").alias("png"), (F.col("estado") == "revisar").alias("revisar"))
    return agg.batch_summary(sheets, marks)


@query("a9_file_inventory", w("archivos", """
    , f AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, bytes,
        lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+(\\.[^.]+)$', 1)) AS ext FROM archivos)
    SELECT 'extension' AS grupo, ext AS valor, count(*) AS archivos, CAST(sum(bytes) AS BIGINT) AS bytes FROM f GROUP BY ext
    UNION ALL SELECT * FROM (SELECT 'carpeta', dir, count(*) AS n, CAST(sum(bytes) AS BIGINT) FROM f GROUP BY dir)
    UNION ALL SELECT 'total', '', count(*), CAST(sum(bytes) AS BIGINT) FROM f"""))
def _(t):
    return agg.file_inventory(t.archivos)


@query("g6_operation_manifest", w("operaciones marcas", """
    SELECT 'OP-' || lpad(CAST(o.id AS STRING), greatest(4, CAST(length(CAST(o.id AS STRING)) AS INT)), '0') || '_' || o.numero_guia || '.pdf' AS archivo,
      o.id AS operacion_id, o.numero_guia, 0 AS parte, string_agg(m.id || ':' || m.codigo || ':' || m.tipo, ',' ORDER BY m.id) AS marcas
    FROM operaciones o JOIN marcas m ON m.operacion_id = o.id GROUP BY o.id, o.numero_guia"""))
def _(t):
    listed = guides.operation_manifest(t.operaciones, t.marcas)
    text = F.array_join(F.transform("marcas", lambda m: F.concat_ws(":", m["id"], m["codigo"], m["tipo"])), ",")
    return listed.withColumn("marcas", text)


# --- checks on marks and operations -----------------------------------------------------------
@query("q7_existing_operation", w("operaciones", """
    SELECT n.id, n.numero_guia, n.tipo_operacion, min(o.id) AS operacion_existente
    FROM operaciones n LEFT JOIN operaciones o ON o.numero_guia = n.numero_guia AND o.tipo_operacion = n.tipo_operacion AND o.activo
    WHERE NOT n.activo GROUP BY ALL"""))
def _(t):
    new = t.operaciones.where("NOT activo").select("id", "numero_guia", "tipo_operacion")
    return audit.existing_operation(new, t.operaciones)


_REQUESTS = """
    , pedidos AS (SELECT codigo, CASE WHEN origen_carpeta_n = 0 THEN operacion_id ELSE operacion_id + 1 END AS operacion_id FROM marcas
        UNION ALL SELECT concat('Z', codigo), operacion_id FROM marcas WHERE tipo = 'dominante')"""


@query("q8_usability", w("marcas", _REQUESTS + """
    SELECT p.codigo, p.operacion_id, CASE WHEN m.codigo IS NULL THEN 'no_existe'
      WHEN NOT m.activo AND m.operacion_id IS DISTINCT FROM p.operacion_id THEN 'oculta' WHEN m.estado = 'baja' THEN 'de_baja'
      WHEN m.archivo_png IS NULL THEN 'sin_imagen' END AS motivo FROM pedidos p LEFT JOIN marcas m USING (codigo)"""))
def _(t):
    m = t.marcas
    own = F.when(F.col("origen_carpeta_n") == 0, F.col("operacion_id")).otherwise(F.col("operacion_id") + 1)
    asked = m.select("codigo", own.alias("operacion_id")).unionByName(
        m.where("tipo = 'dominante'").select(F.concat(F.lit("Z"), "codigo").alias("codigo"), "operacion_id")
    )
    return audit.usability(asked, t.marcas)


@query("q9_dominant_conflicts", w("marcas", """
    SELECT operacion_id, count(*) AS dominantes FROM (SELECT operacion_id, tipo FROM marcas UNION ALL
      SELECT operacion_id, tipo FROM marcas WHERE estado = 'activa') WHERE tipo = 'dominante' GROUP BY 1 HAVING count(*) > 1"""))
def _(t):
    return audit.dominant_conflicts(t.marcas, t.marcas.where("estado = 'activa'"))


@query("x5_snapshot_large", """
    SELECT l_suppkey AS operacion_id, count(*) AS cantidad_marcas, count(*) > 150 AS rechazado, count(*) AS en_lista,
      CAST(min(l_orderkey * 10 + l_linenumber) AS STRING) AS primera FROM lineitem GROUP BY 1""")
def _(t):
    lines = t.raw("lineitem").selectExpr("l_suppkey AS operacion_id", "l_orderkey * 10 + l_linenumber AS pos")
    code = F.col("pos").cast("string")
    stamped = lines.select("operacion_id", "pos", code.alias("codigo"), F.lit("dominante").alias("tipo"), code.alias("descripcion"), F.lit("p").alias("propietario"))
    ops = lines.select(F.col("operacion_id").alias("id"), F.lit("1").alias("numero_guia")).distinct()
    return snapshot(ops, stamped).select(
        "operacion_id", "cantidad_marcas", "rechazado", F.json_array_length("marcas").cast("long").alias("en_lista"),
        F.get_json_object("marcas", "$[0].codigo").alias("primera"),
    )


@query("x5_snapshot", w("operaciones marcas propietarios", """
    , s AS (SELECT m.operacion_id, count(*) AS n, string_agg(
        CASE WHEN p.nombre IS NULL THEN '{"codigo":"' || m.codigo || '","tipo":"' || tipo || '","descripcion":"' || descripcion || '","propietario":null}'
        ELSE '{"codigo":"' || m.codigo || '","tipo":"' || tipo || '","descripcion":"' || descripcion || '","propietario":"' || p.nombre || '"}' END, ',' ORDER BY m.codigo) AS lista
      FROM marcas m LEFT JOIN propietarios p ON p.id = m.propietario_id GROUP BY 1)
    SELECT o.id AS operacion_id, coalesce(n, 0) AS cantidad_marcas, coalesce(n, 0) > 150 AS rechazado, '[' || coalesce(lista, '') || ']' AS marcas,
      o.numero_guia AS numero_guia_foto, o.cantidad_animales AS animales_foto, o.revisar AS revisar_foto
    FROM operaciones o LEFT JOIN s ON s.operacion_id = o.id"""))
def _(t):
    names = t.propietarios.select(F.col("id").alias("propietario_id"), F.col("nombre").alias("propietario"))
    stamped = t.marcas.join(names, "propietario_id", "left").select(
        "operacion_id", F.col("codigo").alias("pos"), "codigo", "tipo", "descripcion", "propietario"
    )
    fields = {"numero_guia": "numero_guia_foto", "cantidad_animales": "animales_foto", "revisar": "revisar_foto"}
    assert set(fields) <= set(SNAPSHOT_FIELDS)
    photo = F.from_json("datos", "numero_guia string, cantidad_animales int, revisar string")
    return snapshot(t.operaciones, stamped).select(
        "operacion_id", "cantidad_marcas", "rechazado", "marcas", *[photo[k].alias(v) for k, v in fields.items()]
    )
