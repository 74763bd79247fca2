"""Queries that apply changes, compare fingerprints, and read or write files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from stampbook.operators import changes as chg
from stampbook.operators import similar as sim
from stampbook.operators.aggregates import action_counts, ingest_counts, load_counts
from stampbook.operators.relations import export_marks, export_operations, plan_retirement
from stampbook.plans.bindings import with_bindings as w
from stampbook.plans.catalogue import _DECISIONS, _decisions
from stampbook.plans.registry import query
from stampbook.session import checkpoint_dir
from stampbook.sources.buckets import Buckets
from stampbook.sources import delimited, export, ingest, page_index, snapshot
from stampbook.streaming import pages as stream

# --- merges -----------------------------------------------------------------------------------
_SLICES = """
    , cur AS (SELECT id, numero_guia, revisar, fecha, activo FROM operaciones WHERE NOT guia_colisionada),
      inc AS (SELECT id, concat(numero_guia, 'X') AS numero_guia, CASE WHEN activo THEN '' ELSE 'nuevo' END AS revisar, 'otra' AS fecha, true AS activo
        FROM operaciones WHERE guia_colisionada OR tipo_operacion = 'venta'),
      j AS (SELECT coalesce(c.id, i.id) AS id, c.id IS NOT NULL AS viejo, i.id IS NOT NULL AS nuevo, c.numero_guia AS cn, i.numero_guia AS inu,
        c.revisar AS cr, i.revisar AS ir, c.fecha AS cf, i.fecha AS fi, c.activo AS ca, i.activo AS ia FROM cur c FULL JOIN inc i ON c.id = i.id)"""


def _slices(t):
    o = t.operaciones.select("id", "numero_guia", "revisar", "fecha", "activo", "guia_colisionada", "tipo_operacion")
    cur = o.where("NOT guia_colisionada").select("id", "numero_guia", "revisar", "fecha", "activo")
    inc = o.where("guia_colisionada OR tipo_operacion = 'venta'").select(
        "id", F.concat("numero_guia", F.lit("X")).alias("numero_guia"), F.when(F.col("activo"), "").otherwise("nuevo").alias("revisar"),
        F.lit("otra").alias("fecha"), F.lit(True).alias("activo"),
    )
    return cur, inc


_ACTION = "CASE WHEN NOT viejo THEN 'nueva' WHEN NOT nuevo THEN 'sin_cambio' ELSE 'actualizada' END"


@query("u1_merge_replace", w("operaciones", _SLICES + f"""
    SELECT id, CASE WHEN nuevo THEN inu ELSE cn END AS numero_guia, CASE WHEN nuevo THEN ir ELSE cr END AS revisar,
      CASE WHEN viejo THEN cf ELSE fi END AS fecha, CASE WHEN viejo THEN ca ELSE ia END AS activo, {_ACTION} AS accion FROM j"""))
def _(t):
    return chg.merge(*_slices(t), ["id"], ["numero_guia", "revisar"])


@query("u1_merge_filled", w("operaciones", _SLICES + f"""
    SELECT id, CASE WHEN nuevo THEN inu ELSE cn END AS numero_guia, CASE WHEN nuevo AND ir <> '' THEN ir ELSE cr END AS revisar,
      CASE WHEN viejo THEN cf ELSE fi END AS fecha, CASE WHEN viejo THEN ca ELSE ia END AS activo, {_ACTION} AS accion FROM j"""))
def _(t):
    return chg.merge(*_slices(t), ["id"], ["numero_guia", "revisar"], policy="filled")


@query("u1_merge_missing_stamped", w("operaciones", _SLICES + f"""
    SELECT id, CASE WHEN viejo THEN cn ELSE inu END AS numero_guia, CASE WHEN NOT viejo OR nullif(cr, '') IS NULL AND nuevo THEN ir ELSE cr END AS revisar,
      CASE WHEN viejo THEN cf ELSE fi END AS fecha, CASE WHEN viejo THEN ca ELSE ia END AS activo, {_ACTION} AS accion,
      CASE WHEN viejo AND nuevo THEN '2024-05-05' ELSE CASE WHEN viejo THEN '2020-01-01' END END AS actualizado FROM j"""))
def _(t):
    cur, inc = _slices(t)
    cur = cur.withColumn("actualizado", F.lit("2020-01-01"))
    return chg.merge(cur, inc, ["id"], ["numero_guia", "revisar"], policy="missing", stamp="actualizado", now=F.lit("2024-05-05"))


@query("u1_merge_missing_keys", w("operaciones", """
    SELECT id, CASE WHEN id % 2 = 0 THEN 'n' ELSE numero_guia END AS numero_guia, CASE WHEN id % 2 = 0 THEN 'actualizada' ELSE 'sin_cambio' END AS accion
    FROM operaciones WHERE id % 3 <> 0 UNION ALL SELECT NULL, numero_guia, 'sin_cambio' FROM operaciones WHERE id % 3 = 0
    UNION ALL SELECT CASE WHEN id % 2 = 0 THEN id END, 'n', 'nueva' FROM operaciones WHERE id % 2 <> 0 OR id % 3 = 0"""))
def _(t):
    cur = t.operaciones.selectExpr("CASE WHEN id % 3 <> 0 THEN id END AS id", "numero_guia")
    inc = t.operaciones.selectExpr("CASE WHEN id % 2 = 0 THEN id END AS id", "'n' AS numero_guia")
    return chg.merge(cur, inc, ["id"], ["numero_guia"])


@query("u1_merge_repeated_keys", """
    WITH i AS (SELECT user_id AS id, arg_max(event_type, event_id) AS valor FROM events GROUP BY 1)
    SELECT coalesce(c_custkey, i.id) AS id, coalesce(i.valor, c_name) AS valor,
      CASE WHEN c_custkey IS NULL THEN 'nueva' WHEN i.id IS NULL THEN 'sin_cambio' ELSE 'actualizada' END AS accion FROM customer FULL JOIN i ON i.id = c_custkey""")
def _(t):
    cur = t.raw("customer").selectExpr("c_custkey AS id", "c_name AS valor")
    return chg.merge(cur, t.raw("events").selectExpr("user_id AS id", "event_type AS valor", "event_id"), ["id"], ["valor"], order="event_id")


@query("u4_batch_without_file", w("marcas", """
    SELECT codigo, NULL AS origen_archivo, 'activa' AS estado, 'sin_cambio' AS accion FROM marcas WHERE estado = 'activa'
    UNION ALL SELECT concat('lote-', id), NULL, CASE WHEN sospechosa_calidad THEN 'revisar' ELSE 'activa' END, 'nueva' FROM marcas"""))
def _(t):
    none = F.lit(None).cast("string")
    cur = t.marcas.where("estado = 'activa'").select(none.alias("origen_archivo"), "codigo", "estado")
    ops = t.operaciones.select("id", "numero_guia", "vendedor_nombre", "vendedor_documento")
    cur_ops = ops.where("false").selectExpr("'' AS origen", "id AS origen_id", "numero_guia")
    marks = t.marcas.select("id", "operacion_id", none.alias("archivo_imagen"), "sospechosa_calidad")
    files = t.marcas.where("false").selectExpr("codigo AS nombre", "codigo AS path", "1 AS carpeta_n")
    loaded = chg.import_batch(cur_ops, cur, t.propietarios.select("id", "nombre", "documento"), ops, marks, files, "lote")
    return loaded["marcas"].select("codigo", "origen_archivo", "estado", "accion")


@query("u16_dry_run_counts", w("operaciones", _SLICES + f" SELECT {_ACTION} AS accion, count(*) AS n FROM j GROUP BY 1"))
def _(t):
    return chg.write_snapshot(chg.merge(*_slices(t), ["id"], ["numero_guia"]), "not-written", dry_run=True)


_IMAGE_NUMBERS = {"fila": "int", "columna": "int", "ancho_px": "int", "alto_px": "int", "aspecto": "double", "tinta_pct": "double", "componentes": "int"}


def _manifest(t):
    m = t.marcas
    numbers = {c: F.lit(1).cast(k) for c, k in _IMAGE_NUMBERS.items()}
    cur = m.where("activo").select(
        "codigo", "archivo_png", "archivo_svg", "estado", "descripcion", "propietario_id", "sha1", F.lit("h").alias("hoja"), F.lit("").alias("observaciones")
    ).withColumns(numbers)
    man = m.where("estado <> 'activa' OR NOT activo").select(
        "codigo", F.col("archivo_png").alias("png"), F.col("archivo_svg").alias("svg"), "sha1", F.lit("h2").alias("hoja"),
        F.col("sospechosa_calidad").alias("revisar"), F.col("motivo_calidad").alias("observaciones"),
    ).withColumns(numbers)
    return chg.import_manifest(cur, man)


@query("u2_import_manifest", w("marcas", """
    , i AS (SELECT * FROM marcas WHERE (estado <> 'activa' OR NOT activo) AND archivo_png <> ''), c AS (SELECT * FROM marcas WHERE activo)
    SELECT coalesce(c.codigo, i.codigo) AS codigo, CASE WHEN i.codigo IS NOT NULL THEN i.archivo_png ELSE c.archivo_png END AS archivo_png,
      CASE WHEN i.codigo IS NULL THEN c.estado WHEN i.sospechosa_calidad THEN 'revisar' ELSE 'activa' END AS estado, c.descripcion, c.propietario_id,
      CASE WHEN i.codigo IS NOT NULL THEN i.motivo_calidad ELSE '' END AS observaciones,
      CASE WHEN c.codigo IS NULL THEN 'nueva' WHEN i.codigo IS NULL THEN 'sin_cambio' ELSE 'actualizada' END AS accion
    FROM c FULL JOIN i ON c.codigo = i.codigo"""))
def _(t):
    return _manifest(t)[0].select("codigo", "archivo_png", "estado", "descripcion", "propietario_id", "observaciones", "accion")


@query("u2_manifest_counts", w("marcas", """
    , m AS (SELECT * FROM marcas WHERE estado <> 'activa' OR NOT activo)
    SELECT count(*) FILTER (WHERE archivo_png <> '' AND NOT activo) AS nuevas, count(*) FILTER (WHERE archivo_png <> '' AND activo) AS actualizadas,
      count(*) FILTER (WHERE archivo_png IS NULL OR archivo_png = '') AS omitidas FROM m"""))
def _(t):
    return _manifest(t)[1]


_OWNER_ROWS = (
    "o_orderkey AS fila, concat('N', CAST(o_custkey % 400 AS STRING)) AS nombre, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')"
    " THEN CAST(o_custkey * 2 AS STRING) ELSE NULL END AS documento, CASE WHEN o_orderstatus = 'P' THEN '' ELSE concat('E', CAST(o_orderkey AS STRING)) END AS establecimiento"
)
_OWNERS = f"""
    , r AS (SELECT {_OWNER_ROWS} FROM orders), cur AS (SELECT c_custkey AS id, concat('N', CAST(c_custkey AS STRING)) AS nombre,
        CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE CAST(c_custkey AS STRING) END AS documento, CASE WHEN c_acctbal < 0 THEN '' ELSE 'propio' END AS establecimiento FROM customer),
      pd AS (SELECT documento, min(fila) AS fila, arg_min(nombre, fila) AS nombre FROM r WHERE documento IS NOT NULL GROUP BY 1),
      ev AS (SELECT fila, nombre, documento FROM pd WHERE documento NOT IN (SELECT documento FROM cur WHERE documento IS NOT NULL)
        UNION ALL SELECT fila, nombre, NULL FROM r WHERE documento IS NULL),
      ev2 AS (SELECT ev.*, f.id AS libre, lag(ev.documento IS NOT NULL) OVER (PARTITION BY ev.nombre ORDER BY fila) AS antes
        FROM ev LEFT JOIN (SELECT nombre, min(id) AS id FROM cur WHERE documento IS NULL GROUP BY 1) f ON f.nombre = ev.nombre),
      ev3 AS (SELECT *, last_value(CASE WHEN CASE WHEN antes IS NULL THEN libre IS NULL ELSE antes END THEN concat('row:', fila) END IGNORE NULLS)
        OVER (PARTITION BY nombre ORDER BY fila ROWS UNBOUNDED PRECEDING) AS hecho FROM ev2),
      du AS (SELECT documento, concat('id:', min(id)) AS owner FROM cur WHERE documento IS NOT NULL GROUP BY 1
        UNION ALL SELECT documento, coalesce(hecho, concat('id:', libre)) FROM ev3 WHERE documento IS NOT NULL),
      lk AS (SELECT r.fila, du.owner FROM r JOIN du USING (documento) UNION ALL SELECT fila, coalesce(hecho, concat('id:', libre)) FROM ev3 WHERE documento IS NULL)"""


def _owner_rows(t):
    inc = t.raw("orders").selectExpr(_OWNER_ROWS.split(", concat")[0], *_owner_exprs()).withColumnRenamed("fila", "row")
    cur = t.raw("customer").selectExpr(
        "c_custkey AS id", "concat('N', CAST(c_custkey AS STRING)) AS nombre",
        "CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE CAST(c_custkey AS STRING) END AS documento",
        "CASE WHEN c_acctbal < 0 THEN '' ELSE 'propio' END AS establecimiento",
    )
    return cur, inc


def _owner_exprs():
    return [
        "concat('N', CAST(o_custkey % 400 AS STRING)) AS nombre",
        "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') THEN CAST(o_custkey * 2 AS STRING) ELSE NULL END AS documento",
        "CASE WHEN o_orderstatus = 'P' THEN '' ELSE concat('E', CAST(o_orderkey AS STRING)) END AS establecimiento",
    ]


@query("u3_owner_links", "WITH z AS (SELECT 1)" + _OWNERS.rstrip() + " SELECT fila AS row, owner FROM lk")
def _(t):
    return chg.resolve_owners(*_owner_rows(t))[0]


@query("u3_resolved_owners", "WITH z AS (SELECT 1)" + _OWNERS.rstrip() + """
    , of AS (SELECT lk.owner, arg_min(nombre, fila) AS nombre, arg_min(documento, fila) FILTER (WHERE documento IS NOT NULL) AS documento,
        arg_min(establecimiento, fila) FILTER (WHERE establecimiento <> '') AS establecimiento FROM lk JOIN r USING (fila) GROUP BY 1),
      cc AS (SELECT concat('id:', id) AS owner, * FROM cur)
    SELECT coalesce(cc.owner, of.owner) AS owner, coalesce(cc.nombre, of.nombre) AS nombre, coalesce(nullif(cc.documento, ''), of.documento) AS documento,
      CASE WHEN nullif(cc.establecimiento, '') IS NOT NULL OR of.owner IS NULL THEN cc.establecimiento ELSE of.establecimiento END AS establecimiento,
      CASE WHEN cc.owner IS NULL THEN 'nueva' WHEN of.owner IS NULL THEN 'sin_cambio' ELSE 'actualizada' END AS accion
    FROM cc FULL JOIN of ON cc.owner = of.owner""")
def _(t):
    return chg.resolve_owners(*_owner_rows(t))[1].select("owner", "nombre", "documento", "establecimiento", "accion")


def _batch(t):
    cur_ops = t.operaciones.where("NOT guia_colisionada").select(
        F.lit("lote").alias("origen"), F.col("id").alias("origen_id"), "numero_guia", "vendedor_nombre", "vendedor_documento", "revisar"
    )
    ops = t.operaciones.select("id", F.concat("numero_guia", F.lit("-")).alias("numero_guia"), "vendedor_nombre", "vendedor_documento", F.lit("ok").alias("revisar"))
    cur_marks = t.marcas.where("estado = 'activa'").select(
        "origen_archivo", F.concat(F.lit("HOY-"), "codigo").alias("codigo"), "tipo", "posicion", "archivo_png", "estado",
        F.lit("lote").alias("origen"), F.col("operacion_id").alias("origen_id"), F.lit(None).cast("string").alias("owner"),
    )
    marks = t.marcas.select(
        "id", "operacion_id", F.when(F.col("tipo") == "dominante", F.col("tipo")).alias("tipo"), "posicion",
        F.col("origen_archivo").alias("archivo_imagen"), "sospechosa_calidad",
    )
    files = t.marcas.where("archivo_svg IS NOT NULL").select(
        F.col("origen_archivo").alias("nombre"), F.concat(F.lit("f/"), "origen_archivo").alias("path"), F.lit(1).alias("carpeta_n")
    )
    owners = t.propietarios.select("id", "nombre", "documento", "establecimiento")
    return chg.import_batch(cur_ops, cur_marks, owners, ops, marks, files.dropDuplicates(["nombre"]), "lote")


@query("u4_batch_operations", w("operaciones", """
    SELECT 'lote' AS origen, id AS origen_id, concat(numero_guia, '-') AS numero_guia, vendedor_nombre, vendedor_documento, 'ok' AS revisar,
      CASE WHEN guia_colisionada THEN 'nueva' ELSE 'actualizada' END AS accion FROM operaciones"""))
def _(t):
    return _batch(t)["operaciones"]


@query("u4_batch_marks", w("marcas operaciones propietarios", """
    , po AS (SELECT vendedor_documento AS documento, min(id) AS fila, vendedor_nombre AS nombre FROM operaciones GROUP BY 1, 3),
      ow AS (SELECT po.documento, CASE WHEN d.id IS NOT NULL THEN concat('id:', d.id) WHEN f.id IS NOT NULL THEN concat('id:', f.id) ELSE concat('row:', po.fila) END AS owner
        FROM po LEFT JOIN propietarios d ON d.documento = po.documento LEFT JOIN propietarios f ON f.nombre = po.nombre AND f.documento IS NULL)
    SELECT m.origen_archivo, CASE WHEN m.estado = 'activa' THEN concat('HOY-', m.codigo) ELSE m.id END AS codigo,
      CASE WHEN m.tipo = 'dominante' OR m.estado = 'activa' THEN m.tipo END AS tipo, m.posicion,
      CASE WHEN m.archivo_svg IS NOT NULL THEN concat('f/', m.origen_archivo) WHEN m.estado = 'activa' THEN m.archivo_png END AS archivo_png,
      CASE WHEN m.sospechosa_calidad THEN 'revisar' ELSE 'activa' END AS estado, m.operacion_id AS origen_id, ow.owner,
      CASE WHEN m.estado = 'activa' THEN 'actualizada' ELSE 'nueva' END AS accion
    FROM marcas m LEFT JOIN operaciones o ON o.id = m.operacion_id LEFT JOIN ow ON ow.documento = o.vendedor_documento"""))
def _(t):
    return _batch(t)["marcas"].select("origen_archivo", "codigo", "tipo", "posicion", "archivo_png", "estado", "origen_id", "owner", "accion")


@query("u4_batch_missing_files", w("marcas", "SELECT origen_archivo AS nombre FROM marcas WHERE archivo_svg IS NULL"))
def _(t):
    return _batch(t)["faltantes"]


@query("u5_import_sheet", w("marcas", """
    , r AS (SELECT codigo, CASE WHEN sospechosa_calidad THEN '' ELSE concat('nueva ', descripcion) END AS descripcion, CASE WHEN activo THEN 'baja' ELSE '' END AS estado FROM marcas WHERE estado <> 'activa'),
      c AS (SELECT codigo, descripcion, estado FROM marcas WHERE activo)
    SELECT coalesce(c.codigo, r.codigo) AS codigo, coalesce(nullif(r.descripcion, ''), c.descripcion) AS descripcion, coalesce(nullif(r.estado, ''), c.estado) AS estado,
      CASE WHEN c.codigo IS NULL THEN 'nueva' WHEN r.codigo IS NULL THEN 'sin_cambio' ELSE 'actualizada' END AS accion FROM c FULL JOIN r ON c.codigo = r.codigo"""))
def _(t):
    m = t.marcas
    cur = m.where("activo").select("codigo", "descripcion", "estado", F.lit(None).cast("string").alias("owner"))
    sheet = m.where("estado <> 'activa'").select(
        F.col("id").alias("row"), "codigo", F.when(F.col("sospechosa_calidad"), "").otherwise(F.concat(F.lit("nueva "), "descripcion")).alias("descripcion"),
        F.when(F.col("activo"), "baja").otherwise("").alias("estado"),
        F.concat(F.lit("D "), F.col("propietario_id").cast("string")).alias("propietario"), F.col("propietario_id").cast("string").alias("documento"),
    )
    marks, _ = chg.import_sheet(cur, t.propietarios.select("id", "nombre", "documento"), sheet)
    return marks.select("codigo", "descripcion", "estado", "accion")


_PAGES_COLS = "carpeta, archivo, numero_guia, fuente_numero, propietario, revisado"
_UPSERT = """
    , c AS (SELECT * FROM escaneos WHERE formato IS NOT NULL), i AS (SELECT carpeta, archivo, numero_guia || '0' AS numero_guia, 'inferido:anexo' AS fuente_numero, 'leido' AS propietario FROM escaneos WHERE formato <> 'GE2_ANEXO' OR formato IS NULL),
      j AS (SELECT coalesce(c.carpeta, i.carpeta) AS carpeta, coalesce(c.archivo, i.archivo) AS archivo, c.archivo IS NULL AS alta, i.archivo IS NULL AS resto,
        coalesce(c.fuente_numero = 'manual' OR c.revisado, false) AS guarda, c.numero_guia AS cn, c.fuente_numero AS cf, c.propietario AS cp, c.revisado AS revisado,
        i.numero_guia AS n, i.fuente_numero AS f, i.propietario AS p FROM c FULL JOIN i ON c.carpeta = i.carpeta AND c.archivo = i.archivo),
      u AS (SELECT carpeta, archivo, CASE WHEN resto OR guarda THEN cn ELSE n END AS numero_guia, CASE WHEN resto OR guarda THEN cf ELSE f END AS fuente_numero,
        CASE WHEN resto OR guarda THEN cp ELSE p END AS propietario, revisado, CASE WHEN alta THEN 'nueva' WHEN resto THEN 'sin_cambio' WHEN guarda THEN 'protegida' ELSE 'actualizada' END AS accion FROM j)"""


def _upsert(t):
    e = t.escaneos
    cur = e.where("formato IS NOT NULL").select(*_PAGES_COLS.split(", "))
    inc = e.where("formato <> 'GE2_ANEXO' OR formato IS NULL").select(
        "carpeta", "archivo", F.concat("numero_guia", F.lit("0")).alias("numero_guia"), F.lit("inferido:anexo").alias("fuente_numero"), F.lit("leido").alias("propietario")
    )
    return chg.protected_upsert(cur, inc)


@query("u6_protected_upsert", w("escaneos", _UPSERT + f" SELECT {_PAGES_COLS}, accion FROM u"))
def _(t):
    return _upsert(t)


@query("a10_ingest_counts", w("escaneos", _UPSERT + """
    SELECT count(*) AS paginas, count(*) FILTER (WHERE starts_with(fuente_numero, 'inferido')) AS inferidas, count(*) FILTER (WHERE numero_guia <> '') AS con_numero,
      count(*) FILTER (WHERE accion = 'nueva') AS nuevas, count(*) FILTER (WHERE accion = 'actualizada') AS actualizadas, count(*) FILTER (WHERE accion = 'protegida') AS protegidas FROM u"""))
def _(t):
    return ingest_counts(_upsert(t))


@query("a10_load_counts", w("escaneos marcas", _UPSERT + """
    , img AS (SELECT carpeta, archivo FROM escaneos WHERE formato IS NOT NULL AND coalesce(numero_guia, '') <> '')
    SELECT count(*) AS paginas, count(*) FILTER (WHERE starts_with(fuente_numero, 'inferido')) AS inferidas, count(*) FILTER (WHERE numero_guia <> '') AS con_numero,
      count(*) FILTER (WHERE accion = 'nueva') AS nuevas, count(*) FILTER (WHERE accion = 'actualizada') AS actualizadas, count(*) FILTER (WHERE accion = 'protegida') AS protegidas,
      (SELECT count(DISTINCT (u.carpeta, u.archivo)) FROM u JOIN img ON img.carpeta = u.carpeta AND img.archivo = u.archivo WHERE accion <> 'sin_cambio') AS imagenes,
      (SELECT count(*) FROM marcas WHERE escaneo_id IS NULL AND (origen_carpeta, origen_pagina) IN (SELECT (carpeta, archivo) FROM u)) AS marcas_vinculadas FROM u"""))
def _(t):
    images = t.escaneos.select("carpeta", "archivo", F.col("formato").alias("imagen"), F.nullif("numero_guia", F.lit("")).alias("miniatura"))
    return load_counts(_upsert(t), t.marcas, images)


@query("u1_bucket_merge", w("operaciones", _SLICES + """
    SELECT id, CASE WHEN nuevo THEN inu ELSE cn END AS numero_guia, CASE WHEN nuevo THEN ir ELSE cr END AS revisar,
      CASE WHEN viejo THEN cf ELSE fi END AS fecha, CASE WHEN viejo THEN ca ELSE ia END AS activo FROM j"""))
def _(t):
    cur, inc = _slices(t)
    stored = Buckets(t.spark, _folder(t, "buckets"))
    stored.create(cur, ["id"], 32)
    stored.merge(inc, ["numero_guia", "revisar"])
    return stored.read()


@query("a10_action_counts", w("escaneos", _UPSERT + " SELECT accion, count(*) AS n FROM u GROUP BY 1"))
def _(t):
    return action_counts(_upsert(t))


@query("u7_insert_new", w("marcas", """
    , f AS (SELECT origen_archivo, origen_carpeta_n <> 0 AS ok FROM marcas WHERE archivo_png IS NOT NULL)
    SELECT m.origen_archivo, CASE WHEN m.sospechosa_calidad THEN 'revisar' ELSE 'activa' END AS estado, CASE WHEN NOT m.activo THEN 'ya_estaba' WHEN f.ok IS NULL THEN 'sin_archivo'
      WHEN NOT f.ok THEN 'danada' ELSE 'cargada' END AS accion FROM marcas m LEFT JOIN f USING (origen_archivo)"""))
def _(t):
    m = t.marcas
    files = m.where("archivo_png IS NOT NULL").select(F.col("origen_archivo").alias("nombre"), (F.col("origen_carpeta_n") != 0).alias("ok"))
    return chg.insert_new(m.where("NOT activo"), m, files).select("origen_archivo", "estado", "accion")


@query("u8_apply_state", w("marcas", """
    SELECT id, CASE WHEN tipo = 'dominante' THEN 'baja' ELSE estado END AS estado, activo, CASE WHEN tipo = 'dominante' THEN 'actualizada' ELSE 'sin_cambio' END AS accion FROM marcas"""))
def _(t):
    return chg.apply_state(t.marcas, t.marcas.where("tipo = 'dominante'").select("id"), "baja")[0].select("id", "estado", "activo", "accion")


@query("u8_undo", w("operaciones", "SELECT id, tipo_operacion AS estado, activo FROM operaciones"))
def _(t):
    cur = t.operaciones.select("id", F.col("tipo_operacion").alias("estado"), "activo")
    after, before = chg.apply_state(cur, t.operaciones.where("guia_colisionada").select("id"), "baja")
    return chg.undo(after.drop("accion"), before).drop("accion")


_RETIRED = _DECISIONS + """
    , m AS (SELECT b.id, b.estado, b.operacion_id, s.motivo_calidad, s.sospechosa_calidad, d.categoria FROM base b JOIN marcas s ON s.id = b.id
        LEFT JOIN decisiones d ON d.origen_archivo = b.origen_archivo),
      x AS (SELECT *, categoria IS NOT NULL AND estado <> 'baja' AND operacion_id IS NULL AS toca FROM m)"""


def _retired(t):
    base, decisions = _decisions(t)
    return base, chg.retire(base, plan_retirement(base, decisions))


@query("u9_retire", w("marcas", _RETIRED + """
    SELECT id, CASE WHEN toca THEN 'baja' ELSE estado END AS estado, sospechosa_calidad OR toca AS sospechosa_calidad,
      CASE WHEN toca THEN concat('no_es_marca:', categoria) ELSE motivo_calidad END AS motivo_calidad, CASE WHEN toca THEN 'actualizada' ELSE 'sin_cambio' END AS accion FROM x"""))
def _(t):
    return _retired(t)[1][0].select("id", "estado", "sospechosa_calidad", "motivo_calidad", "accion")


@query("u9_undo_retire", w("marcas", "SELECT id, estado, sospechosa_calidad, motivo_calidad FROM marcas"))
def _(t):
    _, (after, before) = _retired(t)
    return chg.undo_retire(after.drop("accion"), before).select("id", "estado", "sospechosa_calidad", "motivo_calidad")


@query("u10_set_visible", w("propietarios", """
    SELECT id, activo OR establecimiento = 'BUILDING' AS activo, CASE WHEN establecimiento = 'BUILDING' THEN 'actualizada' ELSE 'sin_cambio' END AS accion FROM propietarios"""))
def _(t):
    p = t.propietarios
    return chg.set_visible(p, p.where("establecimiento = 'BUILDING'").select("id"), True).select("id", "activo", "accion")


_DELETED = """
    , sel AS (SELECT id FROM operaciones WHERE guia_colisionada), gone AS (SELECT id FROM sel WHERE id NOT IN (SELECT operacion_id FROM documentos_emitidos))"""


@query("u11_delete_operations", w("operaciones documentos_emitidos marcas", _DELETED + """
    SELECT 'marca' AS clase, id AS clave, CASE WHEN operacion_id IN (SELECT id FROM gone) THEN NULL ELSE operacion_id END AS operacion_id FROM marcas
    UNION ALL SELECT 'operacion', CAST(id AS STRING), id FROM operaciones WHERE id NOT IN (SELECT id FROM gone)"""))
def _(t):
    out = chg.delete_operations(t.operaciones.where("guia_colisionada").select("id"), t.operaciones, t.documentos_emitidos, t.marcas)
    marks = out["marcas"].select(F.lit("marca").alias("clase"), F.col("id").alias("clave"), "operacion_id")
    return marks.unionByName(out["operaciones"].select(F.lit("operacion").alias("clase"), F.col("id").cast("string").alias("clave"), F.col("id").alias("operacion_id")))


def _images(t):
    c = t.raw("customer")
    cur = c.selectExpr(
        "c_custkey AS id", "CASE WHEN c_acctbal < 0 THEN NULL ELSE c_name END AS archivo_png",
        "CASE WHEN c_mktsegment = 'BUILDING' THEN c_mktsegment END AS archivo_svg", "CAST('h' AS BINARY) AS huella",
    )
    versions = t.raw("supplier").selectExpr(
        "s_suppkey AS id", "s_suppkey AS marca_id", "s_name AS archivo_png", "CAST(NULL AS STRING) AS archivo_svg", "'reemplazo' AS motivo",
        "CAST(s_nationkey AS BIGINT) AS creado_por", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS creado_en",
    )
    return cur, versions


_NOW = "TIMESTAMP_NTZ '2024-06-01 00:00:00'"
_VERSIONS_SQL = """
    WITH cur AS (SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_name END AS png, CASE WHEN c_mktsegment = 'BUILDING' THEN c_mktsegment END AS svg, c_mktsegment AS seg FROM customer),
      v AS (SELECT s_suppkey AS id, s_suppkey AS marca_id, s_name AS png FROM supplier), n AS (SELECT max(id) AS m FROM v)"""


@query("u12_replace_with_history", _VERSIONS_SQL + """
    , s AS (SELECT (SELECT m FROM n) + row_number() OVER (ORDER BY id) AS id, id AS marca_id, png, svg FROM cur WHERE seg <> 'MACHINERY' AND (png IS NOT NULL OR svg IS NOT NULL))
    SELECT 'version' AS clase, id, marca_id, png AS archivo_png, svg AS archivo_svg, 'reemplazo' AS motivo FROM s
    UNION ALL SELECT 'version', id, marca_id, png, NULL, 'reemplazo' FROM v
    UNION ALL SELECT 'marca', id, id, CASE WHEN seg <> 'MACHINERY' THEN 'nueva' ELSE png END, CASE WHEN seg <> 'MACHINERY' THEN NULL ELSE svg END, CASE WHEN seg <> 'MACHINERY' THEN NULL ELSE 'h' END FROM cur""")
def _(t):
    cur, versions = _images(t)
    new = t.raw("customer").where("c_mktsegment <> 'MACHINERY'").selectExpr(
        "c_custkey AS id", "'nueva' AS archivo_png", "CAST(NULL AS STRING) AS archivo_svg", "CAST(1 AS BIGINT) AS usuario"
    )
    marks, history = chg.replace_with_history(cur, versions, new, now=F.expr(_NOW))
    return history.select(F.lit("version").alias("clase"), "id", "marca_id", "archivo_png", "archivo_svg", "motivo").unionByName(
        marks.select(F.lit("marca").alias("clase"), "id", F.col("id").alias("marca_id"), "archivo_png", "archivo_svg", F.col("huella").cast("string").alias("motivo"))
    )


@query("u12_restore_version", _VERSIONS_SQL + """
    SELECT cur.id, CASE WHEN v.id % 2 = 0 THEN v.png ELSE cur.png END AS archivo_png, CASE WHEN v.id % 2 = 0 THEN NULL ELSE cur.svg END AS archivo_svg,
      CASE WHEN v.id % 2 = 0 THEN 'actualizada' ELSE 'sin_cambio' END AS accion FROM cur LEFT JOIN v ON v.marca_id = cur.id""")
def _(t):
    cur, versions = _images(t)
    asked = t.raw("supplier").selectExpr("s_suppkey AS version_id", "CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE s_suppkey + 1 END AS marca_id", "CAST(1 AS BIGINT) AS usuario")
    return chg.restore_version(cur, versions, asked, now=F.expr(_NOW))[0].select("id", "archivo_png", "archivo_svg", "accion")


@query("u13_correct_pages", w("escaneos", """
    SELECT id, CASE WHEN revisado THEN CASE WHEN formato IS NULL THEN NULL ELSE 'N9' END ELSE numero_guia END AS numero_guia, CASE WHEN revisado THEN 'manual' ELSE fuente_numero END AS fuente_numero,
      CASE WHEN revisado THEN 1.0 ELSE conf_numero END AS conf_numero, propietario, CASE WHEN revisado THEN 'actualizada' ELSE 'sin_cambio' END AS accion FROM escaneos"""))
def _(t):
    e = t.escaneos
    edits = e.where("revisado").select("id", F.when(F.col("formato").isNull(), " ").otherwise(" N9 ").alias("numero_guia"), F.lit("x").alias("archivo"))
    return chg.correct_pages(e, edits).select("id", "numero_guia", "fuente_numero", "conf_numero", "propietario", "accion")


@query("u15_evolve", w("propietarios", "SELECT id, nombre, true AS verificado, CAST(NULL AS BIGINT) AS saldo FROM propietarios"))
def _(t):
    target = T.StructType.fromDDL("id bigint, nombre string, verificado boolean, saldo bigint")
    return chg.evolve(t.propietarios.select("id", "nombre"), target, {"verificado": True})


@query("u15_split_column", w("operaciones", """
    SELECT id AS operacion_id, CASE WHEN tipo_operacion = 'venta' THEN 'antes' ELSE revisar END AS contenido FROM operaciones WHERE tipo_operacion = 'venta' OR revisar IS NOT NULL"""))
def _(t):
    side = t.operaciones.where("tipo_operacion = 'venta'").select(F.col("id").alias("operacion_id"), F.lit("antes").alias("contenido"))
    return chg.split_column(t.operaciones, side, "operacion_id", "revisar", "contenido")[1]


@query("u17_bump_counts", w("escaneos marcas", """
    SELECT e.id, e.n_marcas + coalesce(k.n, 0) AS n_marcas FROM escaneos e LEFT JOIN (SELECT escaneo_id, count(*) AS n FROM marcas WHERE escaneo_id IS NOT NULL GROUP BY 1) k ON k.escaneo_id = e.id"""))
def _(t):
    return chg.bump_counts(t.escaneos, t.marcas).select("id", "n_marcas")


# --- fingerprints -----------------------------------------------------------------------------
_UNIT = """
    , c AS (SELECT id, label, aspect, list_transform(v, lambda x: CAST(x AS DOUBLE) - list_avg(list_transform(v, lambda y: CAST(y AS DOUBLE)))) AS z FROM huellas)"""


@query("v1_unit", w("huellas", _UNIT + """
    , n AS (SELECT *, sqrt(list_sum(list_transform(z, lambda x: x * x))) AS largo FROM c)
    SELECT id, round(list_sum(list_transform(z, lambda x: (x / largo) * (x / largo))), 6) AS norma, round(z[1] / sqrt(list_sum(list_transform(z, lambda x: x * x))), 6) AS primero,
      round(z[64] / sqrt(list_sum(list_transform(z, lambda x: x * x))), 6) AS ultimo FROM n"""))
def _(t):
    u = t.huellas.select("id", sim.unit(F.col("v")).alias("u"))
    return u.select(
        "id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norma"), F.round(F.element_at("u", 1), 6).alias("primero"),
        F.round(F.element_at("u", 64), 6).alias("ultimo"),
    )


_SIMILAR = _UNIT + """
    , q AS (SELECT label AS consulta, arg_min(z, id) AS z, arg_min(aspect, id) AS aspect FROM c GROUP BY 1),
      s AS (SELECT q.consulta, c.id, c.label, round(least(greatest(list_cosine_similarity(q.z, c.z), 0), 1) * (0.75 + 0.25 * least(q.aspect, c.aspect) / greatest(q.aspect, c.aspect)) * 100, 9) AS exacto
        FROM q CROSS JOIN c {where}),
      r AS (SELECT *, row_number() OVER (PARTITION BY consulta ORDER BY exacto DESC, id) AS rn FROM s)"""


def _prototypes(t):
    return t.huellas.groupBy("label").agg(F.min_by(F.struct("aspect", "v"), "id").alias("m")).select(F.col("label").alias("consulta"), "m.aspect", "m.v")


@query("v2_similar", w("huellas", _SIMILAR.replace("{where}", "") + " SELECT consulta, id, rn, round(exacto, 4) AS puntaje FROM r WHERE rn <= 24"))
def _(t):
    return sim.similar(_prototypes(t), t.huellas).select("consulta", "id", "rn", F.round("exacto", 4).alias("puntaje"))


@query("v2_similar_all", w("huellas", _UNIT + """
    , s AS (SELECT q.id AS consulta, c.id, round(least(greatest(list_cosine_similarity(q.z, c.z), 0), 1) * (0.75 + 0.25 * least(q.aspect, c.aspect) / greatest(q.aspect, c.aspect)) * 100, 9) AS exacto
        FROM c q CROSS JOIN c),
      r AS (SELECT *, row_number() OVER (PARTITION BY consulta ORDER BY exacto DESC, id) AS rn FROM s)
    SELECT consulta, id, rn, round(exacto, 4) AS puntaje FROM r WHERE rn <= 24"""))
def _(t):
    every = t.huellas.select(F.col("id").alias("consulta"), "aspect", "v")
    return sim.similar(every, t.huellas).select("consulta", "id", "rn", F.round("exacto", 4).alias("puntaje"))


@query("v3_search_similar", w("huellas propietarios", _SIMILAR.replace("{where}", "WHERE c.id % 3 <> 2 AND c.id % 2 = 0 AND c.id % 7 <> 0") + """
    SELECT r.consulta, r.rn, r.id, concat('M-', r.id) AS codigo, CASE WHEN r.id % 2 = 0 THEN 'dominante' ELSE 'complementaria' END AS tipo,
      CASE r.id % 3 WHEN 0 THEN 'activa' ELSE 'revisar' END AS estado, p.nombre AS propietario FROM r LEFT JOIN propietarios p ON p.id = r.id % 50 WHERE rn <= 24"""))
def _(t):
    h = t.huellas
    marks = h.selectExpr(
        "id", "concat('M-', CAST(id AS STRING)) AS codigo", "CASE WHEN id % 2 = 0 THEN 'dominante' ELSE 'complementaria' END AS tipo",
        "CASE id % 3 WHEN 0 THEN 'activa' WHEN 1 THEN 'revisar' ELSE 'baja' END AS estado", "id % 50 AS propietario_id", "id % 7 <> 0 AS activo",
        "aspect", "v",
    )
    return sim.search_similar(_prototypes(t), marks, t.propietarios, tipo="dominante").drop("puntaje")


@query("v4_backfill", w("documentos_emitidos", """
    , p AS (SELECT *, CASE WHEN tipo = 'guia' THEN 'ya' END AS huella, CASE WHEN operacion_id % 5 <> 0 THEN nombre END AS png FROM documentos_emitidos),
      t AS (SELECT id FROM p WHERE huella IS NULL AND png IS NOT NULL)
    SELECT id, CASE WHEN id IN (SELECT id FROM t) THEN CASE WHEN id % 4 = 0 THEN 'sin' ELSE md5(png) END ELSE huella END AS huella,
      CASE WHEN id IN (SELECT id FROM t) THEN CASE WHEN id % 4 = 0 THEN 'sin_tinta' ELSE 'calculada' END WHEN huella IS NULL AND png IS NOT NULL THEN 'pendiente' ELSE 'sin_cambio' END AS accion FROM p"""))
def _(t):
    d = t.documentos_emitidos.selectExpr("id", "CASE WHEN tipo = 'guia' THEN 'ya' END AS huella", "CASE WHEN operacion_id % 5 <> 0 THEN nombre END AS png")
    made = sim.backfill(d, lambda x: x.where("id % 4 <> 0").select("id", F.md5("png").alias("huella")), source="png", sentinel=F.lit("sin"))
    return made.select("id", "huella", "accion")


# --- files ------------------------------------------------------------------------------------
def _folder(t, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(t.spark)}/stampbook/{name}-{uuid.uuid4().hex}"


@query("r1_r2_delimited_sheet", """
    SELECT CAST(c_custkey AS STRING) AS codigo, c_name AS propietario, CAST(c_nationkey AS STRING) AS documento, concat('Ñandú; "', c_mktsegment, '"') AS establecimiento, 'Código' AS ignoradas FROM customer""")
def _(t):
    path = _folder(t, "sheet")
    c = t.raw("customer")
    c.select(
        F.col("c_custkey").alias("Nº de Marca"), F.col("c_name").alias("Nombre y Apellido / Razón Social"), F.col("c_nationkey").alias("CI/RUC"),
        F.concat(F.lit("Ñandú; \""), "c_mktsegment", F.lit("\"")).alias("Establecimiento"), F.lit("x").alias("Código"),
    ).unionByName(c.limit(1).select(*[F.lit(None).cast("string").alias(n) for n in ("Nº de Marca", "Nombre y Apellido / Razón Social", "CI/RUC", "Establecimiento", "Código")])).write.option("header", "true").option("sep", ";").option("encoding", "ISO-8859-1").option("escape", '"').csv(path)
    df, report = delimited.map_columns(delimited.read_delimited(t.spark, path))
    return df.withColumn("ignoradas", F.lit(",".join(report["ignoradas"])))


@query("r3_page_index", w("escaneos", "SELECT carpeta, archivo, orden, numero_guia, cantidad_animales, texto_ocr FROM escaneos WHERE formato IS NOT NULL"))
def _(t):
    path = _folder(t, "index")
    e = t.escaneos.withColumn("error", F.when(F.col("formato").isNull(), "no se pudo leer"))
    e.select("carpeta", "archivo", "orden", "formato", "numero_guia", "cantidad_animales", "texto_ocr", "error").write.json(path)
    return page_index.read_page_index(t.spark, path).select("carpeta", "archivo", "orden", "numero_guia", "cantidad_animales", "texto_ocr")


_DUMPED = {"operaciones": "id bigint, numero_guia string, revisar string, creado_en timestamp_ntz, activo boolean", "documentos_emitidos": "id bigint, nombre string, contenido binary"}


def _dumped(t):
    path = _folder(t, "dump")
    ops = t.operaciones.select("id", "numero_guia", "revisar", "creado_en", "activo", F.lit(1).alias("sobra"))
    docs = t.documentos_emitidos.select("id", "nombre", F.when(F.col("tipo") == "venta", F.encode("datos", "UTF-8")).alias("contenido"))
    manifest = snapshot.dump({"operaciones": ops, "documentos_emitidos": docs}, path, part_rows={"operaciones": 1000})
    return path, manifest


@query("r4_dump_manifest", "SELECT 'operaciones' AS tabla, count(*) AS filas FROM orders UNION ALL SELECT 'documentos_emitidos', count(*) FROM events")
def _(t):
    return _dumped(t)[1].select("tabla", "filas")


@query("r6_restore_operations", w("operaciones", "SELECT id, numero_guia, revisar, creado_en, activo FROM operaciones"))
def _(t):
    schemas = {"operaciones": T.StructType.fromDDL(_DUMPED["operaciones"])}
    return snapshot.restore(t.spark, _dumped(t)[0], schemas)[0]["operaciones"]


@query("r6_restore_documents", w("documentos_emitidos", "SELECT id, nombre, md5(datos) AS contenido FROM documentos_emitidos WHERE tipo = 'venta' AND id NOT IN (SELECT s_suppkey FROM supplier)"))
def _(t):
    schemas = {"documentos_emitidos": T.StructType.fromDDL(_DUMPED["documentos_emitidos"])}
    present = {"documentos_emitidos": t.usuarios.select("id")}
    docs = snapshot.restore(t.spark, _dumped(t)[0], schemas, existing=present, force=True)[0]["documentos_emitidos"]
    return docs.select("id", "nombre", F.md5("contenido").alias("contenido"))


@query("r6_restore_check", w("documentos_emitidos operaciones", """
    SELECT 'operaciones' AS tabla, count(*) AS esperado, count(*) AS leido, true AS coincide FROM operaciones
    UNION ALL SELECT 'documentos_emitidos', count(*), count(*) FILTER (WHERE tipo = 'venta'), false FROM documentos_emitidos"""))
def _(t):
    schemas = {n: T.StructType.fromDDL(d) for n, d in _DUMPED.items()}
    return snapshot.restore(t.spark, _dumped(t)[0], schemas)[1]


@query("r5_changed_only", """
    WITH h AS (SELECT doc_id, concat('doc/', doc_id) AS path, sha1(encode('blob ' || CAST(octet_length(encode(text)) AS STRING)) || '\\x00'::BLOB || encode(text)) AS sha FROM documents)
    SELECT path, sha, CASE WHEN doc_id % 3 = 0 THEN 'nuevo' ELSE 'cambiado' END AS accion FROM h WHERE doc_id % 3 <> 1""")
def _(t):
    d = t.raw("documents").select(F.col("doc_id").alias("k"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), snapshot.blob_sha(F.encode("text", "UTF-8")).alias("sha"))
    before = d.where("k % 3 <> 0").select("path", F.when(F.col("k") % 3 == 1, F.col("sha")).otherwise("viejo").alias("sha"))
    return snapshot.changed_only(d.drop("k"), before)


@query("r7_next_sequence", "SELECT max(o_orderkey * 97) AS ultimo_codigo, max(o_orderkey) AS ultimo_id FROM orders")
def _(t):
    from stampbook.functions.numbers import mark_code

    return snapshot.next_sequence(t.raw("orders").select(F.col("o_orderkey").alias("id"), mark_code(F.col("o_orderkey") * 97).alias("codigo")))


@query("r7_new_keys", """
    SELECT c_custkey AS id, c_custkey AS origen FROM customer WHERE c_acctbal >= 0
    UNION ALL SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY c_custkey), c_custkey FROM customer WHERE c_acctbal < 0""")
def _(t):
    c = t.raw("customer").selectExpr("c_custkey AS id", "c_custkey AS origen", "c_acctbal")
    start = snapshot.next_sequence(c, code=None).first()["ultimo_id"]
    return chg.with_new_ids(c, F.col("c_acctbal") < 0, start, ["origen"]).select("id", "origen")


@query("r8_export_operations", w("operaciones", """
    SELECT CASE tipo_operacion WHEN 'venta' THEN 'Venta' ELSE 'Compra' END AS "Tipo", numero_guia AS "N° de guía", fecha AS "Fecha", vendedor_nombre AS "Vendedor", vendedor_documento AS "Doc. vendedor",
      comprador_nombre AS "Comprador", comprador_documento AS "Doc. comprador", CAST(cantidad_animales AS STRING) AS "Cantidad", categoria_animales AS "Categoría", coalesce(revisar, '') AS "Revisar",
      CASE WHEN guia_colisionada THEN 'Sí' ELSE 'No' END AS "Colisiona", strftime(creado_en, '%d/%m/%Y %H:%M') AS "Creado en" FROM operaciones WHERE activo"""))
def _(t):
    return export.export_frame(export_operations(t.operaciones), export.OPERATION_HEADERS)


@query("r8_export_marks", w("marcas propietarios operaciones", """
    SELECT m.codigo AS "Código", CASE m.tipo WHEN 'dominante' THEN 'Dominante' ELSE 'Complementaria' END AS "Tipo", CASE m.estado WHEN 'activa' THEN 'Al día' WHEN 'revisar' THEN 'Revisar' ELSE 'De baja' END AS "Estado",
      CAST(vence_en AS STRING) AS "Vence", coalesce(p.nombre, '') AS "Propietario", coalesce(p.documento, '') AS "Documento", coalesce(o.numero_guia, '') AS "N° de guía", coalesce(o.fecha, '') AS "Fecha"
    FROM marcas m LEFT JOIN propietarios p ON p.id = m.propietario_id LEFT JOIN operaciones o ON o.id = m.operacion_id WHERE NOT m.activo"""))
def _(t):
    return export.export_frame(export_marks(t.marcas, t.propietarios, t.operaciones, hidden=True), export.MARK_HEADERS)


@query("r9_ingest_incremental", """
    SELECT 'salida' AS destino, doc_id, n_chars FROM documents WHERE lang <> 'es' UNION ALL SELECT 'errores', doc_id, NULL FROM documents WHERE lang = 'es'""")
def _(t):
    sink, dead = _folder(t, "sink"), _folder(t, "dead")
    d = t.raw("documents").select("doc_id", "n_chars", "lang")

    def work(df):
        return df.withColumn("error", F.when(F.col("lang") == "es", "sin texto")).drop("lang")

    ingest.ingest_incremental(d.where("lang = 'en' OR lang = 'es'"), sink, ["doc_id"], work, dead)
    ingest.ingest_incremental(d.where("lang <> 'es'"), sink, ["doc_id"], work, dead)
    done, failed = ingest.loaded(t.spark, sink), ingest.Batches(t.spark, sink).read("errors")
    return done.select(F.lit("salida").alias("destino"), "doc_id", "n_chars").unionByName(
        failed.select(F.lit("errores").alias("destino"), "doc_id", F.lit(None).cast("long").alias("n_chars"))
    )


@query("w1_stream_ingest", """
    SELECT CAST(user_id AS STRING) AS carpeta, event_type AS archivo, max(event_id) AS orden, arg_max(value, event_id) AS valor FROM events WHERE value <= 20 OR event_type <> 'error' GROUP BY 1, 2""")
def _(t):
    src, sink = _folder(t, "stream-in"), _folder(t, "stream-out")
    schema = T.StructType.fromDDL("carpeta string, archivo string, orden bigint, valor double, error string")
    t.raw("events").selectExpr(
        "CAST(user_id AS STRING) AS carpeta", "event_type AS archivo", "event_id AS orden", "value AS valor",
        "CASE WHEN value > 20 AND event_type = 'error' THEN 'ilegible' END AS error",
    ).write.json(src)
    stream.stream_ingest(t.spark, src, schema, sink, _folder(t, "stream-checkpoint"), _folder(t, "stream-dead")).awaitTermination()
    return stream.ingested(t.spark, sink).select("carpeta", "archivo", "orden", "valor")


@query("w1_compacted", """
    SELECT CAST(user_id AS STRING) AS carpeta, event_type AS archivo, max(event_id) AS orden, arg_max(value, event_id) AS valor FROM events GROUP BY 1, 2""")
def _(t):
    src, sink = _folder(t, "stream-in"), _folder(t, "stream-out")
    schema = T.StructType.fromDDL("carpeta string, archivo string, orden bigint, valor double, error string")
    rows = t.raw("events").selectExpr("CAST(user_id AS STRING) AS carpeta", "event_type AS archivo", "event_id AS orden", "value AS valor", "CAST(NULL AS STRING) AS error")
    places = [_folder(t, "stream-checkpoint"), _folder(t, "stream-dead")]
    quarters = rows.agg(F.percentile("orden", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)]))).first()[0]
    for k in range(4):  # every quarter of the events is a run of its own; compactions between and after them
        low, high = ([-1.0, *quarters][k], [*quarters, 1e300][k])
        rows.where((F.col("orden") > low) & (F.col("orden") <= high)).write.mode("append").json(src)
        stream.stream_ingest(t.spark, src, schema, sink, *places).awaitTermination()
        if k % 2:
            stream.compact(t.spark, sink)
    return stream.ingested(t.spark, sink).select("carpeta", "archivo", "orden", "valor")


@query("u11_delete_marks", w("marcas", """
    SELECT id FROM marcas WHERE estado <> 'baja'"""))
def _(t):
    none = t.marcas.select(F.col("id").alias("marca_id"), F.lit("x").alias("archivo_png"))
    return chg.delete_marks(t.marcas.where("estado = 'baja'").select("id"), t.marcas, none)[0].select("id")
