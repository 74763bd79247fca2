"""Registry tables as views over the given tables.

Every column is one SQL expression that Spark and the checking engine both understand, so a binding is written once and
only the operator under test differs between the two sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_LINE = (
    "concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-',"
    " CAST(l_suppkey AS STRING), '-', CAST(CAST(l_quantity AS BIGINT) AS STRING))"
)
_GUIDE = "CAST(90000000 + (o_orderkey - o_orderkey % 2) * 125 AS STRING)"
_PAGE_GUIDE = "CAST(90000000 + CAST(floor(doc_id / 4) AS BIGINT) * 250 AS STRING)"

BINDINGS: dict[str, tuple[str, dict[str, str]]] = {
    "marcas": (
        "lineitem",
        {
            "id": _LINE,
            "codigo": f"concat('M-', {_LINE})",
            "operacion_id": "l_orderkey",
            "propietario_id": "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_suppkey END",
            "escaneo_id": "CASE WHEN l_linenumber = 6 THEN NULL ELSE l_partkey END",
            "estado": "CASE l_returnflag WHEN 'A' THEN 'activa' WHEN 'R' THEN 'revisar' ELSE 'baja' END",
            "tipo": "CASE l_linestatus WHEN 'O' THEN 'dominante' ELSE 'complementaria' END",
            "activo": "l_quantity >= 5",
            "posicion": "concat('casilla ', CAST(l_linenumber AS STRING))",
            "motivo_calidad": (
                "CASE WHEN l_returnflag = 'A' THEN NULL WHEN l_linenumber = 1 THEN 'borde cortado (arriba)' ELSE"
                " concat('no_es_marca:tipo_', CAST(l_linenumber AS STRING), ' (', CAST(l_suppkey AS STRING), ')') END"
            ),
            "sospechosa_calidad": "l_returnflag = 'R'",
            "archivo_png": "CASE WHEN l_tax > 0 THEN 'png' WHEN l_tax = 0 AND l_linenumber = 2 THEN '' ELSE NULL END",
            "archivo_svg": "CASE WHEN l_discount > 0.05 THEN 'svg' ELSE NULL END",
            "vence_en": "CAST(l_shipdate AS DATE)",
            "origen_archivo": f"concat({_LINE}, '.png')",
            "origen_carpeta": "concat('src', CAST(l_partkey % 20 AS STRING))",
            "origen_pagina": "concat('p', CAST(l_partkey AS STRING), '.jpg')",
            "origen_carpeta_n": "CAST(l_linenumber % 3 AS INT)",
            "origen_etiqueta": "concat('Carpeta ', CAST(l_linenumber % 3 AS STRING), ' · pág. ', CAST(l_partkey AS STRING))",
            "sha1": "concat('h', CAST(l_partkey AS STRING), '-', CAST(l_linenumber AS STRING))",
            "descripcion": "concat('marca de ', CAST(l_suppkey AS STRING))",
        },
    ),
    "operaciones": (
        "orders",
        {
            "id": "o_orderkey",
            "numero_guia": _GUIDE,
            "tipo_operacion": "CASE o_orderstatus WHEN 'O' THEN 'venta' ELSE 'compra' END",
            "guia_colisionada": "o_orderstatus = 'P'",
            "revisar": "CASE o_orderpriority WHEN '1-URGENT' THEN 'falta fecha' WHEN '2-HIGH' THEN '' ELSE NULL END",
            "activo": "o_orderpriority <> '5-LOW'",
            "creado_en": "o_orderdate",
            "fecha": (
                "concat(lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), '/', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'),"
                " '/', CAST(year(o_orderdate) AS STRING))"
            ),
            "vendedor_documento": "CAST(o_custkey AS STRING)",
            "comprador_documento": "CAST((o_custkey * 7 + 3) % 997 AS STRING)",
            "vendedor_nombre": "concat('Customer#', lpad(CAST(o_custkey AS STRING), 9, '0'))",
            "comprador_nombre": "concat('Customer#', lpad(CAST((o_custkey * 7 + 3) % 997 AS STRING), 9, '0'))",
            "cantidad_animales": "CAST(floor(o_totalprice / 1000) AS INT)",
            "categoria_animales": "o_orderpriority",
        },
    ),
    "propietarios": (
        "customer",
        {
            "id": "c_custkey",
            "nombre": "c_name",
            "documento": "CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE CAST(c_custkey AS STRING) END",
            "establecimiento": "c_mktsegment",
            "activo": "c_acctbal >= 0",
            "localidad": "concat('L', CAST(c_nationkey AS STRING))",
            "departamento": "CAST(NULL AS STRING)",
        },
    ),
    "usuarios": ("supplier", {"id": "s_suppkey", "nombre": "s_name"}),
    "escaneos": (
        "documents",
        {
            "id": "doc_id",
            "carpeta": "source",
            "archivo": "concat('p', CAST(doc_id AS STRING), '.jpg')",
            "orden": "CAST(floor(doc_id / 2) AS BIGINT)",
            "formato": (
                "CASE lang WHEN 'en' THEN 'GE2_PRINCIPAL' WHEN 'fr' THEN 'GE2_ANEXO' WHEN 'de' THEN 'SENACSA_CERTIFICADO'"
                " ELSE NULL END"
            ),
            "numero_guia": f"CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 50 = 1 THEN '123' ELSE {_PAGE_GUIDE} END",
            "fuente_numero": "CASE WHEN doc_id % 7 = 0 THEN 'manual' WHEN doc_id % 5 = 0 THEN 'inferido:anexo' ELSE 'ocr' END",
            "conf_numero": "CAST(doc_id % 10 AS DOUBLE) / 10",
            "numero_certificado": (
                "CASE WHEN doc_id % 2 = 0 THEN CAST(10000000000000 + CAST(floor(doc_id / 8) AS BIGINT) AS STRING) ELSE NULL END"
            ),
            "propietario": (
                "CASE WHEN doc_id % 4 = 1 THEN NULL WHEN doc_id % 11 = 0 THEN '' ELSE concat('Estancia ', source) END"
            ),
            "propietario_documento": "CASE WHEN doc_id % 5 = 2 THEN NULL ELSE CAST(n_chars AS STRING) END",
            "establecimiento": "CASE WHEN doc_id % 6 = 0 THEN '' ELSE concat('Campo ', CAST(doc_id % 13 AS STRING)) END",
            "cantidad_animales": "CASE WHEN doc_id % 8 = 0 THEN NULL ELSE n_chars END",
            "fecha_texto": (
                "concat(lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0'), '/', lpad(CAST(doc_id % 12 + 1 AS STRING), 2, '0'),"
                " '/2024')"
            ),
            "n_marcas": "doc_id % 4",
            "texto_ocr": (
                f"concat(text, chr(10), 'GE2 ', CAST(90000000 + CAST(floor(doc_id / 4) AS BIGINT) * 250"
                " + CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END AS STRING), ' ', CAST(90000000 + doc_id * 125 AS STRING))"
            ),
            "revisado": "doc_id % 5 = 0",
            "carpeta_n": "CAST(nullif(doc_id % 3, 0) AS INT)",
            "parte": "CAST(nullif(doc_id % 4, 3) AS INT)",
            "pagina_n": "doc_id % 100",
            "etiqueta": "concat('Carpeta ', source, ' · pág. ', CAST(doc_id AS STRING))",
            "imagen": "concat('img/', CAST(doc_id AS STRING))",
        },
    ),
    "documentos_emitidos": (
        "events",
        {
            "id": "event_id",
            "operacion_id": "user_id",
            "tipo": "CASE WHEN event_type IN ('purchase', 'view') THEN 'guia' ELSE 'venta' END",
            "numero_guia": "CAST(90000000 + user_id * 250 AS STRING)",
            "emitido_en": "ts",
            "emitido_por": "user_id % 10",
            "nombre": "concat('doc_', CAST(event_id AS STRING), '.pdf')",
            "datos": (
                "concat('{\"vendedor_nombre\":\"Vendedor ', CAST(user_id AS STRING), '\",\"comprador_nombre\":\"', event_type,"
                " '\",\"props\":', props, '}')"
            ),
            "marcas": (
                "CASE event_id % 3 WHEN 0 THEN '[]' WHEN 1 THEN '[{\"codigo\":\"A\"}]'"
                " ELSE '[{\"codigo\":\"A\"},{\"codigo\":\"B\"}]' END"
            ),
            "respaldo": (
                "concat('[{\"cod\":\"G\",\"numero\":\"', CAST(90000000 + user_id * 250 AS STRING),"
                " '\",\"fecha\":\"27/01/2025\"},{\"cod\":\"B\",\"numero\":\"ACX', CAST(event_id AS STRING), '\",\"fecha\":null}]')"
            ),
        },
    ),
    "secuencia": (
        "conversations",
        {
            "carpeta": "CAST(conv_id AS STRING)",
            "archivo": "lpad(CAST(turn AS STRING), 6, '0')",
            "orden": "turn",
            "formato": "CASE role WHEN 'user' THEN 'GE2_PRINCIPAL' WHEN 'assistant' THEN 'GE2_ANEXO' ELSE 'CIEFA_GO2' END",
            "numero_guia": (
                "CASE WHEN (conv_id + turn) % 3 <> 0 THEN NULL"
                " ELSE CAST(90000000 + conv_id * 10 + CAST(floor(turn / 6) AS BIGINT) AS STRING) END"
            ),
            "fuente_numero": "CASE WHEN (conv_id + turn) % 3 <> 0 THEN NULL ELSE 'ocr' END",
            "conf_numero": "CAST(0.9 AS DOUBLE)",
        },
    ),
    "huellas": (
        "embeddings",
        {"id": "vec_id", "aspect": "0.5 + label / 10.0", "v": "embedding", "label": "label"},
    ),
    "archivos": (
        "pages",
        {
            "path": "concat(regexp_extract(url, '://([^/]+)', 1), '/', CAST(page_id AS STRING), '_', regexp_extract(url, '([^/]*)$', 1))",
            "bytes": "length(html)",
        },
    ),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bound(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A registry table over the given tables."""
    source, columns = BINDINGS[name]
    return table(spark, folder, source).selectExpr(*[f"{expr} AS {col}" for col, expr in columns.items()])


def with_bindings(names: str, body: str) -> str:
    """SQL text of ``body`` preceded by the named registry tables."""
    ctes = []
    for name in names.split():
        source, columns = BINDINGS[name]
        cols = ", ".join(f"{expr} AS {col}" for col, expr in columns.items())
        ctes.append(f"{name} AS (SELECT {cols} FROM {source})")
    return f"WITH {', '.join(ctes)} {body.strip()}"
