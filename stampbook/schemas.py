"""Fixed values and table schemas of the registry data model.

Timestamps are UTC; enum and column names are data, so they keep the registry's own spelling.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------------------------
ESTADOS = ("activa", "revisar", "baja")
TIPOS = ("dominante", "complementaria")
TIPOS_OPERACION = ("compra", "venta")
TIPOS_DOCUMENTO = ("guia", "venta")
PRINCIPAL = "GE2_PRINCIPAL"
ANEXO = "GE2_ANEXO"
CERTIFICADO = "SENACSA_CERTIFICADO"
FORMATOS = (
    "GE2_PRINCIPAL",
    "GE2_ANEXO",
    "SENACSA_CERTIFICADO",
    "CIEFA_GO2",
    "ACTA_INTERVENCION_COLCAT",
    "NOTA_REMISION",
    "LOGISTICA_SIN_MARCAS",
    "DESCONOCIDO",
)
PREFIJO_NO_MARCA = "no_es_marca:"
COPIAS = ("Original", "Duplicado", "Triplicado", "Cuadruplicado")
PREFIJOS_CONOCIDOS = ("10", "90", "91", "80")

# rows per page of each listing
PAGE_SIZES = {
    "marcas": 40,
    "operaciones": 40,
    "propietarios": 40,
    "archivo": 30,
    "guias": 24,
    "sin_numero": 36,
    "revision": 48,
    "busqueda_rapida": 15,
    "exportar": 1000,
}

_TYPES = {
    "string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "binary": T.BinaryType(), "timestamp": T.TimestampType(), "date": T.DateType(),
    "points": T.ArrayType(T.ArrayType(T.DoubleType())),
}


def _struct(columns: str) -> T.StructType:
    """Schema from "name type, name type"; needs no running session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (c.split() for c in columns.split(","))])


# --- tables -----------------------------------------------------------------------------------
PROPIETARIOS = _struct(
    "id bigint, nombre string, documento string, establecimiento string, establecimiento_codigo string,"
    " localidad string, departamento string, telefono string, activo boolean, creado_en timestamp"
)
OPERACIONES = _struct(
    "id bigint, numero_guia string, fecha string, vendedor_nombre string, vendedor_documento string,"
    " vendedor_establecimiento string, vendedor_establecimiento_codigo string, comprador_nombre string,"
    " comprador_documento string, cantidad_animales int, categoria_animales string,"
    " categoria_animales_original string, tipo_formulario string, guia_colisionada boolean, revisar string,"
    " origen string, origen_id bigint, creado_por string, creado_en timestamp, tipo_operacion string,"
    " activo boolean, monto_total bigint"
)
MARCAS = _struct(
    "id bigint, codigo string, descripcion string, propietario_id bigint, operacion_id bigint, tipo string,"
    " posicion string, numero_guia string, origen_archivo string, archivo_png binary, archivo_svg binary,"
    " sospechosa_calidad boolean, motivo_calidad string, estado string, observaciones string,"
    " creado_por string, actualizado_por string, creado_en timestamp, actualizado_en timestamp, vence_en date,"
    " activo boolean, escaneo_id bigint, huella binary, origen_carpeta string, origen_pagina string,"
    " origen_etiqueta string"
)
OCR_LINE = _struct("texto string, caja points, conf double")
CITATION = _struct("cod string, numero string, fecha string")
PAGINAS = _struct(
    "carpeta string, archivo string, orden int, formato string, numero_guia string, fuente_numero string,"
    " conf_numero double, numero_certificado string, propietario string, propietario_documento string,"
    " establecimiento string, cantidad_animales int, fecha_texto string, n_marcas int, texto_ocr string,"
    " ancho int, alto int, imagen string, miniatura string, error string"
)
