"""Spreadsheet-ready frames: labels instead of codes, renamed headers, local time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stampbook.functions.text import LOCAL_ZONE

# --- fixed values: labels and headers of the exports ------------------------------------------
LABELS = {
    "tipo_operacion": {"compra": "Compra", "venta": "Venta"},
    "tipo": {"dominante": "Dominante", "complementaria": "Complementaria"},
    "estado": {"activa": "Al día", "revisar": "Revisar", "baja": "De baja"},
}
OPERATION_HEADERS = {
    "tipo_operacion": "Tipo", "numero_guia": "N° de guía", "fecha": "Fecha", "vendedor_nombre": "Vendedor",
    "vendedor_documento": "Doc. vendedor", "comprador_nombre": "Comprador", "comprador_documento": "Doc. comprador",
    "cantidad_animales": "Cantidad", "categoria_animales": "Categoría", "revisar": "Revisar",
    "guia_colisionada": "Colisiona", "creado_en": "Creado en",
}
MARK_HEADERS = {
    "codigo": "Código", "tipo": "Tipo", "estado": "Estado", "vence_en": "Vence", "propietarios.nombre": "Propietario",
    "propietarios.documento": "Documento", "operaciones.numero_guia": "N° de guía", "operaciones.fecha": "Fecha",
}


def _label(c: Column, table: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), c)


def export_frame(df: DataFrame, headers: dict[str, str], labels: dict = LABELS, zone: str | None = None) -> DataFrame:
    """Columns in header order as text: enums by label, booleans as Sí/No, missing as ''.

    Timestamps lose their zone; with ``zone`` they are shown in that local time first.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.select(*[F.col(c).alias(c) for c in headers]).schema.fields}
    out = []
    for name, header in headers.items():
        c = F.col(name)
        if name in labels:
            c = _label(c, labels[name])
        elif kinds[name] == "boolean":
            c = F.when(c, "Sí").otherwise("No")
        elif kinds[name].startswith("timestamp"):
            c = F.date_format(F.from_utc_timestamp(c, zone) if zone else c, "dd/MM/yyyy HH:mm")
        out.append(F.coalesce(c.cast("string"), F.lit("")).alias(header))
    return df.select(*out)


def write_export(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", "true").option("emptyValue", "").csv(path)


__all__ = ["LABELS", "LOCAL_ZONE", "MARK_HEADERS", "OPERATION_HEADERS", "export_frame", "write_export"]
