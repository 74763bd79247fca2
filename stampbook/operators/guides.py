"""Guides as consolidated views of the pages that carry their number."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stampbook.operators.filters import contains_text, text_search, visible
from stampbook.operators.ordering import Key, packed, ranked
from stampbook.operators.paging import Page, in_order, paginate
from stampbook.operators.relations import groups_matching
from stampbook.schemas import CERTIFICADO, FORMATOS, PAGE_SIZES

PAGE_TEXT = ["numero_guia", "propietario", "propietario_documento", "numero_certificado", "texto_ocr", "etiqueta"]


def pick_first(column: str, fmt: str = "formato", key: str = "id", preferred: str = CERTIFICADO) -> Column:
    """First non-null value; rows without a format come first, then the preferred format, then the rest, by id."""
    rank = F.when(F.col(fmt).isNull(), 0).when(F.col(fmt) == preferred, 1).otherwise(2)
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.struct(rank.alias("r"), F.col(key).alias("k"))))


def pick_first_filled(column: str, fmt: str = "formato", key: str = "id", preferred: str = CERTIFICADO) -> Column:
    """First non-empty value; the preferred format first, everything else (no format included) by id."""
    rank = F.when(F.col(fmt) == preferred, 0).otherwise(1)
    value = F.nullif(F.col(column).cast("string"), F.lit(""))
    return F.min_by(F.col(column), F.when(value.isNotNull(), F.struct(rank.alias("r"), F.col(key).alias("k"))))


def page_filter(text: str | None, formato: str | None, carpeta: int | None) -> Column:
    cond = F.lit(True)
    if (text or "").strip():
        cond = cond & contains_text(text, PAGE_TEXT)
    if formato in FORMATOS:
        cond = cond & (F.col("formato") == formato)
    if carpeta in (1, 2):
        cond = cond & (F.col("carpeta_n") == carpeta)
    return cond


def consolidate_guides(pages: DataFrame) -> DataFrame:
    """One row per number. Every aggregate combines before the shuffle and holds a bounded state: the set of formats is
    limited by the format list, and the page list itself is a frame of its own (:func:`guide_pages`)."""
    return (
        pages.where(F.col("numero_guia").isNotNull()).groupBy("numero_guia").agg(
            F.count(F.lit(1)).alias("paginas"),
            F.array_sort(F.collect_set(F.coalesce("formato", F.lit("")))).alias("formatos"),
            pick_first("propietario").alias("propietario"),
            pick_first("propietario_documento").alias("documento"),
            F.max("cantidad_animales").alias("cantidad_animales"),
            F.min("fecha_texto").alias("fecha_texto"),
            F.every("revisado").alias("revisada"),
            F.min("orden").alias("orden"),
            F.min(F.struct("orden", "id"))["id"].alias("primera_pagina"),
        )
        .withColumn("formatos", F.transform("formatos", lambda f: F.nullif(f, F.lit(""))))
    )


def guide_pages(pages: DataFrame) -> DataFrame:
    """The ordered page ids of every guide in long form: (numero_guia, posicion, id)."""
    numbered = pages.where(F.col("numero_guia").isNotNull()).select("numero_guia", "orden", "id")
    return ranked(numbered, ["numero_guia"], ["orden", "id"], "posicion").select("numero_guia", "posicion", "id")


def marks_per_guide(guides: DataFrame, pages: DataFrame, marks: DataFrame) -> DataFrame:
    """``guides`` with the number of visible, not retired marks taken from their pages.

    Marks are counted per page before they meet the pages, so a guide or page with very many marks shuffles one row per
    map task.
    """
    per_page = (
        visible(marks).where((F.col("estado") != "baja") & F.col("escaneo_id").isNotNull())
        .groupBy(F.col("escaneo_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"))
    )
    per_guide = (
        pages.select("id", "numero_guia").join(guides.select("numero_guia"), "numero_guia", "left_semi").join(per_page, "id", "inner")
        .groupBy("numero_guia").agg(F.sum("_n").alias("_marcas"))
    )
    return guides.join(per_guide, "numero_guia", "left").withColumn("marcas", F.coalesce("_marcas", F.lit(0))).drop("_marcas")


def list_guides_page(
    pages: DataFrame, marks: DataFrame, text: str | None = None, formato: str | None = None, carpeta: int | None = None,
    page: int = 1, size: int = PAGE_SIZES["guias"],
) -> Page:
    """One page of :func:`list_guides`: its numbers are cut first, and only their pages are consolidated."""
    hit = page_filter(text, formato, carpeta)
    numbers = pages.where(F.col("numero_guia").isNotNull() & hit).select("numero_guia").distinct()
    found = paginate(numbers, ["numero_guia"], page, size, clamp=False)
    shown = pages.join(F.broadcast(found.rows), "numero_guia", "left_semi")  # size numbers
    return replace(found, rows=in_order(marks_per_guide(consolidate_guides(shown), shown, marks), "numero_guia"))


def list_guides(
    pages: DataFrame, marks: DataFrame, text: str | None = None, formato: str | None = None, carpeta: int | None = None
) -> DataFrame:
    """Consolidated guides; a guide with one matching page is shown whole."""
    filtered = (text or "").strip() or formato in FORMATOS or carpeta in (1, 2)
    chosen = groups_matching(pages, page_filter(text, formato, carpeta)) if filtered else pages
    return marks_per_guide(consolidate_guides(chosen), pages, marks)


def guide_listing_page(found: DataFrame, page: int = 1, size: int = PAGE_SIZES["guias"]) -> Page:
    return paginate(found, ["numero_guia"], page, size, clamp=False)


def unnumbered_pages(pages: DataFrame, text: str | None = None, carpeta: int | None = None) -> DataFrame:
    found = text_search(pages.where(F.col("numero_guia").isNull()), text, PAGE_TEXT)
    return found.where(F.col("carpeta_n") == carpeta) if carpeta in (1, 2) else found


SCAN_ORDER = [Key("carpeta_n"), Key("parte", nulls_first=True), Key("pagina_n"), Key("id")]


def unnumbered_listing_page(found: DataFrame, page: int = 1, size: int = PAGE_SIZES["sin_numero"]) -> Page:
    return paginate(found, SCAN_ORDER, page, size, clamp=False)


def guide_detail(pages: DataFrame, marks: DataFrame, ops: DataFrame) -> dict[str, DataFrame]:
    """The detail of every guide in ``pages`` as frames keyed by ``numero_guia``.

    ``guia`` holds the consolidated fields; ``paginas``, ``marcas``, ``operaciones`` and ``certificados`` are its lists in
    long form, so that no list has to fit one row.
    """
    numbered = pages.where(F.col("numero_guia").isNotNull())
    has = F.col("respaldo").isNotNull() if "respaldo" in pages.columns else F.lit(False)
    citation = F.min_by("respaldo", F.when(has, F.col("id"))) if "respaldo" in pages.columns else F.lit(None)
    header = numbered.groupBy("numero_guia").agg(
        pick_first_filled("propietario").alias("propietario"),
        pick_first_filled("propietario_documento").alias("documento"),
        pick_first_filled("establecimiento").alias("establecimiento"),
        F.nullif(F.max(F.coalesce("cantidad_animales", F.lit(0))), F.lit(0)).alias("cantidad_animales"),
        pick_first_filled("fecha_texto").alias("fecha_texto"),
        citation.alias("respaldo"),
    )
    numbers = numbered.select(F.col("id").alias("escaneo_id"), "numero_guia")
    shown = visible(marks).select("id", "codigo", "tipo", "estado", "posicion", "escaneo_id", F.col("archivo_png").isNotNull().alias("archivo_png"))
    certificates = numbered.where(F.coalesce(F.col("numero_certificado") != "", F.lit(False)))
    return {
        "guia": header,
        "paginas": ranked(numbered, ["numero_guia"], SCAN_ORDER, "posicion_lectura"),
        "marcas": shown.join(numbers, "escaneo_id", "inner"),
        "operaciones": visible(ops).select("id", "numero_guia", "tipo_operacion", "fecha", "vendedor_nombre", "comprador_nombre")
        .join(numbered.select("numero_guia").distinct(), "numero_guia", "left_semi"),
        "certificados": certificates.select("numero_guia", "numero_certificado").distinct(),
    }


def cited_facts(cited: DataFrame, pages: DataFrame, ops: DataFrame) -> DataFrame:
    """Pages, first page and number of operations of each cited number."""
    numbers = cited.where(F.col("cod") == "G").select(F.col("numero").alias("numero_guia")).distinct()
    p = pages.select("numero_guia", "id").join(numbers, "numero_guia", "left_semi")
    p = p.groupBy("numero_guia").agg(F.count(F.lit(1)).alias("paginas"), F.min("id").alias("primer_escaneo"))
    o = visible(ops).select("numero_guia", "id").join(numbers, "numero_guia", "left_semi").groupBy("numero_guia").agg(F.count(F.lit(1)).alias("operaciones"), F.min("id").alias("primera_operacion"))
    return (
        numbers.join(p, "numero_guia", "left").join(o, "numero_guia", "left")
        .select(
            "numero_guia", F.coalesce("paginas", F.lit(0)).alias("paginas"), "primer_escaneo",
            F.coalesce("operaciones", F.lit(0)).alias("operaciones"), "primera_operacion",
        )
    )


def cited_operations(cited: DataFrame, ops: DataFrame) -> DataFrame:
    """The ids of the operations of every cited number, in order, in long form: (numero_guia, posicion, operacion_id)."""
    numbers = cited.where(F.col("cod") == "G").select(F.col("numero").alias("numero_guia")).distinct()
    found = visible(ops).select("numero_guia", F.col("id").alias("operacion_id")).join(numbers, "numero_guia", "left_semi")
    return ranked(found, ["numero_guia"], ["operacion_id"], "posicion").select("numero_guia", "posicion", "operacion_id")


def operation_manifest(ops: DataFrame, marks: DataFrame, list_size: int = 1_000) -> DataFrame:
    """File name and nested marks of every operation that has marks. A list longer than ``list_size`` continues on
    further rows (``parte`` 0, 1, …)."""
    item = F.struct("id", "codigo", "tipo")
    lists = packed(
        marks.where(F.col("operacion_id").isNotNull()).select("operacion_id", "id", "codigo", "tipo"),
        ["operacion_id"], ["id"], item, list_size, "marcas",
    )
    number = F.replace(F.coalesce(F.nullif(F.col("numero_guia"), F.lit("")), F.lit("SIN-NUMERO")), F.lit("/"), F.lit("-"))
    named = ops.select(
        F.col("id").alias("operacion_id"), "numero_guia", F.format_string("OP-%04d_%s.pdf", "id", number).alias("archivo")
    )
    return named.join(lists, "operacion_id", "inner").select("archivo", "operacion_id", "numero_guia", "parte", "marcas")
