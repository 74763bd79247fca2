"""Joins of marks, owners, operations and pages. Dimension sides carry no broadcast hint: adaptive execution measures
them and broadcasts only what is small, and splits skewed partitions otherwise."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stampbook.functions.text import slug
from stampbook.operators.filters import (
    MARK_FACETS, OPERATION_FACETS, archive_search, between_days, by_keys, contains_text, facets, operation_status,
    reason_prefix, text_search, visible,
)
from stampbook.operators.ordering import Key, lookup, null_safe_join, ranked, sorts
from stampbook.operators.paging import Page, in_order, paginate
from stampbook.schemas import PAGE_SIZES


def with_relations(marks: DataFrame, owners: DataFrame, ops: DataFrame) -> DataFrame:
    """Marks with ``propietarios`` and ``operaciones`` nested as a struct, null when there is no relation."""
    p = owners.select(F.col("id").alias("propietario_id"), F.struct("nombre", "documento").alias("propietarios"))
    o = ops.select(F.col("id").alias("operacion_id"), F.struct("numero_guia", "fecha").alias("operaciones"))
    return lookup(lookup(marks, p, "propietario_id", "codigo"), o, "operacion_id", "codigo")


def matching_marks(
    marks: DataFrame, owners: DataFrame, ops: DataFrame, pages: DataFrame | None = None, text: str | None = None,
    estado: str | None = None, tipo: str | None = None, hidden: bool = False, motivo: str | None = None,
    sin_baja: bool = False, carpeta: int | None = None, ids=None,
) -> DataFrame:
    """Filtered marks; the free text also matches the owner, the operation and the page number.

    Each relation is reduced to the ids that hold the text, so only those meet the marks. Without ``pages`` the page number
    and the origin label are left out of the search, as exports do.
    """
    found = facets(visible(marks, hidden), MARK_FACETS, estado=estado, tipo=tipo, carpeta=carpeta)
    found = by_keys(reason_prefix(found, motivo), "id", ids)
    if sin_baja:
        found = found.where(F.col("estado") != "baja")
    if not (text or "").strip():
        return found
    hit = contains_text(text, ["codigo"] if pages is None else ["codigo", "origen_etiqueta"])
    related = [("propietario_id", owners, ["nombre", "documento"]), ("operacion_id", ops, ["numero_guia"])]
    if pages is not None:
        related.append(("escaneo_id", pages, ["numero_guia"]))
    flags = []
    for key, side, cols in related:
        held = side.where(contains_text(text, cols)).select(F.col("id").alias(key), F.lit(True).alias(f"_by_{key}"))
        found = lookup(found, held, key, "codigo")
        flags.append(f"_by_{key}")
        hit = hit | F.coalesce(f"_by_{key}", F.lit(False))
    return found.where(hit).drop(*flags)


def search_marks(marks: DataFrame, owners: DataFrame, ops: DataFrame, pages: DataFrame | None = None, **filters) -> DataFrame:
    """The marks of :func:`matching_marks` with their relations."""
    return with_relations(matching_marks(marks, owners, ops, pages, **filters), owners, ops)


def search_marks_page(
    marks: DataFrame, owners: DataFrame, ops: DataFrame, pages: DataFrame | None = None, page: int = 1,
    size: int = PAGE_SIZES["marcas"], **filters,
) -> Page:
    """One page of the search: its codes are cut first, and only their marks are read whole and meet their relations."""
    found = mark_page(matching_marks(marks, owners, ops, pages, **filters).select("codigo"), page, size)
    codes = found.rows.distinct()  # size rows
    few = null_safe_join(marks, F.broadcast(codes), ["codigo"], "left_semi")
    rows = matching_marks(few, owners, ops, pages, **filters).orderBy(*sorts(["codigo"])).limit(size)
    return replace(found, rows=in_order(with_relations(rows, owners, ops), "codigo"))


def mark_page(found: DataFrame, page: int = 1, size: int = PAGE_SIZES["marcas"]) -> Page:
    return paginate(found, ["codigo"], page, size)


def list_operations(
    ops: DataFrame, text: str | None = None, estado: str | None = None, lo: str | None = None, hi: str | None = None,
    tipo_operacion: str | None = None, hidden: bool = False, ids=None, strict: bool = False,
) -> DataFrame:
    found = by_keys(facets(visible(ops, hidden), OPERATION_FACETS, tipo_operacion=tipo_operacion), "id", ids)
    found = between_days(operation_status(found, estado), "creado_en", lo, hi, strict=strict)
    return text_search(found, text, ["numero_guia", "vendedor_nombre", "comprador_nombre"])


NEWEST = [Key("creado_en", desc=True), Key("id", desc=True)]


def operation_page(found: DataFrame, page: int = 1, size: int = PAGE_SIZES["operaciones"]) -> Page:
    return paginate(found, NEWEST, page, size)


def list_owners(owners: DataFrame, text: str | None = None, hidden: bool = False) -> DataFrame:
    return text_search(visible(owners, hidden), text, ["nombre", "documento", "establecimiento"])


def owner_page(found: DataFrame, page: int = 1, size: int = PAGE_SIZES["propietarios"]) -> Page:
    return paginate(found, [Key("nombre"), Key("id")], page, size)


def archive_page(docs: DataFrame, users: DataFrame, page: int = 1, **filters) -> Page:
    order = [Key("emitido_en", desc=True), Key("id", desc=True)]
    return paginate(archive_search(docs, users, **filters), order, page, PAGE_SIZES["archivo"])


def marks_of(marks: DataFrame, column: str, parents: DataFrame, hidden_too: bool = False) -> DataFrame:
    """Marks of the given operations or owners (``parents`` holds ``column``); sort by the parent, ``tipo``, ``posicion``."""
    shown = marks if hidden_too else visible(marks)
    return shown.join(parents.select(column).distinct(), column, "left_semi")


def export_operations(ops: DataFrame, **filters) -> DataFrame:
    return list_operations(ops, strict=True, **filters).select(
        "numero_guia", "fecha", "vendedor_nombre", "vendedor_documento", "comprador_nombre", "comprador_documento",
        "cantidad_animales", "categoria_animales", "revisar", "guia_colisionada", "creado_en", "tipo_operacion",
    )


def export_marks(marks: DataFrame, owners: DataFrame, ops: DataFrame, **filters) -> DataFrame:
    found = search_marks(marks, owners, ops, None, **filters)
    return found.select("codigo", "tipo", "estado", "vence_en", "propietarios", "operaciones")


def lookup_ordered(df: DataFrame, codes: DataFrame, key: str = "codigo", usable_only: bool = False) -> DataFrame:
    """Rows for a request list ``(lista, codigos array)`` in the requested order; repeats and unknown codes drop out."""
    wanted = (
        codes.select("lista", F.posexplode("codigos").alias("posicion_pedida", key))
        .groupBy("lista", key)
        .agg(F.min("posicion_pedida").alias("posicion_pedida"))
    )
    rows = usable(df) if usable_only else df
    return asked_join(wanted, rows, key)


#: Requests of one code above which it is joined apart.
HOT_CODE_ROWS = 200_000


def asked_join(wanted: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Inner join of requested codes that keeps a code which very many ask for, known or not, out of a single task.

    Such codes (at most one for ``HOT_CODE_ROWS`` requests) are counted before the shuffle and broadcast; their few rows are
    joined apart, where adaptive execution broadcasts them.
    """
    hot = wanted.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT_CODE_ROWS).select(key)
    apart = wanted.join(F.broadcast(hot), key, "left_semi").join(rows.join(F.broadcast(hot), key, "left_semi"), key)
    return wanted.join(F.broadcast(hot), key, "left_anti").join(rows, key).unionByName(apart)


def usable(marks: DataFrame) -> DataFrame:
    """Visible, not retired and with an image."""
    return visible(marks).where((F.col("estado") != "baja") & F.col("archivo_png").isNotNull())


def groups_matching(pages: DataFrame, condition, key: str = "numero_guia") -> DataFrame:
    """Every member of a group that has at least one matching member."""
    numbered = pages.where(F.col(key).isNotNull())
    return numbered.join(numbered.where(condition).select(key).distinct(), key, "left_semi")


def operations_of_owner(ops: DataFrame, owners: DataFrame) -> DataFrame:
    """(propietario_id, operation) for active operations where the owner's document sells or buys."""
    parties = visible(ops).withColumn(
        "_doc", F.explode(F.array_distinct(F.array("vendedor_documento", "comprador_documento")))
    )
    who = owners.select(F.col("id").alias("propietario_id"), F.trim("documento").alias("_doc")).where(F.col("_doc") != "")
    return parties.join(who, "_doc", "inner").drop("_doc")


def link_pages(marks: DataFrame, pages: DataFrame) -> DataFrame:
    """Fill a missing page reference from (folder, file); ``vinculada`` marks the rows that changed.

    Only rows that can still be linked take part in the join; the others pass through untouched.
    """
    open_ = F.col("escaneo_id").isNull() & F.col("origen_carpeta").isNotNull() & F.col("origen_pagina").isNotNull()
    index = pages.select(
        F.col("carpeta").alias("origen_carpeta"), F.col("archivo").alias("origen_pagina"), F.col("id").alias("_pagina")
    )
    linked = (
        marks.where(open_).join(index, ["origen_carpeta", "origen_pagina"], "left")
        .withColumn("escaneo_id", F.col("_pagina")).withColumn("vinculada", F.col("_pagina").isNotNull()).drop("_pagina")
    )
    return linked.unionByName(marks.where(~open_).withColumn("vinculada", F.lit(False)))


def provenance(marks: DataFrame, pages: DataFrame) -> DataFrame:
    """The page every linked mark was taken from."""
    source = pages.select(
        F.col("id").alias("escaneo_id"), "carpeta", "archivo", "formato",
        F.col("numero_guia").alias("numero_pagina"), "etiqueta",
    )
    return marks.select("codigo", "escaneo_id").join(source, "escaneo_id", "inner")


def deletion_plan(ids: DataFrame, ops: DataFrame, docs: DataFrame) -> DataFrame:
    """Requested operations as ``bloqueada`` (an issued document refers to them) or ``borrable``; unknown ids drop out."""
    wanted = ids.select("id").distinct().join(ops.select("id"), "id", "left_semi")
    archived = docs.select(F.col("operacion_id").alias("id")).distinct().withColumn("_doc", F.lit(True))
    return wanted.join(archived, "id", "left").select(
        "id", F.when(F.col("_doc"), "bloqueada").otherwise("borrable").alias("accion")
    )


def plan_retirement(marks: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row per listed file and mark: ``no_esta``, ``ya_de_baja``, ``en_operacion`` or ``dar_de_baja``."""
    m = marks.select("id", "codigo", "origen_archivo", "estado", "sospechosa_calidad", "motivo_calidad", "operacion_id")
    plan = (
        F.when(F.col("id").isNull(), "no_esta")
        .when(F.col("estado") == "baja", "ya_de_baja")
        .when(F.col("operacion_id").isNotNull(), "en_operacion")
        .otherwise("dar_de_baja")
    )
    return decisions.select("origen_archivo", "categoria").join(m, "origen_archivo", "left").withColumn("accion", plan)


def retirement_counts(plan: DataFrame) -> DataFrame:
    return plan.agg(
        F.countDistinct("origen_archivo").alias("en_la_lista"),
        F.count_if(F.col("accion") == "no_esta").alias("no_estan_en_la_base"),
        F.count_if(F.col("accion") == "ya_de_baja").alias("ya_de_baja"),
        F.count_if(F.col("accion") == "en_operacion").alias("en_una_operacion"),
        F.count_if(F.col("accion") == "dar_de_baja").alias("a_dar_de_baja"),
    )


def match_files(rows: DataFrame, files: DataFrame, name: str = "archivo") -> DataFrame:
    """Path of each expected file name; of several folders holding it the first folder, then the first path, wins."""
    best = files.groupBy(F.col("nombre").alias(name)).agg(
        F.min(F.struct("carpeta_n", "path"))["path"].alias("ruta")
    )
    return rows.join(best, name, "left").withColumn("falta", F.col(name).isNotNull() & F.col("ruta").isNull())


def assign_codes(cells: DataFrame, overrides: DataFrame) -> DataFrame:
    """Listed code of a (sheet, row, column), else SHEET-F##C##."""
    o = overrides.select(F.trim("hoja").alias("hoja"), "fila", "columna", F.trim("codigo").alias("_listed"))
    own = F.format_string("%s-F%02dC%02d", slug(F.col("hoja")), "fila", "columna")
    return (
        cells.join(o, ["hoja", "fila", "columna"], "left")
        .withColumn("codigo", F.coalesce(F.nullif(F.col("_listed"), F.lit("")), own)).drop("_listed")
    )


def companions(marks: DataFrame, requested: DataFrame) -> DataFrame:
    """The other marks of each requested mark's operation, hidden ones included; ``codigo_pedido`` tells whose they are.

    Read in the order ``tipo`` (dominant first), ``posicion``.
    """
    asked = requested.select(F.col("codigo").alias("codigo_pedido")).distinct()
    mine = marks.select(F.col("codigo").alias("codigo_pedido"), "operacion_id").where(F.col("operacion_id").isNotNull())
    of = mine.join(asked, "codigo_pedido", "left_semi")
    return (
        of.join(marks, "operacion_id", "inner").where(F.col("codigo") != F.col("codigo_pedido"))
        .withColumn("dominante_primero", F.when(F.col("tipo") == "dominante", 0).otherwise(1))
    )


def companion_groups(marks: DataFrame, requested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(membership, members): the operation of each requested mark, and each such operation's marks once, dominant first.

    What ``companions`` lists for every requested mark apart, without a row for each pair: a mark's companions are the members of
    its operation but itself.
    """
    asked = requested.select(F.col("codigo").alias("codigo_pedido")).distinct()
    mine = marks.select(F.col("codigo").alias("codigo_pedido"), "operacion_id").where(F.col("operacion_id").isNotNull())
    of = mine.join(asked, "codigo_pedido", "left_semi")
    members = marks.join(of.select("operacion_id").distinct(), "operacion_id", "left_semi")
    return of, members.withColumn("dominante_primero", F.when(F.col("tipo") == "dominante", 0).otherwise(1))


def history(versions: DataFrame, users: DataFrame) -> DataFrame:
    """Stored versions with the user's name and presence flags; ``version_n`` 1 is the newest of its mark."""
    light = versions.select(
        "id", "marca_id", "motivo", "creado_en", "creado_por",
        F.col("archivo_png").isNotNull().alias("tiene_png"), F.col("archivo_svg").isNotNull().alias("tiene_svg"),
    )
    names = users.select(F.col("id").alias("creado_por"), F.col("nombre").alias("creado_por_nombre"))
    return ranked(light, ["marca_id"], NEWEST, "version_n").join(names, "creado_por", "left")


def save_selection(lists: DataFrame, marks: DataFrame) -> DataFrame:
    """Items ``(lista, marca_id, posicion)`` of ordered code lists; unknown codes leave a gap in the positions."""
    items = lists.select("lista", F.posexplode("codigos").alias("_p", "codigo"))
    return asked_join(items, marks.select("codigo", F.col("id").alias("marca_id")), "codigo").select(
        "lista", "marca_id", (F.col("_p") + 1).alias("posicion")
    )
