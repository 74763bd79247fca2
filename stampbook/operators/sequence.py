"""Rules over pages in scan order and positions on a line: inference, neighbours, clusters, layout, slots, page roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stampbook.functions.folds import assign_rows, half_median, half_true_median, let, longest_regular_run
from stampbook.operators.ordering import Key, all_small, null_safe_join, ranked, scan, split
from stampbook.schemas import ANEXO, COPIAS, PRINCIPAL


def infer_numbers(pages: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Complete missing numbers from the neighbours inside each folder, in page order.

    An annex takes the number of the main page or annex before it; any page takes the number both neighbours agree on. A
    completed page passes its number on. Since a completed value always equals the last original one, a page is completed
    exactly when no unlinked page lies between it and that original: two running maxima of row numbers decide it.
    The ordered passes see five narrow columns; only completed pages come back, by folder, place and file.
    """
    n = F.nullif(F.col("numero_guia"), F.lit(""))
    order = [Key("orden"), Key("archivo")]
    narrow = pages.select("carpeta", "orden", "archivo", "formato", n.alias("_n"))
    cut, small = split(narrow, ["carpeta"], order, hot_rows)
    first = scan(
        cut, ["carpeta"], order,
        {
            "_row": ("row_number", None), "_cand": ("last_before", F.col("_n")),
            "_fmt": ("lag", F.col("formato")), "_next": ("lead", F.col("_n")),
        },
        hot_rows, small,
    )
    annex = F.coalesce((F.col("formato") == ANEXO) & F.col("_fmt").isin(PRINCIPAL, ANEXO), F.lit(False))
    agree = F.coalesce(F.col("_cand") == F.col("_next"), F.lit(False))
    linked = first.withColumns({"_annex": annex, "_link": annex | agree})
    second = scan(
        linked, ["carpeta"], order,
        {
            "_given": ("max", F.when(F.col("_n").isNotNull(), F.col("_row"))),
            "_broken": ("max", F.when(F.col("_n").isNull() & ~F.col("_link"), F.col("_row"))),
        },
        hot_rows, small,
    )
    filled = (
        F.col("_n").isNull() & F.col("_given").isNotNull()
        & (F.coalesce("_broken", F.lit(0)) < F.col("_given"))
    )
    place = ["carpeta", "orden", "archivo"]
    completed = second.where(filled).select(*place, "_cand", "_annex").dropDuplicates(place)
    done = F.col("_cand").isNotNull() & F.nullif(F.col("numero_guia"), F.lit("")).isNull()
    out = {
        "inferida": done,
        "fuente_numero": F.when(done & F.col("_annex"), "inferido:anexo").when(done, "inferido:vecinas")
        .otherwise(F.col("fuente_numero")),
        "conf_numero": F.when(done & F.col("_annex"), 0.5).when(done, 0.4).otherwise(F.col("conf_numero")),
        "numero_guia": F.when(done, F.col("_cand")).otherwise(F.col("numero_guia")),
    }
    return null_safe_join(pages, completed, place, "left").withColumns(out).select(*pages.columns, "inferida")


def neighbours(pages: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Previous and next page of each page in its folder; pages sharing its position are skipped.

    Positions are collapsed first, so any number of pages at one position becomes one row of the ordered pass.
    """
    places = pages.groupBy("carpeta", "orden").agg(F.max("id").alias("_hi"), F.min("id").alias("_lo"))
    linked = scan(
        places.where(F.col("orden").isNotNull()), ["carpeta"], ["orden"],
        {"anterior_id": ("lag", F.col("_hi")), "siguiente_id": ("lead", F.col("_lo"))}, hot_rows,
        all_small(pages, ["carpeta"], hot_rows),
    ).drop("_hi", "_lo")
    return pages.join(linked, ["carpeta", "orden"], "left")


def gap_clusters(df: DataFrame, keys, value: str, tolerance: float, hot_rows: int | None = None) -> DataFrame:
    """Mean of each cluster of values; a gap above the tolerance opens the next cluster.

    Equal values are collapsed (with their count) before the ordered pass.
    """
    keys = list(keys)
    points = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_w"))
    points, small = split(points, keys, ["_v"], hot_rows, all_small(df, keys, hot_rows))
    stepped = scan(points, keys, ["_v"], {"_prev": ("lag", F.col("_v"))}, hot_rows, small)
    opens = F.when(F.col("_v") - F.col("_prev") > tolerance, 1).otherwise(0)
    numbered = scan(stepped, keys, ["_v"], {"grupo": ("sum", opens)}, hot_rows, small)
    return numbered.groupBy(*keys, "grupo").agg(
        (F.sum(F.col("_v") * F.col("_w")) / F.sum("_w")).alias("media"), F.sum("_w").alias("valores")
    )


def regular_lines(pages: DataFrame, positions: str = "posiciones", tolerance: float = 0.15) -> DataFrame:
    """``lineas_regulares``: the longest evenly spaced run of each page's line positions (an array of the page row)."""
    return pages.withColumn("lineas_regulares", longest_regular_run(F.col(positions), tolerance))


# fixed values: phrases that tell the pages of a guide apart
MAIN_TITLE, ANNEX_WORD = "GUIA DE TRASLADO Y TRANSFERENCIA DE GANADO", "ANEXO"


def _indexed(boxes: Column) -> Column:
    return F.transform(boxes, lambda b, i: b.withField("i", i))


def reading_order(
    pages: DataFrame, boxes: str = "cajas", tolerance: float | None = None, y_up: bool = True, centres: bool = False
) -> DataFrame:
    """One row per box with ``fila`` and ``columna``; boxes ``(x, y, w, h, …)`` are an array of the page row.

    A box stays in the open row while its level is within the tolerance of the row's first box. The default tolerance is
    half the median height. ``centres`` compares box centres instead of edges (images, y downwards).
    """
    b = _indexed(F.col(boxes))
    if centres:
        b = F.transform(b, lambda x: x.withField("ref", x["y"] + x["h"] / 2))
    heights = F.transform(b, lambda x: x["h"].cast("double"))
    tol = F.lit(float(tolerance)) if tolerance is not None else (half_true_median if centres else half_median)(heights)
    rows = assign_rows(b, "y", tol, y_up, "ref" if centres else None)
    by_x = F.array_sort(F.transform(rows, lambda r: F.struct(r["fila"], r["x"].alias("x"), r["i"].alias("i"), r.alias("r"))))
    def placed(both: Column) -> Column:  # a row's boxes follow each other: the place in the row counts from its first box
        return F.transform(both["b"], lambda r, k: r["r"].withField("columna", (k + 2 - F.array_position(both["f"], r["fila"])).cast("int")))

    first = let(by_x, lambda b: let(F.struct(b.alias("b"), F.transform(b, lambda r: r["fila"]).alias("f")), placed))
    keep = [c for c in pages.columns if c != boxes]
    return pages.select(*keep, F.explode(first).alias("_b")).select(*keep, "_b.*").drop("i", "ref")


def ordered_text(pages: DataFrame, pieces: str = "piezas", tolerance: float = 4.0) -> DataFrame:
    """``texto``: the page's text pieces ``(x, y, texto)`` joined line by line, top to bottom, left to right."""
    p = _indexed(F.filter(F.transform(F.col(pieces), lambda b: b.withField("texto", F.trim(b["texto"]))), lambda b: b["texto"] != ""))
    rows = assign_rows(p, "y", F.lit(float(tolerance)), True)
    by_x = F.array_sort(F.transform(rows, lambda r: F.struct(r["fila"], r["x"].alias("x"), r["i"].alias("i"), r["texto"].alias("t"))))

    def told(pieces: Column) -> Column:
        def after(r: Column, k: Column) -> Column:
            return F.when(k == 0, "").when(F.get(pieces, k - 1)["fila"] == r["fila"], " ").otherwise("\n")

        return F.array_join(F.transform(pieces, lambda r, k: F.concat(after(r, k), r["t"])), "")

    text = let(by_x, told)
    return pages.withColumn("texto", text)


def page_roles(pages: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Role of each page of a document: main page, annex (with its running index inside its copy), or neither."""
    upper = F.upper("text")
    copy_name = F.regexp_extract("text", "(?i)(" + "|".join(COPIAS) + ")", 1)
    copy = F.when(copy_name != "", F.initcap(F.lower(copy_name))).otherwise(COPIAS[0])
    tagged = pages.withColumns(
        {
            "principal": upper.contains(MAIN_TITLE),
            "anexo": upper.contains(ANNEX_WORD),
            "copia": copy,
        }
    )
    counted = scan(
        tagged, ["doc", "copia"], ["page"], {"_k": ("sum", F.when(F.col("anexo"), 1).otherwise(0))}, hot_rows
    )
    return counted.withColumn("orden_anexo", F.when(F.col("anexo"), F.col("_k") - 1)).drop("_k")


def sheet_capacity(slots: DataFrame) -> DataFrame:
    """Free slots of each sheet: (doc, orden, cupo) with the smallest copy deciding."""
    per_copy = slots.groupBy("doc", "copia", "orden").agg(F.count_if(~F.col("ocupada")).alias("libres"))
    return per_copy.groupBy("doc", "orden").agg(F.min("libres").alias("cupo"))


def annex_capacity(slots: DataFrame) -> DataFrame:
    """Free annex slots of each document: the copy with the least room decides."""
    per_copy = slots.groupBy("doc", "copia").agg(F.count_if(~F.col("ocupada")).alias("libres"))
    return per_copy.groupBy("doc").agg(F.min("libres").alias("cupo"))


def allocate(items: DataFrame, slots: DataFrame, hot_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Place ordered items into free slots, identically in every copy; returns (placements, overflow).

    ``items`` (doc, item, pos); ``slots`` (doc, copia, orden, slot, ocupada). A slot's index counts the capacity of the
    sheets before it plus its rank among the free slots of its own sheet, so placing is an equi-join on the index.
    """
    small = all_small(slots, ["doc"], hot_rows)
    sheets = scan(sheet_capacity(slots), ["doc"], ["orden"], {"_upto": ("sum", F.col("cupo"))}, hot_rows, small)
    free = ranked(slots.where(~F.col("ocupada")), ["doc", "copia", "orden"], ["slot"], "_rn", hot_rows, small)
    places = (
        free.join(sheets, ["doc", "orden"], "inner").where(F.col("_rn") <= F.col("cupo"))
        .withColumn("_index", F.col("_upto") - F.col("cupo") + F.col("_rn"))
        .select("doc", "copia", "orden", "slot", "_index")
    )
    queue = ranked(items, ["doc"], ["pos"], "_index", hot_rows)
    placed = queue.join(places, ["doc", "_index"], "inner").select("doc", "item", "copia", "orden", "slot")
    room = sheets.groupBy("doc").agg(F.sum("cupo").alias("_room"))
    overflow = queue.join(room, "doc", "left").where(F.col("_index") > F.coalesce("_room", F.lit(0))).select("doc", "item", "pos")
    return placed, overflow
