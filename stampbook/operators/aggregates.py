"""Counters and breakdowns, each a single pass with map-side partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stampbook.operators.filters import visible
from stampbook.schemas import ESTADOS, PREFIJO_NO_MARCA, TIPOS


def breakdown(marks: DataFrame) -> DataFrame:
    """Marks per state and per type, hidden ones included, zeros kept."""
    return marks.agg(
        *[F.count_if(F.col("estado") == e).alias(e) for e in ESTADOS],
        *[F.count_if(F.col("tipo") == t).alias(t) for t in TIPOS],
    )


def page_summary(pages: DataFrame) -> DataFrame:
    """Rows, different guides, rows without a number and reviewed rows.

    Pre-aggregating per number first keeps the distinct count off a single task's shoulders.
    """
    per_number = pages.groupBy("numero_guia").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("revisado")).alias("r"))
    return per_number.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("paginas"),
        F.count("numero_guia").alias("guias"),
        F.coalesce(F.sum(F.when(F.col("numero_guia").isNull(), F.col("n"))), F.lit(0)).alias("sin_numero"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("revisadas"),
    )


def short_reason(c: Column) -> Column:
    """The reason without its detail in parentheses."""
    return F.split_part(c, F.lit(" ("), F.lit(1))


def reason_histogram(marks: DataFrame, estado: str = "revisar") -> DataFrame:
    return (
        visible(marks).where((F.col("estado") == estado) & F.col("motivo_calidad").isNotNull())
        .groupBy(short_reason(F.col("motivo_calidad")).alias("motivo")).agg(F.count(F.lit(1)).alias("n"))
    )


def review_counters(marks: DataFrame) -> DataFrame:
    """Marks waiting for review, and those retired by the detector."""
    return visible(marks).agg(
        F.count_if(F.col("estado") == "revisar").alias("pendientes"),
        F.count_if(
            (F.col("estado") == "baja") & F.coalesce(F.col("motivo_calidad").startswith(PREFIJO_NO_MARCA), F.lit(False))
        ).alias("bajas_automaticas"),
    )


def duplicate_groups(df: DataFrame, hash_col: str) -> DataFrame:
    """Hashes carried by more than one row, with the number of rows."""
    return (
        df.where(F.col(hash_col).isNotNull()).groupBy(hash_col).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    )


def duplicate_rows(df: DataFrame, hash_col: str) -> DataFrame:
    """The rows behind :func:`duplicate_groups`."""
    return df.join(duplicate_groups(df, hash_col).select(hash_col), hash_col, "left_semi")


def catalog_stats(marks: DataFrame, owners: DataFrame, image: str = "archivo_png") -> DataFrame:
    """Totals by state, owners, marks without owner or image, and repeated image hashes, as one row."""
    no_image = F.col(image).isNull() | (F.length(image) == 0)
    per_hash = marks.groupBy("sha1").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("estado") == e).alias(e) for e in ESTADOS],
        F.count_if(F.col("propietario_id").isNull()).alias("sin"),
        F.count_if(no_image).alias("sin_imagen"),
    )
    stats = per_hash.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("marcas"),
        *[F.coalesce(F.sum(e), F.lit(0)).alias(e) for e in ESTADOS],
        F.coalesce(F.sum("sin"), F.lit(0)).alias("sin_propietario"),
        F.coalesce(F.sum("sin_imagen"), F.lit(0)).alias("sin_imagen"),
        F.count_if((F.col("n") > 1) & F.col("sha1").isNotNull()).alias("imagenes_duplicadas"),
        F.lit(0).cast("long").alias("propietarios"),
    )
    people = owners.agg(F.count(F.lit(1)).alias("propietarios"))
    both = stats.unionByName(people, allowMissingColumns=True)
    return both.agg(*[F.sum(c).alias(c) for c in stats.columns])


def audit_histogram(report: DataFrame, column: str = "motivos") -> DataFrame:
    """Findings per kind: reasons split on ";", cut before their details."""
    kind = F.split_part(F.split_part(F.trim("m"), F.lit(" ("), F.lit(1)), F.lit(" a "), F.lit(1))
    return (
        report.select(F.explode(F.split(column, ";")).alias("m"))
        .groupBy(kind.alias("motivo")).agg(F.count(F.lit(1)).alias("n"))
    )


def batch_summary(sheets: DataFrame, marks: DataFrame) -> DataFrame:
    """Sheets, failed sheets, detected and generated marks, marks to review."""
    a = sheets.agg(F.count(F.lit(1)).alias("hojas"), F.count_if(F.col("error").isNotNull()).alias("hojas_con_error"))
    b = marks.agg(
        F.count(F.lit(1)).alias("marcas_detectadas"),
        F.count_if(F.coalesce(F.col("png") != "", F.lit(False))).alias("marcas_generadas"),
        F.count_if(F.col("revisar")).alias("a_revisar"),
    )
    names = [*a.columns, *b.columns]
    return a.unionByName(b, allowMissingColumns=True).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])


# fixed values: names an archive carries that are no documents
SYSTEM_NAMES = ("__MACOSX", ".DS_Store", "Thumbs.db")


def relevant_files(files: DataFrame, path: str = "path") -> DataFrame:
    parts = F.split(path, "/")
    return files.where(~F.arrays_overlap(parts, F.array(*[F.lit(n) for n in SYSTEM_NAMES])) & ~F.col(path).endswith("/"))


def file_inventory(files: DataFrame, path: str = "path", size: str = "bytes", folders: int | None = None) -> DataFrame:
    """Files and bytes by extension, by folder (all, or the ``folders`` fullest) and in total: (grupo, valor, archivos, bytes)."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    f = relevant_files(files, path).select(
        F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)).alias("ext"),
        F.regexp_replace(path, "/?[^/]*$", "").alias("dir"), F.col(size).alias("b"),
    )
    cube = f.groupBy("ext", "dir").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b"))

    def part(group: str, value: Column) -> DataFrame:
        return cube.groupBy(value.alias("valor")).agg(F.sum("n").alias("archivos"), F.sum("b").alias("bytes")).select(
            F.lit(group).alias("grupo"), "valor", "archivos", "bytes"
        )

    top = part("carpeta", F.col("dir"))
    if folders is not None:
        top = top.orderBy(F.desc("archivos"), "valor").limit(folders)
    return part("extension", F.col("ext")).unionByName(top).unionByName(part("total", F.lit("")))


def action_counts(changes: DataFrame, column: str = "accion") -> DataFrame:
    """Rows per action of a change plan."""
    return changes.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def ingest_counts(changes: DataFrame, number: str = "numero_guia", source: str = "fuente_numero") -> DataFrame:
    """Counters of a page load: pages, inferred, with number, new, updated, protected."""
    return changes.agg(
        F.count(F.lit(1)).alias("paginas"),
        F.count_if(F.coalesce(F.col(source).startswith("inferido"), F.lit(False))).alias("inferidas"),
        F.count_if(F.coalesce(F.col(number) != "", F.lit(False))).alias("con_numero"),
        F.count_if(F.col("accion") == "nueva").alias("nuevas"),
        F.count_if(F.col("accion") == "actualizada").alias("actualizadas"),
        F.count_if(F.col("accion") == "protegida").alias("protegidas"),
    )


def load_counts(changes: DataFrame, marks: DataFrame, images: DataFrame) -> DataFrame:
    """``ingest_counts`` with ``imagenes``, loaded pages whose image and thumbnail are both there, and ``marcas_vinculadas``, marks
    that the load links to their page.

    ``images`` (carpeta, archivo, imagen, miniatura) tells per page which of the two was delivered; ``marks`` as stored.
    """
    page = ["carpeta", "archivo"]
    whole = images.where(F.col("imagen").isNotNull() & F.col("miniatura").isNotNull()).select(*page)
    loaded = changes.where(F.col("accion") != "sin_cambio").select(*page).distinct()
    pages = loaded.join(whole.distinct(), page, "left_semi").agg(F.count(F.lit(1)).alias("imagenes"))
    known = changes.select(F.col("carpeta").alias("origen_carpeta"), F.col("archivo").alias("origen_pagina")).distinct()
    linked = marks.where(F.col("escaneo_id").isNull()).join(known, ["origen_carpeta", "origen_pagina"], "left_semi").agg(F.count(F.lit(1)).alias("marcas_vinculadas"))
    one = [x.withColumn("_one", F.lit(1)) for x in (ingest_counts(changes), pages, linked)]
    return one[0].join(one[1], "_one").join(one[2], "_one").drop("_one")
