"""Verified snapshot dump and restore, changed-file detection and key recovery."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stampbook.functions.numbers import code_suffix

# fixed values: rows per part of the tables that carry images
PART_ROWS = {"marcas": 100, "escaneos": 20, "marcas_versiones_imagen": 20, "respaldos_operacion": 10}
DEFAULT_PART_ROWS = 100_000
MANIFEST = "manifiesto"
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def _textual(df: DataFrame) -> DataFrame:
    binary = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BinaryType)]
    return df.withColumns({c: F.base64(c) for c in binary}) if binary else df


def dump(tables: dict[str, DataFrame], path: str, keys: dict[str, str] | None = None, part_rows: dict[str, int] | None = None) -> DataFrame:
    """Write each table as JSON parts in key order and a manifest (tabla, filas, partes), which is returned.

    Tables are range-partitioned by key, so parts follow one another and no task holds a whole table. Binary columns are
    base64, missing values stay in the JSON, and an empty table still leaves one part. Rows and parts are counted in what
    was stored (one JSON line per row), so the manifest describes the files and not the plan that wrote them.
    """
    keys, sizes = keys or {}, {**PART_ROWS, **(part_rows or {})}
    spark, manifest = next(iter(tables.values())).sparkSession, []
    for name, df in tables.items():
        key = keys.get(name, "id")
        (
            _textual(df).repartitionByRange(key).sortWithinPartitions(key).write.mode("errorifexists")
            .option("maxRecordsPerFile", sizes.get(name, DEFAULT_PART_ROWS)).option("ignoreNullFields", "false")
            .option("timestampFormat", ISO).json(f"{path}/{name}")
        )
        per_file = spark.read.text(f"{path}/{name}").groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n"))
        rows, parts = per_file.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        manifest.append((name, rows, max(1, parts)))
    frame = spark.createDataFrame(manifest, "tabla string, filas long, partes long")
    frame.coalesce(1).write.mode("errorifexists").json(f"{path}/{MANIFEST}")
    return frame


def blob_sha(content: Column) -> Column:
    """Content hash of a stored file: sha1 over "blob <length>", a NUL byte and the bytes."""
    header = F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8")
    return F.sha1(F.concat(header, F.lit(b"\x00"), content.cast("binary")))


def changed_only(curr: DataFrame, prev: DataFrame) -> DataFrame:
    """Files ``(path, sha)`` that are new or differ from the previous manifest; ``accion`` says which."""
    before = prev.select("path", F.col("sha").alias("_sha"))
    joined = curr.join(before, "path", "left").where(~F.col("sha").eqNullSafe(F.col("_sha")))
    return joined.withColumn("accion", F.when(F.col("_sha").isNull(), "nuevo").otherwise("cambiado")).drop("_sha")


def read_part(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One dumped table with the target's columns only; base64 text becomes binary again."""
    stored = T.StructType(
        [T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.BinaryType) else f.dataType) for f in schema.fields]
    )
    raw = spark.read.schema(stored).option("timestampFormat", ISO).json(path)
    binary = [f.name for f in schema.fields if isinstance(f.dataType, T.BinaryType)]
    return raw.withColumns({c: F.unbase64(c) for c in binary}) if binary else raw


class NotEmpty(RuntimeError):
    """The restore target already holds rows."""


def restore(
    spark: SparkSession, path: str, schemas: dict[str, T.StructType], existing: dict[str, DataFrame] | None = None,
    force: bool = False, guarded: tuple[str, ...] = ("usuarios", "operaciones", "marcas"), key: str = "id",
) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, check). Refuses a target that has rows in a guarded table unless forced; forced, known keys are skipped.

    Issued documents without their file are left out, and marks lose their page reference when no pages were dumped.
    ``check`` compares each table's row count with the manifest: (tabla, esperado, leido, coincide).
    """
    existing = existing or {}
    if not force:
        busy = [t for t in guarded if t in existing and existing[t].limit(1).count()]
        if busy:
            raise NotEmpty(f"target already has rows in {', '.join(busy)}")
    tables = {name: read_part(spark, f"{path}/{name}", schema) for name, schema in schemas.items()}
    if "documentos_emitidos" in tables and "contenido" in tables["documentos_emitidos"].columns:
        tables["documentos_emitidos"] = tables["documentos_emitidos"].where(F.col("contenido").isNotNull())
    has_pages = "escaneos" in tables and tables["escaneos"].limit(1).count() > 0
    if "marcas" in tables and not has_pages and "escaneo_id" in tables["marcas"].columns:
        tables["marcas"] = tables["marcas"].withColumn("escaneo_id", F.lit(None).cast("long"))
    read = reduce(
        DataFrame.unionByName,
        [t.agg(F.lit(n).alias("tabla"), F.count(F.lit(1)).alias("leido")) for n, t in tables.items()],
    )
    expected = spark.read.schema("tabla string, filas long, partes long").json(f"{path}/{MANIFEST}")
    check = (
        expected.select("tabla", F.col("filas").alias("esperado")).join(read, "tabla", "full")
        .withColumn("coincide", F.col("esperado").eqNullSafe(F.col("leido")))
    )
    for name, present in existing.items():
        if name in tables and key in tables[name].columns:
            tables[name] = tables[name].join(present.select(key), key, "left_anti").select(*tables[name].columns)
    return tables, check


def missing_binaries(documents: DataFrame, column: str = "contenido") -> DataFrame:
    """Issued documents whose file is not in the dump."""
    return documents.where(F.col(column).isNull()).select("id")


def next_sequence(df: DataFrame, code: str | None = "codigo", key: str | None = "id") -> DataFrame:
    """Largest numeric code suffix and largest id of a table, 0 when there is none."""
    out = []
    if code:
        out.append(F.coalesce(F.max(code_suffix(F.col(code))), F.lit(0)).alias("ultimo_codigo"))
    if key:
        out.append(F.coalesce(F.max(key), F.lit(0)).alias("ultimo_id"))
    return df.agg(*out)
