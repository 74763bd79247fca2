"""Facets, text search, status and date filters, row validation and changed-field detection."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stampbook.functions.text import normalize_label
from stampbook.schemas import ESTADOS, PREFIJO_NO_MARCA, TIPOS, TIPOS_DOCUMENTO, TIPOS_OPERACION

MARK_FACETS = {"estado": ("estado", ESTADOS), "tipo": ("tipo", TIPOS), "carpeta": ("origen_carpeta_n", (1, 2))}
OPERATION_FACETS = {"tipo_operacion": ("tipo_operacion", TIPOS_OPERACION)}
DOCUMENT_FACETS = {"tipo": ("tipo", TIPOS_DOCUMENTO)}
INLINE_KEYS = 1_000


def facets(df: DataFrame, spec: dict, **values) -> DataFrame:
    """One equality per given value that its facet allows; any other value is ignored."""
    for name, value in values.items():
        column, allowed = spec[name]
        if value in allowed:
            df = df.where(F.col(column) == F.lit(value))
    return df


def visible(df: DataFrame, hidden: bool = False) -> DataFrame:
    """Active rows, or only the hidden ones: two separate views."""
    return df.where(F.col("activo") == F.lit(not hidden))


def contains_text(text: str, cols: list[str | Column]) -> Column:
    """Case-insensitive "contains" over several columns; ``%`` and ``_`` typed by the user stay wildcards."""
    pattern = f"%{text.strip()}%"
    tests = [(F.col(c) if isinstance(c, str) else c).ilike(pattern) for c in cols]
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])


def text_search(df: DataFrame, text: str | None, cols: list[str | Column]) -> DataFrame:
    return df.where(contains_text(text, cols)) if (text or "").strip() else df


def needs_review() -> Column:
    return F.coalesce(F.col("revisar") != "", F.lit(False))


def operation_status(df: DataFrame, status: str | None) -> DataFrame:
    """``revisar`` (has notes), ``colisiona`` (its number collides) or ``al_dia`` (neither)."""
    if status == "revisar":
        return df.where(needs_review())
    if status == "colisiona":
        return df.where(F.col("guia_colisionada"))
    if status == "al_dia":
        return df.where(~F.col("guia_colisionada") & ~needs_review())
    return df


def _day(text: str | None, strict: bool) -> date | None:
    if not text:
        return None
    try:
        return date.fromisoformat(text)
    except ValueError:
        if strict:
            raise
        return None


def between_days(
    df: DataFrame, column: str, lo: str | None = None, hi: str | None = None, mode: str = "last_second", strict: bool = False
) -> DataFrame:
    """Date range on a timestamp. ``last_second`` ends at 23:59:59 of ``hi``; ``next_day`` ends before the following day.

    An invalid date is ignored, or raised when ``strict`` (exports do not tolerate it).
    """
    first, last = _day(lo, strict), _day(hi, strict)
    kind = df.schema[column].dataType.simpleString()
    if first:
        df = df.where(F.col(column) >= F.lit(f"{first} 00:00:00").cast(kind))
    if last and mode == "last_second":
        df = df.where(F.col(column) <= F.lit(f"{last} 23:59:59").cast(kind))
    elif last:
        df = df.where(F.col(column) < F.lit(f"{last + timedelta(days=1)} 00:00:00").cast(kind))
    return df


def reason_prefix(df: DataFrame, prefix: str | None, column: str = "motivo_calidad") -> DataFrame:
    """Rows whose reason starts with the literal prefix; percent signs are dropped, underscores are literal."""
    return df.where(F.col(column).startswith(prefix.replace("%", ""))) if prefix else df


def by_keys(df: DataFrame, key: str, keys) -> DataFrame:
    """Rows whose key is listed. A frame of keys, or a long list, becomes a semi-join."""
    if keys is None:
        return df
    if not isinstance(keys, DataFrame):
        if len(keys) <= INLINE_KEYS:
            return df.where(F.col(key).isin(list(keys)))
        keys = df.sparkSession.createDataFrame([(k,) for k in keys], f"{key} {df.schema[key].dataType.simpleString()}")
    return df.join(keys.select(key).distinct(), key, "left_semi")


def presence(df: DataFrame, cols: list[str], blank_is_missing: bool = False) -> DataFrame:
    """Replace heavy columns by a has-value flag; with ``blank_is_missing`` an empty text counts as absent."""
    flags = {}
    for c in cols:
        has = F.col(c).isNotNull()
        flags[c] = has & (F.length(c) > 0) if blank_is_missing else has
    return df.withColumns(flags)


def archive_search(
    docs: DataFrame, users: DataFrame, text: str | None = None, tipo: str | None = None,
    lo: str | None = None, hi: str | None = None,
) -> DataFrame:
    """Issued documents with their user's name and number of stamped marks, filtered on columns and JSON fields."""
    found = between_days(facets(docs, DOCUMENT_FACETS, tipo=tipo), "emitido_en", lo, hi, mode="next_day", strict=True)
    seller, buyer = (F.get_json_object("datos", f"$.{f}") for f in ("vendedor_nombre", "comprador_nombre"))
    found = text_search(found, text, ["numero_guia", seller, buyer, "nombre"])
    names = users.select(F.col("id").alias("emitido_por"), F.col("nombre").alias("emitido_por_nombre"))
    return found.join(names, "emitido_por", "left").select(
        "id", "operacion_id", "tipo", "numero_guia", "emitido_en", "nombre", "datos",
        F.json_array_length("marcas").alias("cantidad_marcas"), "emitido_por_nombre",
    )


def no_mark_reason(category: Column) -> Column:
    return F.concat(F.lit(PREFIJO_NO_MARCA), category)


def validate_rows(
    df: DataFrame, row: str, required: dict[str, str] | None = None, enums: dict[str, tuple] | None = None,
    any_of: list[str] | None = None, not_negative: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Split rows into accepted ones and warnings.

    A row without a required value, with all of ``any_of`` empty, or with a negative count is rejected. An unknown enum
    value only becomes null. Every problem yields one warning row ``(row, problema)``.
    """
    def empty(c: str) -> Column:
        return F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))

    fatal = [F.when(empty(c), F.lit(message)) for c, message in (required or {}).items()]
    if any_of:
        fatal.append(F.when(reduce(lambda a, b: a & b, [empty(c) for c in any_of]), F.lit("fila vacía")))
    for c in not_negative or []:
        fatal.append(F.when(F.col(c) < 0, F.lit(f"{c} negativa")))
    unknown = {
        c: ~empty(c) & ~F.coalesce(normalize_label(F.col(c)).isin(*allowed), F.lit(False)) for c, allowed in (enums or {}).items()
    }
    soft = [F.when(bad, F.concat(F.lit(f"{c} '"), F.col(c), F.lit("' desconocido"))) for c, bad in unknown.items()]
    none = F.array().cast("array<string>")
    flagged = df.withColumns(
        {
            "_fatal": F.filter(F.array(*fatal), lambda x: x.isNotNull()) if fatal else none,
            "_soft": F.filter(F.array(*soft), lambda x: x.isNotNull()) if soft else none,
        }
    )
    warnings = flagged.select(
        row, F.explode(F.when(F.size("_fatal") > 0, F.slice("_fatal", 1, 1)).otherwise(F.col("_soft"))).alias("problema")
    )
    cleaned = {c: F.when(~bad & ~empty(c), normalize_label(F.col(c))) for c, bad in unknown.items()}
    valid = flagged.where(F.size("_fatal") == 0).drop("_fatal", "_soft").withColumns(cleaned)
    return valid, warnings


def changed_fields(old: DataFrame, new: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """(key, campo, anterior, nuevo) for every proposed value that differs; values are trimmed and '' is null."""
    def text(frame: DataFrame, c: str) -> Column:
        return F.nullif(F.trim(frame[c].cast("string")), F.lit(""))

    pairs = [
        F.struct(F.lit(c).alias("campo"), old[c].cast("string").alias("anterior"), text(new, c).alias("nuevo")) for c in cols
    ]
    joined = new.join(old, new[key] == old[key], "inner").select(new[key].alias(key), F.array(*pairs).alias("p"))
    return (
        joined.select(key, F.explode(F.filter("p", lambda p: ~p["anterior"].eqNullSafe(p["nuevo"]))).alias("p"))
        .select(key, "p.campo", "p.anterior", "p.nuevo")
    )
