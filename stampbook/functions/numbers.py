"""Number words, number comparison, safe parsing and code generation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: number words up to 999
UNITS = {
    "CERO": 0, "UN": 1, "UNO": 1, "UNA": 1, "DOS": 2, "TRES": 3, "CUATRO": 4, "CINCO": 5, "SEIS": 6, "SIETE": 7,
    "OCHO": 8, "NUEVE": 9, "DIEZ": 10, "ONCE": 11, "DOCE": 12, "TRECE": 13, "CATORCE": 14, "QUINCE": 15,
    "DIECISEIS": 16, "DIECISIETE": 17, "DIECIOCHO": 18, "DIECINUEVE": 19, "VEINTE": 20, "VEINTIUN": 21,
    "VEINTIUNO": 21, "VEINTIDOS": 22, "VEINTITRES": 23, "VEINTICUATRO": 24, "VEINTICINCO": 25, "VEINTISEIS": 26,
    "VEINTISIETE": 27, "VEINTIOCHO": 28, "VEINTINUEVE": 29,
}
TENS = {"TREINTA": 30, "CUARENTA": 40, "CINCUENTA": 50, "SESENTA": 60, "SETENTA": 70, "OCHENTA": 80, "NOVENTA": 90}
HUNDREDS = {
    "CIEN": 100, "CIENTO": 100, "DOSCIENTOS": 200, "TRESCIENTOS": 300, "CUATROCIENTOS": 400, "QUINIENTOS": 500,
    "SEISCIENTOS": 600, "SETECIENTOS": 700, "OCHOCIENTOS": 800, "NOVECIENTOS": 900,
}


def words_to_number(c: Column) -> Column:
    """"SESENTA Y SEIS" -> 66; null when any word is unknown or there is none."""
    table = F.create_map(*[F.lit(x) for pair in {**UNITS, **TENS, **HUNDREDS}.items() for x in pair])
    plain = F.replace(F.translate(F.upper(c), "ÁÉÍÓÚÜ", "AEIOUU"), F.lit("-"), F.lit(" "))
    words = F.filter(F.split(F.trim(plain), r"\s+"), lambda w: (w != "") & (w != "Y"))
    values = F.transform(words, lambda w: F.try_element_at(table, w))
    total = F.aggregate(values, F.lit(0), lambda acc, v: acc + v)
    return F.when(F.size(words) > 0, total)


def swapped_at(c: Column, i: Column) -> Column:
    """The text with characters ``i`` and ``i + 1`` (from 1) exchanged."""
    return F.concat(
        F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.lit(1)), F.substring(c, i, F.lit(1)),
        F.substring(c, i + 2, F.length(c)),
    )


def near_equal(a: Column, b: Column) -> Column:
    """Same length and either one character differs or two neighbours are exchanged."""
    n = F.length(a)
    places = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    swap = F.exists(places, lambda i: swapped_at(a, i) == b)
    return (n == F.length(b)) & (a != b) & ((F.levenshtein(a, b) == 1) | swap)


def safe_int(c: Column) -> Column:
    """Digits only, otherwise null."""
    t = F.trim(c)
    return F.when(t.rlike("^[0-9]+$"), t.try_cast("long"))


def safe_date(c: Column) -> Column:
    """A valid yyyy-MM-dd date, otherwise null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date"))


# fixed values: words read as true
TRUE_WORDS = ("1", "true", "verdadero", "si", "sí")


def truth_word(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def integral_text(c: Column) -> Column:
    """A number as text without a zero fraction (80020081.0 -> "80020081")."""
    whole = (c == F.floor(c)) & (F.abs(c) < F.lit(1e18))
    return F.when(whole, c.try_cast("long").cast("string")).otherwise(c.cast("string"))


def mark_code(n: Column) -> Column:
    """M-00001, M-00002 …; wider numbers keep all their digits."""
    return F.format_string("M-%05d", n.cast("long"))


def code_suffix(c: Column) -> Column:
    """The number at the end of a code, null when there is none."""
    return F.nullif(F.regexp_extract(c, "[0-9]+$", 0), F.lit("")).try_cast("long")


VALID_CODE = r"^[A-Za-z0-9._-]+$"


def valid_code(c: Column) -> Column:
    return F.coalesce(c.rlike(VALID_CODE), F.lit(False))
