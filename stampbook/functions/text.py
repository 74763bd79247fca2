"""Text normalisation, labels and file-name parsing as Column expressions."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from stampbook.schemas import ANEXO, CERTIFICADO, PRINCIPAL


def _fold_table() -> tuple[str, str, list[tuple[str, str]]]:
    """Compatibility folding to ASCII of all characters that fold to any, derived from the Unicode database."""
    single_from, single_to, longer = [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        ch = chr(code)
        if not unicodedata.decomposition(ch):
            continue
        plain = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            single_from.append(ch)
            single_to.append(plain)
        elif plain:
            longer.append((ch, plain))
    return "".join(single_from), "".join(single_to), longer


_FOLD_FROM, _FOLD_TO, _FOLD_LONGER = _fold_table()
#: Java tests the members of a class one after another, so classes first turn ASCII away.
NOT_ASCII = r"\x{80}-\x{10FFFF}"
_LONGER_FROM = [ch for ch, _ in _FOLD_LONGER]
_LONGER_TO = [plain for _, plain in _FOLD_LONGER]


def ascii_fold(c: Column) -> Column:
    """Strip accents and compatibility forms, then drop what is still not ASCII."""
    table = F.map_from_arrays(F.lit(_LONGER_FROM), F.lit(_LONGER_TO))
    expanded = F.array_join(F.transform(F.split(c, ""), lambda ch: F.when(ch > "\x7f", F.coalesce(F.try_element_at(table, ch), ch)).otherwise(ch)), "")
    longer = F.translate(c, "".join(_LONGER_FROM), "") != c  # one lookup a character; a class of so many members tests them in turn
    folded = F.translate(F.when(longer, expanded).otherwise(c), _FOLD_FROM, _FOLD_TO)
    return F.when(c.rlike(r"^\p{ASCII}*$"), c).otherwise(F.regexp_replace(folded, r"[^\x00-\x7F]", ""))


_NEITHER = "".join(chr(i) for i in range(0x80) if not chr(i).isalnum())


def _words_between(c: Column, sign: str) -> Column:
    """ASCII text with each run of other signs than letters and digits as one ``sign``; only real runs cost a replacement."""
    return F.regexp_replace(F.translate(c, _NEITHER, sign * len(_NEITHER)), sign + "{2,}", sign)


def normalize_label(c: Column) -> Column:
    """"CI / RUC" -> "ci ruc"."""
    return F.lower(F.trim(_words_between(ascii_fold(c), " ")))


def slug(c: Column, default: str = "HOJA") -> Column:
    """Upper-case name made of letters, digits and single dashes; ``default`` when nothing is left."""
    dashed = _words_between(ascii_fold(c), "-")
    return F.coalesce(F.nullif(F.upper(F.trim(dashed, F.lit("-"))), F.lit("")), F.lit(default))


def eight_digit_numbers(c: Column, excluded: str | None = None) -> Column:
    """Numbers of exactly eight digits, in reading order, without one excluded id."""
    runs = F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0))
    return F.filter(runs, lambda n: (F.length(n) == 8) & (n != F.lit(excluded or "")))


WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def without_spaces(c: Column) -> Column:
    """The text without any kind of blank."""
    return F.translate(c, WHITESPACE, "")


# fixed values: characters an OCR reads in place of a digit
CONFUSED = "OoDQIl|ZSBG"
CONFUSED_DIGITS = "00001112586"


def digits_only(c: Column) -> Column:
    """Undo common letter-for-digit confusions, then keep the digits."""
    return F.regexp_replace(F.translate(c, CONFUSED, CONFUSED_DIGITS), r"\D", "")


def letters(c: Column) -> Column:
    return F.regexp_extract_all(F.upper(c), F.lit(r"(\p{L})"), F.lit(1))


def same_text_ratio(a: Column, b: Column) -> Column:
    """Share of positions whose letters agree, over the longer text; spaces and digits do not count."""
    x, y = letters(a), letters(b)
    pairs = F.zip_with(x, y, lambda p, q: p == q)
    agree = F.size(F.filter(pairs, lambda t: t))
    return agree / F.greatest(F.size(x), F.size(y), F.lit(1))


def accept_rereading(read: Column, again: Column, threshold: float = 0.85) -> Column:
    """The second reading when it says the same as the first, otherwise the first."""
    ok = (F.trim(again) != "") & (same_text_ratio(read, again) >= threshold)
    return F.when(ok, again).otherwise(read)


def trailing_page(file_name: Column) -> Column:
    return F.nullif(F.regexp_extract(file_name, r"([0-9]+)\.[A-Za-z]+$", 1), F.lit("")).try_cast("int")


# fixed values: folder code -> (folder number, part)
FOLDERS = {"L3210": (1, None), "L5290": (2, None), "PARTE1": (2, 1), "PARTE2": (2, 2)}


def folder_number(folder: Column) -> Column:
    return F.when(folder.isin(*FOLDERS), F.when(folder == "L3210", 1).otherwise(2))


def folder_part(folder: Column) -> Column:
    return F.when(folder == "PARTE1", 1).when(folder == "PARTE2", 2)


def origin_label(folder: Column, file_name: Column) -> Column:
    """"Carpeta 2 · Parte 1 · pág. 17"; null for an unknown folder."""
    part = F.when(folder_part(folder).isNotNull(), F.concat(F.lit("Parte "), folder_part(folder).cast("string")))
    page = F.coalesce(trailing_page(file_name).cast("string"), file_name)
    label = F.concat_ws(
        " · ",
        F.concat(F.lit("Carpeta "), folder_number(folder).cast("string")),
        part,
        F.concat(F.lit("pág. "), page),
    )
    return F.when(folder.isin(*FOLDERS), label)


def capitalized(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def grid_position(kind: Column, row: Column, col: Column) -> Column:
    """"Complementaria · casilla 1·2" from zero-based row and column; null when nothing is known."""
    cell = F.concat(F.lit("casilla "), (row + 1).cast("string"), F.lit("·"), (col + 1).cast("string"))
    return F.nullif(F.concat_ws(" · ", capitalized(F.nullif(kind, F.lit(""))), cell), F.lit(""))


LOCAL_ZONE = "America/Asuncion"


def local_time(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    """UTC timestamp as dd/MM/yyyy HH:mm in the local zone, a dash when missing."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(ts, zone), "dd/MM/yyyy HH:mm"), F.lit("—"))


def page_kind(text: Column) -> Column:
    """Page type from its text; the first rule that applies wins."""
    t = F.upper(text)

    def has(s: str) -> Column:
        return t.contains(s)

    return (
        F.when(has("ANEXO") & ~has("RUBRO"), ANEXO)
        .when(has("RUBRO 2") | has("GUÍA DE TRASLADO") | has("GUIA DE TRASLADO"), PRINCIPAL)
        .when(has("CERTIFICADO") & has("SANITARIO"), CERTIFICADO)
        .otherwise("DESCONOCIDO")
    )


def number_from_file_name(name: Column) -> Column:
    """Digits after "GE" (six or more), else the first run of seven or more digits."""
    first = F.nullif(F.regexp_extract(name, r"(?i)GE\s*(\d{6,})", 1), F.lit(""))
    return F.coalesce(first, F.nullif(F.regexp_extract(name, r"(\d{7,})", 1), F.lit("")))


def _code_page_extras() -> tuple[str, str]:
    """Characters the 1252 code page keeps outside Latin-1, with the byte each one becomes."""
    chars, codes = [], []
    for byte in range(0x80, 0xA0):
        try:
            chars.append(bytes([byte]).decode("cp1252"))
            codes.append(chr(byte))
        except UnicodeDecodeError:
            continue
    return "".join(chars), "".join(codes)


_EXTRA_CHARS, _EXTRA_CODES = _code_page_extras()
# fixed values: typographic signs replaced by plain ones (the ellipsis becomes three dots)
TYPOGRAPHIC, PLAIN = "—–‘’“”", "--''\"\""


def restricted_text(c: Column) -> Column:
    """Text limited to the 1252 code page: typographic signs made plain, anything outside removed."""
    plain = F.replace(F.translate(c, TYPOGRAPHIC, PLAIN), F.lit("…"), F.lit("..."))
    plain = F.when(c.rlike(f"[{NOT_ASCII}&&[{TYPOGRAPHIC}…]]"), plain).otherwise(c)  # translating goes through every character
    kept = F.regexp_replace(plain, f"[{NOT_ASCII}&&[^\\xA0-\\xFF{_EXTRA_CHARS}]]", "")
    return F.when(kept.rlike(f"[{NOT_ASCII}&&[{_EXTRA_CHARS}]]"), F.translate(kept, _EXTRA_CHARS, _EXTRA_CODES)).otherwise(kept)
