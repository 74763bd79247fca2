"""Fields read from page text and OCR lines. Lines are an array of their page row, so nothing is shuffled or paired
outside the row."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stampbook.functions.folds import let
from stampbook.functions.numbers import words_to_number
from stampbook.functions.text import eight_digit_numbers, without_spaces
from stampbook.schemas import ANEXO, CERTIFICADO, PRINCIPAL

# --- fixed values: reading rules of the official forms ----------------------------------------
ROW_SHARE = 0.012
NEAREST_FACTOR = 0.8
X_WEIGHT = 0.2
RE_OVERLEAF = r"(\d{8})DELANVERSO"
RE_CERTIFICATE = r"(?<!\d)(\d{14})(?!\d)"
RE_OWNER = r"^PROPIETARIO[:\.]?(\d{4,9})"
RE_ESTABLISHMENT = r"^ESTABLECIMIENTO[:\.]?(\d{6,12})"
RE_PERSON = r"^[A-ZÁÉÍÓÚÑ ]{5,}$"
RE_NOT_PERSON = r"DEPART|DISTRITO|NOMBRE|CODIGO"
RE_STARRED = r"\*{3,}(\d{1,4})"
RE_ORDER_LABEL = r"N.?DEORDEN|NDEORDEN|GUIAN|ORDEN"
RE_COMPANY = r"S\.?A\.?|S\.?R\.?L|LTDA|INMOBILIARIA"
RE_DATE = r"(\d{2}/\d{2}/\d{4})"
RE_SELLER = (
    r"N°\s*de\s*Orden\s*CI\s*/\s*RUC\s*DV\n(\S+)\s+(\S+)\s+(\S+)\n"
    r"Nombre y Apellido / Razón Social\n([^\n]+)"
)
RE_BUYER = (
    r"(?s)Rubro 7 - Identificación del Adquiriente.*?"
    r"Nombre y Apellido / Razón Social\s*CI\s*/\s*RUC\s*DV\n([^\n]+)"
)
RE_NAME_ID_DIGIT = r"^(.*?)\s+(\d+)(?:\s+(\d+))?$"
RE_TOTAL = r"Total\s*\*+\s*(\d+)"
RE_IN_WORDS = r"(?i)SON:\s*(.+?)\s+ANIMALES?\s+Y\s+(.+?)\s+MARCAS?"
RE_CITATION = re.compile(r"\((B|G)\)\s*([A-Za-z]*[0-9][A-Za-z0-9]*)(?:\s+(\d{2}/\d{2}/\d{4}))?", re.ASCII)
CITATION_SECTION, CITATION_COLUMN, CITATION_END = "Rubro 4", "Respaldo", "Factura de venta"


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def _first(array: Column) -> Column:
    return F.try_element_at(array, F.lit(1))


def _known(value: Column) -> Column:
    """The value as an array of one, empty when it is null."""
    return F.array_compact(F.array(value))


def compact_lines(lines: Column) -> Column:
    """OCR lines with their centre, and their text without spaces in upper case."""
    def centre(line: Column, axis: int) -> Column:
        return F.aggregate(line["caja"], F.lit(0.0), lambda acc, p: acc + p[axis]) / 4

    return F.transform(
        lines,
        lambda l, i: F.struct(
            i.alias("i"), l["texto"].alias("texto"), F.upper(without_spaces(l["texto"])).alias("t"),
            centre(l, 0).alias("cx"), centre(l, 1).alias("cy"), l["conf"].cast("double").alias("conf"), l["caja"].alias("caja"),
        ),
    )


def nearest_label(candidates: Column, labels: Column, x_weight: float = X_WEIGHT) -> Column:
    """The candidate closest to any label by ``|dy| + x_weight·|dx|``; the first candidate when there is no label."""
    def pick(both: Column) -> Column:
        def distance(c: Column) -> Column:
            away = F.transform(both["e"], lambda e: F.abs(e["cy"] - c["cy"]) + F.abs(e["cx"] - c["cx"]) * x_weight)
            return F.coalesce(F.array_min(away), F.lit(9e9))

        best = F.array_min(F.transform(both["c"], lambda c, k: F.struct(distance(c).alias("d"), k.alias("k"))))
        return F.try_element_at(both["c"], best["k"] + 1)

    return let(F.struct(candidates.alias("c"), labels.alias("e")), pick)


def extract_fields(pages: DataFrame, lines: str = "lineas", height: str = "alto", excluded: str | None = None, owner_box: bool = False) -> DataFrame:
    """Number (with source and confidence), certificate, owner, establishment, animals and date of each page.

    ``owner_box`` adds ``caja_propietario``, the corners of the line that a certificate's owner was read from, for a second reading.
    """
    base = pages.withColumn("_l", compact_lines(F.col(lines))).withColumn(
        "_todo", F.array_join(F.transform("_l", lambda l: l["texto"]), "\n")
    )
    flat = F.replace("_todo", F.lit(" "), F.lit(""))
    is_cert = F.col("formato") == CERTIFICADO
    is_guide = F.col("formato").isin("CIEFA_GO2", PRINCIPAL, ANEXO)
    numbers = F.flatten(
        F.transform(
            "_l",
            lambda l: F.transform(
                eight_digit_numbers(l["texto"], excluded),
                lambda n: F.struct(n.alias("n"), l["cx"].alias("cx"), l["cy"].alias("cy"), l["conf"].alias("conf"), l["t"].alias("t")),
            ),
        )
    )
    base = base.withColumns({"_nums": numbers, "_cert": F.when(is_cert, _found(flat, RE_CERTIFICATE))})

    def picked(array: Column, source: Column, factor: float = 1.0) -> Column:
        return F.transform(
            array, lambda x: F.struct(x["n"].alias("n"), source.alias("f"), (x["conf"] * factor).alias("c"))
        )

    overleaf = F.filter(
        F.transform("_l", lambda l: F.struct(F.regexp_extract(l["t"], RE_OVERLEAF, 1).alias("n"), l["conf"].alias("conf"))),
        lambda x: (x["n"] != "") & (x["n"] != F.lit(excluded or "")),
    )
    same_line = F.filter("_nums", lambda x: x["t"].contains("ANVERSO") | x["t"].contains("DATOS"))
    anchors = F.filter("_l", lambda l: l["t"].contains("ANVERSO") | l["t"].contains("DATOSDEL"))
    loose = F.filter("_nums", lambda x: ~F.coalesce(F.col("_cert"), F.lit("")).contains(x["n"]))
    near = nearest_label(loose, anchors, 0.0)
    labels = F.filter("_l", lambda l: l["t"].rlike(RE_ORDER_LABEL))
    by_label = nearest_label(F.col("_nums"), labels)
    certificate_pick = F.coalesce(
        _first(picked(overleaf, F.lit("certificado:anverso"))),
        _first(picked(same_line, F.lit("certificado:linea"))),
        _first(picked(_known(near), F.lit("certificado:cercano"), NEAREST_FACTOR)),
    )
    guide_pick = _first(picked(_known(by_label), F.concat(F.lower("formato"), F.lit(":orden"))))
    owner_line = _first(F.filter("_l", lambda l: l["t"].rlike(RE_OWNER)))
    base = base.withColumns({"_pick": F.when(is_cert, certificate_pick).when(is_guide, guide_pick), "_own": owner_line})
    names = F.filter(
        "_l",
        lambda l: (F.abs(l["cy"] - F.col("_own")["cy"]) < F.col(height) * ROW_SHARE) & (l["cx"] > F.col("_own")["cx"])
        & F.trim(l["texto"]).rlike(RE_PERSON) & ~F.upper(l["texto"]).rlike(RE_NOT_PERSON),
    )
    company = F.try_element_at(F.filter("_l", lambda l: F.upper(l["texto"]).rlike(RE_COMPANY)), F.lit(-1))
    place = _first(F.filter("_l", lambda l: l["t"].rlike(RE_ESTABLISHMENT)))
    starred = F.array_max(F.transform(F.regexp_extract_all(flat, F.lit(RE_STARRED), F.lit(1)), lambda x: x.cast("int")))
    out = {
        "numero_guia": F.col("_pick")["n"],
        "fuente_numero": F.col("_pick")["f"],
        "conf_numero": F.coalesce(F.col("_pick")["c"], F.lit(0.0)),
        "numero_certificado": F.col("_cert"),
        "propietario": F.when(is_cert, F.trim(_first(names)["texto"]))
        .when(F.col("formato") == PRINCIPAL, F.trim(company["texto"])),
        "propietario_documento": F.when(is_cert, _found(F.col("_own")["t"], RE_OWNER)),
        "establecimiento": F.when(is_cert, F.trim(place["texto"])),
        "cantidad_animales": F.when(is_cert, starred),
        "fecha_texto": _found(F.col("_todo"), RE_DATE),
    }
    if owner_box:
        out["caja_propietario"] = F.when(is_cert, _first(names)["caja"])
    return base.withColumns(out).drop("_l", "_todo", "_nums", "_cert", "_pick", "_own")


def extract_header(df: DataFrame, text: str = "texto") -> DataFrame:
    """Order number, seller, buyer, total animals and declared marks of a guide's main page."""
    t = F.col(text)
    words = _found(t, RE_IN_WORDS, 1), _found(t, RE_IN_WORDS, 2)
    buyer = F.trim(_found(t, RE_BUYER))
    matches = buyer.rlike(RE_NAME_ID_DIGIT)
    return df.withColumns(
        {
            "numero_orden": _found(t, RE_SELLER, 1),
            "vendedor_ci_ruc": _found(t, RE_SELLER, 2),
            "vendedor_dv": _found(t, RE_SELLER, 3),
            "vendedor_nombre": F.trim(_found(t, RE_SELLER, 4)),
            "comprador_nombre": F.when(matches, F.trim(F.regexp_extract(buyer, RE_NAME_ID_DIGIT, 1))),
            "comprador_ci_ruc": F.when(matches, F.regexp_extract(buyer, RE_NAME_ID_DIGIT, 2)),
            "comprador_dv": F.when(matches, _found(buyer, RE_NAME_ID_DIGIT, 3)),
            "cantidad_animales": F.coalesce(_found(t, RE_TOTAL).try_cast("int"), words_to_number(words[0])),
            "marcas_declaradas": words_to_number(words[1]),
        }
    )


def citations_in(text: Column, window: int | None = None) -> Column:
    """Cited documents of a guide's section: array of (cod, numero, fecha), each (code, number) once with its first date, in order.

    A section without its end marker goes on to the end of the text, or for ``window`` characters if given. The lists are read and
    freed of repeats with a dictionary over Arrow columns: sorting them inside a row took most of the time of long lists."""
    def cited(t: str | None) -> dict[tuple[str, str], str | None]:
        start = -1 if t is None else t.find(CITATION_SECTION)
        if start < 0:
            return {}
        end = t.find(CITATION_END, start)
        block = t[start : end if end > start else len(t) if window is None else start + window]
        first: dict[tuple[str, str], str | None] = {}
        for code, number, date in RE_CITATION.findall(block, max(0, block.find(CITATION_COLUMN))):
            first.setdefault((code, number), date or None)
        return first

    def read(texts: pa.Array) -> pa.Array:
        offsets, codes, numbers, dates = [0], [], [], []
        for t in texts:
            found = cited(t.as_py())
            codes += [c for c, _ in found]
            numbers += [n for _, n in found]
            dates += found.values()
            offsets.append(len(codes))
        items = pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in (codes, numbers, dates)], ["cod", "numero", "fecha"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)

    return F.arrow_udf(read, "array<struct<cod:string,numero:string,fecha:string>>")(text)


def parse_citations(df: DataFrame, text: str = "texto", name: str = "respaldo", window: int | None = None) -> DataFrame:
    return df.withColumn(name, citations_in(F.col(text), window))


def citations(pages: DataFrame, key: str = "numero_guia", column: str = "respaldo") -> DataFrame:
    """Citations in long form: (key, posicion, cod, numero, fecha). JSON text or an array are both accepted."""
    c = F.col(column)
    if pages.schema[column].dataType.simpleString() == "string":
        c = F.from_json(c, "array<struct<cod:string,numero:string,fecha:string>>")
    return pages.select(key, F.posexplode(c).alias("posicion", "_c")).select(
        key, "posicion", "_c.cod", "_c.numero", "_c.fecha"
    )


# fixed values: operation fields kept in an issued document
SNAPSHOT_FIELDS = (
    "numero_guia", "fecha", "tipo_operacion", "vendedor_nombre", "vendedor_documento", "vendedor_establecimiento",
    "vendedor_establecimiento_codigo", "comprador_nombre", "comprador_documento", "cantidad_animales",
    "categoria_animales", "categoria_animales_original", "tipo_formulario", "revisar",
)
MAX_STAMPED = 150


def snapshot(ops: DataFrame, stamped: DataFrame, max_marks: int = MAX_STAMPED) -> DataFrame:
    """Issued-document snapshot per operation: ``datos`` JSON object and ``marcas`` JSON array in stamping order.

    ``stamped`` holds (operacion_id, pos, codigo, tipo, descripcion, propietario). The issuing form refuses documents with more
    than ``max_marks`` marks; ``rechazado`` tells which those are, their list is given like any other.
    """
    counts = stamped.groupBy("operacion_id").agg(F.count(F.lit(1)).alias("cantidad_marcas"))
    item = F.struct("codigo", "tipo", "descripcion", "propietario")
    lists = stamped.groupBy("operacion_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", item.alias("m")))), lambda x: x["m"]).alias("_m")
    )
    null_kept = {"ignoreNullFields": "false"}
    fields = [f for f in SNAPSHOT_FIELDS if f in ops.columns]
    return (
        ops.select(F.col("id").alias("operacion_id"), F.to_json(F.struct(*fields), null_kept).alias("datos"))
        .join(counts, "operacion_id", "left").join(lists, "operacion_id", "left")
        .select(
            "operacion_id", "datos", F.coalesce("cantidad_marcas", F.lit(0)).alias("cantidad_marcas"),
            (F.coalesce("cantidad_marcas", F.lit(0)) > max_marks).alias("rechazado"),
            F.coalesce(F.to_json("_m", null_kept), F.lit("[]")).alias("marcas"),
        )
    )
