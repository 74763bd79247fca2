"""Quality rules, page audit, near-equal numbers, reading votes and citation checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stampbook.functions.numbers import swapped_at
from stampbook.functions.text import eight_digit_numbers
from stampbook.operators.filters import visible
from stampbook.operators.guides import cited_facts
from stampbook.operators.ordering import Key, all_small, ranked, top_n
from stampbook.operators.relations import usable
from stampbook.schemas import ANEXO, CERTIFICADO, PREFIJOS_CONOCIDOS, PRINCIPAL

# --- fixed values: thresholds of the rules ----------------------------------------------------
LOW_CONFIDENCE = 0.6
NEAR_CONFIDENCE = 0.75
NEAR_BLOCK = 4
PAGE_READING_WEIGHT = 2
INK_MIN, INK_MAX, PIECES_MAX, SIDE_MIN = 0.8, 35.0, 12, 40


def _percent(c: Column) -> Column:
    return F.concat(F.bround(c * 100, 0).cast("long").cast("string"), F.lit("%"))


def classify(features: DataFrame) -> DataFrame:
    """``categoria`` and ``razon`` of what is not a mark; the first rule that applies wins, null when none does."""
    c = F.col
    # fixed values: limits, category names and wording of the rules
    straight = ((c("lineas") >= 0.82) & (c("largo") >= 0.30) & (c("n_comp") <= 6)) | (
        (c("lineas") >= 0.65) & (c("largo") >= 0.40) & (c("vertices") <= 10) & (c("n_comp") <= 8)
    )
    lettering = (c("n_comp") >= 5) & (c("altura_uniforme") >= 0.8) & (c("max_alto") < 0.30) & (c("filas") <= 3)
    rules = [
        ((c("cobertura") < 0.0012) | (c("n_comp") == 0), "vacia", F.lit("casi sin tinta")),
        (c("n_puntos") >= 120, "fragmento", F.concat(F.lit("trama de puntos ("), c("n_puntos").cast("string"), F.lit(" puntitos)"))),
        (straight & (c("diagonal") >= 0.5), "anulacion", F.concat(_percent(c("lineas")), F.lit(" de la tinta es recta e inclinada"))),
        (straight, "linea_de_tabla", F.concat(_percent(c("lineas")), F.lit(" de la tinta es una línea recta"))),
        (lettering, "texto_o_sello",
         F.concat(c("n_comp").cast("string"), F.lit(" letras parejas en "), c("filas").cast("int").cast("string"), F.lit(" fila(s)"))),
        (c("cobertura") < 0.004, "fragmento", F.lit("muy poca tinta")),
    ]
    category, reason = F.lit(None).cast("string"), F.lit("")
    for test, name, text in reversed(rules):
        category = F.when(test, name).otherwise(category)
        reason = F.when(test, text).otherwise(reason)
    return features.withColumns({"categoria": category, "razon": reason})


def quality_flags(features: DataFrame) -> DataFrame:
    """``observaciones`` (array of notes) and ``revisar`` from ink share, loose pieces and size; 0 pieces is an empty cell."""
    c = F.col
    small = F.least("ancho_px", "alto_px")
    empty = (c("ancho_px") == 0) & (c("alto_px") == 0)
    notes = F.array(
        F.when(c("tinta_pct") < INK_MIN, F.format_string("muy poca tinta (%.1f%%): trazo débil o ruido", c("tinta_pct"))),
        F.when(c("tinta_pct") > INK_MAX, F.format_string("demasiada tinta (%.1f%%): sombra o borrón", c("tinta_pct"))),
        F.when(c("componentes") > PIECES_MAX, F.concat(c("componentes").cast("string"), F.lit(" trazos sueltos: posible suciedad"))),
        F.when(small < SIDE_MIN, F.format_string("trazo diminuto (%dx%d px): revisar resolución", "ancho_px", "alto_px")),
    )
    observed = F.when(empty, F.array(F.lit("casilla vacía o trazo no detectado"))).otherwise(F.array_compact(notes))
    return features.withColumn("observaciones", observed).withColumn("revisar", F.size("observaciones") > 0)


def near_between(left: DataFrame, right: DataFrame, block: int = 0) -> DataFrame:
    """Pairs ``(n, m)`` of near-equal texts from two one-column frames (first column of each; values made distinct).

    Texts that differ in one place share exactly one "wildcard" key, and an exchange of neighbours is matched by looking
    up the exchanged text itself, so one equi-join finds all pairs and every joined pair is a result: a key is shared by
    no more texts than there are characters for its open place. The first ``block`` characters have to agree, so no key
    opens a place among them.
    """
    def places(last: Column) -> Column:
        return F.when(last > block, F.sequence(F.lit(block + 1), last)).otherwise(F.array().cast("array<int>"))

    def wildcards(c: Column) -> Column:
        n = F.length(c)
        return F.transform(
            places(n), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.lit("\u0001"), F.substring(c, i + 1, n))
        )

    def swaps(c: Column) -> Column:
        return F.filter(F.transform(places(F.length(c) - 1), lambda i: swapped_at(c, i)), lambda s: s != c)

    a = left.select(F.col(left.columns[0]).alias("n")).where(F.col("n").isNotNull()).distinct()
    b = right.select(F.col(right.columns[0]).alias("m")).where(F.col("m").isNotNull()).distinct()
    a = a.select("n", F.explode(F.concat(wildcards(F.col("n")), swaps(F.col("n")))).alias("_key"))
    b = b.select("m", F.explode(F.concat(wildcards(F.col("m")), F.array("m"))).alias("_key"))
    # the opened keys are many times the texts that the planner measures, so it would broadcast far more than it means to
    return a.join(b.hint("merge"), "_key", "inner").where(F.col("n") != F.col("m")).select("n", "m")


def near_pairs(df: DataFrame, column: str, block: int | None = None) -> DataFrame:
    """Near-equal pairs inside one column, in both directions; ``block`` keeps pairs with that many equal first characters."""
    numbers = df.select(column)
    return near_between(numbers, numbers, block or 0)


def cited_numbers(pages: DataFrame, excluded: str | None = None) -> DataFrame:
    """Different eight-digit numbers printed on main pages and annexes."""
    texts = pages.where(F.col("formato").isin(PRINCIPAL, ANEXO)).select(
        F.explode(F.array_distinct(eight_digit_numbers(F.col("texto_ocr"), excluded))).alias("numero_guia")
    )
    return texts.distinct()


def uncovered_citations(pages: DataFrame, excluded: str | None = None) -> DataFrame:
    """Cited numbers no page carries."""
    assigned = pages.select("numero_guia").where(F.coalesce(F.col("numero_guia") != "", F.lit(False))).distinct()
    return cited_numbers(pages, excluded).join(assigned, "numero_guia", "left_anti")


def clashing_certificates(pages: DataFrame) -> DataFrame:
    """Numbers found on different certificates (the file stands in for a missing certificate number).

    More than one different value is the same as smallest <> largest, so no set is built.
    """
    c = F.coalesce(F.nullif(F.col("numero_certificado"), F.lit("")), F.col("archivo"))
    return (
        pages.where(F.coalesce(F.col("numero_guia") != "", F.lit(False)))
        .groupBy("numero_guia").agg(F.min(c).alias("a"), F.max(c).alias("b"))
        .where(F.col("a") != F.col("b")).select("numero_guia")
    )


REPORT = ["carpeta", "archivo", "formato", "numero_guia", "fuente", "conf", "propietario", "motivos", "imagen"]


def audit_pages(
    pages: DataFrame, excluded: str | None = None, prefixes: tuple = PREFIJOS_CONOCIDOS, near_shown: int | None = None
) -> DataFrame:
    """One row per page with something to review and per cited number no page carries; ``motivos`` joined by "; ".

    All near-equal numbers are named, or the first ``near_shown``. Pages without a number need no lookup and skip the join. Facts about a number are one small row each.
    """
    n = F.nullif(F.col("numero_guia"), F.lit(""))
    common = {
        "fuente": F.coalesce("fuente_numero", F.lit("")), "conf": F.nullif(F.col("conf_numero"), F.lit(0.0)),
        "propietario": F.coalesce("propietario", F.lit("")), "imagen": F.coalesce("imagen", F.lit("")),
    }
    bare = pages.where(n.isNull()).withColumns({**common, "numero_guia": F.lit(""), "motivos": F.lit("sin número")})

    numbered = pages.where(n.isNotNull())
    close = near_pairs(numbered, "numero_guia", NEAR_BLOCK)  # no more of them than the number's digits allow
    if near_shown is not None:
        close = top_n(close, ["n"], ["m"], near_shown)
    facts = (
        clashing_certificates(pages).withColumn("_clash", F.lit(True))
        .join(
            close.groupBy(F.col("n").alias("numero_guia")).agg(
                F.array_join(F.array_sort(F.collect_list("m")), ", ").alias("_near")
            ),
            "numero_guia", "full",
        )
    )
    eight = F.col("numero_guia").rlike(r"^\d{8}$")
    prefix = F.substring("numero_guia", 1, 2)
    printed = F.col("_printed")
    # what the text says is read before the join, so the text itself is not shuffled
    read = F.when(
        F.col("formato") == PRINCIPAL,
        F.array_sort(F.array_distinct(F.regexp_extract_all("texto_ocr", F.lit(r"GE2\s*(\d{8})"), F.lit(1)))),
    )
    slim = numbered.select(
        "carpeta", "archivo", "formato", "numero_guia", "fuente_numero", "conf_numero", "propietario", "imagen", read.alias("_printed")
    )
    conf = F.col("conf_numero")
    # fixed values: wording and order of the findings
    reasons = F.array(
        F.when(~eight, "no tiene 8 dígitos").when(~prefix.isin(*prefixes), F.concat(F.lit("prefijo raro ("), prefix, F.lit(")"))),
        F.when((F.col("formato") == CERTIFICADO) & F.col("_clash"), "el mismo número en certificados distintos"),
        F.when(F.col("fuente_numero").startswith("inferido"), "número inferido por vecindad"),
        F.when((conf > 0) & (conf < LOW_CONFIDENCE), F.format_string("lectura poco segura (%.2f)", conf)),
        F.when(F.coalesce(conf, F.lit(0.0)) < NEAR_CONFIDENCE, F.concat(F.lit("casi igual a "), F.col("_near"))),
        F.when(
            (F.size(printed) > 0) & ~F.array_contains(printed, F.col("numero_guia")),
            F.concat(F.lit("el «GE2…» impreso dice "), F.array_join(printed, "/")),
        ),
    )
    judged = (
        slim.join(facts, "numero_guia", "left").withColumn("motivos", F.array_join(F.array_compact(reasons), "; "))
        .where(F.col("motivos") != "").withColumns(common)
    )
    missing = uncovered_citations(pages, excluded)
    assigned = numbered.select("numero_guia")
    like = near_between(missing, assigned).groupBy(F.col("n").alias("numero_guia")).agg(
        F.array_join(F.array_sort(F.collect_list("m")), ", ").alias("_near")
    )
    said = F.lit("citado en el Respaldo de una guía y no está cargado")
    cited = missing.join(like, "numero_guia", "left").select(
        F.lit("").alias("carpeta"), F.lit("").alias("archivo"), F.lit("CITADO_EN_RESPALDO").alias("formato"), "numero_guia",
        F.lit("").alias("fuente"), F.lit(None).cast("double").alias("conf"), F.lit("").alias("propietario"),
        F.concat(said, F.coalesce(F.concat(F.lit(" (¿"), F.col("_near"), F.lit("?)")), F.lit(""))).alias("motivos"),
        F.lit("").alias("imagen"),
    )
    return bare.select(*REPORT).unionByName(judged.select(*REPORT)).unionByName(cited)


def weighted_readings(first: DataFrame, extras: DataFrame) -> DataFrame:
    """Votes in long form (item, valor, peso, pos): the page reading first and counting double, then each extra reading."""
    page = first.select("item", "valor", F.lit(PAGE_READING_WEIGHT).alias("peso"), F.lit(-1).cast("long").alias("pos"))
    return page.unionByName(extras.select("item", "valor", F.lit(1).alias("peso"), F.col("pos").cast("long")))


def vote(readings: DataFrame) -> DataFrame:
    """Winner of each item: most votes, ties to the value seen first. Two combining aggregations, no list per item."""
    counted = readings.groupBy("item", "valor").agg(F.sum("peso").alias("votos"), F.min("pos").alias("_pos"))
    best = F.max_by(F.struct("valor", "votos"), F.struct("votos", (-F.col("_pos")).alias("p")))
    return counted.groupBy("item").agg(best.alias("_b")).select("item", F.col("_b.valor").alias("ganador"), "_b.votos")


def candidates(readings: DataFrame, page: str = "pagina", pos: str = "pos", n: int | None = None) -> DataFrame:
    """The candidates of each page that take part in the vote: all, or the first ``n``."""
    return readings if n is None else top_n(readings, [page], [pos], n, "_k").drop("_k")


def reconcile(first: DataFrame, winners: DataFrame) -> DataFrame:
    """Status of each page after a second reading. ``first`` (pagina, primera), ``winners`` (pagina, ganador)."""
    w = winners.groupBy("pagina").agg(
        F.count("ganador").alias("_n"), F.min("ganador").alias("_lo"), F.max("ganador").alias("_hi")
    )
    n, have = F.coalesce("_n", F.lit(0)), F.coalesce(F.col("primera") != "", F.lit(False))
    status = (
        F.when(have & (F.col("_lo") == F.col("primera")) & (F.col("_hi") == F.col("primera")), "coincide")
        .when(~have & (n == 0), "sin_numero_en_ninguna")
        .when(have & (n == 0), "primera_sin_segunda")
        .when(~have, "encontro_numero_nuevo")
        .otherwise("distinto")
    )
    return first.join(w, "pagina", "left").select(
        "pagina", "primera", F.when(n == 1, F.col("_lo")).alias("segunda"), status.alias("estado")
    )


def existing_operation(new: DataFrame, ops: DataFrame) -> DataFrame:
    """``operacion_existente``: first active operation with the same number and type, null when the new one may be created."""
    known = visible(ops).where(F.coalesce(F.col("numero_guia") != "", F.lit(False))).groupBy(
        "numero_guia", "tipo_operacion"
    ).agg(F.min("id").alias("operacion_existente"))
    return new.join(known, ["numero_guia", "tipo_operacion"], "left")


def usability(requests: DataFrame, marks: DataFrame) -> DataFrame:
    """``motivo`` why a requested mark cannot be stamped (no_existe, oculta, de_baja, sin_imagen), null when it can.

    ``requests`` holds (codigo, operacion_id); a hidden mark may still be used by its own operation.
    """
    m = marks.select(
        "codigo", F.lit(True).alias("_known"), F.col("activo").alias("_activo"), F.col("operacion_id").alias("_op"),
        F.col("estado").alias("_estado"), F.col("archivo_png").isNotNull().alias("_img"),
    )
    reason = (
        F.when(F.col("_known").isNull(), "no_existe")
        .when(~F.col("_activo") & ~F.col("_op").eqNullSafe(F.col("operacion_id")), "oculta")
        .when(F.col("_estado") == "baja", "de_baja")
        .when(~F.col("_img"), "sin_imagen")
    )
    return requests.join(m, "codigo", "left").select("codigo", "operacion_id", reason.alias("motivo"))


def dominant_conflicts(marks: DataFrame, new: DataFrame) -> DataFrame:
    """Operations that would hold more than one dominant mark after adding ``new``, hidden marks included."""
    both = marks.select("operacion_id", "tipo").unionByName(new.select("operacion_id", "tipo"))
    return (
        both.where((F.col("tipo") == "dominante") & F.col("operacion_id").isNotNull())
        .groupBy("operacion_id").agg(F.count(F.lit(1)).alias("dominantes")).where(F.col("dominantes") > 1)
    )


def cited_marks(cited: DataFrame, marks: DataFrame, pages: DataFrame, ops: DataFrame, n: int | None = None) -> DataFrame:
    """Usable marks of each cited guide (all, or the first ``n``), reached through their page or their operation, dominant first."""
    numbers = cited.where(F.col("cod") == "G").select(F.col("numero").alias("numero_guia")).distinct()
    shown = ["id", "codigo", "tipo", "estado", *(["descripcion"] if "descripcion" in marks.columns else [])]
    m = usable(marks)

    def through(parents: DataFrame, column: str) -> DataFrame:
        wanted = parents.select(F.col("id").alias(column), "numero_guia").join(numbers, "numero_guia", "left_semi")
        return m.select("id", column).join(wanted, column, "inner").select("numero_guia", "id")

    reached = through(pages, "escaneo_id").unionByName(through(ops, "operacion_id")).distinct()  # narrow: details come after
    placed = reached.join(m.select(*shown), "id").select("numero_guia", *shown).withColumn("_d", F.when(F.col("tipo") == "dominante", 0).otherwise(1))
    order = [Key("_d"), Key("codigo")]
    if n is None:
        found = ranked(placed, ["numero_guia"], order, "posicion", small=all_small(reached, ["numero_guia"]))
    else:
        found = top_n(placed, ["numero_guia"], order, n, "posicion")
    return found.drop("_d")


def validate_citations(cited: DataFrame, pages: DataFrame, ops: DataFrame) -> DataFrame:
    """``cited`` with ``encontrada``, page and operation facts; brand receipts (B) pass through with null."""
    facts = cited_facts(cited, pages, ops).withColumnRenamed("numero_guia", "numero").withColumn("cod", F.lit("G"))
    guide = F.col("cod") == "G"
    return cited.join(facts, ["cod", "numero"], "left").withColumns(
        {
            "encontrada": F.when(guide, F.coalesce(F.col("paginas") + F.col("operaciones") > 0, F.lit(False))),
            "paginas": F.coalesce("paginas", F.lit(0)),
            "operaciones": F.coalesce("operaciones", F.lit(0)),
        }
    )
