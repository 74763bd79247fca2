"""Column functions against literal expectations."""

from pyspark.sql import functions as F

from stampbook.functions import folds, numbers, text
from stampbook.sources.delimited import map_headers, sniff_separator


def apply(spark, fn, rows, cols="a string"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], cols)
    return [r[0] for r in df.select(fn(*[F.col(c) for c in df.columns]).alias("x")).collect()]


def test_labels_and_slug(spark):
    assert apply(spark, text.normalize_label, ["Nº de Marca", "CI / RUC", "  Código   de  Establecimiento ", "ﬁn ½ a—b"]) == [
        "no de marca", "ci ruc", "codigo de establecimiento", "fin 12 ab"]
    assert apply(spark, text.slug, ["Hoja 03 – Estancia Ñandú", "¡!"]) == ["HOJA-03-ESTANCIA-NANDU", "HOJA"]


def test_number_words(spark):
    words = ["SESENTA Y SEIS", "cincuenta y dos", "CIENTO VEINTITRÉS", "VEINTIUN", "DIEZ", "algo raro", "", "Y", "cero"]
    assert apply(spark, numbers.words_to_number, words) == [66, 52, 123, 21, 10, None, None, None, 0]


def test_eight_digits_and_confusions(spark):
    got = apply(spark, lambda c: text.eight_digit_numbers(c, "80000001"), ["a12345678b 123456789 80000001,87654321"])
    assert got == [["12345678", "87654321"]]
    assert apply(spark, text.digits_only, ["9O94-726l"]) == ["90947261"]


def test_near_equal(spark):
    pairs = [("12345678", "12345679"), ("12345678", "12345687"), ("1234", "1234"), ("12", "123"), ("abcd", "badc"), ("1234", "4231")]
    assert apply(spark, numbers.near_equal, pairs, "a string, b string") == [True, True, False, False, False, False]


def test_rereading(spark):
    pairs = [("HUGOALBERTO", "HUGO ALBERTO"), ("HUGO", "JUAN"), ("", "x"), ("ABC", " ")]
    assert apply(spark, text.accept_rereading, pairs, "a string, b string") == ["HUGO ALBERTO", "HUGO", "", "ABC"]


def test_origin_labels(spark):
    rows = [("L3210", "0030.jpg"), ("PARTE1", "p1_0017.jpg"), ("PARTE2", "p2_0003.jpg"), ("L5290", "0349.jpg"), ("X", "1.jpg"), ("L3210", "sin")]
    assert apply(spark, text.origin_label, rows, "a string, b string") == [
        "Carpeta 1 · pág. 30", "Carpeta 2 · Parte 1 · pág. 17", "Carpeta 2 · Parte 2 · pág. 3", "Carpeta 2 · pág. 349", None,
        "Carpeta 1 · pág. sin"]
    assert apply(spark, text.folder_part, ["PARTE1", "L5290"]) == [1, None]


def test_position_kind_and_file_number(spark):
    got = apply(spark, text.grid_position, [("COMPLEMENTARIA", 0, 1), (None, 2, 3), ("", None, None)], "a string, b int, c int")
    assert got == ["Complementaria · casilla 1·2", "casilla 3·4", None]
    assert apply(spark, text.page_kind, ["Anexo 1", "RUBRO 2 anexo", "Certificado Sanitario", "x"]) == [
        "GE2_ANEXO", "GE2_PRINCIPAL", "SENACSA_CERTIFICADO", "DESCONOCIDO"]
    assert apply(spark, text.number_from_file_name, ["Guia ge 123456.pdf", "1234567_ge.pdf", "12.pdf"]) == ["123456", "1234567", None]


def test_restricted_text(spark):
    assert apply(spark, text.restricted_text, ["a—b ‘c’ “d”… ñ Ω€"]) == ["a-b 'c' \"d\"... ñ \x80"]


def test_parsing_and_codes(spark):
    assert apply(spark, numbers.safe_int, [" 12 ", "1x", "", None]) == [12, None, None, None]
    assert [str(d) if d else None for d in apply(spark, numbers.safe_date, ["2024-02-29", "2024-02-30", "29/02/2024"])] == ["2024-02-29", None, None]
    assert apply(spark, numbers.truth_word, ["Sí", " TRUE", "no", None]) == [True, True, False, False]
    assert apply(spark, numbers.integral_text, [(80020081.0,), (1.5,)], "a double") == ["80020081", "1.5"]
    assert apply(spark, numbers.mark_code, [(7,), (123456,)], "a long") == ["M-00007", "M-123456"]
    assert apply(spark, numbers.code_suffix, ["M-00042", "abc"]) == [42, None]


def test_local_time(spark):
    df = spark.sql("select timestamp'2024-07-01 12:00:00' a union all select cast(null as timestamp)")
    assert [r[0] for r in df.select(text.local_time(F.col("a"))).collect()] == ["01/07/2024 08:00", "—"]


def run_by_hand(positions, tolerance=0.15):
    """Longest stretch found by trying every place a stretch can open, in order."""
    pts = sorted(positions)
    if len(pts) < 3:
        return positions
    gaps = [y - x for x, y in zip(pts, pts[1:])]
    opened, best = [0], (0, 1)
    for k in range(1, len(gaps)):
        if abs(gaps[k] - gaps[opened[-1]]) > tolerance * gaps[opened[-1]]:
            opened.append(k)
    for s, e in zip(opened, [*opened[1:], len(gaps)]):
        if e - s > best[1]:
            best = (s, e - s)
    return pts[best[0]:best[0] + best[1] + 1]


def test_regular_run(spark):
    import random

    rnd = random.Random(3)
    rows = [([0.0, 3.0, 10.0, 20.0, 30.0, 41.0, 100.0],), ([1.0, 2.0],), ([],)]
    rows += [([float(rnd.randint(0, 60)) for _ in range(rnd.randint(3, 14))],) for _ in range(300)]
    got = apply(spark, folds.longest_regular_run, rows, "a array<double>")
    assert got[0] == [10.0, 20.0, 30.0, 41.0]
    assert got == [run_by_hand(r[0]) for r in rows]


def test_headers(spark):
    heads = ["Nº de Marca", "Nombre y Apellido / Razón Social", "CI/RUC", "Establecimiento", "Cod. Establecimiento", "Peso vivo"]
    taken, ignored = map_headers(heads)
    assert taken == {0: "codigo", 1: "propietario", 2: "documento", 3: "establecimiento", 4: "establecimiento_codigo"}
    assert ignored == ["Peso vivo"]
    assert map_headers(["Marca", "Código", "Nombre"])[1] == ["Código"]
    assert sniff_separator('a;b;"x,y,z"') == ";" and sniff_separator("solo") == ","
