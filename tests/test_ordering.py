"""Running computations: whole groups and cut-up hot groups must agree with a plain fold."""

import random

import pytest
from pyspark.sql import functions as F

from stampbook.operators import sequence
from stampbook.operators.changes import resolve_owners
from stampbook.operators.ordering import Key, packed, ranked, scan, top_n
from stampbook.operators.paging import paginate, stratified_sample

HOT = [None, 7]


def infer_fold(rows):
    """Left-to-right completion of one folder: rows are [format, number]."""
    rows = [list(r) for r in rows]
    made = []
    for i, (fmt, number) in enumerate(rows):
        before = rows[i - 1] if i else (None, None)
        after = rows[i + 1][1] if i + 1 < len(rows) else None
        if not number and before[1]:
            from_main = fmt == "GE2_ANEXO" and before[0] in ("GE2_PRINCIPAL", "GE2_ANEXO")
            if from_main or before[1] == after:
                rows[i][1] = before[1]
                made.append((i, "inferido:anexo" if from_main else "inferido:vecinas"))
    return [r[1] for r in rows], made


@pytest.mark.parametrize("hot", HOT)
def test_infer_numbers_random(spark, hot):
    rnd = random.Random(11)
    data, expected = [], {}
    for f in range(40):
        n = 60 if f == 0 else rnd.randint(1, 12)
        rows = [(rnd.choice(["GE2_PRINCIPAL", "GE2_ANEXO", "CIEFA_GO2"]), rnd.choice([None, "", "1", "2", None])) for _ in range(n)]
        numbers, made = infer_fold(rows)
        for i, (fmt, num) in enumerate(rows):
            data.append((f"F{f}", f"{i:04d}", i, fmt, num, "ocr" if num else None, 0.9))
            expected[(f"F{f}", i)] = (numbers[i] or None, dict(made).get(i, "ocr" if num else None))
    df = spark.createDataFrame(data, "carpeta string, archivo string, orden int, formato string, numero_guia string, fuente_numero string, conf_numero double")
    got = {(r.carpeta, r.orden): (r.numero_guia or None, r.fuente_numero) for r in sequence.infer_numbers(df, hot).collect()}
    assert got == expected
    assert sum(v[1] is not None and v[1].startswith("inferido") for v in expected.values()) > 20


def test_infer_numbers_fixture(spark):
    rows = [("GE2_PRINCIPAL", "91000001"), ("GE2_ANEXO", None), ("SENACSA_CERTIFICADO", "91000002"), ("CIEFA_GO2", None),
            ("SENACSA_CERTIFICADO", "91000002"), ("CIEFA_GO2", None), ("CIEFA_GO2", "91000003")]
    df = spark.createDataFrame(
        [("A", f"{i}.jpg", i, f, n, "ocr" if n else None, 0.9) for i, (f, n) in enumerate(rows)],
        "carpeta string, archivo string, orden int, formato string, numero_guia string, fuente_numero string, conf_numero double")
    got = [(r.numero_guia, r.fuente_numero) for r in sequence.infer_numbers(df).orderBy("orden").collect()]
    assert got == [("91000001", "ocr"), ("91000001", "inferido:anexo"), ("91000002", "ocr"), ("91000002", "inferido:vecinas"),
                   ("91000002", "ocr"), (None, None), ("91000003", "ocr")]


@pytest.mark.parametrize("hot", HOT)
def test_scan_kinds(spark, hot):
    rnd = random.Random(5)
    data = [("h" if i < 80 else rnd.choice("abc"), rnd.choice([None, 1, 2, 3]), i, rnd.choice([None, rnd.randint(0, 9)])) for i in range(120)]
    df = spark.createDataFrame(data, "g string, a int, id int, v int")
    order = [Key("a", desc=True), Key("id")]
    spec = {"rn": ("row_number", None), "s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v")),
            "b": ("last_before", F.col("v")), "p": ("lag", F.col("v")), "n": ("lead", F.col("v"))}
    got = {r.id: (r.rn, r.s, r.m, r.l, r.b, r.p, r.n) for r in scan(df, ["g"], order, spec, hot).collect()}
    for g in {d[0] for d in data}:
        rows = sorted([d for d in data if d[0] == g], key=lambda d: (d[1] is not None, -(d[1] or 0), d[2]))
        s, m, last = 0, None, None
        for i, (_, _, key, v) in enumerate(rows):
            before = last
            s += v or 0
            m = v if m is None else max(m, v if v is not None else m)
            last = v if v is not None else last
            prev = rows[i - 1][3] if i else None
            nxt = rows[i + 1][3] if i + 1 < len(rows) else None
            assert got[key] == (i + 1, s, m, last, before, prev, nxt)


@pytest.mark.parametrize("hot", HOT)
def test_neighbours_skip_ties(spark, hot):
    rnd = random.Random(2)
    data = [("f" if i < 70 else "g", rnd.randint(0, 30), i) for i in range(90)]
    df = spark.createDataFrame(data, "carpeta string, orden int, id int")
    got = {r.id: (r.anterior_id, r.siguiente_id) for r in sequence.neighbours(df, hot).collect()}
    for c, o, i in data:
        lower = [(x[1], x[2]) for x in data if x[0] == c and x[1] < o]
        upper = [(x[1], x[2]) for x in data if x[0] == c and x[1] > o]
        assert got[i] == (max(lower)[1] if lower else None, min(upper)[1] if upper else None)


@pytest.mark.parametrize("hot", HOT)
def test_gap_clusters(spark, hot):
    rnd = random.Random(9)
    data = [("fijo", v) for v in (10.0, 11.0, 12.5, 20.0)] + [("azar", float(rnd.randint(0, 200))) for _ in range(60)]
    df = spark.createDataFrame(data, "k string, v double")
    rows = sequence.gap_clusters(df, ["k"], "v", 2.0, hot).collect()
    fixed = sorted(r.media for r in rows if r.k == "fijo")
    assert [round(m, 4) for m in fixed] == [11.1667, 20.0]
    values, groups = sorted(v for k, v in data if k == "azar"), []
    for v in values:
        if groups and v - groups[-1][-1] <= 2.0:
            groups[-1].append(v)
        else:
            groups.append([v])
    assert sorted(round(r.media, 6) for r in rows if r.k == "azar") == sorted(round(sum(g) / len(g), 6) for g in groups)


def owners_fold(stored, rows):
    """One row after the other against a growing owner list."""
    owners = [[f"id:{i}", n, d] for i, n, d in stored]
    links = {}
    for row, name, doc in rows:
        hit = next((o for o in owners if doc and o[2] == doc), None) or next((o for o in owners if o[1] == name and o[2] is None), None)
        if hit is None:
            hit = [f"row:{row}", name, doc]
            owners.append(hit)
        elif doc and hit[2] is None:
            hit[2] = doc
        links[row] = hit[0]
    return links, {o[0]: (o[1], o[2]) for o in owners}


@pytest.mark.parametrize("hot", HOT)
def test_resolve_owners_random(spark, hot):
    rnd = random.Random(21)
    stored = [(1, "ana", None), (2, "beto", "10"), (3, "carla", None)]
    rows = [(i, rnd.choice(["ana", "ana", "ana", "beto", "carla", "dora"]), rnd.choice([None, None, *map(str, range(10, 40))])) for i in range(150)]
    links, owners = resolve_owners(
        spark.createDataFrame(stored, "id int, nombre string, documento string"),
        spark.createDataFrame(rows, "row int, nombre string, documento string"), hot)
    want_links, want_owners = owners_fold(stored, rows)
    assert {r.row: r.owner for r in links.collect()} == want_links
    assert {r.owner: (r.nombre, r.documento) for r in owners.collect()} == want_owners


@pytest.mark.parametrize("hot", HOT)
def test_allocate(spark, hot):
    rnd = random.Random(4)
    slots = [(d, c, o, s, rnd.random() < 0.4) for d in (1, 2) for c in ("Original", "Duplicado") for o in range(6) for s in range(5)]
    items = [(d, f"m{i}", i) for d in (1, 2) for i in range(3 if d == 1 else 40)]
    placed, over = sequence.allocate(spark.createDataFrame(items, "doc int, item string, pos int"),
                                     spark.createDataFrame(slots, "doc int, copia string, orden int, slot int, ocupada boolean"), hot)
    got, left, spare = {tuple(r) for r in placed.collect()}, {(r.doc, r.item) for r in over.collect()}, set()
    want = set()
    for d in (1, 2):
        queue = [i for x, i, _ in items if x == d]
        for o in range(6):
            free = {c: [s for dd, cc, oo, s, busy in slots if (dd, cc, oo) == (d, c, o) and not busy] for c in ("Original", "Duplicado")}
            room = min(map(len, free.values()))
            now, queue = queue[:room], queue[room:]
            want |= {(d, item, c, o, s) for c in free for item, s in zip(now, free[c])}
        spare |= {(d, i) for i in queue}
    assert got == want and left == spare and spare


@pytest.mark.parametrize("hot", HOT)
def test_page_roles(spark, hot):
    rows = [("d", 0, "GUIA DE TRASLADO Y TRANSFERENCIA DE GANADO duplicado"), ("d", 1, "Anexo ORIGINAL"), ("d", 2, "ANEXO Original"), ("d", 3, "anexo")]
    rows += [("h", i, "ANEXO Triplicado") for i in range(20)]
    got = {(r.doc, r.page): (r.principal, r.copia, r.orden_anexo) for r in sequence.page_roles(spark.createDataFrame(rows, "doc string, page int, text string"), hot).collect()}
    assert [got[("d", i)] for i in range(4)] == [(True, "Duplicado", None), (False, "Original", 0), (False, "Original", 1), (False, "Original", 2)]
    assert [got[("h", i)][2] for i in range(20)] == list(range(20))


def test_ranked_over_everything_and_packed(spark):
    df = spark.range(100).withColumn("g", F.lit(1))
    rows = ranked(df, [], ["id"], "n", hot_rows=9).collect()
    assert {r.id: r.n for r in rows} == {i: i + 1 for i in range(100)}
    lists = packed(df, ["g"], ["id"], F.col("id"), 30, "ids").orderBy("parte").collect()
    assert [len(r.ids) for r in lists] == [30, 30, 30, 10] and [x for r in lists for x in r.ids] == list(range(100))


def test_pages(spark, monkeypatch):
    from stampbook.operators import paging

    df = spark.range(95).withColumn("k", (F.col("id") % 10).cast("int"))
    order = [Key("k", desc=True), Key("id")]
    want = sorted(range(95), key=lambda i: (-(i % 10), i))
    for take in (50_000, 12):
        monkeypatch.setattr(paging, "TAKE_ROWS", take)
        for page in (1, 3, 5, 10, 99):
            p = paginate(df, order, page, 10)
            at = min(page, 10)
            assert (p.total, p.page, p.last) == (95, at, 10)
            assert [r.id for r in p.rows.collect()] == want[(at - 1) * 10:at * 10]
    assert paginate(df, order, 10**9, 10, clamp=False).rows.count() == 0
    empty = paginate(df.where("id < 0"), order, 4, 10)
    assert (empty.total, empty.page, empty.rows.count()) == (0, 1, 0)


def test_top_n_and_sample(spark):
    df = spark.createDataFrame([(f"{d}/{i}.png",) for d in ("a", "b") for i in range(8)], "path string")
    draw = [sorted(r.path for r in stratified_sample(df, 6, s).collect()) for s in (1, 1, 2)]
    assert draw[0] == draw[1] and [p[0] for p in draw[0]].count("a") == 3
    assert stratified_sample(df, 99, 1).count() == 16
    best = top_n(spark.range(20).withColumn("g", F.col("id") % 2), ["g"], [Key("id", desc=True)], 2)
    assert sorted(r.id for r in best.collect()) == [16, 17, 18, 19]
