import collections

from pyspark.sql import functions as F

from stampbook.llm import mixing
from stampbook.llm.mixing import cycled_weights, measured, mix
from stampbook.operators.numbering import numbered
from support import WORD, documents, prose


def fill(sizes, weights, ceiling=3):
    """Targets by resharing step by step."""
    total, capped = sum(sizes.values()), {}
    while True:
        rest = {s for s in sizes if s not in capped}
        w = sum(weights[s] for s in rest)
        left = total - sum(capped.values())
        out = {s: left * weights[s] / w for s in rest}
        over = [s for s in rest if out[s] > ceiling * sizes[s]]
        if not over:
            return {**capped, **out}
        capped |= {s: ceiling * sizes[s] for s in over}


def taken(docs):
    sized = measured(docs)
    return mix(docs, cycled_weights(sized), sized=sized)


def table(spark):
    rows = [(1000 * k + i, prose(k * 999 + i, 1 + (i * 7 + k) % 60), "en", s) for k, (s, n) in enumerate([("a", 4), ("B", 300), ("c", 250), ("é", 40), (None, 200), ("z", 3)]) for i in range(n)]
    rows += [(9001, None, "en", "c"), (9002, "", "en", "c"), (9003, "only", "en", "tiny"), (None, prose(1, 30), "en", "B"), (1000, prose(999, 1), "en", "B"), (9004, "", "en", "void")]
    return rows


def test_targets_and_shares(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BORDER_ROWS", 0)  # every level of the rank histogram
    rows = table(spark)
    docs = documents(spark, rows)
    got = taken(docs).collect()
    size = lambda t: len(WORD.findall(t or ""))
    sizes = collections.Counter()
    for _, text, _, source in rows:
        sizes[source] += size(text)
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    assert len(got) == len(rows)
    assert sorted((r.doc_id or -1, r["size"]) for r in got) == sorted((d or -1, size(t)) for d, t, _, _ in rows)
    total = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.taken == r["size"] * r.copies and 0 <= r.copies <= 3
        total[r.source] += r.taken
    for s in sizes:
        assert abs(total[s] - want[s]) <= 60  # one document
    again = taken(documents(spark, rows[::-1])).collect()
    key = lambda x: sorted((r.doc_id or -1, r["size"], r.copies) for r in x)
    assert key(got) == key(again)


def test_one_level_and_window_agree(spark):
    docs = documents(spark, table(spark))
    a = taken(docs).collect()
    mixing.BINS, old = 4, mixing.BINS
    try:
        b = taken(docs).collect()
    finally:
        mixing.BINS = old
    key = lambda x: sorted((r.doc_id or -1, r["size"], r.copies) for r in x)
    assert key(a) == key(b)


def test_pareto_inclusion(spark):
    """Every document of a source has the same chance: halves of the source get near the same share."""
    rows = [(i, "w " * 10, "en", "ab"[i % 2]) for i in range(8000)]
    docs = documents(spark, rows, clash=False)
    got = mix(docs, spark.createDataFrame([("a", 3.0), ("b", 5.0)], "source string, weight double")).collect()
    share = collections.Counter((r.source, r.doc_id < 4000) for r in got for _ in range(r.copies))
    assert sum(share.values()) == 8000
    assert abs(share["a", True] - share["a", False]) < 200 and abs(share["a", True] + share["a", False] - 3000) <= 1


def test_empty(spark):
    assert taken(documents(spark, [])).count() == 0
    assert [r.taken for r in taken(documents(spark, [(1, None), (2, "")])).collect()] == [0, 0]


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(5)
    assert sorted((r.n, r.x) for r in numbered(df, [F.col("x")]).collect()) == [(i + 1, i) for i in range(1000)]
