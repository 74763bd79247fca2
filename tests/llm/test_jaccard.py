import random
import threading

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from stampbook.llm.common import Scratch, written
from stampbook.llm.jaccard import Bands, _common, _compare, _lists, _rarest, _shared, components, near_classes, set_ids, shingle_sets
from support import WORD, documents, prose

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, n=3, percent=90):
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(UP))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, len(s), least.get(find(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets))), key=str)


def near(seed, base, n, edits):
    r = random.Random(seed)
    out = []
    for k in range(n):
        w = base.split()
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"w{seed}x{k}x{r.randrange(99)}"
        out.append(" ".join(w))
    return out


def test_against_brute_force(spark):
    texts = [None, "", " \n", "one", "One", "two words", "TWO words", "a b c", "a b c a b c", "É b", "é b"]
    for seed, size, n, edits in ((1, 200, 25, 6), (2, 60, 20, 2), (3, 30, 15, 1), (4, 12, 10, 1), (5, 500, 8, 14)):
        texts += near(seed, prose(seed, size), n, edits)
    texts += [prose(50 + i, 20) for i in range(20)]
    random.Random(7).shuffle(texts)
    rows = list(enumerate(texts))
    got = near_classes(documents(spark, rows)).collect()
    want = brute(rows)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want
    assert 3 < len({c for _, _, c in want}) < len(rows)


def test_one_large_group_of_loose_copies(spark):
    """Copies of copies: links that no pivot shows, and many pairs of one list that are not similar."""
    r = random.Random(11)
    pool = [prose(77, 120)]
    for k in range(150):
        w = r.choice(pool).split()
        for _ in range(r.randint(1, 4)):
            w[r.randrange(len(w))] = f"k{k}x{r.randrange(9)}"
        pool.append(" ".join(w))
    rows = list(enumerate(pool))
    got = near_classes(documents(spark, rows)).collect()
    want = brute(rows)
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=str) == want
    assert 5 < len({c for _, _, c in want}) < 150


def test_repeated_rows_missing_ids_empty(spark):
    a, b = prose(1, 50), prose(2, 50)
    rows = [(5, a), (5, a), (5, b), (None, a), (3, b), (None, "alone")]
    got = near_classes(documents(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    assert near_classes(documents(spark, [])).count() == 0


def test_bands_hold_all_differences():
    for percent in (80, 90, 95):
        bands = Bands(percent)
        t = percent / 100
        for x in range(1, 400):
            for y in range(x, int(x / t) + 1):
                low, high = bands.band(x), bands.band(y)
                assert high - low in (0, 1)
                least = -(-percent * (x + y) // (100 + percent))  # smallest overlap that reaches the threshold
                assert x + y - 2 * least < bands.blocks(int(low))


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x.id: x["class"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_short_and_long_texts(spark, n, percent):
    """Copies with edits of texts of 10 to 5,000 words."""
    texts = []
    for size in (10, 25, 60, 200, 1000, 5000):
        texts += near(size, prose(size, size), 6, max(1, size // 40)) + [prose(size + k, size) for k in (1, 2)]
    random.Random(3).shuffle(texts)
    rows = list(enumerate(texts))
    got = near_classes(documents(spark, rows), n, percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, n, percent)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_lists_stay_below_the_text(n, percent):
    """Index rows of 16 bytes: at most twice the text, at any length, and every key comes from a filled block."""
    for words in (50, 200, 1000, 5000):
        texts = [prose(words + k, words, 10**4) for k in range(3)]
        batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
        rows = sum(b.num_rows for b in _lists(n, percent)([batch]))
        assert rows * 16 < 2.2 * sum(map(len, texts))


def test_similar_sets_agree_on_a_listed_block():
    bands, r = Bands(80), np.random.default_rng(3)
    for size in (1, 2, 3, 5, 9, 20, 60, 300):
        d = int(bands.differ(np.array([size]), int(bands.band(np.array([size]))[0]))[0])
        assert d < size
        for _ in range(20):
            words = [f"w{x}" for x in r.integers(0, 10**9, size + 4)]
            for cut in range(d // 5 + 1):
                a, b = " ".join(words), " ".join(words[: len(words) - cut])
                keys = [{k for x in _lists(5, 80)([pa.RecordBatch.from_arrays([pa.array([t])], ["text"])]) for k in x.column("key").to_pylist()} for t in (a, b)]
                na, nb = size, max(1, size - cut)
                if 100 * nb >= 80 * na:
                    assert keys[0] & keys[1]


def test_runs_side_by_side_keep_their_tables(spark):
    tables, steps = {}, threading.Barrier(2)

    def work(k):
        with Scratch(spark, f"thread{k}") as scratch:
            tables[k] = written(spark.range(5 + k), "rows")
        steps.wait()
        if k == 0:
            scratch.remove()
        steps.wait()
        if k == 1:
            assert tables[k].count() == 6
            scratch.remove()

    threads = [threading.Thread(target=work, args=(k,)) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    with pytest.raises(Exception):  # noqa: B017
        tables[1].count()


def test_copies_are_listed_once_for_each_task():
    text = " ".join(f"w{i}" for i in range(40))
    batch = pa.RecordBatch.from_arrays([pa.array([text])], ["text"])
    once, many = (sum(b.num_rows for b in _lists(3, 90)([batch] * k)) for k in (1, 50))
    assert once == many > 0


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_shared_keys_keep_every_set_across_batches(size):
    rng = random.Random(5)
    rows = sorted((rng.randrange(40), rng.randrange(4)) for _ in range(90))
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[a : a + size], strict=True)], ["key", "sid"]) for a in range(0, len(rows), size)]
    found = [tuple(r.values()) for b in _shared(batches) for r in b.to_pylist()]
    assert found == sorted({r for r in rows if len({s for k, s in rows if k == r[0]}) > 1})
    assert not sum(b.num_rows for b in _shared([]))


def test_a_run_keeps_no_shuffle_files(spark):
    files = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(files)
    kept = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    with Scratch(spark, "files") as run:
        held = kept()
        for k in range(3):
            written(spark.range(1000).repartition(3 + k, "id"), "dealt")
        assert kept() <= held
    run.remove()
    assert spark.conf.get(files) == before


def test_loose_copies_do_not_meet_pair_by_pair(spark, monkeypatch):
    """Copies that differ by more than links allow share what their pivot lacks: classes met used to grow with the square."""
    from stampbook.llm import jaccard

    tables = {}

    def kept(df, name):
        tables.setdefault(name, []).append(out := written(df, name))
        return out

    monkeypatch.setattr(jaccard, "written", kept)
    r, base = random.Random(9), prose(33, 400).split()
    texts = []
    for k in range(150):
        w = list(base)
        for i in r.sample(range(len(w)), 3 if k < 30 else 16):
            w[i] = f"w{k}x{i}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    got = near_classes(documents(spark, rows)).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=str) == brute(rows)

    def met(members):
        return members.groupBy("pivot", "shingle").agg(F.count_distinct("class").alias("c")).agg(F.sum(F.expr("c * c"))).first()[0]

    before, after = met(tables["differences"][1]), met(tables["ordered"][0])
    assert after < before / 2, (after, before)


def test_known_frequent_shingles_come_last():
    """One pivot's list is looked up once, and every row of that pivot has the same order."""
    base = [f"b{i}" for i in range(30)]
    rows = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in (5, 12, 20)]
    pivot = " ".join(base[:28] + ["y", "z"])
    part = {"a": [1] * 3, "b": [2, 3, 4], "wide": [True] * 3, "text_a": [pivot] * 3, "text_b": rows}
    types = pa.list_(pa.int32())
    plain = pa.RecordBatch.from_pydict({**part, "hot": pa.array([None] * 3, types)})
    common = pa.Table.from_batches(list(_common(1)([plain]))).to_pydict()
    late = [s for _, s in sorted(zip(common["n"], common["shingle"]))]
    assert set(common["n"]) == {3} and len(late) == 4  # y, z, b28 and b29
    hot = pa.array([[s >> 32 for s in late]] * 3, types)
    (ordered,) = _compare(1, 60)([pa.RecordBatch.from_pydict({**part, "hot": hot})])
    for first in ordered.column("first").to_pylist():
        assert len(first) == 6 and first[2:] == late and not set(first[:2]) & set(late)


@pytest.mark.parametrize("limit", [0, 500_000])
def test_sets_that_only_share_a_passage_meet_no_pivot(spark, monkeypatch, limit):
    """They used to be compared with the pivots of all lists they share; their number grew faster than the documents."""
    from stampbook.llm import jaccard

    tables = {}

    def kept(df, name):
        tables.setdefault(name, []).append(out := written(df, name))
        return out

    monkeypatch.setattr(jaccard, "written", kept)
    monkeypatch.setattr(jaccard, "BROADCAST_SETS", limit)  # ids of sets are broadcast, or joined by a shuffle
    passage = prose(1, 120, 10**4)
    texts = [f"{prose(100 + k, 200, 10**4)} {passage} {prose(300 + k, 100, 10**4)}" for k in range(120)]
    texts += near(4, prose(99, 300, 10**4), 5, 6)
    rows = list(enumerate(texts))
    got = near_classes(documents(spark, rows), 5, 80).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=str) == brute(rows, 5, 80)
    listed, left = (t.select("sid").distinct().count() for t in (tables["lists"][0], tables["lists"][-1]))
    assert listed > 100 and left < 20 and tables["pairs"][0].count() < 20 and tables["texts"][0].count() < 20


@pytest.mark.parametrize(("n", "percent"), [(1, 60), (3, 90), (5, 80)])
def test_every_similar_pair_stays_in_a_list(spark, n, percent):
    r, texts = random.Random(8), []
    for size in (4, 9, 15, 40, 150, 600):
        base = prose(size, size, 10**4)
        for k in range(25):
            w = base.split()
            for _ in range(r.randint(0, 1 + size * (100 - percent) // (100 * n))):
                w[r.randrange(len(w))] = f"w{k}x{r.randrange(4)}"
            texts.append(" ".join(w[r.randint(0, 1) :]))
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    listed = rows.mapInArrow(_lists(n, percent), "key long, sid long, cut long").repartition("key").sortWithinPartitions("key", "sid")
    with Scratch(spark, "rarest") as run:
        kept = _rarest(written(listed.mapInArrow(_shared, "key long, sid long, cut long"), "lists")).collect()
    run.remove()
    keys = {}
    for x in kept:
        keys.setdefault(x.sid, set()).add(x.key)
    hashes, first = shingle_sets(pa.array(texts), n)
    sets = {int(s): set(hashes[a:b].tolist()) for s, a, b in zip(set_ids(hashes, first), first[:-1], first[1:])}
    similar = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    assert len(similar) > 50
    assert all(keys.get(a, set()) & keys.get(b, set()) for a, b in similar)
