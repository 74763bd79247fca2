"""Language model, decontamination, divergence: against brute force, and on held-out labels."""

import collections
import math
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stampbook.llm import decontaminate, language_model
from stampbook.llm.decontaminate import common_subsequence, contaminated
from stampbook.llm.divergence import counted, quality
from stampbook.llm.language_model import classified, perplexities
from support import WORD, documents, prose, speech

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LABELS = "doc_id long, quality int, toxic int"


class Brute:
    """Interpolated modified Kneser-Ney over characters, from its definition."""

    def __init__(self, texts, order=4):
        self.order = order
        top = collections.Counter()
        for t in texts:
            s = "\x02" * (order - 1) + self.units(t)
            top.update(s[i : i + order] for i in range(len(s) - order + 1))
        self.counts = {order: top}
        for k in range(order - 1, 0, -1):
            self.counts[k] = collections.Counter(g[1:] for g in self.counts[k + 1])
        self.d = {}
        for k, c in self.counts.items():
            n = collections.Counter(c.values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
            self.d[k] = [max(0.05, min(i - 0.05, i - (i + 1) * y * n[i + 1] / n[i])) if n[i] and n[i + 1] else 0.5 for i in (1, 2, 3)]
        self.by = {k: collections.defaultdict(dict) for k in self.counts}
        for k, c in self.counts.items():
            for g, n in c.items():
                self.by[k][g[:-1]][g] = n

    @staticmethod
    def units(t):
        raw = t.encode("utf-16-le")
        return "".join(chr(raw[i] + 256 * raw[i + 1]) for i in range(0, len(raw), 2))

    def p(self, g):
        k = len(g)
        if not k:
            return 1 / (len(self.counts[1]) + 1)
        seen = self.by[k].get(g[:-1])
        if not seen:
            return self.p(g[1:])
        cut = lambda n: self.d[k][min(n, 3) - 1]
        total = sum(seen.values())
        own = (seen[g] - cut(seen[g])) / total if g in seen else 0
        return own + sum(map(cut, seen.values())) / total * self.p(g[1:])

    def bits(self, t):
        s = "\x02" * (self.order - 1) + self.units(t)
        return -sum(math.log2(self.p(s[i : i + self.order])) for i in range(len(s) - self.order + 1))


def test_perplexities_against_the_definition(spark, monkeypatch):
    monkeypatch.setattr(language_model, "BLOCK_BYTES", 2000)  # several blocks
    train = {"en": [prose(i, 30) for i in range(8)], "de": ["aäb äß " * 5, "中文 mit 😀", ""], "": ["x"]}
    test = [(1, "the same", "en"), (2, prose(3, 20), "en"), (3, "äß 中 unseen Q", "de"), (4, "", "en"), (5, None, "en"), (6, "none", "fr"), (7, "xx", ""), (8, prose(9, 400), "en")]
    rows = [(100 * k + i, t, lang) for k, (lang, ts) in enumerate(train.items()) for i, t in enumerate(ts)]
    counts = documents(spark, rows).select("lang", "text").mapInArrow(language_model._count, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    docs = documents(spark, test).select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    got = {r.doc_id: r for r in perplexities(docs, counts).collect()}
    models = {lang: Brute(ts) for lang, ts in train.items()}
    for doc, text, lang in test:
        if lang in models and text:
            assert got[doc].bits == pytest.approx(models[lang].bits(text), rel=1e-6), doc
            assert got[doc].n_chars == len(text.encode("utf-16-le")) // 2
        else:
            assert got[doc].bits in (None, 0.0)
    g = next(iter(models["en"].by[4]))
    symbols = list(models["en"].counts[1])
    assert sum(models["en"].p(g + c) for c in symbols) + models["en"].p(g + "￿") == pytest.approx(1, abs=0.02)


def test_classifier_on_held_out_labels(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    known = {r.doc_id: r.quality for r in labels.collect()}
    half = labels.where("doc_id % 2 = 0")  # trains on half of the labels
    kept = {r.doc_id: r.kept for r in classified(docs, half).collect()}
    assert len(kept) == docs.count()
    good = [kept[d] for d, q in known.items() if q == 1 and d % 2]
    bad = [kept[d] for d, q in known.items() if q == 0]
    assert sum(good) >= 0.85 * len(good) and sum(bad) <= 0.4 * len(bad)


def junk_kind(text):
    w = text.split()
    if sum(x == y for x, y in zip(w, w[1:])) > 0.5 * len(w):
        return "one word repeated"
    if len(set(w)) < 0.2 * len(w):
        return "phrases repeated"
    if sum(c in "#*$%&" for c in text) > 0.03 * len(text):
        return "symbols"
    return "tables" if "|" in text else "capitals" if sum(c.isupper() for c in text) > 0.3 * len(text) else "short"


def test_classifier_on_every_kind_of_junk(spark):
    folder = os.path.join(os.path.dirname(DATA), "sf0.1")
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    kept = {r.doc_id: r.kept for r in classified(docs.repartition(8), labels.where("doc_id % 4 <> 0")).collect()}
    clean = [kept[r.doc_id] for r in labels.where("doc_id % 4 = 0 AND quality = 1 AND toxic = 0").collect()]
    assert sum(clean) >= 0.97 * len(clean)
    kinds = collections.defaultdict(list)
    for r in docs.join(labels.where("quality = 0").select("doc_id"), "doc_id").collect():
        kinds[junk_kind(r.text or "")].append(kept[r.doc_id])
    left = {k: sum(v) / len(v) for k, v in kinds.items() if len(v) >= 20}
    assert set(left) == {"one word repeated", "phrases repeated", "symbols", "tables", "capitals"}
    assert max(left.values()) <= 0.3, left
    assert sum(map(sum, kinds.values())) <= 0.1 * sum(map(len, kinds.values()))


def test_classifier_edges(spark):
    rows = [(i, prose(i % 7, 40), "en") for i in range(40)] + [(50, "#%&|$ 0x9 " * 30, "en"), (51, None, "en"), (52, "", "en"), (53, "q", None), (None, prose(3, 40), "en"), (1, prose(1, 40), "en"), (1, prose(1, 40), "en"), (54, (prose(2, 40) + " ") * 500, "en")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(None, 1, 0), (31, 1, 1), (32, 0, 0), (33, None, None), (5, 0, 0)], LABELS).withColumn("text", F.lit(1))
    got = classified(documents(spark, rows), labels).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id: r.kept for r in got}
    assert not kept.pop(50) and all(kept.values())
    none = spark.createDataFrame([], LABELS)
    assert all(r.kept for r in classified(documents(spark, rows), none).collect())
    assert classified(documents(spark, []), labels).count() == 0


@pytest.mark.parametrize("at_once", [7, 100])
def test_all_trusted_documents_train(spark, monkeypatch, at_once):
    rows = [(i, prose(i % 9, 30 + i)) for i in range(60)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(48)], LABELS)
    whole = sorted((r.doc_id, round(r.perplexity, 9), r.kept) for r in classified(documents(spark, rows), labels).collect())
    monkeypatch.setattr(language_model, "IDS_AT_ONCE", at_once, raising=False)
    monkeypatch.setattr(language_model, "MAX_TRUSTED", 7, raising=False)  # the bound there was
    got = sorted((r.doc_id, round(r.perplexity, 9), r.kept) for r in classified(documents(spark, rows), labels).collect())
    assert got == whole


def items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("word", F.lit(2))


def test_decontamination_finds_planted_passages(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 8)  # several blocks
    r = random.Random(4)
    bench = [speech(i % 3, i, r.randint(15, 60)) + ". The " + speech(i % 3, 200 + i, 5) + "." for i in range(20)]
    bench += [None, "", "...", speech(1, 500, 150)]
    rows, planted = [], {}
    for i in range(120):
        words = speech(i % 3, 1000 + i, r.randint(1, 300)).split()
        kind = i % 4
        if kind < 3 and i % 5 == 0:
            k = r.randrange(20)
            w = bench[k].split()
            if kind == 1:  # other case and marks
                w = [x.upper() + "," for x in w]
            if kind == 2:  # a paraphrase: some words changed or gone
                for _ in range(len(w) // 8):
                    w[r.randrange(len(w) - 6)] = "other"
                del w[r.randrange(len(w) - 6)]
            at = r.randint(0, len(words))
            words[at:at] = w
            planted[i] = k
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, bench[-1]), (203, "one two " + " ".join(bench[3].split()[:4])), (None, bench[0]), (204, speech(1, 3000, 9000) + " " + bench[7])]
    got = contaminated(documents(spark, rows), items(spark, bench)).collect()
    assert len(got) == len(rows)
    found = {x.doc_id: x.item_id for x in got if x.contaminated}
    assert found == {**planted, 202: 23, None: 0, 204: 7}


def test_latent_space_is_fitted_on_all_documents(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SAMPLE_DOCUMENTS", 3, raising=False)  # the bound there was
    rows = [(i, prose(i % 11, 20 * i, 90)) for i in range(40)] + [(50, None), (51, ""), (52, "qq zz")]
    words = np.unique(decontaminate.plain_words(pa.array([prose(2, 60, 90) + " " + prose(3, 60, 90)]))[0])
    weight, basis = np.linspace(0.5, 3, len(words)), np.random.default_rng(1).standard_normal((len(words), 5))
    passages = []
    for _, text in rows:
        col = decontaminate._columns(decontaminate.plain_words(pa.array([text or ""]))[0], words)
        for a in range(0, len(col), 64):
            passages.append(np.bincount(col[a : a + 64][col[a : a + 64] >= 0], minlength=len(words)) * weight)
    a = np.array(passages)
    docs = documents(spark, rows).withColumn("text", F.coalesce("text", F.lit("")))
    assert np.allclose(decontaminate._corpus_product(docs, basis, words, weight), a.T @ (a @ basis), rtol=1e-4, atol=1e-2)


def test_candidate_recall_against_brute_force(spark):
    """Cosine candidates in the latent space hold at least nine of ten pairs that subsequences confirm."""
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    norm = lambda t: re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", " ", (t or "").lower()).split()
    bench = {x.item_id: norm(x.text) for x in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    true = set()
    for d in docs.collect():
        w = norm(d.text)
        for item, q in bench.items():
            for a in range(0, max(1, len(w) - 16), 16):
                if common_subsequence(w[max(0, a - 16) : a + 80 + len(q) // 2], q) >= 0.8 * len(q):
                    true.add((d.doc_id, item))
                    break
    got = {(x.doc_id, h.item_id) for x in contaminated(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect() for h in x.hits}
    assert len(true) >= 3 and len(true & got) >= 0.9 * len(true)


def test_recall_of_short_items_in_long_documents(spark):
    """A full block of short items: at least nine of ten exact copies inside long documents of the same words are found."""
    r = random.Random(8)
    words = [prose(k, 3000, 6000).split() for k in range(2)]
    said = lambda k, n: [r.choice(words[k]) for _ in range(n)]
    bench = [" ".join(said(i % 2, r.randint(11, 22))) + ". The " + " ".join(said(i % 2, 3)) + "." for i in range(decontaminate.BLOCK)]
    rows = []
    for i, item in enumerate(bench):
        text = said(i % 2, r.randint(300, 900))
        at = r.randint(0, len(text))
        text[at:at] = item.split()
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(r.choice(bench).split()[:5] * 60)) for i in range(200)]  # repeated words outweigh other text
    got = {(x.doc_id, h.item_id) for x in contaminated(documents(spark, rows, clash=False), items(spark, bench)).collect() for h in x.hits}
    true = {(i, i) for i in range(len(bench))}
    assert len(true & got) >= 0.9 * len(true)
    assert all(doc < 1000 for doc, _ in got)


def test_recall_of_paraphrases_without_a_common_run(spark):
    """Every third word another one: no run of four words is left, so only the latent space can find them; brute force confirms all."""
    r = random.Random(12)
    words = prose(5, 4000, 3000).split()
    bench = [" ".join(r.choice(words) for _ in range(r.randint(36, 64))) for _ in range(150)]
    rows = []
    for i, item in enumerate(bench):
        w = item.split()
        w = [x if k % 3 else r.choice(words) for k, x in enumerate(w)]
        text = [r.choice(words) for _ in range(r.randint(50, 400))]
        at = r.randint(0, len(text))
        text[at:at] = w
        rows.append((i, " ".join(text)))
    rows += [(1000 + k, " ".join(r.choice(words) for _ in range(300))) for k in range(150)]
    want = {(i, i) for i, item in enumerate(bench) if common_subsequence(rows[i][1].split(), item.split()) >= 0.6 * len(item.split())}
    docs = documents(spark, rows, clash=False)
    got = {(x.doc_id, h.item_id) for x in contaminated(docs, items(spark, bench), sure=0.6).collect() for h in x.hits}
    assert len(want) > 140 and len(want & got) >= 0.9 * len(want)
    assert all(doc < 1000 for doc, _ in got)


def test_decontamination_of_empty_tables(spark):
    assert contaminated(documents(spark, []), items(spark, ["a b c"])).count() == 0
    assert [x.contaminated for x in contaminated(documents(spark, [(1, "a b c")]), items(spark, [])).collect()] == [False]


def test_common_subsequence():
    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.randrange(4) for _ in range(r.randint(0, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert common_subsequence(a, b) == t[-1][-1]


def base(text):
    w = WORD.findall(text or "")
    n = len(w)
    windows = [tuple(w[i : i + 8]) for i in range(n - 7)]
    often, gone = collections.Counter(windows), [0] * n
    for i, x in enumerate(windows):
        if often[x] > 1:
            gone[i : i + 8] = [1] * 8
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), sum(gone), n < 20 or 100 * sum(gone) > 30 * n


def test_base_counts_and_divergence(spark):
    r = random.Random(6)
    rows = [(i, prose(i % 4, r.randint(20, 120)), "en") for i in range(60)]
    rows += [(100, "ab\nab\n \nab \nab", "en"), (101, "a b c d e f g h " * 5, "en"), (102, None, "en"), (103, "", None), (104, "😀 ä#* <x> " * 30, "de"), (105, " ".join(prose(2, 60).split()).upper() + "!! " * 3, "en"), (106, "#%&$ " * 60, "en"), (None, prose(1, 40), None), (107, prose(8, 20000), "en")]
    rows += [(108, "\n".join(" ".join(prose(5, 9).split()[:9]) for _ in range(3)) + prose(3, 60), "en")] * 2
    got = quality(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {x.doc_id: x for x in got}
    for doc, text, _ in rows:
        assert tuple(by[doc])[1:7] == base(text), doc
    assert all(by[i].kept == (not by[i].base_failed) for i in range(60))
    assert not by[105].kept and not by[106].kept
    # distances against the definition
    counts = {x.doc_id: x for x in counted(documents(spark, rows)).collect()}
    total = [sum(c) for c in zip(*(x.classes for x in counts.values() if x.lang == "en" and not by[x.doc_id].base_failed for _ in range(2 if x.doc_id == 108 else 1)))]
    p, q = ([v / sum(x) for v in x] for x in (counts[105].classes, total))
    js = sum((a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0) for a, b in zip(p, q)) / 2
    assert by[105].class_distance == pytest.approx(math.sqrt(js), abs=1e-9)
    assert quality(documents(spark, [])).count() == 0


def test_words_are_found_in_a_vocabulary():
    r = np.random.default_rng(4)
    for size in (0, 1, 5, 3000):
        vocabulary = np.unique(r.integers(0, 2**64, size, np.uint64))
        words = np.concatenate([r.choice(vocabulary, 400) if size else vocabulary, r.integers(0, 2**64, 400, np.uint64), np.array([0, 2**64 - 1], np.uint64)])
        places = {w: i for i, w in enumerate(vocabulary.tolist())}
        assert decontaminate._columns(words, vocabulary).tolist() == [places.get(w, -1) for w in words.tolist()]


def test_only_words_of_the_benchmark_are_compared(monkeypatch):
    """Candidates are told apart by the words they share with the benchmark; the rest of a text never reaches the comparison."""
    question = "which river of the old valley carries the most water in spring when snow melts above ? the grey one"
    block = decontaminate.passages_of([(7, question)])
    vocabulary = np.unique(block[0]["words"])
    h, at = decontaminate._runs(block[0]["words"], np.array([0, len(block[0]["words"])]), 4)
    order = np.argsort(h, kind="stable")
    table = np.ones((len(vocabulary), 1), np.float32)
    model = {"block": block, "vocabulary": vocabulary, "table": table, "latent": np.ones((1, 1), np.float32), "runs": {4: (h[order], np.zeros(len(h), np.int64), at[order])}}
    compared, real = [], decontaminate.common_subsequence
    monkeypatch.setattr(decontaminate, "common_subsequence", lambda words, of: compared.extend(words) or real(words, of))
    texts = ["one two three " * 9 + question + " four five six" * 9, "one two three " * 40, question.upper()]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(texts), pa.array([0, 0, 0])], ["doc_id", "text", "text_hash"])
    found = [r for b in decontaminate._searched(model, 0.25, 0.35, 0.6, 0.8, 0.5)([batch]) for r in b.to_pylist()]
    assert [(r["doc_id"], r["item_id"], r["score"]) for r in found] == [(1, 7, 1.0), (3, 7, 1.0)]
    assert compared and set(compared) <= set(vocabulary.tolist())
