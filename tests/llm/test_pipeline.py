"""Every stage on the smallest tables with awkward rows added, against plain code on the stage's own input."""

import collections
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
tokenizers = pytest.importorskip("tokenizers")

from stampbook.llm.language_model import classified  # noqa: E402
from support import documents, prose  # noqa: E402
from test_jaccard import brute, near  # noqa: E402
from test_mixing import fill  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    out = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(*COLUMNS)
    one = docs.orderBy("doc_id").limit(1)
    extra = spark.createDataFrame([(None, "without an id " * 9, "en", None, 126), (90001, None, None, "src1", None), (90002, "", "en", "src2", 0)], docs.schema)
    docs.unionByName(extra).unionByName(one).repartition(3).write.parquet(f"{out}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{t}.parquet").write.parquet(f"{out}/{t}.parquet")
    return out


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """(name, input, output) of each stage, written and read again as in use."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, folder).write.parquet(path)
        new = spark.read.parquet(path)
        out.append((name, docs, new))
        docs = new
    return out


def test_names_and_columns(stages):
    assert [s[0] for s in stages] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    assert all(s[2].columns == COLUMNS for s in stages[:-1])


def test_quality_stage(spark, folder, stages):
    _, docs, out = stages[0]
    judged = classified(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = {(r.doc_id, r.text_hash) for r in judged.where("kept").collect()}
    hashed = docs.withColumn("x", F.xxhash64(F.coalesce("text", F.lit("")))).collect()
    assert rows_of(out) == sorted((tuple(r)[:5] for r in hashed if (r.doc_id, r.x) in kept), key=str)
    labels = {r.doc_id: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    left = {r.doc_id for r in out.collect()}
    clean = [d for d, r in labels.items() if r.quality == 1 and r.toxic == 0]
    assert sum(d in left for d in clean) >= 0.95 * len(clean)
    assert {90001, 90002} <= left


def test_near_duplicate_stage(stages):
    _, docs, out = stages[1]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    classes = brute(rows, 5, 80)
    want = sorted({d for d, n, c in classes if d == c or n == 0}, key=str)
    assert sorted((r.doc_id for r in out.collect()), key=str) == want


def test_near_duplicate_stage_takes_five_words_and_80_percent(spark):
    r = random.Random(5)
    texts = [t for k in range(6) for t in near(k, prose(k, 120), 6, 4)] + [prose(90 + k, 60) for k in range(10)]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    docs = documents(spark, rows, clash=False)
    want = [d for d, n, c in brute(rows, 5, 80) if d == c or n == 0]
    assert sorted(want) != sorted(d for d, n, c in brute(rows) if d == c or n == 0)
    assert sorted(x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == sorted(want)


def test_decontamination_stage(spark, folder, stages):
    _, docs, out = stages[2]
    norm = lambda t: re.sub(r"\W+", " ", (t or "").lower()).split()
    bench = [norm(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    leaks = {r.doc_id for r in docs.collect() for b in bench if b and " ".join(b) in " ".join(norm(r.text))}
    left = {r.doc_id for r in out.collect()}
    assert leaks and not leaks & left
    grams = {tuple(b[i : i + 5]) for b in bench for i in range(len(b) - 4)}
    clean = {r.doc_id for r in docs.collect() if not any(tuple(w[i : i + 5]) in grams for w in [norm(r.text)] for i in range(len(w) - 4))}
    assert clean <= left


def test_mixing_stage(stages):
    _, docs, out = stages[3]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, longest, taken = collections.Counter(), 0, collections.Counter()
    for r in docs.collect():
        sizes[r.source] += size(r.text)
        longest = max(longest, size(r.text))
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    want = fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    copies = collections.Counter(rows_of(out))
    assert set(copies) <= set(rows_of(docs)) and max(copies.values()) <= 3
    for row, n in copies.items():
        taken[row[3]] += n * size(row[1])
    assert all(abs(taken[s] - want[s]) <= longest for s in sizes)


def test_token_stage(spark, folder, stages):
    import public_tokenizers

    _, docs, out = stages[4]
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [(r.doc_id, zlib.crc32(np.asarray([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for r in docs.collect()]
    got = out.collect()
    assert sorted(((r.doc_id, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    assert sorted(got, key=lambda r: r.start)[-1].start == sum(r.n_tokens for r in got) - max(got, key=lambda r: r.start).n_tokens


def test_every_stage_on_empty_tables_and_clashing_columns(spark, folder, tmp_path):
    """Columns named like those the stages add pass through unchanged; an empty table stays empty and keeps its columns."""
    mine = ["_hash", "_id", "_text", "_copies", "_copy", "text_hash", "copies"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 60 OR doc_id > 90000")
    for c in mine:
        docs = docs.withColumn(c, F.concat(F.lit(c), F.col("doc_id").cast("string")))
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        rows = spark.read.parquet(f"{tmp_path}/{k}").collect()
        assert rows and all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in rows for c in mine)
        none = stage(spark, docs.limit(0), folder)
        assert none.columns == docs.columns and none.count() == 0
    assert corpus_pipeline.token_ids(spark, docs.limit(0), folder).count() == 0
