import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from stampbook.llm.prefix_trie import conversation_trie, rebuilt, sequences, trie

SCHEMA = StructType([StructField("conv_id", LongType()), StructField("turn", LongType()), StructField("role", StringType()), StructField("text", StringType())])
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def table(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for c in ("id", "pos", "item", "bytes", "k", "at", "n", "low", "part", "h", "m", "first", "key"):
        df = df.withColumn(c, F.lit(-1))
    return df


def dialogues(rows, rebuild):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    if not rebuild:
        return own
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[: h[c]] + own[c][h[c] :] for c in own}


def brute(rows, rebuild=True):
    seqs = {c: tuple(x) for c, x in dialogues(rows, rebuild).items()}
    members = defaultdict(set)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].add(c)
    children = defaultdict(set)
    for s in members:
        if s:
            children[s[:-1]].add(s)
    leaves, saved, out = defaultdict(int), defaultdict(int), []
    for s in sorted(members, key=len, reverse=True):
        leaves[s] += not children[s]
        if s:
            saved[s] += (len(members[s]) - 1) * len(s[-1][1].encode())
            leaves[s[:-1]] += leaves[s]
            saved[s[:-1]] += saved[s]
    for s, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(s))
        out.append((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(children[s]), leaves[s], saved[s], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    assert df.columns[: len(COLUMNS)] == COLUMNS
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


def sample(seed, n, longest, words=3):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(3 * n), n):
        for t in range(r.randint(1, longest)):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(["ja", "né", "", None][:words])))
    r.shuffle(rows)
    return rows


def awkward():
    return [(None, 1, "user", "lost"), (7, None, "user", "first"), (7, 1, None, None), (7, 1, None, None), (7, 1, "b", "y"), (7, 1, "b", "x"), (7, 1, "a", "z"), (9, 3, "user", "x" * 5000), (12, 1, "", "")]


@pytest.mark.parametrize("rebuild", [True, False])
def test_against_brute_force(spark, rebuild):
    rows = sample(1, 120, 12) + awkward()
    df = trie(*rebuilt(table(spark, rows))) if rebuild else conversation_trie(table(spark, rows))
    assert got(df) == brute(rows, rebuild)


def test_many_slices_and_blocks(spark):
    """Small blocks and slices: nodes that cross several borders, conversations of many blocks, ends at a block's border."""
    rows = sample(2, 80, 14, 2) + [(500 + c, t, "user", "same") for c in range(30) for t in range(c % 3 * 4 + 4)] + awkward()
    assert got(trie(*sequences(table(spark, rows)), block=4, size=4)) == brute(rows, False)


def test_one_long_dialogue_with_copies(spark):
    rows = [(c, t, "user", f"t{t if t < 700 or c < 3 else -c}") for c in range(5) for t in range(600 + 100 * c)] + [(10, t, "user", f"t{t}") for t in range(512)]
    assert got(conversation_trie(table(spark, rows))) == brute(rows, False)


def test_empty(spark):
    assert trie(*rebuilt(table(spark, []))).count() == 0
    assert conversation_trie(table(spark, [(None, 1, "user", "x")])).count() == 0
