import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from stampbook.llm import repeats, textbytes
from stampbook.llm.relative_lz import remove_copied_words
from stampbook.llm.suffix_dedup import remove_repeats
from support import WORD, documents, prose


def brute_bytes(rows, length):
    out, seen = {}, set()
    for doc, text in sorted(rows):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[doc] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest(), kept)
    return out


def brute_words(rows, window):
    out, first = {}, {}
    for doc, text in sorted(rows):
        w = WORD.findall(text or "")
        gone = [0] * len(w)
        for i in range(len(w) - window + 1):
            if first.setdefault(tuple(w[i : i + window]), doc) < doc:
                gone[i : i + window] = [1] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[doc] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    base = prose(1, 400)
    passage = prose(2, 40)
    out = [(0, base), (1, base), (2, None), (3, ""), (4, "ab" * 300), (5, "x ä 中😀 " * 60), (6, "x ä 中😀 " * 30)]
    for i in range(7, 60):
        words = prose(i, r.randint(1, 150)).split()
        if i % 2:
            at = r.randint(0, len(words))
            words[at:at] = passage.split()[r.randint(0, 8) :]
        if i % 5 == 0:
            words = base.split()[r.randint(0, 40) : r.randint(60, 300)]
            words[r.randint(0, len(words) - 1)] = f"changed{i}"
        out.append((i, r.choice([" ", "\n", "  "]).join(words)))
    return out


@pytest.mark.parametrize("local_keys", [20_000, 2])
@pytest.mark.parametrize("length,gram", [(30, 10), (100, 24)])
def test_bytes_against_brute_force(spark, rows, length, gram, local_keys, monkeypatch):
    monkeypatch.setattr("stampbook.llm.suffix_dedup.Windows", lambda *a: repeats.Windows(*a, local_keys=local_keys))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in remove_repeats(documents(spark, rows), length, gram).collect()}
    want = brute_bytes(rows, length)
    assert got == want
    assert sum(v[1] for v in want.values()) > 1000


@pytest.mark.parametrize("local_keys", [20_000, 2])
def test_words_against_brute_force(spark, rows, local_keys, monkeypatch):
    monkeypatch.setattr("stampbook.llm.relative_lz.Windows", lambda *a: repeats.Windows(*a, local_keys=local_keys))
    for window, gram in ((12, 5), (30, 15)):
        found = remove_copied_words(documents(spark, rows), window, gram).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in found} == brute_words(rows, window)
        assert all(sum(f.words for f in r.factors) == r.n_removed for r in found)


def test_many_places_of_one_window(spark):
    """A passage between different texts: its border windows differ in every document."""
    passage = prose(9, 30)
    rows = [(i, f"{prose(100 + i, 30)} {passage} {prose(900 + i, 30)}") for i in range(150)]
    got = {r.doc_id: r.n_removed for r in remove_repeats(documents(spark, rows), 60, 20).collect()}
    assert got == {k: v[1] for k, v in brute_bytes(rows, 60).items()}


def test_repeated_rows_and_missing_ids(spark):
    a, b = prose(5, 80), prose(6, 80)
    rows = [(1, a), (1, a), (None, a), (2, b), (2, a)]
    got = sorted(((r.doc_id is None, r.doc_id, r.n_removed, r.n_bytes) for r in remove_repeats(documents(spark, rows)).collect()), key=str)
    n = len(a)
    assert got == sorted([(False, 1, 0, n), (False, 1, 0, n), (True, None, n, n), (False, 2, 0, len(b)), (False, 2, n, n)], key=str)
    got = [(r.doc_id, r.n_removed) for r in remove_copied_words(documents(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(1, 0), (1, 0), (None, 80), (2, 0), (2, 80)], key=str)


def test_empty_table(spark):
    assert remove_repeats(documents(spark, [])).count() == 0
    assert remove_copied_words(documents(spark, [])).count() == 0


def test_winnowed_windows_agree():
    r = random.Random(1)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(0, 90))) for _ in range(60)] + [None]
    data, starts = textbytes.buffer(pa.array(texts))
    w = textbytes.Winnowed(textbytes.BYTE_VALUE[data], starts, 12, 5)
    seen = {}
    covered = 0
    for lo, n, at, text in zip(w.lo, w.n, w.at, w.text):
        for i in range(lo, lo + n):
            s = bytes(data[i : i + 12])
            assert seen.setdefault(s, at - i) == at - i and starts[text] <= i and i + 12 <= starts[text + 1]
            covered += 1
    assert covered == sum(max(0, len(t or "") - 11) for t in texts)


def test_words_of_a_buffer():
    texts = ["a  bc\td", None, "", " x", "é y z"]
    data, starts = textbytes.buffer(pa.array(texts))
    w = textbytes.Words(data, starts)
    got = [[bytes(data[s:e]).decode() for s, e in zip(w.start[a:b], w.end[a:b])] for a, b in zip(w.first[:-1], w.first[1:])]
    assert got == [WORD.findall(t or "") for t in texts]
    assert len(np.unique(w.values(data))) == 6
