import random
import re

import pyarrow as pa
import pytest
from stampbook.llm.license_scan import BASE, NOTICES, Notice, Scanner, scanned
from support import documents, prose

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def brute(text):
    w = WORDS.findall((text or "").translate(UP))
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def edited(r, text, n):
    t = list(text)
    for _ in range(n):
        i = r.randrange(1, len(t) - 1)
        kind = r.randrange(3)
        if kind == 0:
            t[i] = r.choice("qxz")
        elif kind == 1:
            t.insert(i, r.choice("qxz"))
        else:
            del t[i]
    return "".join(t)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_base_places(spark):
    r = random.Random(1)
    texts = [None, "", " .-", "CC-BY-NC", "cc by nc cc by nc by nc", "accby nc", "Under the MIT License", "under the mit licenses", "under thé mit license", "cc\nby.nc", "x" * 200_000 + " cc by nc " + "é cc by nc " * 3000]
    for k in range(120):
        parts = [prose(k, r.randint(0, 12))]
        for _ in range(r.randint(0, 4)):
            parts.append(r.choice([*PHRASES, "Apache License,\tVersion 2.0", "apache license version 20", "cc by", "nc"]))
            parts.append(prose(k + 1000, r.randint(0, 3)))
        texts.append(r.choice([" ", "\n", "-", "; "]).join(parts))
    rows = list(enumerate(texts))
    got = {x.doc_id: x for x in scanned(documents(spark, [*rows, (None, "cc by nc"), (500, "cc by nc"), (500, "cc by nc")])).collect()}
    assert len(got) == len(rows) + 2
    for d, t in rows:
        x = got[d]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == brute(t), t
        assert set(x.base_labels.split(",")) - {""} <= set(x.labels.split(","))
        assert (x.score == 1.0) if x.n_base else 0 <= x.score <= 1
    assert scanned(documents(spark, [])).count() == 0


def test_edited_notices_are_found_and_others_left(spark):
    r = random.Random(2)
    rows, want = [], {}
    for k, n in enumerate([*BASE, *NOTICES] * 6):
        text = edited(r, n.text, r.randint(0, n.edits)) if n.edits else n.text
        if distance(text, n.text) <= n.edits and all(f" {w} " in f" {text} " for w in n.firm):
            rows.append((k, f"{prose(k, 30)} {text} {prose(k + 7, 30)}"))
            want[k] = n.label
    clean = [(1000 + k, prose(3000 + k, 300)) for k in range(60)]
    clean += [(2000, "under the mpl license"), (2001, "apache license version 1"), (2002, "the general public may license versions of it"), (2003, "cc by nd"), (2004, "gnu general public license version 4")]
    got = {x.doc_id: x for x in scanned(documents(spark, rows + clean)).collect()}
    assert len(want) > 60
    assert [k for k, label in want.items() if label not in got[k].labels.split(",")] == []
    assert [d for d, _ in clean if got[d].labels or got[d].score] == []


def test_spans_name_the_words(spark):
    x = scanned(documents(spark, [(1, "one two under teh MIT license, three")])).collect()[0]
    assert [(s.label, s.first_word, s.last_word, s.edits, s.exact) for s in x.spans] == [("mit", 2, 5, 2, False)]
    assert x.n_base == 0 and x.labels == "mit" and abs(x.score - (1 - 2 / 21)) < 1e-12


def test_matches_never_cross_documents():
    scanner = Scanner(BASE)
    text, _ = scanner.laid_out(pa.array(["x under the", "mit license y"]))
    assert scanner.places(text) == []


@pytest.mark.parametrize("notice", [*BASE, *NOTICES], ids=lambda n: n.text[:20])
def test_pieces(notice: Notice):
    assert len(notice.pieces) == (notice.edits + 2 if notice.edits else 1)
    assert b"".join(p for _, p in notice.pieces).decode() == notice.text
    assert notice.edits == 0 or min(len(p) for _, p in notice.pieces) >= 5
