import random
import re
from collections import Counter

import numpy as np
import pytest
from stampbook.llm.collocations import Filter, collocations
from support import documents

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top, inside=80):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(UP)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for j in range(1, 5):
                f.update((lang, tuple(w[i : i + j])) for i in range(len(w) - j + 1))
    cand = {k: c for k, c in f.items() if len(k[1]) > 1 and c >= least}
    dropped = set()
    for (lang, p), c in cand.items():
        for j in range(2, len(p)):
            for i in range(len(p) - j + 1):
                if 100 * c >= inside * f[lang, p[i : i + j]]:
                    dropped.add((lang, p[i : i + j]))
    out = {}
    for (lang, p), a in cand.items():
        if (lang, p) not in dropped:
            s, _, l, r = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-s, -a, " ".join(p).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top]))


def sample(seed, n):
    r = random.Random(seed)
    words = ["Ab", "ab", "né", "x", "yz", "long", "r2", "ß", "the", "of"]
    rows = []
    for d in range(n):
        parts = []
        for _ in range(r.randint(0, 25)):
            parts.append(r.choice(["the state of", "of the art", "né à x", r.choice(words), r.choice(words)]))
            parts.append(r.choice([" ", " ", "  ", "\t", ". ", "\n", "\r\n", "\x0b", ", ", " "]))
        rows.append((d, "".join(parts), r.choice(["en", "en", "de", None])))
    return rows


@pytest.mark.parametrize(("least", "top"), [(3, 40), (6, 2000), (30, 7)])
def test_against_brute_force(spark, least, top):
    rows = [*sample(least, 150), (900, None, "en"), (901, "", "de"), (902, " .,\n", None), (903, "the state of " * 4000, "en"), (5, "né à x", "en"), (5, "né à x", "en")]
    got = collocations(documents(spark, rows), least, top).collect()
    assert sorted(map(tuple, got)) == brute(rows, least, top)
    assert len(got) > 5


def test_other_columns_and_empty(spark):
    assert collocations(documents(spark, [])).count() == 0
    assert collocations(documents(spark, [(1, None, None), (2, "a b", "en")])).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_filter_loses_nothing():
    h = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2)
    bits, on = 1 << 17, np.zeros(1 << 17, np.uint8)
    for p in Filter.places(h[:2500], bits):
        on[p] = 1
    known = Filter(bits, np.packbits(on, bitorder="little"))
    assert known(h[:2500]).all() and known(h[2500:]).mean() < 0.05
