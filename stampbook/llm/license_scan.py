"""License scans: short notices with a few edits, found by exact seeds and verified by bounded-error matching.

A notice that may carry e edits is split into e + 2 pieces: at least two of them stand unchanged in any text that holds the notice with
at most e edits, and at most e characters farther apart or nearer than in the notice. So the pieces are sought as they are, and only
where two of them agree on a place the ``regex`` library matches the whole notice there with bounded errors. Where matches overlap, the one with the fewest edits counts (then the longest, then the first).
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stampbook.llm.common import tidy
from stampbook.llm.textbytes import buffer, slices

#: Letters and digits of a notice for each edit it may carry, and the least length of a piece.
CHARS_PER_EDIT, LEAST_PIECE = 9, 5
#: Edits at most, however long the notice: the cost of a bounded-error match grows steeply with them.
MAX_EDITS = 5

#: Bytes of words as they are compared (A-Z lower-cased), all others as blanks.
KEPT = np.full(256, 0x20, np.uint8)
KEPT[0x30:0x3A] = np.arange(0x30, 0x3A)
KEPT[0x61:0x7B] = np.arange(0x61, 0x7B)
KEPT[0x41:0x5B] = np.arange(0x61, 0x7B)
KEPT[0x80:] = np.arange(0x80, 0x100)


@dataclass(frozen=True)
class Notice:
    """A notice in words, its label, and words of it that may not be edited: those that tell licenses apart, numbers among them."""

    label: str
    text: str
    firm: tuple[str, ...] = ()
    base: bool = False
    edits: int = field(init=False)
    pieces: tuple[tuple[int, bytes], ...] = field(init=False)

    def __post_init__(self):
        n = len(self.text)
        edits = max(0, min(n // CHARS_PER_EDIT, MAX_EDITS, n // LEAST_PIECE - 2))
        parts = edits + 2 if edits else 1
        cuts = [n * i // parts for i in range(parts + 1)]
        object.__setattr__(self, "edits", edits)
        object.__setattr__(self, "pieces", tuple((a, self.text[a:b].encode()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)))


# --- fixed values: the phrases of the base labels ------------------------------------------------
BASE = [
    Notice("mit", "under the mit license", ("mit",), True),
    Notice("apache-2", "apache license version 2", ("apache", "2"), True),
    Notice("cc-by-nc", "cc by nc", ("cc", "by", "nc"), True),
]
#: Further short notices. Texts of well-known licenses begin with or hold these words.
NOTICES = [
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Notice("mit", "released under the mit license", ("mit",)),
    Notice("apache-2", "licensed under the apache license version 2 0", ("apache", "2", "0")),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Notice("bsd", "under the bsd license", ("bsd",)),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Notice("isc", "under the isc license", ("isc",)),
    Notice("gpl-2", "gnu general public license version 2", ("gnu", "2")),
    Notice("gpl-3", "gnu general public license version 3", ("gnu", "3")),
    Notice("lgpl", "gnu lesser general public license", ("gnu", "lesser")),
    Notice("agpl", "gnu affero general public license", ("gnu", "affero")),
    Notice("mpl-2", "mozilla public license version 2 0", ("mozilla", "2", "0")),
    Notice("epl-2", "eclipse public license version 2 0", ("eclipse", "2", "0")),
    Notice("cc-by", "creative commons attribution 4 0 international license", ("attribution", "4", "0")),
    Notice("cc-by-sa", "creative commons attribution sharealike", ("attribution", "sharealike")),
    Notice("cc-by-nc", "creative commons attribution noncommercial", ("attribution", "noncommercial")),
    Notice("cc0", "cc0 1 0 universal public domain dedication", ("cc0", "1", "0")),
    Notice("unlicense", "this is free and unencumbered software released into the public domain"),
]


class Scanner:
    """Notices ready to be sought in a buffer of texts. Every text stands between line ends and its words between single blanks,
    with one blank at either side, so that nothing runs from one text into the next."""

    def __init__(self, notices: list[Notice]):
        self.notices = notices
        self.patterns = [regex.compile(b"(?b)(?:%s){e<=%d}" % (regex.escape(n.text.encode()), n.edits)) for n in notices]
        self.firm = [[f" {w} ".encode() for w in n.firm] for n in notices]

    @staticmethod
    def laid_out(column: pa.Array) -> tuple[bytes, np.ndarray]:
        """(the buffer, start of every text in it)."""
        data, starts = buffer(column)
        low = KEPT[data].tobytes()
        texts = [b" ".join([b"", *low[a:b].split(), b"\n"]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        return b"\n" + b"".join(texts), np.cumsum([1, *map(len, texts)])

    def places(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """(start, end, edits, notice) of all matches: exact ones of base notices, and the best of overlapping others."""
        fuzzy, exact = [], []
        for k, n in enumerate(self.notices):
            whole, seen = n.text.encode(), -1
            starts = []  # (where the notice would begin, piece)
            for i, (offset, piece) in enumerate(n.pieces):
                at = text.find(piece)
                while at >= 0:
                    a = at - offset
                    if n.base and offset == 0 and text[a - 1 : a + len(whole) + 1] == b" %s " % whole:
                        exact.append((a, a + len(whole), 0, k))
                    starts.append((a, i))
                    at = text.find(piece, at + 1)
            starts.sort()
            windows = []
            for x, (a, i) in enumerate(starts):
                y = x + 1
                while n.edits and y < len(starts) and starts[y][0] <= a + n.edits and starts[y][1] == i:
                    y += 1
                if not n.edits or y < len(starts) and starts[y][0] <= a + n.edits:
                    windows.append((a - n.edits - 1, a + len(whole) + 2 * n.edits + 1))
            for a, b in windows:
                a = max(a, seen)  # what lies before has been matched
                while 0 <= a < b:
                    m = self.patterns[k].search(text, max(a, 0), min(b, len(text)))
                    if not m or m.end() == m.start():
                        break
                    s, e = self._whole_words(text, m.start(), m.end())
                    if self._holds(text[s - 1 : e + 1], k):
                        fuzzy.append((s, e, sum(m.fuzzy_counts), k))
                        a = seen = m.end()
                    else:
                        a = m.start() + 1
        best: list[tuple[int, int, int, int]] = []  # by place; they never overlap
        for m in sorted(fuzzy, key=lambda m: (m[2], m[0] - m[1], m[0], m[3])):
            i = bisect.bisect(best, m)
            if (i == 0 or best[i - 1][1] <= m[0]) and (i == len(best) or m[1] <= best[i][0]):
                best.insert(i, m)
        return sorted({*exact, *best})

    @staticmethod
    def _whole_words(text: bytes, a: int, b: int) -> tuple[int, int]:
        """The match without blanks at its ends, and with the rest of the words that it cuts."""
        while a < b and text[a : a + 1] in b" \n":
            a += 1
        while b > a and text[b - 1 : b] in b" \n":
            b -= 1
        while text[a - 1 : a] not in b" \n":
            a -= 1
        while text[b : b + 1] not in b" \n":
            b += 1
        return a, b

    def _holds(self, found: bytes, k: int) -> bool:
        return b"\n" not in found[1:-1] and all(w in found for w in self.firm[k])


RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,last_word:long,edits:int,exact:boolean>>"
SPAN = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("exact", pa.bool_())]))


def scanned(docs: DataFrame, base: list[Notice] = BASE, notices: list[Notice] = NOTICES) -> DataFrame:
    """License notices of every document.

    Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. ``base`` notices count wherever their
    words stand unchanged; those and ``notices`` are also found with up to one edit (a character put in, left out or changed) for
    every ``CHARS_PER_EDIT`` characters, ``MAX_EDITS`` at most, their firm words unchanged. Result: doc_id, n_words, n_base (exact places of base
    notices), first_word and last_word (their smallest and largest first word, from 0; missing if none), base_labels, labels (both
    kinds; distinct, sorted, comma-joined), score (1 - edits / length of the closest match; 0 without one), spans (label, first and
    last word, edits, exact: a base place). A missing text is empty; repeated rows are scanned alike; other columns are ignored;
    an empty table gives an empty result. Texts are scanned whole in the scan stage: nothing is shuffled.
    """
    notices = [*base, *notices]

    def run(batches):
        scanner = Scanner(notices)
        for batch in batches:
            for part in slices(batch):
                text, starts = scanner.laid_out(part.column("text"))
                raw = np.frombuffer(text, np.uint8)
                blanks = np.cumsum(raw == 0x20)  # each text has one blank before every word and one at its end
                n_words = np.maximum(blanks[starts[1:] - 1] - blanks[starts[:-1] - 1] - 1, 0)
                rows = [[] for _ in range(part.num_rows)]
                for a, b, edits, k in scanner.places(text):
                    d = int(np.searchsorted(starts, a, side="right")) - 1
                    before = int(blanks[starts[d] - 1])
                    n = notices[k]
                    rows[d].append((k, int(blanks[a - 1]) - before - 1, int(blanks[b - 1]) - before - 1, edits, n.base and edits == 0 and text[a:b] == n.text.encode()))
                out = []
                for row in rows:
                    exact = [r for r in row if r[4]]
                    own = {notices[r[0]].label for r in exact}
                    score = max((1 - r[3] / len(notices[r[0]].text) for r in row), default=0.0)
                    spans = [{"label": notices[k].label, "first_word": a, "last_word": b, "edits": e, "exact": x} for k, a, b, e, x in row]
                    first = [r[1] for r in exact]
                    out.append((len(first), min(first, default=None), max(first, default=None), ",".join(sorted(own)), ",".join(sorted({notices[r[0]].label for r in row})), score, spans))
                n_base, first, last, own, labels, score, spans = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n_words), pa.array(n_base, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(own, pa.string()), pa.array(labels, pa.string()), pa.array(score, pa.float64()), pa.array(spans, SPAN)],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, RESULT)


@tidy
def op13_license_scan(spark, folder: str) -> DataFrame:
    """Every whole text of documents."""
    return scanned(spark.read.parquet(f"{folder}/documents.parquet")).drop("spans")
