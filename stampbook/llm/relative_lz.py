"""Removal of word windows that occur in an earlier document, as factors relative to all documents before it.

A greedy relative Lempel-Ziv parse takes at each place the longest factor of any one reference, so it needs every place at
which a reference holds a block: on the 10,000 documents of the largest test table 90,067 of 323,505 block places are repeated, and
they make 8.7 million pairs of place and reference (a block occurs up to 1,935 times), which grow with the square of a group of
copies. The answer here does not depend on which document a factor is copied from, only on whether one holds it. So a factor may change
its source from window to window, and one earlier owner of each block is enough:

* the reference is indexed in blocks: the stretch of text whose windows share one representative gram (see ``repeats``), so
  that a block equals another one wherever the text is the same, whatever came before it; its first owner is a minimum;
* a block that an earlier document owns extends a factor as a whole;
* where blocks part, which is where factors end, single windows are looked up: a factor ends at exactly the last repeated word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stampbook.llm.common import tidy
from stampbook.llm.repeats import NO_ID, Windows, covered, keyed, repeated_spans
from stampbook.llm.textbytes import Words, buffer

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, factors array<struct<start: int, words: int>>, kept string"


def remove_copied_words(docs: DataFrame, window: int = 50, gram: int = 25, keep_text: bool = True) -> DataFrame:
    """Per document what is left without every word covered by ``window`` words that also occur in a document with a smaller id.

    Words are split at blanks and kept as they are; a missing text has none. Windows are judged on the input. Result: doc_id,
    n_words, n_removed, kept_sha256 (of the kept words joined by one blank), ``factors`` (maximal removed stretches: first
    word and length) and ``kept`` (missing unless ``keep_text``). A missing doc_id orders last. Rows that repeat a doc_id never
    remove from each other; all rows are returned. An empty table gives an empty result. Other columns are ignored.
    """
    found = repeated_spans(keyed(docs), Windows(True, window, gram, False))
    factor = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())]))

    def finish(batches):
        for batch in batches:
            data, starts = buffer(batch.column("text"))
            w = Words(data, starts)
            raw, rows = data.tobytes(), []
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                a, b = int(w.first[i]), int(w.first[i + 1])
                gone = covered(batch.column("spans"), i, b - a, window)
                keep = np.flatnonzero(~gone) + a
                kept = b" ".join([raw[s:e] for s, e in zip(w.start[keep].tolist(), w.end[keep].tolist(), strict=True)])
                edge = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
                begin = np.flatnonzero(edge == 1)
                factors = [{"start": s, "words": n} for s, n in zip(begin.tolist(), (np.flatnonzero(edge == -1) - begin).tolist(), strict=True)]
                rows.append((None if doc == NO_ID else doc, b - a, int(gone.sum()), hashlib.sha256(kept).hexdigest(), factors, kept.decode() if keep_text else None))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), factor, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256", "factors", "kept"])

    return found.mapInArrow(finish, SCHEMA)


@tidy
def op8_relative_lz(spark, folder: str) -> DataFrame:
    """The whole of documents, at 50 words."""
    return remove_copied_words(spark.read.parquet(f"{folder}/documents.parquet"), keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
