"""Windows of consecutive tokens that also occur earlier, for a whole corpus, without listing pairs of places.

1.  Every window of ``length`` tokens has a representative: the smallest hash among its grams. Two equal windows have the same
    one, so a window can only be repeated if its representative's hash occurs twice. One row per representative is counted;
    hashes that occur once drop out (two passes over the text, so that only hashes are shuffled for the count).
2.  What is left is one row per run of neighbouring windows with the same representative, keyed by (representative, hash of
    the run's tokens). The first place of each key is a minimum, combined before the shuffle. Every other place of the same
    key is repeated as a whole, however many there are.
3.  Keys that share a representative but differ (the borders of copied passages) are compared window by window: the text of
    each key's first place is brought together by representative, the first owner of every window is found, and the windows
    of later keys are marked. Groups of up to ``local_keys`` keys are handled in one task; larger ones by a combining
    aggregation over window hashes, so that no group has to fit anywhere.
4.  Marked windows go back to their documents as intervals.

Equality of runs and windows is equality of a 64-bit hash within the same 64-bit representative hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stampbook.llm.common import written
from stampbook.llm.textbytes import BASE, BYTE_VALUE, Prefix, Winnowed, Words, buffer, mix, slices

#: A missing id orders after all others.
NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Windows:
    """What a window is: ``length`` tokens, found through grams of ``gram`` tokens."""

    words: bool
    length: int
    gram: int
    #: True: an earlier place of the same document counts too.
    same_document: bool
    local_keys: int = 20_000

    def tokens(self, data: np.ndarray, starts: np.ndarray):
        """(value of each token, first token of each text, byte start and end of each token or None for single bytes)."""
        if not self.words:
            return BYTE_VALUE[data], starts, None, None
        w = Words(data, starts)
        return w.values(data), w.first, w.start, w.end

    def winnow(self, column: pa.Array):
        data, starts = buffer(column)
        values, first, lo, hi = self.tokens(data, starts)
        return data, values, first, lo, hi, Winnowed(values, first, self.length, self.gram)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id (missing: last), tid (tells different texts under one id apart), text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.hash("text").alias("tid"), F.coalesce("text", F.lit("")).alias("text"))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _hashes(spec: Windows) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([_signed(spec.winnow(part.column("text"))[-1].hash)], ["h"])

    return run


def _runs(spec: Windows):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                _, _, first, _, _, w = spec.winnow(part.column("text"))
                doc, tid = (part.column(c).take(pa.array(w.text)) for c in ("doc_id", "tid"))
                lo = (w.lo - first[w.text]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([_signed(w.hash), _signed(w.run_hash()), doc, tid, pa.array(lo), pa.array(w.n.astype(np.int16))], ["h", "s", "doc_id", "tid", "lo", "n"])

    return run


def _bodies(spec: Windows):
    """Text of every listed run of a document."""

    def run(batches):
        names = ["h", "s", "keys", "doc_id", "tid", "lo", "n", "body"]
        for batch in batches:
            batch = batch.filter(batch.column("items").is_valid())
            for part in slices(batch):
                data, starts = buffer(part.column("text"))
                _, first, begin, end = spec.tokens(data, starts)
                items = part.column("items")
                of = items.value_parent_indices()
                flat = items.flatten()
                col = {k: flat.field(k) for k in ("h", "s", "keys", "lo", "n")}
                a = first[of.to_numpy()] + col["lo"].to_numpy().astype(np.int64)
                b = a + col["n"].to_numpy() + spec.length - 1
                at, to = (a, b) if begin is None else (begin[a], end[b - 1])
                raw = data.tobytes()
                body = pa.array([raw[i:j] for i, j in zip(at.tolist(), to.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([col["h"], col["s"], col["keys"], part.column("doc_id").take(of), part.column("tid").take(of), col["lo"], col["n"], body], names)

    return run


def _window_keys(spec: Windows, part: pa.RecordBatch):
    """For every window of every body: its body, its number in the body, and a key equal for equal windows of one representative."""
    _, values, first, _, _, w = spec.winnow(part.column("body"))
    n = w.n
    body = np.repeat(w.text, n)
    off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(w.lo, n) + off
    lead = np.repeat(w.at, n) - start
    h = np.repeat(w.hash, n)
    whole = Prefix(values).spans(start, start + spec.length)
    return body, off, mix(whole ^ mix(h ^ (lead.astype(np.uint64) * np.uint64(BASE))))


def _marks_local(spec: Windows):
    """Rows sorted by (h, place), groups whole: the windows of each body that an earlier body of its group has."""

    def marks(table: pa.Table) -> Iterator[pa.RecordBatch]:
        place = [table.column(c).to_numpy() for c in ("h", "doc_id", "tid", "lo")]
        fresh = np.ones(table.num_rows, bool)
        if table.num_rows > 1:
            fresh[1:] = np.any([c[1:] != c[:-1] for c in place], axis=0)
        table = table.filter(pa.array(fresh)).combine_chunks()
        group = table.column("h").to_numpy()
        ends = np.concatenate((np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]))
        at = 0
        while at < len(group):  # whole groups, about as many rows as fit a slice
            to = int(ends[np.searchsorted(ends, min(at + 4096, len(group)))])
            part = table.slice(at, to - at).combine_chunks().to_batches()[0]
            at = to
            body, off, key = _window_keys(spec, part)
            order = np.argsort(key, kind="stable")
            run = np.ones(len(key), bool)
            run[1:] = key[order][1:] != key[order][:-1]
            owner = body[order][np.maximum.accumulate(np.where(run, np.arange(len(key)), 0))]
            doc = part.column("doc_id").to_numpy()
            later = (doc[owner] < doc[body[order]]) if not spec.same_document else ~run
            hit = order[later]
            hit.sort()
            n = np.bincount(body[hit], minlength=part.num_rows)
            some = np.flatnonzero(n)
            offs = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n[some]))).astype(np.int32)), pa.array(off[hit].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(c).take(pa.array(some)) for c in ("h", "s")] + [offs], ["h", "s", "offs"])

    def run(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            h = t.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1]))  # sorted: the last group may go on in the next batch
            rest = t.slice(cut)
            if cut:
                yield from marks(t.slice(0, cut))
        if rest is not None:
            yield from marks(rest)

    return run


def _window_rows(spec: Windows):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "body"):
                body, off, key = _window_keys(spec, part)
                take = pa.array(body)
                cols = [part.column(c).take(take) for c in ("h", "s", "doc_id", "tid", "lo")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(off.astype(np.int32)), _signed(key)], ["h", "s", "doc_id", "tid", "lo", "off", "key"])

    return run


def repeated_spans(docs: DataFrame, spec: Windows) -> DataFrame:
    """``docs`` (of ``keyed``) with ``spans``: array of (lo, n, offs). offs missing: the n windows from token lo on are repeated;
    else those at lo + offs. Documents without repeats have no spans."""
    text = docs.select("doc_id", "tid", "text")
    twice = text.select("text").mapInArrow(_hashes(spec), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h")
    twice = written(twice, "twice")  # a table of its own, so that the join below can be dealt anew where one hash is hot
    runs = text.mapInArrow(_runs(spec), "h long, s long, doc_id long, tid int, lo int, n short")
    runs = written(runs.join(twice.hint("shuffle_hash"), "h"), "runs")

    keys = runs.groupBy("h", "s").agg(F.min(F.struct("doc_id", "tid", "lo")).alias("at"), F.max("n").alias("n"))
    several = keys.groupBy("h").agg(F.count(F.lit(1)).alias("keys")).where("keys > 1")
    item = F.struct("h", "s", F.col("at.lo").alias("lo"), "n", "keys")
    items = keys.join(several, "h").groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.tid").alias("tid")).agg(F.collect_list(item).alias("items"))
    bodies = text.join(items, ["doc_id", "tid"], "left").mapInArrow(_bodies(spec), "h long, s long, keys long, doc_id long, tid int, lo int, n short, body binary")
    bodies = written(bodies, "bodies")

    local = bodies.where(F.col("keys") <= spec.local_keys).repartition("h").sortWithinPartitions("h", "doc_id", "tid", "lo")
    marks = local.mapInArrow(_marks_local(spec), "h long, s long, offs array<int>")
    rows = bodies.where(F.col("keys") > spec.local_keys).mapInArrow(_window_rows(spec), "h long, s long, doc_id long, tid int, lo int, off int, key long")
    firsts = rows.groupBy("h", "key").agg(F.min(F.struct("doc_id", "tid", "lo")).alias("at"))
    later = F.col("at") < F.struct("doc_id", "tid", "lo") if spec.same_document else F.col("at.doc_id") < F.col("doc_id")
    marks = marks.unionByName(rows.join(firsts, ["h", "key"]).where(later).groupBy("h", "s").agg(F.collect_list("off").alias("offs")))

    known = keys.join(marks, ["h", "s"], "left").select("h", "s", F.col("at.doc_id").alias("a"), F.col("at.tid").alias("b"), F.col("at.lo").alias("c"), "offs")
    found = runs.join(written(known, "known"), ["h", "s"])
    whole = F.struct("a", "b", "c") < F.struct("doc_id", "tid", "lo") if spec.same_document else F.col("a") < F.col("doc_id")
    spans = found.where(whole | F.col("offs").isNotNull()).select("doc_id", "tid", F.struct("lo", "n", F.when(~whole, F.col("offs")).alias("offs")).alias("span"))
    spans = spans.groupBy("doc_id", "tid").agg(F.collect_list("span").alias("spans"))
    return text.join(spans, ["doc_id", "tid"], "left")


def covered(spans: pa.Array, row: int, n: int, length: int) -> np.ndarray:
    """Which of a document's n tokens a repeated window covers."""
    delta = np.zeros(n + 1, np.int32)
    for span in spans[row].as_py() or ():
        lo = span["lo"]
        if span["offs"] is None:
            delta[lo] += 1
            delta[lo + span["n"] + length - 1] -= 1
        else:
            at = lo + np.asarray(span["offs"])
            np.add.at(delta, at, 1)
            np.add.at(delta, at + length, -1)
    return np.cumsum(delta[:-1]) > 0
