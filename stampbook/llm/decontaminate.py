"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages, sought a fixed number at a time. For these a randomised SVD of TF-IDF passages, theirs and those
of all documents alike, gives a space of low rank (the documents' part from one product with a random basis, formed on the executors
in one pass over the corpus). Every
window of every document is projected and compared there by cosine: a paraphrase comes near without a common phrase. Beside it
stands an exact score, common runs of a few words, which finds whole copies however short they are beside other text. A
candidate is confirmed where its text lies: by the longest common subsequence of words, and by the answer. Document
frequencies of all benchmark words come from one pass over the corpus; hits of the passes are brought together per document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stampbook.llm.common import small_broadcast, tidy, written
from stampbook.llm.textbytes import LOWER, Prefix, Words, buffer, slices

#: Passages of benchmark items sought at once, and words per passage at most.
BLOCK, PASSAGE_WORDS = 512, 64
#: Document passages: STEPS steps of STEP words.
STEP, STEPS = 16, 4
RANK, OVERSAMPLING = 96, 8
#: Words of a common run.
RUN = 4
#: Matrices of words x rank that the driver adds up; tasks' own are added up to these before.
PARTS = 4
#: Rows of a matrix gathered at once, few enough for a processor's cache.
GATHERED = 4096
#: Bytes of a table documents x words of the benchmark that a task marks; beyond that it sorts the words it finds.
MARKED = 1 << 25
#: Words of the benchmark whose frequencies one pass counts; hits that are broadcast to be put beside their documents.
COUNTED_WORDS, BROADCAST_HITS = 4_000_000, 500_000

#: ASCII letters to lower case, other ASCII characters but digits to blanks.
PLAIN = LOWER.copy()
PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = 32


def plain_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of the texts, first word of each text); case and punctuation do not count."""
    data, starts = buffer(column)
    data = PLAIN[data]
    w = Words(data, starts)
    return w.values(data), w.first


def passages_of(items: list[tuple[int, str]]) -> list[dict]:
    """Passages of the items: item, words (hashes), answer (hashes of what follows the last question mark, else the last sentence)."""
    out = []
    for item, text in items:
        body = (text or "").rstrip(" .!?\n\t")
        cut = text.rfind("?") + 1 if text and "?" in body else max(body.rfind(c) for c in ".!\n") + 1 if body else 0
        words, first = plain_words(pa.array([text or "", (text or "")[cut:]]))
        words, answer = words[: first[1]], words[first[1] :]
        n = -(-len(words) // PASSAGE_WORDS)
        for i in range(n):  # equal parts, so that no passage is a small rest
            a, b = len(words) * i // n, len(words) * (i + 1) // n
            out.append({"item": item, "words": words[a:b], "answer": answer[-PASSAGE_WORDS:] if i == n - 1 else answer[:0]})
    return out


def _columns(words: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Place of every word in the sorted vocabulary, -1 for others: hashes spread, so their first bits lead to it."""
    out = np.full(len(words), -1)
    if not len(vocabulary) or not len(words):
        return out
    cut = np.uint64(64 - min(22, len(vocabulary).bit_length() + 2))
    begin = np.searchsorted(vocabulary >> cut, np.arange((1 << 64 - int(cut)) + 1, dtype=np.uint64))
    group = words >> cut
    at, end = begin[group], begin[group + np.uint64(1)]
    left = np.flatnonzero(at < end)
    while len(left):
        place = at[left]
        same = vocabulary[place] == words[left]
        out[left[same]] = place[same]
        at[left] += 1
        left = left[~same & (place + 1 < end[left])]
    return out


def _document_counts(docs: DataFrame, vocabulary: np.ndarray) -> tuple[int, np.ndarray]:
    """(documents, documents that hold each word of the vocabulary), over all documents."""

    def count(batches):
        held, n = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            for part in slices(batch):
                words, first = plain_words(part.column("text"))
                col = _columns(words, vocabulary)
                text = np.repeat(np.arange(part.num_rows), np.diff(first))
                some = col >= 0
                pairs = text[some] * len(vocabulary) + col[some]
                if part.num_rows * len(vocabulary) <= MARKED:
                    there = np.zeros((part.num_rows, len(vocabulary)), bool)
                    there.ravel()[pairs] = True
                    held += there.sum(axis=0)
                else:
                    held += np.bincount(np.unique(pairs) % len(vocabulary), minlength=len(vocabulary))
                n += part.num_rows
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(held[at], n))], ["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # one row per word of the block
    held = np.zeros(len(vocabulary), np.int64)
    n = 0
    for r in rows:
        if r.word < 0:
            n = r.n
        else:
            held[r.word] = r.n
    return n, held


def _step_sums(col: np.ndarray, first: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum of the table's rows over every step of words: (sums, text of each step, its number in the text)."""
    count = np.diff(first)
    steps = -(-count // STEP)
    begin = np.cumsum(steps) - steps
    text = np.repeat(np.arange(len(count)), count)
    step = begin[text] + (np.arange(len(col)) - first[text]) // STEP
    sums = np.zeros((int(steps.sum()), table.shape[1]), np.float32)
    some = np.flatnonzero(col >= 0)
    _add_rows(sums, step[some], table, col[some])
    owner = np.repeat(np.arange(len(count)), steps)
    return sums, owner, np.arange(len(owner)) - begin[owner]


def _windows(sums: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Sums over STEPS steps of one text from each step on (shorter at a text's end)."""
    out = sums.copy()
    for k in range(1, STEPS):
        same = owner[k:] == owner[:-k]
        out[:-k][same] += sums[k:][same]
    return out


def _add_rows(out: np.ndarray, to: np.ndarray, table: np.ndarray, of: np.ndarray) -> None:
    """Adds the table's rows ``of`` to the rows ``to`` (equal ones side by side) of ``out``."""
    for a in range(0, len(of), GATHERED):
        at = to[a : a + GATHERED]
        new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        out[at[new]] += np.add.reduceat(table[of[a : a + GATHERED]], new, axis=0)


def _corpus_product(docs: DataFrame, basis: np.ndarray, vocabulary: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Gram matrix of the TF-IDF passages of all documents (words x words, never formed) times ``basis`` (words x columns)."""
    table, size = (weight[:, None] * basis).astype(np.float32), STEP * STEPS

    def run(batches):
        total = np.zeros(basis.shape, np.float32)
        for batch in batches:
            for part in slices(batch):
                words, first = plain_words(part.column("text"))
                count = np.diff(first)
                passages = -(-count // size)
                text = np.repeat(np.arange(len(count)), count)
                passage = (np.cumsum(passages) - passages)[text] + (np.arange(len(words)) - first[text]) // size
                col = _columns(words, vocabulary)
                some = col >= 0
                col, passage = col[some], passage[some]
                projected = np.zeros((int(passages.sum()), basis.shape[1]), np.float32)
                _add_rows(projected, passage, table, col)
                order = np.argsort(col.astype(np.min_scalar_type(len(vocabulary))), kind="stable")  # short numbers are sorted by their digits
                _add_rows(total, col[order], projected, passage[order])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    def add(batches):
        total = np.zeros(basis.shape, np.float32)
        for batch in batches:
            for one in batch.column("total"):
                total += np.frombuffer(one.as_buffer(), np.float32).reshape(basis.shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    out = np.zeros(basis.shape)
    for r in docs.select("text").mapInArrow(run, "total binary").repartition(PARTS).mapInArrow(add, "total binary").collect():  # PARTS matrices
        out += np.frombuffer(r.total, np.float32).reshape(basis.shape)
    return out * weight[:, None]


def _decompose(docs: DataFrame, rows: np.ndarray, vocabulary: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Right singular vectors (words x rank) of the TF-IDF passages: the benchmark's rows and those of all documents.

    The documents' part is as a random basis shows it (Nystroem), so one pass does. Both parts have the same energy, so that the
    space follows the corpus as well as the passages.
    """
    rank = max(1, min(RANK, len(rows) // 2, len(vocabulary) // 2))
    width = min(rank + OVERSAMPLING, len(vocabulary))
    basis = np.linalg.qr(np.random.default_rng(11).standard_normal((len(vocabulary), width)))[0]
    image = _corpus_product(docs, basis, vocabulary, weight)
    energy = float((basis * image).sum()) * len(vocabulary) / width  # of the documents, as a random basis sees it
    heavy = energy / max(1e-9, float((rows**2).sum())) if energy > 0 else 1.0
    values, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
    live = values > max(1e-6 * values[-1], 1e-12)
    both = np.vstack([np.sqrt(heavy) * rows.astype(np.float64), (image @ (turn[:, live] / np.sqrt(values[live]))).T])
    squares, left = np.linalg.eigh(both @ both.T)
    best = np.argsort(-squares)[:rank]
    return (both.T @ (left[:, best] / np.sqrt(np.maximum(squares[best], 1e-12)))).astype(np.float32)


def common_subsequence(words: list[int], of: list[int]) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    places: dict[int, int] = {}
    for i, w in enumerate(of):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(of)) - 1
    v = full
    for w in words:
        u = v & places.get(w, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return len(of) - v.bit_count()


def _frequencies(docs: DataFrame, items: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(documents, words of the benchmark in order, documents that hold each), ``COUNTED_WORDS`` words in a pass."""

    def words(batches):
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(plain_words(part.column("text"))[0]).view(np.int64))], ["word"])

    known = items.mapInArrow(words, "word long").distinct().toArrow().column("word").to_numpy().view(np.uint64)  # 8 bytes per different word
    known = np.sort(known)
    n, held = 0, []
    for a in range(0, max(1, len(known)), COUNTED_WORDS):
        n, some = _document_counts(docs, known[a : a + COUNTED_WORDS])
        held.append(some)
    return n, known, np.concatenate(held)


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.25, carried: float = 0.35, share: float = 0.6, sure: float = 0.8, answer_share: float = 0.5) -> DataFrame:
    """Per document: doc_id, contaminated, item_id (its best hit), score, hits (item_id, score, first word of the passage), text_hash.

    A document is contaminated if one of its passages is a candidate for a benchmark passage (its cosine in the latent space reaches
    ``cosine`` and it carries ``carried`` of the passage's weight there, or both share a run of ``RUN`` words, of shorter passages all
    words) and, with the words around it, holds ``share`` of that passage's words in order, and also ``answer_share`` of the item's
    answer, or ``sure`` of the passage alone. Score: that share of words. Case and punctuation do not count. Items without words and
    documents without words or text match nothing; one row per input row; rows are judged one by one, also where they repeat an
    id. Empty tables: no hits, an empty result. Other columns are ignored. The driver holds ``BLOCK`` passages with their model at a
    time, and 16 bytes for each different word of the benchmark.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    n, known, held = _frequencies(rows, items.select("text"))
    found, block = [], []

    def search():
        model = _fit(rows, block, known, np.log((n + 1) / (held + 1)))
        hits = rows.mapInArrow(_searched(model, cosine, carried, share, sure, answer_share), "doc_id long, text_hash long, item_id long, score double, word int")
        found.append(written(hits.distinct(), "hits"))

    for item in items.orderBy("item_id", "text").toLocalIterator():  # a stated query set; in blocks
        block += passages_of([(item.item_id, item.text)])
        if len(block) >= BLOCK:
            search()
            block = []
    if block:
        search()

    keys = rows.select("doc_id", "text_hash")
    none = keys.select("doc_id", "text_hash", F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("word")).limit(0)
    hits = none
    for f in found:
        hits = hits.unionByName(f)
    best = hits.groupBy("doc_id", "text_hash", "item_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "word")).alias("b"))
    best = best.select("doc_id", "text_hash", F.struct(F.col("b.s").alias("s"), "item_id", F.col("b.word").alias("word")).alias("h"))
    best = written(best.groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).agg(F.sort_array(F.collect_list("h")).alias("h")), "found")
    full = keys.join(small_broadcast(best, BROADCAST_HITS), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_t")), "left")
    told = F.transform(F.coalesce("h", F.array().cast("array<struct<s:double,item_id:bigint,word:int>>")), lambda x: F.struct(x["item_id"].alias("item_id"), (-x["s"]).alias("score"), x["word"].alias("word")))
    return full.select("doc_id", F.col("h").isNotNull().alias("contaminated"), F.col("h")[0]["item_id"].alias("item_id"), (-F.col("h")[0]["s"]).alias("score"), told.alias("hits"), "text_hash")


def _runs(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of all runs of ``size`` words of one text."""
    h = Prefix(words).windows(size)
    at = np.arange(len(h))
    text = np.searchsorted(first, at, side="right") - 1
    ok = at + size <= first[text + 1]
    return h[ok], at[ok]


def _fit(docs: DataFrame, block: list[dict], known: np.ndarray, idf: np.ndarray) -> dict:
    vocabulary = np.unique(np.concatenate([p["words"] for p in block]))
    weight = np.maximum(idf[np.searchsorted(known, vocabulary)], 1e-3).astype(np.float32)
    counts = np.zeros((len(block), len(vocabulary)), np.float32)
    for i, p in enumerate(block):
        np.add.at(counts[i], _columns(p["words"], vocabulary), 1)
    tfidf = counts * weight
    tfidf /= np.maximum(np.linalg.norm(tfidf, axis=1), 1e-9)[:, None]
    vectors = _decompose(docs, tfidf, vocabulary, weight)
    latent = (counts * weight) @ vectors
    runs: dict[int, list] = {}
    for i, p in enumerate(block):
        size = min(RUN, len(p["words"]))
        h, at = _runs(p["words"], np.array([0, len(p["words"])]), size)
        runs.setdefault(size, []).append((h, np.full(len(h), i), at))
    index = {}
    for size, parts in runs.items():
        h, passage, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h, kind="stable")
        index[size] = (h[order], passage[order], at[order])
    return {"block": block, "vocabulary": vocabulary, "table": (weight[:, None] * vectors).astype(np.float32), "latent": latent.astype(np.float32), "runs": index}


def near(words: np.ndarray, first: np.ndarray, model: dict, cosine: float, carried: float):
    """(text, first word of a stretch, one after its last, passage) of the candidates in the latent space."""
    sums, owner, number = _step_sums(_columns(words, model["vocabulary"]), first, model["table"])
    windows = _windows(sums, owner)
    length = np.linalg.norm(windows, axis=1)
    own = np.linalg.norm(model["latent"], axis=1)
    size = np.array([len(p["words"]) for p in model["block"]])
    live = np.flatnonzero(length > 0)
    for a in range(0, len(live), 4096):
        at = live[a : a + 4096]
        dot = windows[at] @ model["latent"].T
        row, passage = np.nonzero((dot >= cosine * length[at, None] * own) & (dot >= carried * own**2) & (own > 0))
        start = number[at[row]] * STEP
        yield owner[at[row]], start - STEP, start + (STEPS + 1) * STEP + size[passage] // 2, passage


def common(words: np.ndarray, first: np.ndarray, model: dict):
    """The same for passages that share a run of words with a text, once for each place where the passage would begin."""
    size = np.array([len(p["words"]) for p in model["block"]])
    for run, (known, passage, offset) in model["runs"].items():
        h, at = _runs(words, first, run)
        hit = np.flatnonzero(_columns(h, np.unique(known)) >= 0)
        low, high = np.searchsorted(known, h[hit], side="left"), np.searchsorted(known, h[hit], side="right")
        n = high - low
        entry = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        place = np.repeat(at[hit], n)
        text = np.searchsorted(first, place, side="right") - 1
        start = place - first[text] - offset[entry]
        once = np.unique(np.stack([text, passage[entry], start // STEP]), axis=1)
        text, of, start = once[0], once[1], once[2] * STEP
        yield text, start - size[of] // 2 - STEP, start + size[of] + size[of] // 2 + 2 * STEP, of


def _searched(model: dict, cosine, carried, share, sure, answer_share):
    """doc_id, text_hash and the best hit for each item, of the documents with one."""
    wanted = [p["words"].tolist() for p in model["block"]]
    answers = [p["answer"].tolist() for p in model["block"]]

    kinds = [frozenset(q) for q in wanted]
    size = np.array([len(q) for q in wanted])

    def confirmed(words, first):
        best: dict[tuple[int, int], tuple[float, int]] = {}
        count, held = np.diff(first), _columns(words, model["vocabulary"]) >= 0
        told = words[held].tolist()  # no other word is in a passage or an answer
        before = np.concatenate(([0], np.cumsum(held)))
        for found in (common(words, first, model), near(words, first, model, cosine, carried)):
            for text, begin, end, passage in found:
                begin, end = np.maximum(begin, 0), np.minimum(end, count[text])
                low, high = before[first[text] + begin], before[first[text] + np.maximum(begin, end)]
                full = high - low >= share * size[passage]
                for t, a, x, y, p in zip(*(z[full].tolist() for z in (text, begin, low, high, passage)), strict=True):
                    q, key = wanted[p], (t, model["block"][p]["item"])
                    score = best.get(key, (0.0,))[0]
                    if score >= 0.999:
                        continue
                    around, least = told[x:y], max(share, score) * len(q)
                    there = kinds[p].intersection(around)
                    # words in order are words that are there; without the second test, those that q repeats count as there
                    if len(there) + len(q) - len(kinds[p]) < least or sum(w in there for w in q) < least:
                        continue
                    score, earlier = common_subsequence(around, q) / len(q), score
                    if score >= share and score > earlier and (score >= sure or answers[p] and common_subsequence(around, answers[p]) >= answer_share * len(answers[p])):
                        best[key] = (score, a)
        return best

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                words, first = plain_words(part.column("text"))
                hits = [(t, item, score, word) for (t, item), (score, word) in confirmed(words, first).items()]
                if hits:
                    text, item, score, word = zip(*hits, strict=True)
                    at = pa.array(text)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(at), part.column("text_hash").take(at), pa.array(item, pa.int64()), pa.array(score, pa.float64()), pa.array(word, pa.int32())],
                        ["doc_id", "text_hash", "item_id", "score", "word"],
                    )

    return run


@tidy
def op5_decontaminate(spark, folder: str) -> DataFrame:
    """The whole of documents against the whole of benchmark."""
    return contaminated(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))
