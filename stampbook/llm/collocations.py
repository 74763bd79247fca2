"""Phrase collocations from count streams in prefix and suffix order.

1.  Words are counted, then pairs of frequent words, then longer phrases all of whose pairs are frequent: three passes over the
    texts. What is frequent a filter of bounded size says (it may let others pass, which their own count then removes, but loses
    none). Counts are summed in the map tasks first.
2.  All frequent phrases are one table of word hashes. Sorted by first words it is the prefix stream: every phrase stands behind
    its own beginnings and before its continuations, so beginnings' counts and the largest continuation are read off the
    neighbours. Sorted by last words it is the suffix stream, which gives the same for endings and words put in front. The second
    stream takes up what the first found: one pass over each in turn, no table of counts is ever looked up.
3.  A phrase inside a longer one that is nearly as frequent is inside one that is longer by one word and at least as frequent, so the
    two largest extensions decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stampbook.llm.common import tidy, written
from stampbook.llm.textbytes import BASE, BYTE_VALUE, LOWER, Prefix, buffer, mix, slices

MAX_WORDS = 4
UNKNOWN = "und"
#: Windows gathered in a task before equal ones are summed and sent.
GATHERED = 1 << 19
#: Filter: bits for each phrase, bits in a chunk, and bits at most (32 MB, whatever the corpus holds).
BITS_EACH, CHUNK_BITS, MAX_BITS = 16, 1 << 16, 1 << 28

BREAKS = np.zeros(256, np.int64)
BREAKS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 1
APART = BREAKS.astype(bool)
APART[[0x20, 0x09]] = True
SECOND = np.uint64(0x5851F42D4C957F2D)


class Pieces:
    """Words of a slice of texts: byte range, 64-bit hash of language and word, number of the piece (none spans two texts)."""

    def __init__(self, batch: pa.RecordBatch):
        data, starts = buffer(batch.column("text"))
        self.data = LOWER[data]
        inside = ~APART[self.data]
        n = len(data)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cuts = starts[(starts > 0) & (starts < n)]
        before[cuts] = False
        after[cuts - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.text = np.searchsorted(starts, self.start, side="right") - 1
        self.piece = np.cumsum(BREAKS[self.data])[self.start] + self.text if n else self.start
        lang, at = buffer(batch.column("lang"))
        of_lang = Prefix(BYTE_VALUE[lang]).spans(at[:-1], at[1:])
        self.value = mix(Prefix(BYTE_VALUE[self.data]).spans(self.start, self.end) + of_lang[self.text] * np.uint64(BASE))


def joined(words: list[np.ndarray]) -> np.ndarray:
    """One hash for each row of word hashes."""
    h = np.full(len(words[0]), len(words), np.uint64)
    for w in words:
        h = mix(h * np.uint64(BASE) + w)
    return h


class Filter:
    """A Bloom filter with two places for each phrase."""

    def __init__(self, bits: int, data: np.ndarray):
        self.bits, self.data = bits, data

    @staticmethod
    def places(h: np.ndarray, bits: int) -> list[np.ndarray]:
        shift = np.uint64(64 - bits.bit_length() + 1)
        return [h >> shift, mix(h ^ SECOND) >> shift]

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for p in self.places(h, self.bits):
            out &= (self.data[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)
        return out


def filter_of(phrases: DataFrame, words: int) -> Filter:
    """The filter of a table of phrases (w1, w2, ...); built in chunks, so that only its own bits reach the driver."""
    n = phrases.count()
    bits = min(MAX_BITS, max(CHUNK_BITS, 1 << (BITS_EACH * n).bit_length()))

    def places(batches):
        for batch in batches:
            h = joined([batch.column(f"w{i + 1}").to_numpy().view(np.uint64) for i in range(words)])
            p = np.concatenate(Filter.places(h, bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((p // CHUNK_BITS).astype(np.int32)), pa.array((p % CHUNK_BITS).astype(np.int32))], ["chunk", "place"])

    def chunk(table: pa.Table) -> pa.Table:
        on = np.zeros(CHUNK_BITS, np.uint8)
        on[table.column("place").to_numpy()] = 1
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "data": pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())})

    data = np.zeros(bits // 8, np.uint8)
    rows = phrases.select(*[f"w{i + 1}" for i in range(words)]).mapInArrow(places, "chunk int, place int").distinct()
    for r in rows.groupBy("chunk").applyInArrow(chunk, "chunk int, data binary").collect():  # MAX_BITS / 8 bytes at most
        data[r.chunk * CHUNK_BITS // 8 : (r.chunk + 1) * CHUNK_BITS // 8] = np.frombuffer(r.data, np.uint8)
    return Filter(bits, data)


def _word_counts(batches):
    """w1, lang, word, c: words of each slice with their number."""
    for batch in batches:
        for part in slices(batch):
            p = Pieces(part)
            value, at, c = np.unique(p.value, return_index=True, return_counts=True)
            raw = p.data.tobytes()
            words = pa.array([raw[a:b] for a, b in zip(p.start[at].tolist(), p.end[at].tolist(), strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), part.column("lang").take(pa.array(p.text[at])), words, pa.array(c)], ["w1", "lang", "word", "c"])


def _phrase_counts(sizes: range, known: Filter, part: int, max_words: int):
    """words, w1, w2, ..., c: windows of each size all of whose parts of ``part`` words pass the filter."""
    names = [f"w{i + 1}" for i in range(max_words)]

    def summed(words, rows):
        columns = [np.concatenate(x) for x in zip(*rows, strict=True)]
        _, at, c = np.unique(joined(columns), return_index=True, return_counts=True)
        arrays = [pa.array(x[at].view(np.int64)) for x in columns] + [pa.nulls(len(at), pa.int64())] * (max_words - words)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), words, np.int32)), *arrays, pa.array(c)], ["words", *names, "c"])

    def run(batches):
        rows, gathered = {words: [] for words in sizes}, 0
        for batch in batches:
            for cut in slices(batch):
                p = Pieces(cut)
                n = len(p.value) - part + 1
                if n <= 0:
                    continue
                passed = known(joined([p.value[i : i + n] for i in range(part)]))
                for words in sizes:
                    m = len(p.value) - words + 1
                    if m <= 0:
                        continue
                    ok = p.piece[:m] == p.piece[words - 1 :]
                    for i in range(words - part + 1):
                        ok &= passed[i : i + m]
                    ok = np.flatnonzero(ok)
                    if len(ok):
                        rows[words].append([p.value[ok + i] for i in range(words)])
                        gathered += len(ok)
                if gathered >= GATHERED:
                    for words, found in rows.items():
                        if found:
                            yield summed(words, found)
                    rows, gathered = {words: [] for words in sizes}, 0
        for words, found in rows.items():
            if found:
                yield summed(words, found)

    return run


def counted(docs: DataFrame, least: int, max_words: int = MAX_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(number of words per lang; frequent words w1, lang, word, c; frequent phrases words, w1 ... w4, c)."""
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"))
    every = written(rows.mapInArrow(_word_counts, "w1 long, lang string, word string, c long").groupBy("w1", "lang", "word").agg(F.sum("c").alias("c")), "words")
    totals = written(every.groupBy("lang").agg(F.sum("c").alias("n")), "totals")
    frequent = every.where(F.col("c") >= least)

    def phrases(sizes: range, of: DataFrame, part: int) -> DataFrame:
        """Frequent phrases. The tasks send sums for each ``GATHERED`` windows, dealt by phrase as they are: a further hash
        aggregation before the shuffle would hold a task's phrases once more."""
        names = [f"w{i + 1}" for i in range(sizes[-1])]
        schema = ", ".join(["words int", *[f"{c} long" for c in names], "c long"])
        found = rows.mapInArrow(_phrase_counts(sizes, filter_of(of, part), part, sizes[-1]), schema)
        keys = names if len(sizes) == 1 else ["words", *names]
        sums = found.select(*keys, "c").repartition(*keys).groupBy(*keys).agg(F.sum("c").alias("c")).where(F.col("c") >= least)
        kept = written(sums, "phrases")
        lacking = [F.lit(None).cast("long").alias(f"w{i + 1}") for i in range(sizes[-1], max_words)]
        return kept.select(F.col("words") if len(sizes) > 1 else F.lit(sizes[0]).alias("words"), *names, *lacking, "c")

    pairs = phrases(range(2, 3), frequent, 1)
    return totals, frequent, pairs.unionByName(phrases(range(3, max_words + 1), pairs, 2)) if max_words > 2 else pairs


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, inside: int = 80) -> DataFrame:
    """The ``top`` phrases of 2 to 4 words of each language by their weakest cut.

    Texts are split into pieces at ``.,;:!?`` and line ends, pieces into words at blanks and tabs, A-Z lower-cased. A phrase that occurs
    a >= ``least`` times scores floor(2000000 * a / (l + r)) at the cut with the lowest score (of equal ones the first), l and r the
    occurrences of its parts. It is dropped if a longer such phrase around it occurs at least ``inside`` percent as often. Result: lang,
    rank, phrase, a, l, r, n (words of the language), score; by score, then a, then phrase in byte order. A missing text is
    empty, a missing lang ``und``; repeated rows count like others; other columns are ignored; an empty table gives an empty
    result. Words are told apart by 64-bit hashes. Arithmetic is in decimals.
    """
    sizes, words, phrases = counted(docs, least)
    w = [f"w{i + 1}" for i in range(MAX_WORDS)]
    size = F.col("words")
    nth = lambda i: F.element_at(F.array(*w), i)

    def of(k, keys):
        """Largest count of the phrases of k words in the group of ``keys``, which the stream's order holds together."""
        return F.max(F.when(size == k, F.col("c"))).over(Window.partitionBy(*keys))

    prefix = phrases.withColumns({"l2": of(2, w[:2]), "l3": of(3, w[:3])})
    # continuations of a phrase of two or three words
    prefix = prefix.withColumn("after", F.when(size == 2, of(3, w[:2])).when(size == 3, of(4, w[:3])))
    s = {f"s{i}": F.when(size >= i, nth(size - (i - 1))) for i in range(1, 4)}
    suffix = prefix.withColumns(s)
    suffix = suffix.withColumns({"r2": of(2, ["s1", "s2"]), "r3": of(3, ["s1", "s2", "s3"])})
    suffix = suffix.withColumn("ahead", F.when(size == 2, of(3, ["s1", "s2"])).when(size == 3, of(4, ["s1", "s2", "s3"])))
    suffix = suffix.select("words", *w, F.col("c").alias("a"), "l2", "l3", "r2", "r3", "after", "ahead")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    nested = lambda c: F.coalesce(F.lit(100) * exact(c) >= F.lit(inside) * exact("a"), F.lit(False))
    kept = written(suffix.where(~nested("after") & ~nested("ahead")), "candidates")

    # texts and counts of single words: one row per word meets the words, and comes back to its phrase
    single = kept.select(*w, F.posexplode(F.filter(F.array(*w), lambda x: x.isNotNull())).alias("place", "w"))
    told = single.join(words.select(F.col("w1").alias("w"), "lang", "word", "c"), "w")
    told = told.groupBy(*w).agg(F.min("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("place", "word", "c"))).alias("x"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in w]
    told = told.select(*[F.col(c).alias(f"_{c}") for c in w], "lang", F.array_join(F.transform("x", lambda x: x["word"]), " ").alias("phrase"), F.col("x")[0]["c"].alias("l1"), F.element_at("x", -1)["c"].alias("r1"))
    full = kept.join(told, (F.col("w1") == F.col("_w1")) & (F.col("w2") == F.col("_w2")) & same[2] & same[3])

    def cut(k, left, right):
        score = F.expr(f"(CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0))) div (CAST({left} AS DECIMAL(19,0)) + CAST({right} AS DECIMAL(19,0)))")
        return F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))

    cuts = {2: F.array(cut(1, "l1", "r1")), 3: F.array(cut(1, "l1", "r2"), cut(2, "l2", "r1")), 4: F.array(cut(1, "l1", "r3"), cut(2, "l2", "r2"), cut(3, "l3", "r1"))}
    best = F.when(size == 2, F.array_min(cuts[2])).when(size == 3, F.array_min(cuts[3])).otherwise(F.array_min(cuts[4]))
    full = full.select("lang", "phrase", "a", best.alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))  # each task keeps ``top`` of a language at most
    ranked = full.withColumn("rank", place).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


@tidy
def op12_collocations(spark, folder: str) -> DataFrame:
    """The whole of documents."""
    return collocations(spark.read.parquet(f"{folder}/documents.parquet"))


CHECK = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS ws FROM p),
g AS (SELECT lang, j, ws[i:i + j - 1] AS ph FROM (SELECT lang, ws, j, unnest(range(1, len(ws) - j + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS j))),
f AS (SELECT lang, j, ph, count(*) AS c FROM g GROUP BY ALL),
n AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE j = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT * FROM f WHERE c >= 30),
cuts AS (SELECT x.lang, x.ph, x.c AS a, k, l.c AS l, r.c AS r, (2000000::HUGEINT * x.c // (l.c + r.c))::BIGINT AS score
    FROM (SELECT *, unnest(range(1, j)) AS k FROM c WHERE j > 1) x JOIN c l ON l.lang = x.lang AND l.ph = x.ph[1:k] JOIN c r ON r.lang = x.lang AND r.ph = x.ph[k + 1:]),
best AS (SELECT lang, ph, a, arg_min(l, struct_pack(s := score, k := k)) AS l, arg_min(r, struct_pack(s := score, k := k)) AS r, min(score) AS score FROM cuts GROUP BY ALL),
parts AS (SELECT lang, c, ph[i:i + m - 1] AS ph FROM (SELECT *, unnest(range(1, j - m + 2)) AS i FROM (SELECT *, unnest(range(2, j)) AS m FROM c WHERE j > 2))),
held AS (SELECT lang, ph, max(c) AS longer FROM parts GROUP BY ALL)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
    SELECT b.lang, array_to_string(b.ph, ' ') AS phrase, a, l, r, n, score,
        row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, array_to_string(b.ph, ' ')) AS rank
    FROM best b JOIN n ON n.lang = b.lang LEFT JOIN held h ON h.lang = b.lang AND h.ph = b.ph WHERE h.longer IS NULL OR 100 * h.longer < 80 * a)
WHERE rank <= 2000"""
