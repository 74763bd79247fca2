"""Quality classifier: interpolated modified Kneser-Ney n-gram model over characters, trained on trusted text.

Characters (UTF-16 units) are the tokens: a gram of four packs into 64 bits without loss, and grams recur, which words of a
corpus hardly do. Counts, continuation counts and discounts are Spark aggregations, one model per language. For scoring, the
corpus is cut into blocks; the distinct grams of a block, of every order, are joined with the count tables, which are sharded
by gram, and what is found goes back to the block, where every document's perplexity is worked out. The counts are never
broadcast; what is joined grows with the corpus.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stampbook.llm.common import written
from stampbook.llm.textbytes import slices

ORDER = 4
#: Ids of training documents that are broadcast at once; more take further scans of the texts, which are never shuffled for it.
IDS_AT_ONCE = 2_000_000
#: One of so many trusted documents is held out of training and calibrates the thresholds.
HELD_OUT = 5
#: Text bytes per block.
BLOCK_BYTES = 48 << 20
#: Characters that a document's score is drawn towards its language's mean with, so that short texts do not swing.
PRIOR_CHARS = 60
#: Texts of so many characters and shorter ones have thresholds of their own: short texts swing, and would set long ones' too.
LONG_CHARS = 600
PAD = "\x02" * (ORDER - 1)
MASK = (1 << 16) - 1


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(gram that ends at each character of all texts, text of each)."""
    units = [np.frombuffer((PAD + t).encode("utf-16-le", "surrogatepass"), np.uint16) for t in texts]
    size = np.fromiter(map(len, units), np.int64, len(units))
    codes = np.concatenate(units).astype(np.uint64) if units else np.zeros(0, np.uint64)
    g = codes.copy()
    for k in range(1, ORDER):
        g[k:] |= codes[:-k] << np.uint64(16 * k)
    text = np.repeat(np.arange(len(units)), size)
    inside = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size) >= ORDER - 1
    return g[inside], text[inside]


def _by_language(part: pa.RecordBatch):
    """(language, rows of it, their texts)."""
    langs = np.asarray(part.column("lang").to_pylist(), object)
    for lang in dict.fromkeys(langs.tolist()):
        at = np.flatnonzero(langs == lang)
        yield lang, at, part.column("text").take(pa.array(at)).to_pylist()


def _merge(old: tuple[np.ndarray, np.ndarray] | None, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.unique(g, return_counts=True)
    if old is None:
        return keys, n
    both, at = np.unique(np.concatenate([old[0], keys]), return_inverse=True)
    return both, np.bincount(at, np.concatenate([old[1], n]), len(both)).astype(np.int64)


def _count(batches):
    """Grams with their counts, summed over the whole partition."""
    held: dict = {}
    for batch in batches:
        for part in slices(batch):
            for lang, _, texts in _by_language(part):
                held[lang] = _merge(held.get(lang), grams(texts)[0])
    for lang, (g, n) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.view(np.int64)), pa.array(n)], ["lang", "g", "n"])


def _context(order: int):
    """The gram without its last character, as a gram of the order below."""
    return F.shiftrightunsigned("g", 16) if order == ORDER else F.shiftright("g", 16)


def model(counts: DataFrame) -> DataFrame:
    """Rows (lang, k, g, p, gamma): p, the discounted probability of gram g of order k given its context; gamma, the weight that
    g leaves to the order below when it is the context (order 0: the empty context, g 0, p 1 / number of characters)."""
    table, out, sizes = counts, [], None
    for k in range(ORDER, 0, -1):
        table = written(table, f"counts{k}")
        of = table.groupBy("lang").agg(*[F.sum(F.when(F.col("n") == i, 1).otherwise(0)).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)])
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        # where a count of counts is 0 the formula says nothing and half a count is taken
        d = [F.when((F.col(f"n{i}") > 0) & (F.col(f"n{i + 1}") > 0), F.greatest(F.lit(0.05), F.least(F.lit(i - 0.05), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")))).otherwise(0.5) for i in (1, 2, 3)]
        discounts = written(of.select("lang", *[x.alias(f"d{i}") for i, x in zip((1, 2, 3), d, strict=True)]), "discounts")
        rows = table.withColumn("c", _context(k) if k > 1 else F.lit(0).cast("long"))
        kind = [F.col("n") == 1, F.col("n") == 2, F.col("n") >= 3]
        contexts = rows.groupBy("lang", "c").agg(F.sum("n").alias("total"), *[F.sum(F.when(x, 1).otherwise(0)).alias(f"k{i}") for i, x in enumerate(kind, 1)])
        contexts = contexts.join(discounts, "lang")  # one row per language
        gamma = (F.col("d1") * F.col("k1") + F.col("d2") * F.col("k2") + F.col("d3") * F.col("k3")) / F.col("total")
        contexts = contexts.select("lang", "c", "total", gamma.alias("gamma"), "d1", "d2", "d3")
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        found = rows.join(contexts, ["lang", "c"]).select("lang", F.lit(k).alias("k"), "g", ((F.col("n") - cut) / F.col("total")).alias("p"), F.lit(0.0).alias("gamma"))
        out += [found, contexts.select("lang", F.lit(k - 1).alias("k"), F.col("c").alias("g"), F.lit(0.0).alias("p"), "gamma")]
        if k > 1:
            below = F.col("g").bitwiseAND(F.lit((1 << 16 * (k - 1)) - 1))
            table = table.groupBy("lang", below.alias("g")).agg(F.count(F.lit(1)).alias("n"))
        else:
            sizes = table.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    out.append(sizes.select("lang", F.lit(0).alias("k"), F.lit(0).cast("long").alias("g"), (1 / (F.col("v") + 1)).alias("p"), F.lit(0.0).alias("gamma")))
    both = out[0]
    for x in out[1:]:
        both = both.unionByName(x)
    return both.groupBy("lang", "k", "g").agg(F.sum("p").alias("p"), F.sum("gamma").alias("gamma"))


def _orders(g: np.ndarray):
    """Distinct grams of every order that a text with the distinct grams g of the highest order looks up, contexts included."""
    for k in range(ORDER, 0, -1):
        low = g & np.uint64((1 << 16 * k) - 1) if k < ORDER else g
        more = [low] if k == ORDER else [low, last >> np.uint64(16)]
        last = np.unique(np.concatenate(more))
        yield k, last
    yield 0, np.zeros(1, np.uint64)


def _wanted(block: pa.Table) -> pa.Table:
    held: dict = {}
    for batch in block.to_batches():
        for part in slices(batch):
            for lang, _, texts in _by_language(part):
                g = np.unique(grams(texts)[0])
                held[lang] = np.union1d(held[lang], g) if lang in held else g
    parts = [(lang, k, g) for lang, top in held.items() for k, g in _orders(top)]
    number = block.column("block")[0].as_py()
    n = sum(len(g) for _, _, g in parts)
    return pa.table({
        "block": pa.array(np.full(n, number, np.int32)),
        "lang": pa.array([lang for lang, _, g in parts for _ in range(len(g))], pa.string()),
        "k": pa.array(np.concatenate([np.full(len(g), k, np.int32) for _, k, g in parts])),
        "g": pa.array(np.concatenate([g for _, _, g in parts]).view(np.int64)),
    })


class Lookup:
    """Log-probabilities of one language from the rows found for a block."""

    def __init__(self, k: np.ndarray, g: np.ndarray, p: np.ndarray, gamma: np.ndarray):
        self.of = {}
        for order in range(ORDER + 1):
            at = np.flatnonzero(k == order)
            at = at[np.argsort(g[at])]
            self.of[order] = (g[at], p[at], gamma[at])

    def _find(self, order: int, g: np.ndarray):
        keys, p, gamma = self.of[order]
        if not len(keys):
            return np.zeros(len(g)), np.zeros(len(g)), np.zeros(len(g), bool)
        at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
        ok = keys[at] == g
        return np.where(ok, p[at], 0), np.where(ok, gamma[at], 0), ok

    def bits(self, top: np.ndarray) -> np.ndarray:
        """-log2 of the probability of every gram's last character."""
        keys, p, gamma = self.of[0]
        prob = np.full(len(top), p[0] if len(p) else 1 / (MASK + 1))
        for k in range(1, ORDER + 1):
            g = top & np.uint64((1 << 16 * k) - 1) if k < ORDER else top
            own = self._find(k, g)[0]
            _, left, seen = self._find(k - 1, g >> np.uint64(16) if k > 1 else np.zeros(len(g), np.uint64))
            prob = np.where(seen & (left > 0), own + left * prob, prob)
        return -np.log2(np.maximum(prob, 1e-12))


def _score(block: pa.Table, found: pa.Table) -> pa.Table:
    lookups: dict = {}
    if found.num_rows:
        langs = found.column("lang").combine_chunks().dictionary_encode()
        langs = langs if isinstance(langs, pa.DictionaryArray) else langs.combine_chunks()
        code = langs.indices.to_numpy(zero_copy_only=False)
        k, g = found.column("k").to_numpy(), found.column("g").to_numpy().view(np.uint64)
        p, gamma = found.column("p").to_numpy(), found.column("gamma").to_numpy()
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            at = code == i
            lookups[lang] = Lookup(k[at], g[at], p[at], gamma[at])
    out = []
    for batch in block.to_batches():
        for part in slices(batch):
            bits, chars, scored = np.zeros(part.num_rows), np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, bool)
            for lang, at, texts in _by_language(part):
                g, text = grams(texts)
                chars[at] = np.bincount(text, minlength=len(at))
                if lang in lookups and len(g):
                    top, inverse = np.unique(g, return_inverse=True)
                    bits[at] = np.bincount(text, lookups[lang].bits(top)[inverse], minlength=len(at))
                    scored[at] = True
            out.append(pa.table({"doc_id": part.column("doc_id"), "text_hash": part.column("text_hash"), "lang": part.column("lang"), "n_chars": pa.array(chars), "bits": pa.array(bits, mask=~scored)}))
    return pa.concat_tables(out) if out else block.select(["doc_id", "text_hash", "lang"]).slice(0, 0).append_column("n_chars", pa.array([], pa.int64())).append_column("bits", pa.array([], pa.float64()))


def perplexities(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """doc_id, lang, n_chars, bits (missing without a model of the language): the sharded count join, block by block."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    dealt = docs.select(block.alias("block"), "doc_id", "text_hash", "lang", "text")
    wanted = dealt.groupBy("block").applyInArrow(_wanted, "block int, lang string, k int, g long")
    found = wanted.join(model(counts), ["lang", "k", "g"]).select("block", "lang", "k", "g", F.col("p").cast("double"), F.col("gamma").cast("double"))
    return dealt.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_score, "doc_id long, text_hash long, lang string, n_chars long, bits double")


def _trained(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """lang, g, n: grams of all documents with one of the ids (long, each once), ``IDS_AT_ONCE`` of the ids in a scan."""
    parts = max(1, math.ceil(ids.count() / IDS_AT_ONCE))
    counts = []
    for part in range(parts):
        some = ids.where(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(parts)) == part)
        found = rows.join(F.broadcast(some), "doc_id", "left_semi").select("lang", "text").mapInArrow(_count, "lang string, g long, n long")
        found = found.groupBy("lang", "g").agg(F.sum("n").alias("n"))
        counts.append(found if parts == 1 else written(found, "counts"))
    return reduce(DataFrame.unionByName, counts).groupBy("lang", "g").agg(F.sum("n").alias("n")) if parts > 1 else counts[0]


def classified(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, slack: float = 1.2, min_held: int = 20) -> DataFrame:
    """Per document: doc_id, lang, n_chars, perplexity (per character), threshold (its language's and length's), kept, text_hash.

    Trusted text: all documents labelled quality 1 and not toxic; one in ``HELD_OUT`` calibrates instead of training. A document is kept up to the ``quantile`` of the held-out perplexities of its language, those of texts
    from ``LONG_CHARS`` characters on and of shorter ones apart; with fewer than ``min_held`` of a length, of the language's; with
    fewer of them too, up to ``slack`` times that of all trusted ones of the language, since most of these have trained and score
    better than others; without any, it is kept. A missing language is one of its
    own, a missing text is empty and kept: it has no perplexity. Repeated rows are scored alike; ids labelled more than once are
    trusted if all their labels say so. Empty tables: everything is kept, an empty result. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    good = (F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    trusted = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(good).alias("good")).where("good").select("doc_id")
    trusted = written(trusted.withColumn("held_out", F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(HELD_OUT)) == 0), "trusted")
    counts = _trained(rows, trusted.where("NOT held_out").select("doc_id"))

    scored = written(perplexities(rows, counts), "scored")
    known = scored.where("bits IS NOT NULL AND n_chars > 0")
    means = written(known.groupBy("lang").agg((F.sum("bits") / F.sum("n_chars")).alias("mean")), "means")
    drawn = (F.col("bits") + PRIOR_CHARS * F.col("mean")) / (F.col("n_chars") + PRIOR_CHARS)
    scored = scored.join(means, "lang", "left").withColumn("perplexity", F.when(F.col("n_chars") > 0, F.pow(F.lit(2.0), drawn)))
    sure = scored.join(trusted, "doc_id").where("perplexity IS NOT NULL")
    at = lambda c: F.percentile_approx(F.when(c, F.col("perplexity")), quantile, 1000)
    held, long = F.col("held_out"), F.col("n_chars") >= LONG_CHARS
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    bands = {"long": held & long, "short": held & ~long, "held": held}
    limits = sure.groupBy("lang").agg(*[count(c).alias(f"n_{k}") for k, c in bands.items()], *[at(c).alias(k) for k, c in bands.items()], at(F.lit(True)).alias("every"))
    by_lang = F.when(F.col("n_held") >= min_held, F.col("held")).otherwise(slack * F.col("every"))
    limit = lambda k: F.when(F.col(f"n_{k}") >= min_held, F.col(k)).otherwise(by_lang)
    limits = written(limits.select("lang", limit("long").alias("long"), limit("short").alias("short")), "limits")
    out = scored.join(limits, "lang", "left").withColumn("threshold", F.when(long, F.col("long")).otherwise(F.col("short")))
    return out.select("doc_id", "lang", "n_chars", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("kept"), "text_hash")


def op2_kneser_ney(spark, folder: str) -> DataFrame:
    """The whole of documents, trained on the documents that labels trusts."""
    return classified(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
