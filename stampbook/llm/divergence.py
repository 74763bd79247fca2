"""Quality rules by distribution: Jensen-Shannon distance of a document's histograms to those of its language.

DataFrame functions only. One pass over the text leaves a narrow table of counts; references and verdicts come from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stampbook.llm.common import SPACE_CLASS, small_broadcast, tidy, words_of, written

#: Character classes, each taken out of what the ones before it left; the rest is a class too.
CLASSES = {"lower": "[a-z]+", "space": f"[{SPACE_CLASS}]+", "upper": "[A-Z]+", "digit": "[0-9]+", "point": r"[.,;:!?'\"()-]+", "symbol": "[#*$%&|<>]+"}
#: One code for each of a language's common words, and one for all other words.
CODES = "ABCDEFGHIJKLMNOPQRSTUVWX"
OTHER = "-"
BROADCAST_LANGUAGES = 10_000
WINDOW = 8


def _common_words(docs: DataFrame) -> DataFrame:
    """Per language its most frequent words, most frequent first, counted over all documents."""
    words = docs.select("lang", F.explode(words_of(F.col("text"))).alias("word"))
    counts = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("c"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("c"), "word"))
    top = counts.withColumn("place", place).where(F.col("place") <= len(CODES))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"])
    return top.groupBy("lang").agg(ordered.alias("common"))


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words inside windows of 8 words that the text holds twice or more."""
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    windows = F.transform(F.sequence(F.lit(1), F.size("hashes") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("hashes", i, WINDOW)))
    df = df.withColumn("hashes", hashes)
    df = df.withColumn("windows", F.when(F.size("hashes") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    places = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("sorted", F.when(repeated, places).otherwise(F.lit(None)))
    n = F.size("sorted")

    def twin(x, i):
        before = F.when(i > 0, F.col("sorted")[i - 1]["h"] == x["h"]).otherwise(False)
        after = F.when(i < n - 1, F.col("sorted")[i + 1]["h"] == x["h"]).otherwise(False)
        return before | after

    df = df.withColumn("twins", F.array_sort(F.transform(F.filter("sorted", twin), lambda x: x["i"])))
    step = F.transform("twins", lambda p, k: F.when(k < F.size("twins") - 1, F.least(F.lit(WINDOW), F.col("twins")[k + 1] - p)).otherwise(WINDOW))
    covered = F.aggregate(step, F.lit(0), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("hashes", "windows", "sorted", "twins")


def counted(docs: DataFrame) -> DataFrame:
    """One narrow row per document: base counts, ``classes`` and ``common`` (histograms as arrays of counts), n_words, lang."""
    docs = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    common = small_broadcast(written(_common_words(docs), "common"), BROADCAST_LANGUAGES)
    df = docs.join(common, "lang", "left").withColumn("words", words_of(F.col("text")))

    names, left = list(CLASSES), "text"
    for name, pattern in CLASSES.items():
        df = df.withColumn(f"_{name}", F.regexp_replace(left, pattern, ""))
        df = df.withColumn(f"n_{name}", (F.length(left) - F.length(f"_{name}")).cast("long"))
        if left != "text":
            df = df.drop(left)
        left = f"_{name}"
    df = df.withColumn("classes", F.array(*[F.col(f"n_{name}") for name in names], F.length(left).cast("long"))).drop(left)
    df = df.withColumn("word_chars", F.length("text") - F.col("n_space"))
    lines = F.filter(F.split("text", "\n"), lambda line: F.rlike(line, F.lit(f"[^{SPACE_CLASS}]")))
    df = df.withColumn("lines", lines)
    df = df.withColumn("n_dup_lines", F.size("lines") - F.size(F.array_distinct("lines"))).drop("lines", "text")

    codes = F.array(F.lit(OTHER), *[F.lit(c) for c in CODES])
    known = F.coalesce("common", F.array().cast("array<string>"))
    marks = F.array_join(F.transform("words", lambda w: F.element_at(codes, F.array_position(known, w).cast("int") + 1)), "")
    df = df.withColumn("marks", marks).drop("common")
    histogram = F.array(*[(F.length("marks") - F.length(F.replace("marks", F.lit(c), F.lit("")))).cast("long") for c in [OTHER, *CODES]])
    df = df.withColumn("common", histogram).drop("marks")
    df = _repeat_words(df.withColumn("n_words", F.size("words").cast("long")))
    return df.select("doc_id", "lang", "n_words", F.col("word_chars").cast("long"), F.col("n_symbol").alias("n_symbols"), F.col("n_dup_lines").cast("long"), "n_repeat_words", "classes", "common")


def _sums(column: str, n: int) -> Column:
    return F.array(*[F.sum(F.col(column)[i]) for i in range(n)])


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of two arrays of counts; 0 if either is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    n, m = total(p), total(q)
    terms = F.zip_with(p, q, lambda a, b: part(a / n, (a / n + b / m) / 2) + part(b / m, (a / n + b / m) / 2))
    return F.when((n > 0) & (m > 0), F.sqrt(F.greatest(F.lit(0.0), total(terms) / 2))).otherwise(0.0)


def judge(counts: DataFrame, class_limit: float, word_limit: float, min_words: int, min_chars: int) -> DataFrame:
    """Verdicts from ``counted`` rows: base rules, then the distances to the language's pooled histograms."""
    bad = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    counts = counts.withColumn("base_failed", bad)
    good = counts.where("NOT base_failed")
    references = good.groupBy("lang").agg(_sums("classes", len(CLASSES) + 1).alias("ref_classes"), _sums("common", len(CODES) + 1).alias("ref_common"))
    references = small_broadcast(written(references, "references"), BROADCAST_LANGUAGES)
    df = counts.join(references, "lang", "left")
    df = df.withColumn("class_distance", F.coalesce(js_distance(F.col("classes"), F.col("ref_classes")), F.lit(0.0)))
    df = df.withColumn("word_distance", F.coalesce(js_distance(F.col("common"), F.col("ref_common")), F.lit(0.0)))
    far = (F.col("word_chars") >= min_chars) & (F.col("class_distance") > class_limit) | (F.col("n_words") >= min_words) & (F.col("word_distance") > word_limit)
    return df.withColumn("kept", ~F.col("base_failed") & ~far).drop("ref_classes", "ref_common")


def quality(docs: DataFrame, class_limit: float = 0.25, word_limit: float = 0.45, min_words: int = 50, min_chars: int = 100) -> DataFrame:
    """Base counts and the verdict for every document.

    References are pooled histograms over all documents of a language that pass the base rules. A document fails if its
    character classes lie farther than ``class_limit`` from the reference (from ``min_chars`` word characters on) or its common
    words farther than ``word_limit`` (from ``min_words`` words on): shorter texts say too little. A missing language is one of
    its own; a missing text has no words and fails the base rules. Repeated rows are judged alike. An empty table gives an
    empty result. Result: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and both
    distances. Other columns are ignored.
    """
    found = judge(written(counted(docs), "counts"), class_limit, word_limit, min_words, min_chars)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


@tidy
def op7_divergence(spark, folder: str) -> DataFrame:
    """Every whole text of documents."""
    return quality(spark.read.parquet(f"{folder}/documents.parquet"))
