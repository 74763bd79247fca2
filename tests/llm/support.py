"""Small tables for the tests of the training-data operators."""

import random
import re

from pyspark.sql.types import LongType, StringType, StructField, StructType

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Extra columns whose names clash with ones the operators use inside.
CLASHING = ["h", "s", "size", "rank", "bin", "key", "class", "text_hash", "spans", "n", "words", "_id", "block"]
SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())])


def documents(spark, rows, clash=True):
    """rows: (doc_id, text[, lang[, source]])"""
    full = [(*r, *("en", "src0")[len(r) - 2 :], len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, SCHEMA).repartition(3)
    if clash:
        for c in CLASHING:
            df = df.withColumn(c, df["n_chars"] * 0 - 1)
    return df


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeghilmnorstu") for _ in range(r.randint(2, 8))) for _ in range(vocabulary)]
    return " ".join(r.choice(words) for _ in range(n))


def speech(language, seed, n, vocabulary=900):
    """Different texts over the same words."""
    words = prose(language, 4 * vocabulary, vocabulary).split()
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n))
