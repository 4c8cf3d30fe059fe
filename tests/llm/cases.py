"""Awkward documents shared by the tests of this folder."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["score", "Kept", "n_words", "key", "entry", "size", "copies", "lang_pred", "n_tokens", "bucket", "trusted", "sample"]


def words(seed, n, vocabulary=200):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def documents(spark, clash=False):
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n\x0b\x0c\r ", "en", "a", 7), (4, "one", "en", "a", 3),
        (5, words(1, 80), "en", "a", 1), (6, words(1, 80), "en", "b", 1), (6, words(1, 80), "en", "b", 1), (7, words(2, 90), None, "b", 1),
        (8, words(3, 30000, 4000), "fr", None, 1), (9, "x" * 200000, "fr", "é", 1), (10, "Ünïcödé text 😀 " * 40, "de", "é", 1), (None, words(4, 60), "de", "b", 1), (-50, "a\nb\na\n\nb", "en", "b", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in CLASHING if clash else []:
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit(1))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
