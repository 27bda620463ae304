"""Terms that a text contains, whatever their number: one pass over the text."""

import time

from claimloom.functions.semantics import found
from claimloom.operators.features import lexicon_counts
from pyspark.sql import functions as F


def test_terms_that_begin_end_or_overlap_others(spark):
    terms = ["greener", "green", "een", "net zero", "zero waste", "碳中和", "中和", "100%", "c.b"]
    texts = ["A GREENER net zero waste", "100% 碳中和", "c.b", "cxb", "", None, "gree n"]
    rows = spark.createDataFrame(enumerate(texts), "i int, text string").select("i", found(F.col("text"), terms).alias("m")).orderBy("i").collect()
    assert [r["m"] for r in rows] == [["greener", "green", "een", "net zero", "zero waste"], ["碳中和", "中和", "100%"], ["c.b"], [], [], [], []]


def test_empty_and_repeated_terms(spark):
    rows = spark.createDataFrame([("ab",), (None,)], "text string").select(found(F.col("text"), ["", "b", "b"]).alias("m"), found(F.col("text"), []).alias("n")).collect()
    assert [(r["m"], r["n"]) for r in rows] == [(["", "b", "b"], []), ([], [])]


def test_time_does_not_grow_with_the_terms(spark):
    docs = spark.range(0, 20_000, 1, 8).select(F.col("id").alias("doc_id"), F.expr("repeat(concat('plain words ', id, ' '), 20)").alias("text"))

    def seconds(n):
        own = {"a": [f"term {i} here" for i in range(n)]}
        t = time.time()
        lexicon_counts(docs, own).agg(F.sum("n_a")).collect()
        return time.time() - t

    seconds(20)
    assert seconds(2000) < 4 * seconds(20) + 3
