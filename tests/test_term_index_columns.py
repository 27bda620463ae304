"""Hits don't carry the columns of their text through Python."""

from claimloom.operators import term_index as L
from pyspark.sql import functions as F


def test_texts_are_not_copied_for_their_hits(spark):
    docs = spark.range(4).select(F.col("id").alias("doc_id"), F.expr("repeat('ab cd ', 1000)").alias("text"))
    lexicon = spark.createDataFrame([("x", i, t) for i, t in enumerate(["ab", "cd", "b c", "zz"])], L.SCHEMA)
    hits = L.match_terms(docs, lexicon).select("doc_id", "category", "hit", "term")
    assert sorted(map(tuple, hits.collect())) == [(d, "x", h, t) for d in range(4) for h, t in ((1, "ab"), (2, "cd"), (3, "b c"))]
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    exploded = [line for line in plan.splitlines() if "Generate" in line]
    assert exploded and "MapInArrow" not in plan
