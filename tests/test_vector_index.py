"""The index of cells beside the plain search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.operators import evidence as O
from claimloom.operators import vector_index as V

SF = "/root/testdata/sf0.01"


def table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def found(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", F.round("score", 5)).collect())


def queries_of(v):
    return v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@pytest.mark.parametrize("kind", ["clusters", "noise", "copies"])
def test_exact_search_beside_the_plain_one(spark, monkeypatch, kind):
    """With clusters most cells are left out, with noise few; copies are one crowded cell, cut into parts."""
    monkeypatch.setattr(V, "PART", 50)
    monkeypatch.setattr(V, "BLOCK", 4)
    g = np.random.default_rng(1)
    x = {"clusters": g.normal(size=(30, 8))[g.integers(0, 30, 600)] + 0.05 * g.normal(size=(600, 8)), "noise": g.normal(size=(400, 8)), "copies": np.vstack([np.ones((300, 8)), g.normal(size=(100, 8)), np.zeros((2, 8))])}[kind]
    v = table(spark, x).unionByName(spark.createDataFrame([(5000, None)], "vec_id long, embedding array<double>"))
    index = V.VectorIndex(v, cells=16)
    assert found(index.search(queries_of(v), probes=2)) == found(O.retrieve_vectors(v, queries_of(v)))


def test_empty_tables(spark):
    v = table(spark, np.ones((3, 2)))
    index = V.VectorIndex(v)
    assert index.search(queries_of(v.limit(0))).count() == 0 and V.VectorIndex(v.limit(0)).search(queries_of(v)).count() == 0
    assert index.search(queries_of(v)).count() == 2


def test_recall_of_the_approximate_mode(spark):
    """Ids divisible by 20 against all rows of the given table."""
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    index = V.VectorIndex(v, sample=500)
    assert index.rows.count() == v.filter("embedding IS NOT NULL").count()
    want, got = ({(r.query_id, r.vec_id) for r in df.collect()} for df in (O.retrieve_vectors(v, queries_of(v)), index.search(queries_of(v), probes=max(8, len(index.cells) * 3 // 4), exact=False)))
    assert len(want & got) >= 0.9 * len(want)


def test_tasks_hold_few_scores(spark, monkeypatch):
    """A query that looks into every cell, and a full part, leave the task in small frames; results don't depend on them."""
    x = np.random.default_rng(3).normal(size=(500, 4))
    v = table(spark, np.vstack([x, x[:100]]))
    index = V.VectorIndex(v, cells=20)
    want = found(O.retrieve_vectors(v, queries_of(v)))
    monkeypatch.setattr(V, "SCORES", 64)
    monkeypatch.setattr(V, "ROWS", 7)
    assert found(index.search(queries_of(v), probes=2)) == want
    asked = index._asked(v.select(F.col("vec_id").alias("query_id"), "embedding"), lambda away, radius, f: away < 9)
    assert asked.count() == 600 * len(index.cells)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000000")
    try:
        sizes = []
        monkeypatch.setattr(type(v), "mapInPandas", lambda self, run, schema: sizes.extend(len(f) for f in run([self.toPandas()])) or self)
        index._asked(v.select(F.col("vec_id").alias("query_id"), "embedding"), lambda away, radius, f: away < 9)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sum(sizes) == 600 * len(index.cells) and max(sizes) <= 7
