"""As-of reuse of answers beside a plain search."""

import random

import pytest
from pyspark.sql import functions as F

from claimloom.operators import responses as W


def plain(asked, told, ttl):
    out = {}
    for q, key, at in asked:
        fits = [(t, a) for k, t, a in told if k == key and key is not None and t is not None and at is not None and 0 <= at - t <= ttl]
        out[q] = max(fits, key=lambda x: (x[0], x[1] or ""))[1] if fits else None
    return out


def tables(spark, asked, told):
    at = lambda df: df.withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")))
    q = at(spark.createDataFrame(asked, "request_id long, key string, s double")).withColumn("hit", F.lit("mine"))
    return q, at(spark.createDataFrame(told, "key string, s double, response string"))


@pytest.mark.parametrize(("crowd", "stretch"), [(100_000, 4096), (3, 18), (1, 40)])
def test_reuse_beside_a_plain_search(spark, crowd, stretch):
    """Ties, ages of exactly ttl, answers without text, keys and times that are null, slots and stretches cut small."""
    r = random.Random(crowd)
    moment = lambda: r.choice([float(r.randrange(0, 4000, 50)), round(r.uniform(0, 4000), 3)])
    key = lambda: r.choice(["hot", "hot", "a", "b", None])
    asked = [(i, key(), None if i % 50 == 0 else moment()) for i in range(300)]
    told = [(key(), None if i % 40 == 0 else moment(), r.choice([f"answer {i}", None])) for i in range(80)]
    q, a = tables(spark, asked, told)
    got = W.reuse_responses(q, a, 300, crowd, stretch)
    assert got.columns == ["request_id", "key", "s", "ts", "response", "hit"]
    rows = got.collect()
    want = plain(asked, told, 300)
    assert {x.request_id: x.response for x in rows} == want and len(rows) == 300
    assert all(x.hit == (x.response is not None) for x in rows) and any(x.hit for x in rows)


def test_reuse_without_answers_or_requests(spark):
    q, a = tables(spark, [(1, "a", 1.0)], [("a", 1.0, "x")])
    assert W.reuse_responses(q, a.limit(0)).first().hit is False and W.reuse_responses(q.limit(0), a).count() == 0
    assert W.reuse_responses(q, a).first().response == "x"


def test_a_busy_key_runs_evenly(spark):
    """A million requests of one key in ten minutes: no task of the merge gets more than some slots of them."""
    q = spark.range(1_000_000).select(F.col("id").alias("request_id"), F.lit("hot").alias("key"), F.timestamp_micros(F.col("id") * 600).alias("ts"))
    a = spark.range(0, 600, 7).select(F.lit("hot").alias("key"), F.timestamp_micros(F.col("id") * 1_000_000).alias("ts"), F.concat(F.lit("answer "), F.col("id")).alias("response"))
    got = W.reuse_responses(q, a, 300, crowd=10_000)
    want = F.concat(F.lit("answer "), (F.floor(F.col("request_id") * 600 / 7_000_000) * 7))
    assert got.filter(F.col("response") != want).count() == 0 and got.filter("hit").count() == 1_000_000
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 0.5 * sum(sizes)
