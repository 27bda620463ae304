"""Counts of contradictions by a sorted sweep, beside the pairs that the joins list."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from claimloom.operators import consistency as I
from claimloom.operators import risk as J

SCHEMA = "doc_id long, ord int, claim_id string, text string, n_absolute int, metric_name string, metric_value double, metric_unit string, ghg_scope array<int>, target_year int"


def claims_of(spark, rows):
    seen = Counter()
    out = []
    for doc, *rest in rows:
        seen[doc] += 1
        out.append((doc, seen[doc], f"C{seen[doc]}", *rest))
    return spark.createDataFrame(out, SCHEMA)


def listed(claims):
    got = Counter()
    for e in I.contradictions(claims).collect():
        kind = {"numeric_metric_mismatch": e.severity, "target_year_mismatch": "year", "absolute_vs_partial_scope": "scope"}[e.type]
        for c in (e.claim_a, e.claim_b):
            got[e.doc_id, c, kind] += 1
    return +got


def counted(claims, **more):
    got = Counter()
    for r in I.conflict_counts(claims, **more).collect():
        for kind in ("high", "medium", "year", "scope"):
            got[r.doc_id, r.claim_id, kind] = r[kind]
    return +got


def some(seed, n, docs):
    """Ties, exact five and twenty-five per cent, values around one and zero, negatives, null units, years, scopes."""
    r = random.Random(seed)
    values = [0, 1, 0.95, 0.05, 0.75, 0.25, 1.05, 1 / 0.95, 95, 100, 75, 9.5, 10, 105.263157894737, 133.3333333333333, 0.1, 0.15, 0.3, 0.35, -1, -0.95, -100, -95, -75, -0.05, 1e-9, 1e12, 9.5e11, None, None]
    rows = []
    for _ in range(n):
        v = r.choice([*values, round(r.uniform(-2, 2), 2), float(r.randrange(60, 140))])
        rows.append((r.randrange(docs), r.choice(["net zero by 2040", "NET ZERO", "plain"]), r.randrange(2), r.choice([None, "Energy Use"]), None if v is None else float(v), r.choice(["%", "kWh", None]), r.choice([None, [1], [1, 2], [3]]), r.choice([None, None, 2030, 2040])))
    return rows


@pytest.mark.parametrize(("n", "docs"), [(60, 1), (400, 5), (900, 200)])
def test_counts_are_those_of_the_pairs(spark, n, docs):
    claims = claims_of(spark, some(n, n, docs))
    want = listed(claims)
    assert counted(claims) == want and want
    assert counted(claims, small=0) == want  # all swept
    assert counted(claims, small=4, list_rows=10) == want  # some paired, lists cut into ranges


def test_counts_with_units_only(spark):
    claims = claims_of(spark, [(*r[:5], r[5] or "t", *r[6:]) for r in some(7, 300, 6)])
    assert counted(claims, small=0) == listed(claims)


def test_risks_and_summaries_agree_with_the_pairs(spark):
    claims = claims_of(spark, some(3, 300, 40))
    hits = spark.createDataFrame([], "doc_id long")
    edges, counts = I.contradictions(claims), I.conflict_counts(claims, small=6)
    risk = lambda found: {(r.doc_id, r.claim_id): r.consistency_risk for r in J.consistency_risk(claims, found).collect()}
    assert risk(counts) == risk(edges) and max(risk(counts).values()) == 100
    got = {r.doc_id: r.contradictions for r in I.consistency_summary(claims, counts, hits).collect()}
    want = Counter(e.doc_id for e in edges.collect())
    assert got == {d: want[d] for d in got} and sum(got.values()) == sum(want.values())


@pytest.mark.parametrize("tolerance", [0.05, 0.25])
def test_bounds_are_where_the_gap_is(spark, tolerance):
    """Every pair of many decimals is on the same side of the bound as the gap puts it."""
    values = sorted({*(i / 100 for i in range(-150, 300)), *(float(i) for i in range(60, 150)), *(i / 1000 for i in range(900, 1100)), 1e-9, 1e9, 9.5e8})
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ends = df.select("v", I.bound(F.col("v"), tolerance, -1).alias("low"), I.bound(F.col("v"), tolerance, 1).alias("high")).collect()
    for v, low, high in ends:
        for w in values:
            assert (low <= w <= high) == (not abs(v - w) / max(abs(v), abs(w), 1.0) > tolerance), (v, w, low, high)


def test_a_document_of_many_claims(spark):
    """100,000 claims of one document and no name: 5,000,000,000 pairs, and no pair is made."""
    rows = spark.range(100_000).select(
        F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("ord"), F.concat(F.lit("C"), F.col("id")).alias("claim_id"), F.lit("net zero").alias("text"), (F.col("id") % 2).cast("int").alias("n_absolute"),
        (F.col("id") % 1000).cast("double").alias("metric_value"), F.lit("%").alias("metric_unit"), F.array(F.lit(1)).alias("ghg_scope"), (2030 + F.col("id") % 4).cast("int").alias("target_year"),
    )
    t = time.time()
    got = {r.metric_value: (r.high, r.medium, r.year, r.scope) for r in I.conflict_counts(rows).join(rows, ["doc_id", "claim_id"]).collect()}
    assert time.time() - t < 60
    gap = [[abs(a - b) / max(a, b, 1) for b in range(1000)] for a in (0, 7, 500, 999)]
    for a, g in zip((0, 7, 500, 999), gap, strict=True):
        high, medium = 100 * sum(x > 0.25 for x in g), 100 * sum(0.05 < x <= 0.25 for x in g)
        assert got[a] == (high, medium, 75_000, 149_998 if a % 2 else 50_000)
