"""Reports need little disk: claims are dealt out once, without their texts, and lines are packed."""

import gzip
import json
from pathlib import Path

from claimloom.operators import evidence as O
from claimloom.plans import evidence as P
from claimloom.sources import corpus as C
from claimloom.sources.shared import shared_dir

SMALL = "/root/testdata/sf0.001"


def dealt(df) -> list[str]:
    """The lines of the plan that shuffle, each with what it shuffles."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return [below for line, below in zip(lines, lines[1:], strict=False) if "Exchange hashpartitioning" in line]


def test_claims_are_dealt_out_once_without_texts(spark):
    claims, docs = dealt(C.claims(spark, SMALL)), dealt(C.documents(spark, SMALL))
    assert len(claims) == len(docs) == 1  # documents are made where their claims are
    assert "concat" not in claims[0] + docs[0]


def test_a_report_is_one_grouping(spark):
    made = O.full_reports(P.verdicts(spark, SMALL).selectExpr("*", "1D AS text_risk_score"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert len(dealt(made)) == 1 and "Join" not in plan and plan.count("FileScan") == 1


def test_documents_without_id_have_no_report(spark):
    v = spark.createDataFrame([(d, "C1", "text", "supported", 0.9, 10.0, 40.0) for d in (None, 1)], "doc_id long, claim_id string, text string, verdict string, confidence double, evidence_risk_score double, text_risk_score double")
    assert [r.doc_id for r in O.full_reports(v).collect()] == [1]


def test_report_lines_are_packed(spark):
    top = Path(f"{shared_dir(spark)}/claimloom".removeprefix("file:"))
    before = set(top.glob("reports-*"))
    rows = P.a11e(spark, SMALL).count()
    (made,) = set(top.glob("reports-*")) - before
    files = [f for f in made.iterdir() if f.name.startswith("part-")]
    lines = [line for f in files for line in gzip.open(f, "rt").read().splitlines()]
    assert len(lines) == rows and sum(f.stat().st_size for f in files) * 8 < sum(len(x.encode()) for x in lines)
    assert all(len(r["claims"]) == r["total_claims"] for r in map(json.loads, lines))


def test_prose_is_not_parsed_and_odd_answers_stay(spark):
    raws = ["null", "5", '"abc"', "", None, "cannot say", '\n{"verdict": "supported"}', 'Sure: {"verdict": "supported"}', '[[{"verdict": "supported"}]]', '{"verdict": "supported"', "{}"]
    made = O.normalize_verdicts(spark.createDataFrame(list(enumerate(raws)), "i int, raw string"))
    assert [(r.verdict, r.confidence, r.parsed) for r in made.orderBy("i").collect()] == [("supported", 0.5, True) if i == 6 else ("insufficient_evidence", 0.5, True) if i == 10 else ("insufficient_evidence", 0.2, False) for i in range(len(raws))]
    plan = made.select("verdict", "confidence", "evidence_risk_score", "parsed")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == plan.count("jsonObjectKeys") == 1
