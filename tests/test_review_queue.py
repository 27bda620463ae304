"""The queue for review takes the risk of those documents only that may be in it."""

import pytest
from pyspark.sql import functions as F

from claimloom.operators import planned as R
from claimloom.operators import scoring_v1 as S
from claimloom.plans import records
from claimloom.sources import corpus as C

SF = "/root/testdata/sf0.001"


def test_confidence_alone(spark):
    """As score_documents tells it, also of null, blank and untrimmed texts."""
    docs = C.documents(spark, SF).unionByName(spark.createDataFrame([(-1, None), (-2, " \n "), (-3, "  green products, greener future  ")], "doc_id long, text string"))
    a, b = ({r.doc_id: r.confidence for r in f(docs).select("doc_id", "confidence").collect()} for f in (S.score_documents, S.document_confidence))
    assert a == b and a[-1] == a[-2] == 0


@pytest.mark.parametrize("n", [1, 3, 5, 6, 40])
def test_candidates_hold_the_queue(spark, n):
    """With equal and missing confidences; with fewer documents than places, all."""
    docs = spark.createDataFrame([(i, c, float(i * 7 % 5)) for i, c in enumerate([None, None, 1.0, 1.0, 1.0, 2.0, 2.0, 3.0])], "doc_id long, confidence double, gri double")
    some = R.review_candidates(docs, n)
    assert R.review_queue(some, n).collect() == R.review_queue(docs, n).collect()
    assert some.count() == {1: 2, 3: 5, 5: 5, 6: 7, 40: 8}[n]


def test_risks_of_candidates_only(spark, monkeypatch):
    seen, keep = [], records.document_risk
    monkeypatch.setattr(records, "document_risk", lambda rows: seen.append(rows) or keep(rows))
    out = records.r4(spark, SF)
    assert out.count() == 100
    asked = seen[0].select("doc_id").distinct().count()
    assert 100 <= asked < C.documents(spark, SF).count()
