"""Texts are made and matched once: no filter that Spark adds holds them again."""

import pytest
from claimloom.operators import certificates as H
from claimloom.operators import consistency as I
from claimloom.operators import features as D
from claimloom.plans.claims_v2 import analyzed
from claimloom.sources import corpus as C

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("made", [H.match_certifications, H.false_label_signals, D.match_lexicon, lambda c: I.sin_hits(analyzed(c))])
def test_no_filter_matches_texts_again(spark, made):
    plan = made(C.every_claim(spark, SMALL))._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Filter")]
    assert not [f for f in filters if "Checked against" in f or "RLIKE" in f]
