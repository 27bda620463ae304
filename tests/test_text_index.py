"""The text index from one search of the texts."""

from pyspark.sql import functions as F

from claimloom.operators import features as D
from claimloom.operators import text_index as M
from claimloom.plans import models
from claimloom.sources import corpus as C

SF = "/root/testdata/sf0.001"


def test_one_search_tells_what_three_did(spark, monkeypatch):
    docs = C.documents(spark, SF).unionByName(spark.createDataFrame([(-1, ""), (-2, "NOT YET green; however, a gap. 挑战与不足")], "doc_id long, text string"))
    names = ["doc_id", "m3", "m4", "positive", "balance"]
    want = sorted(M.framing(M.vagueness(D.flags_v2(D.lexicon_counts(docs)))).select(*names).collect())
    searches, keep = [], F.arrow_udf
    monkeypatch.setattr(F, "arrow_udf", lambda f, kind: searches.append(kind) or keep(f, kind))
    monkeypatch.setattr(models, "_docs", lambda spark, sf: docs)
    assert sorted(models._indexed(spark, SF).select(*names).collect()) == want
    assert len(searches) == 1 and searches[0].count("array<string>") == len(M.COUNTED)
