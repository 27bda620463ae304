"""Terms leave Python by their lists, spans by one pass, and equal texts are analysed once."""

from pyspark.sql import functions as F

from claimloom.functions.semantics import found, list_name, lists_in, spans_in
from claimloom.operators import scoring_v1 as S
from claimloom.plans import claims_v2 as P

TEXTS = ["Green eco green", "", None, "xEcoeco", "绿色\U0001f600绿色", "aaaa"]


def test_lists_are_those_of_found(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    lists = [["eco", "green", "never"], ["绿色", "\U0001f600", "eco"], ["green", "eco", "green"], [""], []]
    rows = docs.select("doc_id", lists_in(F.lower("text"), lists).alias("l"), *[found(F.col("text"), terms).alias(f"f{i}") for i, terms in enumerate(lists)])
    for r in rows.collect():
        for i, terms in enumerate(lists):
            assert r["l"][list_name(terms)] == r[f"f{i}"], (r, terms)


def test_spans_do_not_overlap_and_count_characters(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = docs.select("doc_id", F.explode(spans_in(F.lower("text"), [("a", "eco"), ("b", "eco"), ("a", "aa"), ("a", "绿色"), ("a", "")])).alias("s")).select("doc_id", "s.*")
    want = [(0, c, "eco", 6, 9) for c in "ab"] + [(3, c, "eco", i, i + 3) for c in "ab" for i in (1, 4)] + [(4, "a", "绿色", 0, 2), (4, "a", "绿色", 3, 5), (5, "a", "aa", 0, 2), (5, "a", "aa", 2, 4)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_no_list_is_compared_with_another_when_documents_are_scored(spark):
    docs = spark.createDataFrame([(1, "Our green plan")], "doc_id long, text string")
    assert "array_intersect" not in S.score_documents(docs)._jdf.queryExecution().optimizedPlan().toString()


def test_equal_texts_are_analysed_once(spark):
    texts = ["Net zero by 2030, verified to ISO 14064-1.", None, "", "Cut by 12 kg since 2015"]
    claims = spark.range(40).select((F.col("id") % 3).alias("doc_id"), F.col("id").cast("int").alias("ord"), F.col("id").cast("string").alias("claim_id"), F.array(*[F.lit(t) for t in texts])[(F.col("id") % 4).cast("int")].alias("text"))
    one, all_ = P.analyzed(claims), P.text_analyzed(claims)
    assert one.columns == all_.columns
    assert sorted(map(str, one.collect())) == sorted(map(str, all_.collect()))
    assert "ArrowEvalPython" not in one._jdf.queryExecution().optimizedPlan().toString()
