"""The automaton and the join of large lexicons, beside plain search."""

import random
import time

import pytest
from pyspark.sql import functions as F

from claimloom.functions.fixed import LEXICON
from claimloom.operators import features as D
from claimloom.operators import term_index as L

TERMS = [("b", 2, "green"), ("b", 1, "een"), ("b", 1, "gree"), ("a", 0, "green"), ("a", 7, "低碳"), ("a", 8, "碳"), ("c", 1, "x"), ("c", 0, "\U0001f600y"), ("c", 5, ""), ("c", None, None), ("b", 9, "green"), ("d", 0, "never there")]
TEXTS = ["Green green GREENER", "低碳生活", "碳", None, "", "x", "a\U0001f600y x", "gre en", "ÉX"]


def plain(texts, terms):
    first = {}
    for c, o, t in terms:
        if t:
            first[c, t] = min(o, first.get((c, t), o))
    out = set()
    for i, text in enumerate(texts):
        for c in {c for c, _ in first}:
            own = [t for _, t in sorted((o, t) for (d, t), o in first.items() if d == c and t in (text or "").lower())]
            out |= {(i, c, n + 1, t) for n, t in enumerate(own)}
    return out


@pytest.mark.parametrize("sent", [L.SENT_BYTES, 0])
def test_terms_beside_plain_search(spark, sent):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("term", F.lit("mine"))
    got = L.match_terms(docs, spark.createDataFrame(TERMS, L.SCHEMA), sent_bytes=sent)
    assert got.columns == ["doc_id", "text", "category", "hit", "term"]
    assert {(r.doc_id, r.category, r.hit, r.term) for r in got.collect()} == plain(TEXTS, TERMS)
    assert L.match_terms(docs.limit(0), spark.createDataFrame(TERMS, L.SCHEMA), sent_bytes=sent).count() == 0


def test_both_ways_agree_on_random_texts(spark):
    r = random.Random(4)
    word = lambda n: "".join(r.choice("ab碳 ") for _ in range(n))
    terms = [(r.choice("pq"), i, word(r.randrange(1, 7))) for i in range(300)]
    docs = spark.createDataFrame([(i, word(r.randrange(60))) for i in range(200)], "doc_id long, text string")
    lexicon = spark.createDataFrame(terms, L.SCHEMA)
    one, two = (sorted(tuple(x) for x in L.match_terms(docs, lexicon, sent_bytes=n).collect()) for n in (L.SENT_BYTES, 0))
    assert one == two and len(one) > 1000


def test_the_fixed_lexicon_gives_the_rows_of_match_lexicon(spark):
    """Every one of its terms occurs, alone and inside another word."""
    texts = [x for terms in LEXICON.values() for t in terms for x in (t, f"xx{t.upper()}yy and {t[:-1]}")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {tuple(r) for r in D.match_lexicon(docs).collect()}
    assert {tuple(r) for r in L.match_terms(docs, L.read_lexicon_table(spark)).collect()} == want
    assert {r[-1] for r in want} == {t for terms in LEXICON.values() for t in terms}


def test_no_terms_are_an_error(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    with pytest.raises(ValueError, match="no terms"):
        L.match_terms(docs, spark.createDataFrame([("a", 1, "")], L.SCHEMA))


def test_time_does_not_grow_with_terms(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("our Green plant number "), F.col("id"), F.lit(" aims at net zero ")).alias("text"))
    few = L.read_lexicon_table(spark)
    many = few.unionByName(spark.range(100_000).select(F.lit("many").alias("category"), F.col("id").cast("int").alias("ord"), F.concat(F.lit("term q"), F.col("id")).alias("term")))
    took = []
    for lexicon in (few, many):
        for again in range(2):  # the second run has warm workers
            t = time.time()
            n = L.match_terms(docs, lexicon).count()
            if again:
                took.append(time.time() - t)
        assert n >= 60_000
    assert took[1] < 2 * took[0] + 10


def test_only_terms_leave_the_texts(spark):
    """Long terms, runs over the ends of texts, and no run that is in no term: a text had all its runs sent before."""
    r = random.Random(8)
    words = ["".join(r.choice("abcdefgh") for _ in range(n)) for n in (1, 2, 3, 4, 9, 15, 16, 17, 18, 40, 41, 300) for _ in range(9)]
    words += [words[-1][:299] + "!", "x\ny", words[70] + "\U0001f600"]
    texts = [" ".join(r.choices(words, k=400)) for _ in range(30)] + ["x", "y", "x\ny", words[-1], "ab" * 5000, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    lexicon = [("c", i, w) for i, w in enumerate(words)]
    got = L.match_terms(docs, spark.createDataFrame(lexicon, L.SCHEMA), sent_bytes=0)
    want = plain(texts, lexicon)
    assert {(x.doc_id, x.category, x.hit, x.term) for x in got.collect()} == want
    base = docs.withColumnRenamed("doc_id", "__row")
    runs = L.runs_in(base, spark.createDataFrame([(w,) for w in set(words)], "term string"), "text").collect()
    assert len(want) <= len(runs) == len(set(runs)) < 1.2 * len(want) + 1000
