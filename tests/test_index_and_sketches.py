"""The stored chunk index beside the plain search, and the ranks of sketches."""

import os
import random
import shutil
import tempfile

from pyspark.sql import functions as F

from claimloom.operators import evidence as O
from claimloom.operators import planned as R
from claimloom.sources.chunk_index import ChunkIndex


def chunks_of(spark, seed, docs):
    r = random.Random(seed)
    words = ["carbon", "Energy", "net", "zero", "水", "42", "the", "the", "the"]
    rows = [(d, c, " ".join(r.choice(words) for _ in range(r.randrange(15)))) for d in docs for c in range(r.randrange(1, 9))]
    return spark.createDataFrame(rows, "doc_id long, chunk int, text string")


def found(df):
    return sorted(tuple(r) for r in df.select("doc_id", "claim_id", "query_id", "rank", "chunk", "score").collect())


def test_index_beside_plain_search(spark):
    own = chunks_of(spark, 1, range(30)).unionByName(spark.createDataFrame([(99, 0, None), (99, 1, "")], "doc_id long, chunk int, text string"))
    queries = spark.createDataFrame([(d, "C1", f"Q{i}", q) for d in (3, 7, 29, 99, 500) for i, q in enumerate(["carbon energy", "THE the 水", "nothing", ""])], "doc_id long, claim_id string, query_id string, query_text string")
    want = found(O.retrieve_lexical(queries, own))
    index = ChunkIndex(spark, tempfile.mkdtemp(dir="/tmp"))
    for batch in range(3):
        index.add(own.filter(F.col("doc_id") % 3 == batch), batch)
    assert found(index.search(queries)) == want and len(want) > 20
    index.add(own.filter(F.col("doc_id") % 3 == 1), 1)  # once more: it replaces itself
    assert found(index.search(queries)) == want
    # no text is kept, and none is read
    assert {f for f in os.listdir(index.path)} == {"postings", "terms", "sizes"} and "text" not in index._table("postings", "token string").columns
    shutil.rmtree(index.path)


def test_sketches_merge_and_keep_ranks(spark):
    rows = spark.range(200_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias("sector"), (F.col("id") % 12).alias("month"), F.when(F.col("id") % 7 != 0, F.pow(F.xxhash64("id") % 1000 / 10.0, 3)).alias("value"))
    kept = R.baseline_sketches(rows, ["sector"], "month")
    got = R.rank_errors(rows, R.baselines_of_sketches(kept, ["sector"]), ["sector"]).collect()
    assert len(got) == 6 and max(r.error for r in got) < 0.01
    exact = {r.sector: r for r in R.sector_baselines(rows.filter("value IS NOT NULL"), ["sector"]).collect()}
    assert {r.sector: r.n for r in got} == {s: r.n for s, r in exact.items()}
    wrong = R.rank_errors(rows, R.sector_baselines(rows, ["sector"]).withColumn("p50", F.col("p90")), ["sector"])
    assert all(abs(r.error - 0.4) < 0.02 for r in wrong.collect())
