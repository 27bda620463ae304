"""From claims to queries, retrieved chunks, verdicts and reports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import binned, each
from ..functions.fixed import LEVELS

VERDICTS = ["supported", "partially_supported", "contradicted", "insufficient_evidence"]
#: Risk bands of verdicts: low and high.
BANDS = {"supported": (0, 35), "partially_supported": (35, 65), "contradicted": (65, 85), "insufficient_evidence": (50, 75)}
VERDICT_SCHEMA = "claim_id string, verdict string, confidence double, evidence_risk_score double, supporting_evidence array<struct<chunk_text: string, page_number: int>>, contradicting_evidence array<struct<chunk_text: string, page_number: int>>, evidence_gaps array<struct<gap_type: string, severity: string>>"


def expand_queries(claims: DataFrame) -> DataFrame:
    """3-5 queries of a claim with structure, each for a purpose that its fields allow; a claim of which
    nothing is known is its own query. No join: purposes are an array."""
    c, subject = F.col, F.coalesce(F.col("metric_unit"), F.lit("claim"))
    words = [
        ("value", c("metric_value").isNotNull(), F.concat(F.lit("data behind the reported value in "), subject)),
        ("baseline", c("baseline_year").isNotNull(), F.concat(F.lit("reference year "), c("baseline_year").cast("string"))),
        ("boundary", c("ghg_scope").isNotNull(), F.concat(F.lit("boundary and scope "), F.array_join(c("ghg_scope").cast("array<string>"), " "))),
        ("method", c("metric_value").isNotNull(), F.lit("accounting method and standard")),
        ("assurance", F.size("certs") > 0, F.concat(F.lit("assurance by "), F.array_join("certs", " "))),
        ("consistency", c("target_year").isNotNull(), F.concat(F.lit("other targets for "), c("target_year").cast("string"))),
    ]
    fit = F.slice(F.array_compact(F.array(*[F.when(t, F.struct(F.lit(p).alias("purpose"), q.alias("query_text"))) for p, t, q in words])), 1, 5)
    own = F.array(F.struct(F.lit("claim").alias("purpose"), c("text").alias("query_text")))
    rows = each(claims, ["doc_id", "claim_id"], F.when(F.size(fit) > 0, fit).otherwise(own), "q", "i")
    return rows.select("doc_id", "claim_id", F.format_string("Q%03d", F.col("i") + 1).alias("query_id"), "q.purpose", "q.query_text")


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def postings(chunks: DataFrame) -> DataFrame:
    """doc_id, chunk, token, tf: tokens are counted per chunk before they move."""
    return chunks.select("doc_id", "chunk", F.explode(tokens_of(F.col("text"))).alias("token")).groupBy("doc_id", "chunk", "token").agg(F.count("*").alias("tf"))


def search_postings(queries: DataFrame, tf: DataFrame, idf: DataFrame, k: int = 5) -> DataFrame:
    """The k chunks of the query's own document with the most tf-idf weight. The join is on document and token,
    so a frequent token only meets its document."""
    q = queries.select("doc_id", "claim_id", "query_id", F.explode(F.array_distinct(tokens_of(F.col("query_text")))).alias("token"))
    hits = q.join(tf, ["doc_id", "token"]).join(idf, "token").groupBy("doc_id", "claim_id", "query_id", "chunk").agg(F.round(F.sum(F.col("tf") * F.col("idf")), 6).alias("score"))
    w = Window.partitionBy("doc_id", "claim_id", "query_id").orderBy(F.desc("score"), "chunk")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def inverse_frequency(df: DataFrame, n: DataFrame) -> DataFrame:
    """token, idf from token, df and the one row n."""
    return df.crossJoin(F.broadcast(n)).select("token", F.log(1 + F.col("n") / F.col("df")).alias("idf"))  # n is one row


def retrieve_lexical(queries: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """search_postings over chunks as they are."""
    tf = postings(chunks)
    return search_postings(queries, tf, inverse_frequency(tf.groupBy("token").agg(F.count("*").alias("df")), chunks.agg(F.count("*").alias("n"))), k)


def retrieve_vectors(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 4096, part: int = 32768) -> DataFrame:
    """The k nearest vectors by cosine of each query (query_id, embedding), not counting itself. Queries go in
    blocks and vectors in parts of bounded size; each block meets each part in one task, which keeps k per
    query, then Spark ranks. Scores count to six decimals, and the smaller id wins a tie."""
    rows = vectors.select("vec_id", "embedding").filter("embedding IS NOT NULL")
    asked = queries.select("query_id", "embedding").filter("embedding IS NOT NULL")
    n_blocks, n_parts = asked.count() // block + 1, rows.count() // part + 1

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        """Even shares by place in the input, also where ids repeat; a copy for each share of the other side."""
        return df.withColumn(own, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))

    def nearest(some: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(others):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        ids, q = some["query_id"].to_numpy(), unit(np.stack(some["embedding"].to_numpy()).astype(np.float64))
        best, best_ids = np.full((len(q), 0), -2.0), np.zeros((len(q), 0), np.int64)
        for start in range(0, len(others), 1024):  # a slice of scores at a time
            own = others["vec_id"].to_numpy()[start : start + 1024]
            score = np.round(q @ unit(np.stack(others["embedding"].to_numpy()[start : start + 1024]).astype(np.float64)).T, 6)
            score[ids[:, None] == own[None, :]] = -2
            best, best_ids = np.hstack([best, score]), np.hstack([best_ids, np.broadcast_to(own, score.shape)])
            top = np.lexsort((best_ids, -best))[:, :k]
            best, best_ids = np.take_along_axis(best, top, 1), np.take_along_axis(best_ids, top, 1)
        return pd.DataFrame({"query_id": np.repeat(ids, best.shape[1]), "vec_id": best_ids.ravel(), "score": best.ravel()})

    left, right = dealt(asked, "block", n_blocks, "part", n_parts), dealt(rows, "part", n_parts, "block", n_blocks)
    met = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(nearest, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.filter("score >= -1.5").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def merge_query_results(*hits: DataFrame) -> DataFrame:
    """The hits of all queries of a claim, query by query. A chunk that several queries find stays once for each:
    dedupe_chunks takes the first."""
    out = hits[0]
    for more in hits[1:]:
        out = out.unionByName(more)
    return out


def query_counts(merged: DataFrame) -> DataFrame:
    """For each claim: hits, different chunks, and queries that found something."""
    return merged.groupBy("doc_id", "claim_id").agg(F.count("*").alias("chunks"), F.countDistinct("chunk").alias("different"), F.countDistinct("query_id").alias("queries"))


def dedupe_chunks(retrieved: DataFrame) -> DataFrame:
    """One row per claim of chunks with the same first 120 characters and page, in page order (null is 0)."""
    rows = retrieved.withColumns({"__h": F.substring("text", 1, 120), "__p": F.coalesce("page", F.lit(0))})
    first = Window.partitionBy("doc_id", "claim_id", "__h", "__p").orderBy("query_id", "rank")
    rows = rows.withColumn("__r", F.row_number().over(first)).filter("__r = 1")
    order = Window.partitionBy("doc_id", "claim_id").orderBy("__p", "query_id", "rank")
    return rows.withColumn("place", F.row_number().over(order)).drop("__h", "__p", "__r")


def evidence_context(deduped: DataFrame, n: int = 15) -> DataFrame:
    rows = deduped.filter(F.col("place") <= n)
    block = F.concat(F.lit("["), F.coalesce(F.col("page").cast("string"), F.lit("?")), F.lit("] "), F.col("text"))
    out = rows.groupBy("doc_id", "claim_id").agg(F.sort_array(F.collect_list(F.struct("place", block.alias("b")))).alias("l"))
    return out.select("doc_id", "claim_id", F.array_join("l.b", "\n\n").alias("context"), F.size("l").alias("chunks"))


def default_verdicts(claims: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Claims without any chunk."""
    rest = claims.select("doc_id", "claim_id").join(retrieved.select("doc_id", "claim_id").distinct(), ["doc_id", "claim_id"], "left_anti")
    return rest.withColumns({"verdict": F.lit("insufficient_evidence"), "confidence": F.lit(0.3).cast("double"), "evidence_risk_score": F.lit(60.0).cast("double"), "gap": F.lit("no_evidence_found")})


def normalize_verdicts(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Model verdicts: a list counts by its first entry, the id is the claim's own, defaults for what is
    missing; what isn't JSON is insufficient with confidence 0.2 and risk 60."""
    text = F.trim(raw)
    rows = rows.withColumn("__item", F.when(text.startswith("["), F.get_json_object(text, "$[0]")).otherwise(text))
    # answers are parsed once, as columns that several others read; prose is not: each failure to parse is an exception
    json = F.when(~F.col("__item").rlike(r"^\s*[A-Za-z]"), F.col("__item"))
    rows = rows.withColumns({"__ok": F.json_object_keys(json).isNotNull(), "__v": F.from_json(json, VERDICT_SCHEMA, {"mode": "PERMISSIVE"})})
    ok, v = F.col("__ok"), F.col("__v")
    kind = F.when(v["verdict"].isin(VERDICTS), v["verdict"]).otherwise("insufficient_evidence")
    d = lambda x: F.lit(x).cast("double")
    none = F.expr("array()").cast("array<struct<chunk_text: string, page_number: int>>")
    return rows.withColumns({
        "verdict": F.when(ok, kind).otherwise("insufficient_evidence"), "confidence": F.when(ok, F.coalesce(v["confidence"], d(0.5))).otherwise(d(0.2)),
        "evidence_risk_score": F.when(ok, F.coalesce(v["evidence_risk_score"], d(50))).otherwise(d(60)), "supporting": F.coalesce(v["supporting_evidence"], none),
        "contradicting": F.coalesce(v["contradicting_evidence"], none), "parsed": F.coalesce(ok, F.lit(False)),
    }).drop("__item", "__ok", "__v")


def verdict_band_check(verdicts: DataFrame) -> DataFrame:
    bands = F.create_map(*[x for v, (a, b) in BANDS.items() for x in (F.lit(v), F.array(F.lit(a), F.lit(b)))])[F.col("verdict")]
    inside = F.col("evidence_risk_score").between(bands[0], bands[1])
    return verdicts.withColumn("in_band", F.coalesce(inside, F.lit(False)))


def attach_text_risk(claims: DataFrame, index: DataFrame) -> DataFrame:
    rows = claims.join(index.select("doc_id", F.col("tgri").alias("text_risk_score"), F.col("risk_level").alias("text_risk_level")), "doc_id", "left")
    return rows.fillna(0, ["text_risk_score"]).fillna("unknown", ["text_risk_level"])


def _mean(c: Column | str) -> Column:
    """Rounded to nine digits, so halves don't depend on the order in which scores were summed."""
    return F.round(F.avg(c), 9)


def _sums() -> list[Column]:
    """What a document's scores need: the number of claims and both means."""
    return [F.count("*").alias("claims"), _mean(F.coalesce("text_risk_score", F.lit(0.0))).alias("t"), _mean("evidence_risk_score").alias("e")]


def _gri() -> Column:
    return F.round(F.lit(0.5).cast("double") * F.col("t") + F.lit(0.5).cast("double") * F.col("e"), 9)


def _scores() -> list[Column]:
    """From _sums: both means, half of each, to one decimal (half to even), and the level."""
    return [F.bround("t", 1).alias("text_risk_score"), F.bround("e", 1).alias("evidence_risk_score"), F.bround(_gri(), 1).alias("document_gri"), binned(_gri(), [25, 50, 75], LEVELS).alias("risk_level")]


def _distribution() -> list[Column]:
    return [F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS]


def evidence_report(verdicts: DataFrame) -> DataFrame:
    """Per document: mean text and evidence risk, half of each, to one decimal (half to even)."""
    return verdicts.groupBy("doc_id").agg(*_sums()).select("doc_id", "claims", *_scores())


def verdict_distribution(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("doc_id").agg(*_distribution())


def key_findings(counts: DataFrame) -> DataFrame:
    say = [("contradicted", "claims contradict other parts of the report"), ("insufficient_evidence", "claims lack sufficient evidence"), ("partially_supported", "claims are supported in part")]
    found = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {s}"))) for c, s in say]))
    return counts.withColumn("findings", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("all claims are supported"))))


REPORT = "doc_id long, total_claims long, scoring struct<text_risk_score: double, evidence_risk_score: double, document_gri: double, risk_level: string, distribution: struct<supported: long, partially_supported: long, contradicted: long, insufficient_evidence: long>>, findings array<string>, top_claims array<struct<claim_id: string, claim_text: string, verdict: string, evidence_risk_score: double>>, claims array<struct<claim_id: string, verdict: string, confidence: double, evidence_risk_score: double>>"


def full_reports(verdicts: DataFrame, n: int = 5) -> DataFrame:
    """doc_id and report: a document's nested report as JSON text of schema REPORT; none where doc_id is null.
    verdicts: doc_id, claim_id, text, verdict, confidence, evidence_risk_score, text_risk_score. One grouping makes
    all parts of a report, so claims are read and dealt out once."""
    c = F.col
    claim = F.struct((-c("evidence_risk_score")).alias("o"), "claim_id", F.substring("text", 1, 150).alias("claim_text"), "verdict", "evidence_risk_score", "confidence")
    listed = F.sort_array(F.collect_list(claim)).alias("h")  # heaviest first; the list of claims comes from the same one
    docs = verdicts.filter(c("doc_id").isNotNull()).groupBy("doc_id").agg(*_sums(), *_distribution(), listed)
    own = F.sort_array(F.transform("h", lambda x: F.struct(*[x[k].alias(k) for k in ("claim_id", "verdict", "confidence", "evidence_risk_score")])))
    rows = key_findings(docs.select("doc_id", c("claims").alias("total_claims"), *_scores(), *VERDICTS, own.alias("claims"), "h"))
    top = F.transform(F.slice("h", 1, n), lambda x: F.struct(x["claim_id"].alias("claim_id"), x["claim_text"].alias("claim_text"), x["verdict"].alias("verdict"), x["evidence_risk_score"].alias("evidence_risk_score")))
    scoring = F.struct("text_risk_score", "evidence_risk_score", "document_gri", "risk_level", F.struct(*VERDICTS).alias("distribution"))
    report = F.struct("doc_id", "total_claims", scoring.alias("scoring"), "findings", top.alias("top_claims"), "claims")
    return rows.select("doc_id", F.to_json(report).alias("report"))


def top_risk_claims(claims: DataFrame, verdicts: DataFrame, n: int = 5) -> DataFrame:
    """The n claims of highest evidence risk of each document, joined by id, in claim order where equal."""
    rows = claims.join(verdicts, ["doc_id", "claim_id"])
    w = Window.partitionBy("doc_id").orderBy(F.desc("evidence_risk_score"), "claim_id")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select("doc_id", "place", "claim_id", F.substring("text", 1, 150).alias("claim_text"), "verdict", "evidence_risk_score")
