"""Queries over evidence: queries of claims, retrieval, verdicts, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning as B
from ..operators import evidence as O
from ..operators.vector_index import VectorIndex
from ..sources import corpus as C
from ..sources.chunk_index import ChunkIndex
from ..sources.shared import new_path
from ..sources.tables import read_reports, write_reports
from .claims_v2 import WIDE_SQL, analyzed
from .models import TOTAL_SQL, text_index

#: Documents are chunked small, so that there is a choice.
SIZE, OVERLAP = 60, 10
#: Model verdicts, made from the claims' texts. Read by both engines.
VERDICT = """CASE CAST(length(text) % 5 AS INT) WHEN 0 THEN concat('{"verdict": "supported", "confidence": 0.9, "evidence_risk_score": ', CAST((length(text) + 3 * ord) % 50 AS STRING), '}')
 WHEN 1 THEN concat('[{"verdict": "contradicted", "evidence_risk_score": ', CAST((length(text) + 3 * ord) % 100 AS STRING), '}]') WHEN 2 THEN '{"verdict": "partially_supported"}' WHEN 3 THEN '{"verdict": "sure"}' ELSE 'cannot say' END"""


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.chunk_documents(C.table(spark, sf, "documents").filter("text IS NOT NULL"), SIZE, OVERLAP)
    return rows.select("doc_id", "chunk", "text", (F.col("chunk") % 3 + 1).alias("page"))


def claims_on(spark: SparkSession, sf: str) -> DataFrame:
    """The queries of the searches: every whole chunk of the documents whose id is divisible by 20."""
    rows = chunks(spark, sf).filter("doc_id % 20 = 0")
    return rows.select("doc_id", F.format_string("C%03d", F.col("chunk")).alias("claim_id"), F.lit("Q001").alias("query_id"), F.col("text").alias("query_text"))


def retrieved(spark, sf) -> DataFrame:
    own = chunks(spark, sf)
    return O.retrieve_lexical(claims_on(spark, sf), own).join(own, ["doc_id", "chunk"])


def o1(spark, sf):
    return O.expand_queries(analyzed(C.claims(spark, sf)))


def o2(spark, sf):
    return O.retrieve_lexical(claims_on(spark, sf), chunks(spark, sf)).select("doc_id", "claim_id", "query_id", "rank", "chunk", "score")


def o2i(spark, sf):
    """The same from a stored index, made in two batches."""
    index, own = ChunkIndex(spark, new_path(spark, "index")), chunks(spark, sf)
    for batch in (0, 1):
        index.add(own.filter(F.pmod(F.col("doc_id"), F.lit(2)) == batch), batch)
    return index.search(claims_on(spark, sf)).select("doc_id", "claim_id", "query_id", "rank", "chunk", "score")


def o3(spark, sf):
    v = C.table(spark, sf, "embeddings")
    out = O.retrieve_vectors(v, v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))
    return out.select("query_id", "rank", "vec_id", F.round("score", 4).alias("score"))


def o3i(spark, sf):
    """The same by an index of cells, in its exact mode."""
    v = C.table(spark, sf, "embeddings")
    out = VectorIndex(v).search(v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))
    return out.select("query_id", "rank", "vec_id", F.round("score", 4).alias("score"))


def _both(spark, sf):
    """Two queries per claim: the second finds what the first does, and is ranked after it."""
    hits = retrieved(spark, sf)
    return O.merge_query_results(hits, hits.filter("rank <= 3").withColumn("query_id", F.lit("Q002")))


def o4(spark, sf):
    return O.query_counts(_both(spark, sf))


def o5(spark, sf):
    return O.dedupe_chunks(_both(spark, sf)).select("doc_id", "claim_id", "place", "query_id", "chunk", "page")


def o6(spark, sf):
    out = O.evidence_context(O.dedupe_chunks(_both(spark, sf)), 4)
    return out.select("doc_id", "claim_id", "chunks", F.md5("context").alias("context_md5"))


def o7(spark, sf):
    return O.default_verdicts(claims_on(spark, sf), retrieved(spark, sf).filter("score > 20"))


def verdicts(spark, sf) -> DataFrame:
    rows = C.claims(spark, sf)
    return O.normalize_verdicts(rows.withColumn("raw", F.expr(VERDICT))).select("doc_id", "ord", "claim_id", "text", "verdict", "confidence", "evidence_risk_score", "parsed")


def o8(spark, sf):
    return verdicts(spark, sf).select("doc_id", "claim_id", "verdict", "confidence", "evidence_risk_score", "parsed")


def o9(spark, sf):
    return O.verdict_band_check(verdicts(spark, sf)).select("doc_id", "claim_id", "verdict", "evidence_risk_score", "in_band")


def _scored(spark, sf):
    """The index to nine digits: the engines sum its parts in different orders."""
    return O.attach_text_risk(verdicts(spark, sf), text_index(spark, sf).withColumn("tgri", F.round("tgri", 9)))


def o10(spark, sf):
    return _scored(spark, sf).select("doc_id", "claim_id", F.round("text_risk_score", 6).alias("text_risk_score"), "text_risk_level")


def o11(spark, sf):
    return O.evidence_report(_scored(spark, sf))


def o12(spark, sf):
    return O.verdict_distribution(verdicts(spark, sf))


def o13(spark, sf):
    return O.key_findings(O.verdict_distribution(verdicts(spark, sf))).select("doc_id", F.array_join("findings", "|").alias("findings"))


def o14(spark, sf):
    v = verdicts(spark, sf)
    return O.top_risk_claims(v.select("doc_id", "claim_id", "text"), v.select("doc_id", "claim_id", "verdict", "evidence_risk_score"))


def a11e(spark, sf):
    """Full reports, written as packed lines and read again."""
    path = new_path(spark, "reports")
    write_reports(O.full_reports(_scored(spark, sf)), path, 500, "gzip")
    r = read_reports(spark, path, O.REPORT)
    s = F.col("scoring")
    top = F.transform("top_claims", lambda x: F.concat_ws("/", x["claim_id"], x["verdict"], x["evidence_risk_score"].cast("int").cast("string"), x["claim_text"]))
    return r.select("doc_id", "total_claims", s["text_risk_score"].alias("text_risk_score"), s["evidence_risk_score"].alias("evidence_risk_score"), s["document_gri"].alias("document_gri"), s["risk_level"].alias("risk_level"), *[s["distribution"][v].alias(v) for v in O.VERDICTS], F.array_join("findings", "|").alias("findings"), F.array_join(top, "|").alias("top_claims"), F.size("claims").alias("claims"))


QUERIES = {
    "A11_evidence_reports": a11e,
    "O1_expand_queries": o1, "O2_retrieve_lexical": o2, "O2_retrieve_indexed": o2i, "O3_retrieve_vectors": o3, "O3_retrieve_by_cells": o3i, "O4_merge_query_results": o4, "O5_dedupe_chunks": o5, "O6_evidence_context": o6, "O7_default_verdicts": o7, "O8_normalize_verdicts": o8, "O9_verdict_band_check": o9,
    "O10_attach_text_risk": o10, "O11_evidence_report": o11, "O12_verdict_distribution": o12, "O13_key_findings": o13, "O14_top_risk_claims": o14,
}

CHUNKS_SQL = rf"""toks AS (SELECT doc_id, regexp_extract_all("text", '\S+') AS w FROM documents WHERE "text" IS NOT NULL),
numbered AS (SELECT doc_id, w, unnest(range(0, greatest(0, len(w) - {OVERLAP + 1}) // {SIZE - OVERLAP} + 1))::INT AS chunk FROM toks WHERE len(w) > 0),
chunks AS (SELECT doc_id, chunk, w[chunk * {SIZE - OVERLAP} + 1:chunk * {SIZE - OVERLAP} + {SIZE}] AS ws, array_to_string(ws, ' ') AS text, chunk % 3 + 1 AS page FROM numbered),
claims_on AS (SELECT doc_id, 'C' || lpad(chunk::VARCHAR, greatest(3, length(chunk::VARCHAR))::INT, '0') AS claim_id, 'Q001' AS query_id, text AS query_text FROM chunks WHERE doc_id % 20 = 0),
tf AS (SELECT doc_id, chunk, token, count(*) AS tf FROM (SELECT doc_id, chunk, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS token FROM chunks) GROUP BY ALL),
idf AS (SELECT token, ln(1 + (SELECT count(*) FROM chunks) / count(*)) AS idf FROM tf GROUP BY token),
qt AS (SELECT DISTINCT doc_id, claim_id, query_id, unnest(regexp_extract_all(lower(query_text), '[\p{{L}}\p{{N}}]+')) AS token FROM claims_on),
hits AS (SELECT doc_id, claim_id, query_id, chunk, round(sum(tf * idf), 6) AS score FROM qt JOIN tf USING (doc_id, token) JOIN idf USING (token) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, claim_id, query_id ORDER BY score DESC, chunk)::INT AS rank FROM hits),
retrieved AS (SELECT r.*, c.text, c.page FROM ranked r JOIN chunks c USING (doc_id, chunk) WHERE rank <= 5),
both_queries AS (SELECT * FROM retrieved UNION ALL SELECT * REPLACE ('Q002' AS query_id) FROM retrieved WHERE rank <= 3),
firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, claim_id, text[1:120], page ORDER BY query_id, rank) AS f FROM both_queries),
deduped AS (SELECT *, row_number() OVER (PARTITION BY doc_id, claim_id ORDER BY page, query_id, rank)::INT AS place FROM firsts WHERE f = 1)"""
VERDICTS_SQL = C.CLAIMS_SQL + """,
verdicts AS (SELECT doc_id, ord, claim_id, text, CASE length(text) % 5 WHEN 0 THEN 'supported' WHEN 1 THEN 'contradicted' WHEN 2 THEN 'partially_supported' ELSE 'insufficient_evidence' END AS verdict, CASE length(text) % 5 WHEN 0 THEN 0.9 WHEN 4 THEN 0.2 ELSE 0.5 END::DOUBLE AS confidence,
  CASE length(text) % 5 WHEN 0 THEN (length(text) + 3 * ord) % 50 WHEN 1 THEN (length(text) + 3 * ord) % 100 WHEN 4 THEN 60 ELSE 50 END::DOUBLE AS evidence_risk_score, length(text) % 5 <> 4 AS parsed FROM claims),
distribution AS (SELECT doc_id, count(*) FILTER (verdict = 'supported') AS supported, count(*) FILTER (verdict = 'partially_supported') AS partially_supported, count(*) FILTER (verdict = 'contradicted') AS contradicted, count(*) FILTER (verdict = 'insufficient_evidence') AS insufficient_evidence FROM verdicts GROUP BY doc_id)"""
SCORED_SQL = TOTAL_SQL + ",\n" + VERDICTS_SQL.split(C.CLAIMS_SQL + ",\n", 1)[1] + """,
scored AS (SELECT v.*, coalesce(round(tgri, 9), 0) AS text_risk_score, CASE WHEN tgri IS NULL THEN 'unknown' WHEN tgri <= 25 THEN '低风险' WHEN tgri <= 50 THEN '中低风险' WHEN tgri <= 75 THEN '中高风险' ELSE '高风险' END AS text_risk_level FROM verdicts v LEFT JOIN totals t USING (doc_id))"""
REPORT_SQL = SCORED_SQL + """,
m AS (SELECT doc_id, count(*) AS claims, round(avg(text_risk_score), 9) AS t, round(avg(evidence_risk_score), 9) AS e FROM scored GROUP BY doc_id), g AS (SELECT *, round(0.5::DOUBLE * t + 0.5::DOUBLE * e, 9) AS gri FROM m),
reports AS (SELECT doc_id, claims, round_even(t, 1) AS text_risk_score, round_even(e, 1) AS evidence_risk_score, round_even(gri, 1) AS document_gri, CASE WHEN gri <= 25 THEN '低风险' WHEN gri <= 50 THEN '中低风险' WHEN gri <= 75 THEN '中高风险' ELSE '高风险' END AS risk_level FROM g)"""
FINDINGS_SQL = """coalesce(nullif(concat_ws('|', CASE WHEN contradicted > 0 THEN contradicted || ' claims contradict other parts of the report' END, CASE WHEN insufficient_evidence > 0 THEN insufficient_evidence || ' claims lack sufficient evidence' END, CASE WHEN partially_supported > 0 THEN partially_supported || ' claims are supported in part' END), ''), 'all claims are supported')"""
_UNIT = "list_transform(embedding, lambda x: x::DOUBLE)"
ORACLE_SQL = {
    "O1_expand_queries": f"""WITH {WIDE_SQL}, fit AS (SELECT doc_id, claim_id, text, list_filter([CASE WHEN metric_value IS NOT NULL THEN {{'p': 'value', 'q': 'data behind the reported value in ' || metric_unit}} END, CASE WHEN baseline_year IS NOT NULL THEN {{'p': 'baseline', 'q': 'reference year ' || baseline_year}} END,
  CASE WHEN ghg_scope IS NOT NULL THEN {{'p': 'boundary', 'q': 'boundary and scope ' || array_to_string(ghg_scope, ' ')}} END, CASE WHEN metric_value IS NOT NULL THEN {{'p': 'method', 'q': 'accounting method and standard'}} END, CASE WHEN len(certs) > 0 THEN {{'p': 'assurance', 'q': 'assurance by ' || array_to_string(certs, ' ')}} END,
  CASE WHEN target_year IS NOT NULL THEN {{'p': 'consistency', 'q': 'other targets for ' || target_year}} END], lambda x: x IS NOT NULL)[1:5] AS f FROM wide),
listed AS (SELECT doc_id, claim_id, CASE WHEN len(f) > 0 THEN f ELSE [{{'p': 'claim', 'q': text}}] END AS f FROM fit),
each AS (SELECT doc_id, claim_id, generate_subscripts(f, 1) AS i, unnest(f) AS q FROM listed)
SELECT doc_id, claim_id, 'Q' || lpad(i::VARCHAR, 3, '0') AS query_id, q.p AS purpose, q.q AS query_text FROM each""",
    "O2_retrieve_lexical": f"WITH {CHUNKS_SQL} SELECT doc_id, claim_id, query_id, rank, chunk, score FROM ranked WHERE rank <= 5",
    "O2_retrieve_indexed": f"WITH {CHUNKS_SQL} SELECT doc_id, claim_id, query_id, rank, chunk, score FROM ranked WHERE rank <= 5",
    "O3_retrieve_vectors": f"""WITH v AS (SELECT vec_id, {_UNIT} AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, vec_id)::INT AS rank FROM s) SELECT query_id, rank, vec_id, round(round(score, 6), 4) AS score FROM r WHERE rank <= 5""",
    "O4_merge_query_results": f"WITH {CHUNKS_SQL} SELECT doc_id, claim_id, count(*) AS chunks, count(DISTINCT chunk) AS different, count(DISTINCT query_id) AS queries FROM both_queries GROUP BY doc_id, claim_id",
    "O5_dedupe_chunks": f"WITH {CHUNKS_SQL} SELECT doc_id, claim_id, place, query_id, chunk, page FROM deduped",
    "O6_evidence_context": f"WITH {CHUNKS_SQL} SELECT doc_id, claim_id, count(*)::INT AS chunks, md5(string_agg('[' || page || '] ' || text, chr(10) || chr(10) ORDER BY place)) AS context_md5 FROM deduped WHERE place <= 4 GROUP BY doc_id, claim_id",
    "O7_default_verdicts": f"WITH {CHUNKS_SQL} SELECT doc_id, claim_id, 'insufficient_evidence' AS verdict, 0.3::DOUBLE AS confidence, 60.0::DOUBLE AS evidence_risk_score, 'no_evidence_found' AS gap FROM claims_on c WHERE NOT EXISTS (SELECT 1 FROM retrieved r WHERE r.doc_id = c.doc_id AND r.claim_id = c.claim_id AND score > 20)",
    "O8_normalize_verdicts": f"WITH {VERDICTS_SQL} SELECT doc_id, claim_id, verdict, confidence, evidence_risk_score, parsed FROM verdicts",
    "O9_verdict_band_check": f"WITH {VERDICTS_SQL} SELECT doc_id, claim_id, verdict, evidence_risk_score, CASE verdict WHEN 'supported' THEN evidence_risk_score BETWEEN 0 AND 35 WHEN 'partially_supported' THEN evidence_risk_score BETWEEN 35 AND 65 WHEN 'contradicted' THEN evidence_risk_score BETWEEN 65 AND 85 ELSE evidence_risk_score BETWEEN 50 AND 75 END AS in_band FROM verdicts",
    "O10_attach_text_risk": f"WITH {SCORED_SQL} SELECT doc_id, claim_id, round(text_risk_score, 6) AS text_risk_score, text_risk_level FROM scored",
    "O11_evidence_report": f"WITH {REPORT_SQL} SELECT * FROM reports",
    "A11_evidence_reports": f"""WITH {REPORT_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY evidence_risk_score DESC, claim_id) AS place FROM verdicts),
top AS (SELECT doc_id, string_agg(concat_ws('/', claim_id, verdict, evidence_risk_score::INT::VARCHAR, text[1:150]), '|' ORDER BY place) AS top_claims FROM r WHERE place <= 5 GROUP BY doc_id)
SELECT doc_id, claims AS total_claims, text_risk_score, evidence_risk_score, document_gri, risk_level, supported, partially_supported, contradicted, insufficient_evidence, {FINDINGS_SQL} AS findings, top_claims, claims::INT AS claims
FROM reports JOIN distribution USING (doc_id) JOIN top USING (doc_id)""",
    "O12_verdict_distribution": f"WITH {VERDICTS_SQL} SELECT * FROM distribution",
    "O13_key_findings": f"WITH {VERDICTS_SQL} SELECT doc_id, {FINDINGS_SQL} AS findings FROM distribution",
    "O14_top_risk_claims": f"WITH {VERDICTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY evidence_risk_score DESC, claim_id)::INT AS place FROM verdicts) SELECT doc_id, place, claim_id, text[1:150] AS claim_text, verdict, evidence_risk_score FROM r WHERE place <= 5",
}
ORACLE_SQL["O3_retrieve_by_cells"] = ORACLE_SQL["O3_retrieve_vectors"]
