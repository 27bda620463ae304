"""Queries over emotion scores, model answers, the text index and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.semantics import sql_list
from ..operators import checks as N
from ..operators import responses as W
from ..operators import scoring_v1 as S
from ..operators import sentiment as K
from ..operators import text_index as M
from ..operators.features import lexicon_counts
from ..sources import corpus as C
from .claims_v2 import STRUCTURE_SQL, _m, analyzed
from .texts import V1_SQL, midpoint_sql

# Model answers are made from the claims and documents themselves, by expressions that both engines read.
LABELS = "CASE CAST(ord % 4 AS INT) WHEN 0 THEN 'Opportunity' WHEN 1 THEN 'risk' WHEN 2 THEN 'Neutral' END AS sentiment_label, CASE CAST(ord % 5 AS INT) WHEN 0 THEN 'yes' WHEN 1 THEN 'no commitment' WHEN 2 THEN 'Commitment' WHEN 3 THEN 'commitment detected' END AS commitment_label, CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN 'spec' WHEN 1 THEN 'unspec' WHEN 2 THEN 'non-specific' WHEN 3 THEN 'specific' END AS specificity_label, CAST((doc_id % 10) / 10.0 AS DOUBLE) AS specificity_raw"
ANSWERS = """CASE CAST(doc_id % 6 AS INT) WHEN 0 THEN concat('{"summary": "', w, '", "adjustedRisk": ', CAST(n AS STRING), ', "evidenceStatus": "supported"}')
 WHEN 1 THEN concat('```json', chr(10), '{"summary": "', w, '", "adjustedRisk": ', CAST(n AS STRING), ', "annotations": ["', w, '", "b"]}', chr(10), '```')
 WHEN 2 THEN concat('Here it is: {"summary": "', w, '", "evidenceStatus": "maybe",}', chr(10)) WHEN 3 THEN concat('no answer on ', w)
 WHEN 4 THEN concat('As [asked]: {"summary": "{', w, '} // [x]", "emotionAnalysis": {"score": ', CAST(n AS STRING), '}, "adjustedRisk": ', CAST(n AS STRING), '} instead of {', w, '}')
 ELSE concat('{"summary": "http://', w, ',]", /* ', w, ' */ "annotations": ["', w, '",], "adjustedRisk": ', CAST(n AS STRING), ' // {', w, '}', chr(10), '}') END"""
#: A word and a number of each document, of which answers are made.
SAID = """doc_id, regexp_extract(coalesce("text", ''), '[A-Za-z]+', 0) AS w, CAST(length(coalesce("text", '')) % 100 AS INT) AS n"""
EMOTION = "CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN CAST(doc_id % 130 AS DOUBLE) END AS model_score, doc_id % 2 = 0 AS nlp_ok, CAST(doc_id % 101 AS DOUBLE) AS nlp_score, CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN 'opportunity' WHEN 1 THEN 'risk' WHEN 2 THEN 'odd' ELSE 'neutral' END AS nlp_sentiment, CAST((doc_id % 11) / 10.0 AS DOUBLE) AS nlp_specificity"
REQUESTS = "event_id AS request_id, ts, concat('text ', CAST(user_id % 7 AS STRING)) AS text, event_type AS context_type, 'energy' AS sector, 'p' AS provider, 'm' AS model"


def _docs(spark, sf):
    return C.documents(spark, sf)


def _with(df: DataFrame, expressions: str) -> DataFrame:
    return df.sparkSession.sql(f"SELECT *, {expressions} FROM {{rows}}", rows=df)


def k1(spark, sf):
    return K.zh_emotion_score(_docs(spark, sf)).select("doc_id", "emotion_score")


def k2(spark, sf):
    return K.normalize_labels(_with(C.claims(spark, sf), LABELS)).select("doc_id", "claim_id", "climate_sentiment", "commitment_type", "specificity_score")


def k3(spark, sf):
    out = K.climate_emotion_score(K.normalize_labels(_with(C.claims(spark, sf), LABELS)))
    return out.select("doc_id", "claim_id", F.round("emotion_score", 6).alias("emotion_score"))


def k4(spark, sf):
    rows = _with(_docs(spark, sf), "CASE CAST(doc_id % 6 AS INT) WHEN 0 THEN 'ZH' WHEN 1 THEN 'auto' WHEN 2 THEN 'fr' END AS language")
    return K.route_language(rows).select("doc_id", "route")


def make_length_predictor():
    """Stands for a caller's model: longer claims are more specific."""

    def predict(frame):
        n = frame["text"].str.len()
        return frame[["doc_id", "claim_id"]].assign(label=(n > 80).map({True: "spec", False: "unspec"}), score=(n / (n + 80)).round(6))

    return predict


def k5(spark, sf):
    return K.predict_batches(C.claims(spark, sf), make_length_predictor, "doc_id long, claim_id string, label string, score double", ["doc_id", "claim_id", "text"])


def k6(spark, sf):
    rows = S.score_documents(_docs(spark, sf)).select("doc_id", F.col("emotional").alias("rule_emotional"))
    return K.fuse_emotion(_with(rows, EMOTION)).select("doc_id", "fused_score", "consistency", "layers", "level", "rule_part", "nlp_part", "model_part")


def answers(spark, sf):
    said = spark.sql("SELECT " + SAID.replace('"text"', "text") + " FROM {docs}", docs=C.table(spark, sf, "documents"))
    return said.select("doc_id", F.expr(ANSWERS).alias("raw"))


def a8(spark, sf):
    return W.parse_answers(answers(spark, sf)).select("doc_id", "attempt", F.col("answer.summary").alias("summary"))


def w1(spark, sf):
    out = W.normalize_responses(W.parse_answers(answers(spark, sf)))
    return out.select("doc_id", "summary", "adjusted_risk", "evidence_status", F.array_join("annotations", "|").alias("annotations"), "rewrite_suggestion")


def requests(spark, sf):
    e = C.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return W.response_key(spark.sql(f"SELECT {REQUESTS} FROM {{e}}", e=e))


def w2(spark, sf):
    return requests(spark, sf).select("request_id", "key")


def w3(spark, sf):
    rows = requests(spark, sf)
    told = rows.filter("request_id % 3 = 0").select("key", "ts", F.concat(F.lit("answer "), F.col("request_id").cast("string")).alias("response"))
    return W.reuse_responses(rows, told, 3600).select("request_id", "response", "hit")


def halves(spark, sf):
    """Both halves of every document with answers made from their lengths."""
    from ..operators.extraction import split_midpoint

    docs = split_midpoint(_docs(spark, sf))
    parts = docs.select("doc_id", F.explode(F.array(F.struct(F.lit(1).alias("part"), F.length("first_half").alias("n")), F.struct(F.lit(2).alias("part"), F.length("second_half").alias("n")))).alias("p")).select("doc_id", "p.part", "p.n")
    return _with(parts, HALVES)


HALVES = "CASE WHEN (doc_id + part) % 4 <> 0 THEN CAST((doc_id * part) % 100 AS DOUBLE) END AS adjusted_risk, CASE WHEN doc_id % 3 <> 0 THEN CAST((doc_id + 7 * part) % 100 AS DOUBLE) END AS emotion_score, CASE CAST((doc_id + part) % 5 AS INT) WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' WHEN 3 THEN 'none' END AS emotion_level, CASE WHEN doc_id % 2 = 0 THEN concat('half ', CAST(part AS STRING)) ELSE '' END AS summary, array(concat('note ', CAST(part AS STRING))) AS annotations"


def w4(spark, sf):
    out = W.merge_split_responses(halves(spark, sf))
    return out.select("doc_id", "adjusted_risk", "emotion_score", "emotion_level", "summary", F.array_join("annotations", "|").alias("annotations"))


#: A model's emotion of a document, from a word and a number of its text.
RAW_EMOTION = """concat('{"score": ', CAST(3 * n - 50 AS STRING), ', "level": "', CASE WHEN n % 2 = 0 THEN 'high' ELSE 'huge' END, CASE WHEN n % 3 = 0 THEN concat('", "rationale": "', w) ELSE '' END, '", "signals": ["', w, '", "x"]}')"""


def w5(spark, sf):
    said = spark.sql("SELECT " + SAID.replace('"text"', "text") + " FROM {docs}", docs=C.table(spark, sf, "documents"))
    rows = said.select("doc_id", F.from_json(F.expr(RAW_EMOTION), "score double, level string, rationale string, signals array<string>").alias("e"))
    out = rows.select("doc_id", W.normalize_emotion(F.col("e")).alias("e"))
    return out.select("doc_id", "e.score", "e.level", "e.rationale", F.array_join("e.signals", "|").alias("signals"))


def w6(spark, sf):
    docs = _docs(spark, sf)
    counts = M.framing(lexicon_counts(docs))
    deep = counts.select("doc_id", F.col("m_absolute").alias("positive_signals"), F.col("m_scope").alias("balance_signals"))
    prior = docs.select("doc_id", F.col("text").alias("summary"), F.split("text", " ").alias("annotations"), F.expr("CASE WHEN doc_id % 2 = 0 THEN 'say less' END").alias("rewrite_suggestion"))
    out = W.merge_prior_findings(deep, prior, S.classify_context(docs).select("doc_id", F.col("context").alias("selected")))
    return out.select("doc_id", "claim_direction", F.array_join("text_types", "|").alias("text_types"), "one_line", F.array_join("key_findings", "|").alias("key_findings"), F.array_join("recommendations", "|").alias("recommendations"))


def _indexed(spark, sf):
    return M.indexed(_docs(spark, sf))


def _levels(spark, sf):
    return M.claim_level(analyzed(C.claims(spark, sf)))


def text_index(spark: SparkSession, sf: str) -> DataFrame:
    """m3, m4, m5, tgri, risk_level, primary_type per document."""
    gap = M.commitment_gap(_levels(spark, sf)).select("doc_id", "m5")
    return M.total(_indexed(spark, sf).join(gap, "doc_id")).select("doc_id", "m3", "m4", "m5", "tgri", "risk_level", "primary_type")


def m1(spark, sf):
    return _indexed(spark, sf).select("doc_id", F.round("m3", 6).alias("m3"))


def m2(spark, sf):
    return _indexed(spark, sf).select("doc_id", "positive", "balance", F.round("m4", 6).alias("m4"))


def m3(spark, sf):
    return _levels(spark, sf).select("doc_id", "claim_id", "level")


def m4(spark, sf):
    return M.commitment_gap(_levels(spark, sf)).select("doc_id", F.round("mean_level", 6).alias("mean_level"), F.round("level1_share", 6).alias("level1_share"), F.round("m5", 6).alias("m5"))


def m5(spark, sf):
    return text_index(spark, sf).select("doc_id", F.round("tgri", 6).alias("tgri"), "risk_level", "primary_type")


def m6(spark, sf):
    return M.claim_direction(_indexed(spark, sf)).select("doc_id", "direction")


CHECKED = "CASE WHEN doc_id % 7 = 0 THEN 'manual' ELSE 'keyword' END AS context_source, CASE WHEN doc_id % 9 = 0 THEN 'manual' ELSE 'keyword' END AS sector_source, doc_id % 5 <> 0 AS model_enabled, CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN 'supported' WHEN 1 THEN 'dubious' ELSE 'unknown' END AS evidence_status, CASE WHEN doc_id % 11 = 0 THEN 'timeout' END AS model_error, CASE WHEN doc_id % 6 <> 0 THEN CAST(doc_id % 100 AS DOUBLE) END AS adjusted_risk, CASE WHEN doc_id % 2 = 0 THEN 'Audit and baseline are missing' ELSE 'nothing to add' END AS model_text"


def _checked(spark, sf):
    return _with(S.score_documents(_docs(spark, sf)), CHECKED)


def n1(spark, sf):
    return N.classification_checks(_checked(spark, sf))


def n2(spark, sf):
    return N.rule_and_schema_checks(_checked(spark, sf))


def n3(spark, sf):
    return N.risk_gap_check(_checked(spark, sf))


def n4(spark, sf):
    return N.tag_overlap_check(_checked(spark, sf))


def n5(spark, sf):
    return N.overall_status(N.all_checks(_checked(spark, sf)))


QUERIES = {
    "K1_zh_emotion_score": k1, "K2_normalize_model_labels": k2, "K3_climate_emotion_score": k3, "K4_route_language": k4, "K5_predict_batches": k5, "K6_fuse_emotion": k6,
    "A8_read_model_responses": a8, "W1_normalize_responses": w1, "W2_response_key": w2, "W3_reuse_responses": w3, "W4_merge_split_responses": w4, "W5_normalize_emotion": w5, "W6_merge_prior_findings": w6,
    "M1_tgri_vagueness": m1, "M2_tgri_framing": m2, "M3_claim_level": m3, "M4_tgri_commitment_gap": m4, "M5_tgri_total": m5, "M6_claim_direction": m6,
    "N1_classification_checks": n1, "N2_rule_and_schema_checks": n2, "N3_risk_gap_check": n3, "N4_tag_overlap_check": n4, "N5_overall_status": n5,
}

_EMO = " + ".join(f"CASE WHEN contains(text, '{p}') THEN {w} ELSE 0 END" for p, w in X.EMOTION_WEIGHTS.items() if w)
LABELS_SQL = f"""{C.CLAIMS_SQL}, raw_labels AS (SELECT doc_id, claim_id, {LABELS} FROM claims), spec AS (SELECT *, lower(coalesce(specificity_label, '')) AS p, CASE WHEN coalesce(specificity_raw, 0) = 0 THEN 0.5::DOUBLE ELSE specificity_raw END AS s FROM raw_labels),
labels AS (SELECT doc_id, claim_id, CASE WHEN lower(coalesce(sentiment_label, 'neutral')) LIKE '%opportunity%' THEN 'opportunity' WHEN lower(coalesce(sentiment_label, 'neutral')) LIKE '%risk%' THEN 'risk' ELSE 'neutral' END AS climate_sentiment,
  CASE WHEN lower(coalesce(commitment_label, 'no commitment')) IN ('yes', 'commitment', 'action') OR (lower(commitment_label) LIKE '%commitment%' AND lower(commitment_label) NOT LIKE '%no%') THEN 'commitment' ELSE 'no commitment' END AS commitment_type,
  round(CASE WHEN p IN ('unspec', 'vague') OR (p NOT IN ('spec', 'specific') AND (p LIKE '%non%' OR p LIKE '%vague%' OR p LIKE '%not%')) THEN 1 - s ELSE s END, 4) AS specificity_score FROM spec)"""
INDEX_SQL = (
    V1_SQL
    + f""",
indexed AS (SELECT doc_id, len(list_filter({sql_list(X.TGRI_VAGUE)}, lambda t: contains(lower(text), t))) AS v, {_m(X.QUANTITY_V2)}::INT + {_m(X.TIMELINE_V2)}::INT + (sc > 0)::INT + (pr > 0)::INT + (ac > 0)::INT AS s,
  len(regexp_extract_all(text, '\\S+')) + ceil(len(regexp_extract_all(text, '[一-鿿]')) * 0.6::DOUBLE) AS t, (ab + em)::INT AS positive, (sc + len(list_filter({sql_list(M.BALANCE)}, lambda t: contains(lower(text), t))))::INT AS balance FROM counts),
scores AS (SELECT *, (v / greatest(v + s, 1) * 0.65::DOUBLE + least(v / greatest(t, 1) * 10, 1.0::DOUBLE) * 0.35::DOUBLE) * 100 AS m3, ((positive - balance) / greatest(positive + balance, 1) + 1) / 2 * 100 AS m4 FROM indexed)"""
)
LEVELS_SQL = f""",
structured_levels AS (SELECT doc_id, claim_id, text, CASE WHEN n_action > 0 AND (quantified OR n_proof > 0) THEN 4 WHEN n_future > 0 AND (target_year IS NOT NULL OR quantified) THEN 3 WHEN n_future > 0 OR n_action > 0 THEN 2 ELSE 1 END AS level FROM structured),
means AS (SELECT doc_id, avg(level) AS mean_level, avg((level = 1)::INT) AS level1_share, bool_or({_m(X.NET_ZERO)} AND level <= 2) AS bold FROM structured_levels GROUP BY doc_id),
gap AS (SELECT doc_id, mean_level, level1_share, greatest(0.0::DOUBLE, least(100.0::DOUBLE, (1 - (mean_level - 1) / 3) * 100 + CASE WHEN level1_share > 0.3::DOUBLE OR bold THEN 15 ELSE 0 END)) AS m5 FROM means)"""
GAP_SQL = STRUCTURE_SQL + LEVELS_SQL
TOTAL_SQL = INDEX_SQL + ",\n" + GAP_SQL.split(C.CLAIMS_SQL + ",\n", 1)[1] + ",\ntotals AS (SELECT doc_id, m3, m4, m5, m3 * 0.4::DOUBLE + m4 * 0.2::DOUBLE + m5 * 0.4::DOUBLE AS tgri FROM scores JOIN gap USING (doc_id))"
KIND_SQL = "CASE WHEN m3 > 50 AND m5 > 50 THEN '模糊修辞+空洞承诺复合型' WHEN m3 = greatest(m3, m4, m5) THEN '模糊修辞型' WHEN m4 = greatest(m3, m4, m5) THEN '过度包装型' ELSE '空洞承诺型' END"
CHECKS_SQL = (
    V1_SQL
    + f""",
checked AS (SELECT *, {CHECKED} FROM v1),
tags AS (SELECT *, list_filter([CASE WHEN NOT q THEN 'quantified' END, CASE WHEN pr = 0 THEN 'evidence' END, CASE WHEN sc = 0 THEN 'scope' END, CASE WHEN promise > 0 THEN 'promise' END, CASE WHEN overclaim > 0 THEN 'absolute' END, CASE WHEN ac = 0 THEN 'action' END], lambda x: x IS NOT NULL) AS own,
  list_filter([{", ".join(f"CASE WHEN len(list_filter({sql_list(t)}, lambda k: contains(lower(model_text), k))) > 0 THEN '{g}' END" for g, t in X.TAG_KEYWORDS.items())}], lambda x: x IS NOT NULL) AS told FROM checked),
kind_checks AS (SELECT doc_id, CASE WHEN context_source = 'manual' THEN 'context_manual_override' WHEN context_confidence < 0.55::DOUBLE THEN 'context_low_confidence' ELSE 'context_confidence' END AS "check", CASE WHEN context_source <> 'manual' AND context_confidence < 0.55::DOUBLE THEN 'warn' ELSE 'pass' END AS status FROM checked
  UNION ALL SELECT doc_id, CASE WHEN sector_source = 'manual' THEN 'sector_manual_override' WHEN sector_confidence < 0.55::DOUBLE THEN 'sector_low_confidence' ELSE 'sector_confidence' END, CASE WHEN sector_source <> 'manual' AND sector_confidence < 0.55::DOUBLE THEN 'warn' ELSE 'pass' END FROM checked),
rule_checks AS (SELECT doc_id, CASE WHEN confidence < 55 THEN 'rule_confidence_low' ELSE 'rule_confidence_ok' END AS "check", CASE WHEN confidence < 55 THEN 'warn' ELSE 'pass' END AS status FROM checked
  UNION ALL SELECT doc_id, CASE WHEN model_enabled THEN 'llm_enabled' ELSE 'llm_disabled' END, CASE WHEN model_enabled THEN 'pass' ELSE 'warn' END FROM checked
  UNION ALL SELECT doc_id, 'llm_schema', CASE WHEN evidence_status = 'dubious' THEN 'fail' ELSE 'pass' END FROM checked WHERE model_enabled
  UNION ALL SELECT doc_id, 'llm_error', 'warn' FROM checked WHERE model_error IS NOT NULL),
gap_checks AS (SELECT doc_id, CASE WHEN adjusted_risk IS NULL THEN 'llm_risk_missing' ELSE 'llm_risk_gap' END AS "check", CASE WHEN adjusted_risk IS NULL OR abs(adjusted_risk - risk) > 25 THEN 'warn' ELSE 'pass' END AS status FROM checked WHERE model_enabled),
tag_checks AS (SELECT doc_id, 'llm_tag_overlap' AS "check", CASE WHEN list_has_any(own, told) THEN 'pass' ELSE 'warn' END AS status FROM tags WHERE model_enabled),
all_checks AS (SELECT * FROM kind_checks UNION ALL SELECT * FROM rule_checks UNION ALL SELECT * FROM gap_checks UNION ALL SELECT * FROM tag_checks)"""
)
_KEY = "sha256(concat_ws(chr(31), text, context_type, sector, provider, model))"
_STRING = r'("(?:[^"\\]|\\.)*")'


def _valid(x: str) -> str:
    """JSON without trailing commas, which DuckDB lets pass."""
    return rf"(json_valid({x}) AND NOT regexp_matches(regexp_replace({x}, '{_STRING}', 's', 'g'), ',\s*[}}\]]'))"


def _value(x: str) -> str:
    """The first value of a text is its shortest start that is JSON."""
    return f"list_filter(list_transform(range(1, length({x}) + 1), lambda i: {x}[1:i]), lambda s: {_valid('s')})[1]"


ANSWERS_SQL = rf"""said AS (SELECT {SAID} FROM documents), raws AS (SELECT doc_id, {ANSWERS} AS raw FROM said),
bares AS (SELECT *, trim(regexp_replace(raw, '^\s*```(?:json)?\s*|\s*```\s*$', '', 'g')) AS bare FROM raws),
starts AS (SELECT *, regexp_extract(bare, '(?s)\{{.*', 0) AS o, regexp_extract(bare, '(?s)\[.*', 0) AS l FROM bares),
clean AS (SELECT *, regexp_replace(regexp_replace(o, '(?s){_STRING}|//[^\n]*|/\*.*?\*/', '\1', 'g'), '(?s){_STRING}|,(\s*[}}\]])', '\1\2', 'g') AS fixed FROM starts),
firsts AS (SELECT *, {_value('o')} AS a, {_value('l')} AS b, {_value('fixed')} AS c FROM clean),
answered AS (SELECT doc_id, raw, CASE WHEN {_valid('raw')} THEN 0 WHEN {_valid('bare')} THEN 1 WHEN coalesce(a, b) IS NOT NULL THEN 2 WHEN c IS NOT NULL THEN 3 END::INT AS attempt,
 CASE WHEN {_valid('raw')} THEN raw WHEN {_valid('bare')} THEN bare ELSE coalesce(a, b, c) END::JSON AS json FROM firsts)"""

ORACLE_SQL = {
    "K1_zh_emotion_score": f"WITH {C.DOCUMENTS_SQL} SELECT doc_id, round_even(least(100.0::DOUBLE, ({_EMO}) / greatest(length(regexp_replace(text, '\\s+', '', 'g')) / 20, 1.0::DOUBLE) * 20), 0)::INT AS emotion_score FROM docs",
    "K2_normalize_model_labels": f"WITH {LABELS_SQL} SELECT * FROM labels",
    "K3_climate_emotion_score": f"WITH {LABELS_SQL} SELECT doc_id, claim_id, round(CASE climate_sentiment WHEN 'opportunity' THEN 70 WHEN 'risk' THEN 15 ELSE 30 END * 0.6::DOUBLE + (1 - specificity_score) * 40 * 0.4::DOUBLE, 6) AS emotion_score FROM labels",
    "K4_route_language": f"WITH {C.DOCUMENTS_SQL}, n AS (SELECT doc_id, len(regexp_extract_all(text, '[一-鿿]')) AS h, len(regexp_extract_all(text, '[A-Za-z]')) AS l FROM docs) SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'zh' WHEN h > 0 AND l > 0 THEN 'mixed' WHEN h > l THEN 'zh' ELSE 'en' END AS route FROM n",
    "K5_predict_batches": f"WITH {C.CLAIMS_SQL} SELECT doc_id, claim_id, CASE WHEN length(text) > 80 THEN 'spec' ELSE 'unspec' END AS label, round(length(text) / (length(text) + 80), 6) AS score FROM claims",
    "K6_fuse_emotion": f"""WITH {V1_SQL}, raw AS (SELECT emotional / 30 * 100 AS r, doc_id, {EMOTION} FROM v1),
n AS (SELECT *, CASE WHEN nlp_ok THEN least(100.0::DOUBLE, nlp_score * 0.5::DOUBLE + CASE nlp_sentiment WHEN 'opportunity' THEN 70 WHEN 'risk' THEN 15 ELSE 30 END * 0.3::DOUBLE + (1 - nlp_specificity) * 40 * 0.2::DOUBLE) END AS p FROM raw),
w AS (SELECT *, CASE WHEN nlp_ok THEN 0.2::DOUBLE ELSE 0.35::DOUBLE END AS wr, CASE WHEN nlp_ok THEN 0.45::DOUBLE ELSE 0.0::DOUBLE END AS wn, CASE WHEN model_score IS NULL THEN 0.0::DOUBLE WHEN nlp_ok THEN 0.35::DOUBLE ELSE 0.65::DOUBLE END AS wm, 1 + nlp_ok::INT + (model_score IS NOT NULL)::INT AS layers FROM n),
f AS (SELECT *, floor((r * wr + coalesce(p, 0.0::DOUBLE) * wn + coalesce(model_score, 0.0::DOUBLE) * wm) / (wr + wn + wm) + 0.5::DOUBLE) AS fused_score FROM w),
s AS (SELECT *, CASE WHEN layers > 1 THEN ((r - fused_score) * (r - fused_score) + coalesce((p - fused_score) * (p - fused_score), 0.0::DOUBLE) + coalesce((model_score - fused_score) * (model_score - fused_score), 0.0::DOUBLE)) / layers ELSE 2500.0::DOUBLE END AS x FROM f)
SELECT doc_id, fused_score, floor(greatest(0.0::DOUBLE, 1 - x / 2500) * 100 + 0.5::DOUBLE) AS consistency, layers, CASE WHEN fused_score >= 71 THEN 'high' WHEN fused_score >= 46 THEN 'medium' WHEN fused_score >= 21 THEN 'low' ELSE 'none' END AS level, floor(r + 0.5::DOUBLE) AS rule_part, floor(p + 0.5::DOUBLE) AS nlp_part, floor(model_score + 0.5::DOUBLE) AS model_part FROM s""",
    "A8_read_model_responses": f"WITH {ANSWERS_SQL} SELECT doc_id, attempt, json->>'summary' AS summary FROM answered",
    "W1_normalize_responses": f"WITH {ANSWERS_SQL} SELECT doc_id, coalesce(json->>'summary', raw) AS summary, (json->>'adjustedRisk')::DOUBLE AS adjusted_risk, coalesce(json->>'evidenceStatus', 'unknown') AS evidence_status, coalesce(array_to_string(from_json(json->'annotations', '[\"VARCHAR\"]'), '|'), '') AS annotations, NULL::VARCHAR AS rewrite_suggestion FROM answered",
    "W2_response_key": f"WITH r AS (SELECT {REQUESTS} FROM events) SELECT request_id, {_KEY} AS key FROM r",
    "W3_reuse_responses": f"WITH r AS (SELECT *, {_KEY} AS key FROM (SELECT {REQUESTS} FROM events)), h AS (SELECT q.request_id, arg_max('answer ' || a.request_id, a.ts) AS response FROM r q JOIN r a ON q.key = a.key AND a.request_id % 3 = 0 AND a.ts <= q.ts AND a.ts >= q.ts - INTERVAL 3600 SECONDS GROUP BY q.request_id) SELECT r.request_id, response, response IS NOT NULL AS hit FROM r LEFT JOIN h USING (request_id)",
    "W6_merge_prior_findings": f"WITH {V1_SQL} SELECT doc_id, CASE WHEN ab > sc THEN 'positive_claim' WHEN sc > ab THEN 'balanced_disclosure' ELSE 'mixed' END AS claim_direction, context AS text_types, text[1:200] AS one_line, array_to_string(string_split(text, ' ')[1:5], '|') AS key_findings, CASE WHEN doc_id % 2 = 0 THEN 'say less' ELSE '' END AS recommendations FROM counts",
    "W5_normalize_emotion": f"SELECT doc_id, greatest(0, least(100, 3 * n - 50))::DOUBLE AS score, CASE WHEN n % 2 = 0 THEN 'high' END AS level, CASE WHEN n % 3 = 0 THEN w ELSE '' END AS rationale, w || '|x' AS signals FROM (SELECT {SAID} FROM documents)",
    "M1_tgri_vagueness": f"WITH {INDEX_SQL} SELECT doc_id, round(m3, 6) AS m3 FROM scores",
    "M2_tgri_framing": f"WITH {INDEX_SQL} SELECT doc_id, positive, balance, round(m4, 6) AS m4 FROM scores",
    "M3_claim_level": f"WITH {GAP_SQL} SELECT doc_id, claim_id, level FROM structured_levels",
    "M4_tgri_commitment_gap": f"WITH {GAP_SQL} SELECT doc_id, round(mean_level, 6) AS mean_level, round(level1_share, 6) AS level1_share, round(m5, 6) AS m5 FROM gap",
    "M5_tgri_total": f"WITH {TOTAL_SQL} SELECT doc_id, round(tgri, 6) AS tgri, CASE WHEN tgri <= 25 THEN '低风险' WHEN tgri <= 50 THEN '中低风险' WHEN tgri <= 75 THEN '中高风险' ELSE '高风险' END AS risk_level, {KIND_SQL} AS primary_type FROM totals",
    "M6_claim_direction": f"WITH {INDEX_SQL} SELECT doc_id, CASE WHEN positive > balance THEN 'positive_claim' WHEN balance > positive THEN 'balanced_disclosure' ELSE 'mixed' END AS direction FROM scores",
    "N1_classification_checks": f"WITH {CHECKS_SQL} SELECT * FROM kind_checks",
    "N2_rule_and_schema_checks": f"WITH {CHECKS_SQL} SELECT * FROM rule_checks",
    "N3_risk_gap_check": f"WITH {CHECKS_SQL} SELECT * FROM gap_checks",
    "N4_tag_overlap_check": f"WITH {CHECKS_SQL} SELECT * FROM tag_checks",
    "N5_overall_status": f"WITH {CHECKS_SQL} SELECT doc_id, CASE max(CASE status WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'pass' END AS overall, count(*) AS checks FROM all_checks GROUP BY doc_id",
}

ORACLE_SQL["W4_merge_split_responses"] = f"""WITH {C.DOCUMENTS_SQL}, {midpoint_sql("docs")}, parts AS (SELECT doc_id, unnest([1, 2]) AS part, unnest([length(first_half), length(second_half)]) AS n FROM halved),
told AS (SELECT doc_id, part, n, {HALVES.replace("array(concat", "list_value(concat")} FROM parts)
SELECT doc_id, floor(coalesce(sum(adjusted_risk * n) / nullif(sum(n) FILTER (adjusted_risk IS NOT NULL), 0), max(adjusted_risk)) + 0.5::DOUBLE) AS adjusted_risk, floor(coalesce(sum(emotion_score * n) / nullif(sum(n) FILTER (emotion_score IS NOT NULL), 0), max(emotion_score)) + 0.5::DOUBLE) AS emotion_score,
  {sql_list(W.EMOTION_LEVELS)}[max(list_position({sql_list(W.EMOTION_LEVELS)}, coalesce(emotion_level, 'none')))] AS emotion_level, coalesce(string_agg(summary, chr(10) || chr(10) ORDER BY part) FILTER (summary <> ''), '') AS summary, string_agg(array_to_string(annotations, '|'), '|' ORDER BY part) AS annotations FROM told GROUP BY doc_id"""
