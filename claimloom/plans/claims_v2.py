"""Claim analysis end to end: claims, features, structure, certificates, contradictions, sins, risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.semantics import sql_list, sql_text
from ..operators import certificates as H
from ..operators import consistency as I
from ..operators import features as D
from ..operators import risk as J
from ..operators import structure as G
from ..operators import term_index as L
from ..sources import corpus as C
from ..sources.shared import written

LISTS = [f"m_{c}" for c in X.LEXICON]
COUNTS = [f"n_{c}" for c in X.LEXICON]
MODES = ("fast", "standard", "comprehensive")


def text_analyzed(claims: DataFrame) -> DataFrame:
    """claims with everything that a claim tells by itself: one projection, no shuffle."""
    out = D.flags_v2(D.lexicon_counts(claims)).drop(*LISTS)
    return H.with_signals(H.with_certificates(G.structure(out)))


def analyzed(claims: DataFrame) -> DataFrame:
    """The same with each distinct text analysed once: claims repeat what was said before. The analysed texts are a
    table in the shared folder; Spark sends it to the claims or deals both out by text, by its size. What claims
    tell beside their text (claim_type) and streams are analysed row by row."""
    if claims.isStreaming or set(claims.columns) & {"claim_type", D.THERE}:
        return text_analyzed(claims)
    texts = written(text_analyzed(claims.select("text").distinct()), "analysed")
    added = [c for c in texts.columns if c != "text"]
    rows = claims.drop(*added).alias("c").join(texts.alias("t"), F.col("c.text").eqNullSafe(F.col("t.text")))
    return rows.select("c.*", *[F.col(f"t.{c}") for c in added])


def scored(claims: DataFrame) -> DataFrame:
    """Claims with four components and claim_risk."""
    own = J.external_risk(J.evidence_risk(J.text_risk(claims)))
    return J.claim_risk(J.consistency_risk(own, I.conflict_counts(claims)))


def run_pipeline(claims: DataFrame, mode: str = "fast") -> dict[str, DataFrame]:
    """Only the tables that the mode asks for are built; an unknown mode is `fast`. fast: features;
    standard: with structure; comprehensive: with certificates, contradictions, sins and risks."""
    mode = mode if mode in MODES else "fast"
    claims = claims.filter(F.trim("text") != "")
    features = D.flags_v2(D.lexicon_counts(claims))
    if mode == "fast":
        return {"features": features}
    if mode == "standard":
        return {"features": features, "structure": G.structure(claims)}
    wide = written(analyzed(claims), "claims")
    hits = I.sin_hits(wide)
    risks = scored(wide)
    return {"features": features, "structure": G.structure(claims), "certificates": H.mentions(wide), "signals": H.signal_rows(wide), "contradictions": I.contradictions(wide), "sin_hits": hits, "claim_risk": J.claim_sins(risks, hits), "document_risk": J.document_risk(risks), "top_concerns": J.top_concerns(I.sin_summary(hits))}


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    return C.claims(spark, sf)


def _wide(spark: SparkSession, sf: str) -> DataFrame:
    return analyzed(C.claims(spark, sf))


def wide_table(spark: SparkSession, sf: str) -> DataFrame:
    """The same as a table in the shared folder, for queries in which several branches read it: the
    matching of terms and patterns, which is what costs, is done once."""
    return written(_wide(spark, sf), "claims")


def _joined(c: str, sep: str = "|"):
    return F.array_join(F.col(c), sep).alias(c)


def d1(spark, sf):
    return D.match_lexicon(_claims(spark, sf)).select("doc_id", "claim_id", "category", "hit", "term")


def d2(spark, sf):
    return D.lexicon_counts(_claims(spark, sf)).select("doc_id", "claim_id", *COUNTS, *[_joined(m) for m in LISTS], (F.col("n_proof") > 0).alias("proof_present"), (F.col("n_scope") > 0).alias("scope_present"))


def d3(spark, sf):
    return D.flags_v2(_claims(spark, sf)).select("doc_id", "claim_id", "quantified", "timeline")


def d4(spark, sf):
    return D.flags_v1(_claims(spark, sf)).select("doc_id", "claim_id", "quantified", "timeline")


def d5(spark, sf):
    return _claims(spark, sf).select("doc_id", "claim_id", D.approx_tokens(F.col("text")).alias("tokens"))


def d6(spark, sf):
    return D.text_metrics(C.documents(spark, sf)).select("doc_id", "latin_words", "cjk", "density", "tokens")


def d7(spark, sf):
    return D.highlight_spans(C.documents(spark, sf))


def d8(spark, sf):
    return D.term_coverage(_claims(spark, sf)).select("category", "term", "docs", F.round("share", 9).alias("share"))


def large_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """The fixed lexicon and, as one category more, every word of the benchmark's texts."""
    words = F.explode(F.split(F.lower("text"), "[^a-z]+"))
    own = C.table(spark, sf, "benchmark").select(words.alias("term")).filter("term <> ''").distinct()
    own = own.select(F.lit("benchmark").alias("category"), F.lit(0).alias("ord"), "term")
    return L.read_lexicon_table(spark).unionByName(own)


def _texts(spark, sf):
    return C.table(spark, sf, "documents").select("doc_id", "text")


def d1l(spark, sf):
    return L.match_terms(_texts(spark, sf), large_lexicon(spark, sf)).select("doc_id", "category", "hit", "term")


def d1g(spark, sf):
    """The same, as if the lexicon were too large to be sent."""
    return L.match_terms(_texts(spark, sf), large_lexicon(spark, sf), sent_bytes=0).select("doc_id", "category", "hit", "term")


def d1a(spark, sf):
    """The fixed lexicon over all claims, by the automaton: the rows of D1."""
    return L.match_terms(_claims(spark, sf), L.read_lexicon_table(spark)).select("doc_id", "claim_id", "category", "hit", "term")


def d8l(spark, sf):
    docs = _texts(spark, sf)
    return L.coverage(L.match_terms(docs, large_lexicon(spark, sf)), docs).select("category", "term", "docs", F.round("share", 9).alias("share"))


def d9(spark, sf):
    out = D.breakdown_v2(_wide(spark, sf))
    return out.select("doc_id", *[F.round(c, 6).alias(c) for c in ("vague", "no_proof", "absolute", "future")])


def g1(spark, sf):
    return G.parsed(_claims(spark, sf)).select("doc_id", "claim_id", "metric_value", "metric_unit")


def g2(spark, sf):
    return G.parsed(_claims(spark, sf)).select("doc_id", "claim_id", F.array_join(F.col("ghg_scope").cast("array<string>"), ",").alias("ghg_scope"))


def g3(spark, sf):
    return G.parsed(_claims(spark, sf)).select("doc_id", "claim_id", "baseline_year")


def g4(spark, sf):
    return G.parsed(_claims(spark, sf)).select("doc_id", "claim_id", "target_year")


def g5(spark, sf):
    return G.structure(_claims(spark, sf)).select("doc_id", "claim_id", "claim_type")


def model_structure(spark, sf) -> DataFrame:
    """Model answers for every fifth part number: JSON texts made from the line items themselves."""
    own = C.claims(spark, sf)
    raw = F.expr(MODEL_JSON)
    return own.filter("ord % 2 = 0").select("doc_id", "ord", "claim_id", raw.alias("structure_json"))


#: Read by both engines; ord and doc_id make the fields.
MODEL_JSON = """concat('{"claim_type": "', CASE WHEN ord % 4 = 0 THEN 'vision' ELSE 'slogan' END, '", "metric": {"name": "Energy Use", "value": ', CAST(doc_id % 90 AS STRING), ', "unit": "kWh"}, "scope": {"boundary": "', CASE WHEN ord % 4 = 0 THEN 'company' ELSE 'galaxy' END, '", "ghg_scope": [3, 1, ', CAST(ord AS STRING), ']}, "confidence": ', CASE WHEN ord % 4 = 0 THEN '1.5' ELSE 'null' END, '}')"""


def g6(spark, sf):
    out = G.normalize_structure(model_structure(spark, sf))
    return out.select("doc_id", "claim_id", "claim_type", "metric_name", "metric_value", "metric_unit", "boundary", F.array_join(F.col("ghg_scope").cast("array<string>"), ",").alias("ghg_scope"), "confidence")


def g7(spark, sf):
    out = G.structure_claims(_claims(spark, sf), G.normalize_structure(model_structure(spark, sf)))
    return out.select("doc_id", "claim_id", "claim_type", "metric_value", "metric_unit", F.array_join(F.col("ghg_scope").cast("array<string>"), ",").alias("ghg_scope"), "baseline_year", "target_year", "confidence", "structure_source")


def h1(spark, sf):
    return H.match_certifications(_claims(spark, sf)).select("doc_id", "claim_id", "cert_id", "cert_ord")


def h2(spark, sf):
    """Cited names: each third claim cites the English name of a certificate and a name of no registry."""
    own = _claims(spark, sf)
    cited = own.filter("ord % 3 = 0").select("doc_id", "claim_id", F.explode(F.array(F.lit("ISO 14064"), F.lit("GRI Standards"), F.lit("House Seal"))).alias("name"))
    return H.fold_cited_evidence(H.match_certifications(own), cited, H.read_registry(spark))


def h3(spark, sf):
    return H.false_label_signals(_claims(spark, sf)).select("doc_id", "claim_id", "signal", "severity")


def h4(spark, sf):
    return H.cert_summary(_claims(spark, sf))


def h5(spark, sf):
    return H.cert_rollup(H.match_certifications(_claims(spark, sf)), H.read_registry(spark))


def i1(spark, sf):
    return I.metric_key(_wide(spark, sf)).select("doc_id", "claim_id", "metric_key")


def _edges(f):
    return lambda spark, sf: f(_wide(spark, sf)).select("doc_id", "type", "severity", "claim_a", "claim_b")


def _sin(name):
    return lambda spark, sf: I.sin_hits(_wide(spark, sf), [name]).select("doc_id", "claim_id", "sin", "severity")


def i11(spark, sf):
    return I.sin_hits(_wide(spark, sf)).select("doc_id", "claim_id", "sin", "severity")


def i12(spark, sf):
    return I.sin_summary(I.sin_hits(_wide(spark, sf))).select("doc_id", "sin", "hit_count", "high", "medium", "low")


def i13(spark, sf):
    wide = wide_table(spark, sf)
    return I.consistency_summary(wide, I.conflict_counts(wide), I.sin_hits(wide))


def i5c(spark, sf):
    return I.conflict_counts(wide_table(spark, sf))


def j1(spark, sf):
    return J.text_risk(_wide(spark, sf)).select("doc_id", "claim_id", "text_risk")


def j2(spark, sf):
    return J.evidence_risk(_wide(spark, sf)).select("doc_id", "claim_id", "evidence_risk")


def j3(spark, sf):
    return J.external_risk(_wide(spark, sf)).select("doc_id", "claim_id", "external_risk")


def j4(spark, sf):
    wide = wide_table(spark, sf)
    return J.consistency_risk(wide, I.conflict_counts(wide)).select("doc_id", "claim_id", "consistency_risk")


def j5(spark, sf):
    return scored(wide_table(spark, sf)).select("doc_id", "claim_id", "claim_risk", "risk_level")


def j6(spark, sf):
    wide = _wide(spark, sf)
    return J.claim_sins(wide, I.sin_hits(wide)).select("doc_id", "claim_id", _joined("sins", ","))


def j7(spark, sf):
    return J.document_risk(scored(wide_table(spark, sf)))


def j8(spark, sf):
    return J.top_concerns(I.sin_summary(I.sin_hits(_wide(spark, sf))))


def j9(spark, sf):
    """Sizes of the tables of each mode."""
    out, own = None, written(_claims(spark, sf), "texts")
    for mode in MODES:
        for name, df in run_pipeline(own, mode).items():
            n = df.agg(F.count("*").alias("rows")).select(F.lit(mode).alias("mode"), F.lit(name).alias("part"), "rows")
            out = n if out is None else out.unionByName(n)
    return out


def j10(spark, sf):
    out = J.portfolio_rollup(j7(spark, sf), C.companies(spark, sf))
    return out.select("sector", "year", "company", "documents", F.round("mean_gri", 6).alias("mean_gri"), "max_gri", F.col("grouping").cast("int").alias("grouping"))


def d2e(spark, sf):
    return D.lexicon_counts(C.every_claim(spark, sf)).select("doc_id", "claim_id", *COUNTS, *[_joined(m) for m in LISTS])


def g1e(spark, sf):
    return G.structure(C.every_claim(spark, sf)).select("doc_id", "claim_id", "metric_value", "metric_unit", F.array_join(F.col("ghg_scope").cast("array<string>"), ",").alias("ghg_scope"), "baseline_year", "target_year", "claim_type")


def h1e(spark, sf):
    return H.match_certifications(C.every_claim(spark, sf)).select("doc_id", "claim_id", "cert_id", "cert_ord")


def h1d(spark, sf):
    out = H.certification_details(H.match_certifications(C.every_claim(spark, sf)), H.read_registry(spark))
    return out.select("doc_id", "claim_id", "cert_id", "name_en", "type", "authority", "verification_url", "official")


def h3e(spark, sf):
    return H.false_label_signals(C.every_claim(spark, sf)).select("doc_id", "claim_id", "signal", "severity")


def j7e(spark, sf):
    return J.document_risk(scored(written(analyzed(C.every_claim(spark, sf)), "claims")))


QUERIES = {
    "D2_lexicon_counts_every": d2e, "G1_structure_every": g1e, "H1_match_certifications_every": h1e, "H1_certification_details": h1d, "H3_false_label_signals_every": h3e, "J7_document_risk_every": j7e,
    "D1_match_lexicon": d1, "D1_match_lexicon_automaton": d1a, "D1_match_lexicon_large": d1l, "D1_match_lexicon_joined": d1g, "D8_term_coverage_large": d8l, "D2_lexicon_counts": d2, "D3_flags_v2": d3, "D4_flags_v1": d4, "D5_approx_tokens": d5, "D6_text_metrics": d6, "D7_highlight_spans": d7, "D8_term_coverage": d8, "D9_breakdown_v2": d9,
    "G1_parse_metric": g1, "G2_parse_ghg_scope": g2, "G3_parse_baseline_year": g3, "G4_parse_target_year": g4, "G5_infer_claim_type": g5, "G6_normalize_structure": g6, "G7_structure_claims": g7,
    "H1_match_certifications": h1, "H2_fold_cited_evidence": h2, "H3_false_label_signals": h3, "H4_cert_summary": h4, "H5_cert_rollup": h5,
    "I1_metric_key": i1, "I2_numeric_contradictions": _edges(I.numeric_contradictions), "I3_target_year_contradictions": _edges(I.target_year_contradictions), "I4_scope_contradictions": _edges(I.scope_contradictions), "I5_contradictions": _edges(I.contradictions), "I5_conflict_counts": i5c,
    "I6_sin_hidden_tradeoff": _sin("hidden_tradeoff"), "I7_sin_no_proof": _sin("no_proof"), "I8_sin_vagueness": _sin("vagueness"), "I9_sin_false_labels": _sin("false_labels"), "I10_sin_irrelevance": _sin("irrelevance"), "I11_sin_hits": i11, "I12_sin_summary": i12, "I13_consistency_summary": i13,
    "J1_text_risk": j1, "J2_evidence_risk": j2, "J3_external_risk": j3, "J4_consistency_risk": j4, "J5_claim_risk": j5, "J6_claim_sins": j6, "J7_document_risk": j7, "J8_top_concerns": j8, "J9_run_pipeline": j9, "J10_portfolio_rollup": j10,
}


# The oracle: the same tables as one chain of common table expressions, written for DuckDB.
def _m(p: str, text: str = "text") -> str:
    return f"regexp_matches({text}, {sql_text(p)}, 'i')"


def _n(p: str) -> str:
    return f"len(regexp_extract_all(text, {sql_text('(?i)' + p)}))"


def _g(p: str, group: int) -> str:
    return f"nullif(regexp_extract(text, {sql_text('(?i)' + p)}, {group}), '')"


def _signal(p: str) -> str:
    """Look-ahead by counting: some match is not followed by what must not follow."""
    if "(?!" not in p:
        return _m(p)
    if "第一" in p:
        plain = p.replace(r"|行业\s?第一(?!\s*家)", "")
        return f"({_m(plain)} OR {_n('行业' + chr(92) + 's?第一')} > {_n('行业' + chr(92) + 's?第一' + chr(92) + 's*家')})"
    word, after = r"\b(?:certified|认证)\b", r"\s+(?:by|to|under|to\s+the|under\s+the|per|against|的|于)\b"
    return f"({_n(word)} > {_n(word + after)})"


FEATURES_SQL = (
    C.CLAIMS_SQL
    + ",\nfeatures AS (SELECT *, "
    + ", ".join(f"len(m_{c})::INT AS n_{c}" for c in X.LEXICON)
    + " FROM (SELECT *, "
    + ", ".join(f"list_filter({sql_list(t)}, lambda t: contains(lower(text), t)) AS m_{c}" for c, t in X.LEXICON.items())
    + f", {_m(X.QUANTITY_V2)} AS quantified, {_m(X.TIMELINE_V2)} AS timeline FROM claims))"
)
STRUCTURE_SQL = (
    FEATURES_SQL
    + f""",
parsed AS (SELECT *, {_g(X.METRIC, 1)}::DOUBLE AS metric_value, {_g(X.METRIC, 2)} AS metric_unit,
  list_sort(list_distinct(list_transform(list_concat(regexp_extract_all(text, {sql_text("(?i)" + X.SCOPE_EN)}, 1), list_transform(regexp_extract_all(text, {sql_text(X.SCOPE_ZH)}, 1), lambda x: translate(x, '一二三', '123'))), lambda x: x::INT))) AS scopes,
  {_g(X.BASELINE_YEAR, 1)}::INT AS raw_year, coalesce({_g(X.TARGET_YEAR, 1)}, {_g(X.TARGET_YEAR, 2)})::INT AS target_year FROM features),
structured AS (SELECT *, CASE WHEN len(scopes) > 0 THEN scopes END AS ghg_scope, CASE WHEN raw_year < 100 THEN raw_year + 2000 ELSE raw_year END AS baseline_year,
  CASE WHEN target_year IS NOT NULL AND {_m(X.FUTURE_WORD)} THEN 'commitment' WHEN metric_value IS NOT NULL AND {_m(X.DONE_WORD)} THEN 'performance' ELSE 'disclosure' END AS claim_type FROM parsed)"""
)
WIDE_SQL = (
    STRUCTURE_SQL
    + ",\nwide AS (SELECT *, list_filter(["
    + ", ".join(f"CASE WHEN {_m(c[7])} THEN '{c[0]}' END" for c in X.CERTIFICATES)
    + "], lambda x: x IS NOT NULL) AS certs, list_filter(["
    + ", ".join(f"CASE WHEN {_signal(p)} THEN '{s}' END" for s, _, p in X.FALSE_LABELS)
    + "], lambda x: x IS NOT NULL) AS signal_names, "
    + " || ".join(f"CASE WHEN {_signal(p)} THEN '{v[0]}' ELSE '' END" for _, v, p in X.FALSE_LABELS)
    + " AS signal_marks FROM structured)"
)
SEVERITY_SQL = "CASE severity WHEN 'high' THEN 30 WHEN 'medium' THEN 15 WHEN 'low' THEN 5 END"
EDGES_SQL = (
    WIDE_SQL
    + f""",
keyed AS (SELECT *, 'unnamed_metric' || coalesce('_scope' || array_to_string(ghg_scope, ''), '') AS metric_key FROM wide),
numeric_edges AS (SELECT doc_id, 'numeric_metric_mismatch' AS type, CASE WHEN gap > 0.25::DOUBLE THEN 'high' ELSE 'medium' END AS severity, claim_a, claim_b FROM (
  SELECT a.doc_id, a.claim_id AS claim_a, b.claim_id AS claim_b, abs(a.metric_value - b.metric_value) / greatest(abs(a.metric_value), abs(b.metric_value), 1.0::DOUBLE) AS gap
  FROM keyed a JOIN keyed b ON a.doc_id = b.doc_id AND a.metric_key = b.metric_key AND a.ord < b.ord WHERE a.metric_unit = b.metric_unit) WHERE gap > 0.05::DOUBLE),
year_edges AS (SELECT a.doc_id, 'target_year_mismatch' AS type, 'medium' AS severity, a.claim_id AS claim_a, b.claim_id AS claim_b
  FROM keyed a JOIN keyed b ON a.doc_id = b.doc_id AND a.metric_key = b.metric_key AND a.ord < b.ord AND a.target_year <> b.target_year),
scope_edges AS (SELECT a.doc_id, 'absolute_vs_partial_scope' AS type, 'medium' AS severity, a.claim_id AS claim_a, b.claim_id AS claim_b
  FROM wide a JOIN wide b ON a.doc_id = b.doc_id AND a.ord <> b.ord WHERE a.n_absolute > 0 AND {_m(X.NET_ZERO, "a.text")} AND b.ghg_scope IS NOT NULL AND NOT list_contains(b.ghg_scope, 3)),
edges AS (SELECT * FROM numeric_edges UNION ALL SELECT * FROM year_edges UNION ALL SELECT * FROM scope_edges)"""
)
SINS_SQL = (
    EDGES_SQL
    + f""",
sins AS (SELECT doc_id, ord, claim_id, unnest(['hidden_tradeoff', 'no_proof', 'vagueness', 'false_labels', 'irrelevance']) AS sin, unnest([0, 1, 2, 3, 4]) AS sin_ord, unnest([
  CASE WHEN n_green >= 1 AND n_scope = 0 AND NOT coalesce(list_contains(ghg_scope, 3), false) THEN CASE WHEN n_green >= 3 THEN 'medium' ELSE 'low' END END,
  CASE WHEN n_green >= 1 AND n_proof = 0 AND len(certs) = 0 THEN CASE WHEN n_green >= 3 THEN 'high' ELSE 'medium' END END,
  CASE WHEN n_vague >= 2 AND NOT quantified THEN CASE WHEN n_vague >= 4 THEN 'high' WHEN n_vague = 3 THEN 'medium' ELSE 'low' END END,
  CASE WHEN contains(signal_marks, 'h') THEN 'high' WHEN contains(signal_marks, 'm') THEN 'medium' WHEN signal_marks <> '' THEN 'low' END,
  CASE WHEN {_m(X.CFC_FREE)} THEN 'medium' END]) AS severity FROM wide),
sin_hits AS (SELECT * FROM sins WHERE severity IS NOT NULL)"""
)
RISK_SQL = (
    SINS_SQL
    + f""",
touched AS (SELECT doc_id, claim_id, sum(p) AS p FROM (SELECT doc_id, claim_a AS claim_id, {SEVERITY_SQL} AS p FROM edges UNION ALL SELECT doc_id, claim_b, {SEVERITY_SQL} FROM edges) GROUP BY doc_id, claim_id),
components AS (SELECT w.*, greatest(0, least(100, CASE WHEN n_green >= 1 AND n_vague >= 1 THEN 20 ELSE 0 END + least(30, 8 * n_vague) + CASE WHEN n_absolute >= 1 AND n_proof = 0 THEN 18 ELSE 0 END
    + CASE WHEN n_emotional >= 2 THEN 12 ELSE 0 END - CASE WHEN n_action >= 1 THEN 15 ELSE 0 END - CASE WHEN quantified THEN 10 ELSE 0 END))::DOUBLE AS text_risk,
  greatest(0, least(100, 50 - CASE WHEN metric_value IS NULL THEN 0 ELSE 10 END - CASE WHEN ghg_scope IS NULL THEN 0 ELSE 15 END - CASE WHEN baseline_year IS NULL THEN 0 ELSE 12 END - CASE WHEN target_year IS NULL THEN 0 ELSE 8 END
    - least(30, 15 * len(certs)) + CASE WHEN n_absolute >= 1 AND ghg_scope IS NULL AND baseline_year IS NULL AND metric_value IS NULL THEN 25 ELSE 0 END))::DOUBLE AS evidence_risk,
  least(100, 30 * len(regexp_extract_all(signal_marks, 'h')) + 15 * len(regexp_extract_all(signal_marks, 'm')) + 5 * len(regexp_extract_all(signal_marks, 'l')))::DOUBLE AS external_risk,
  least(100, coalesce(p, 0))::DOUBLE AS consistency_risk FROM wide w LEFT JOIN touched t ON w.doc_id = t.doc_id AND w.claim_id = t.claim_id),
raw_risk AS (SELECT *, 0.0::DOUBLE + 0.3::DOUBLE * text_risk + 0.4::DOUBLE * evidence_risk + 0.15::DOUBLE * external_risk + 0.15::DOUBLE * consistency_risk AS r FROM components),
claim_risks AS (SELECT *, floor(r * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS claim_risk, CASE WHEN r <= 25 THEN '低风险' WHEN r <= 50 THEN '中低风险' WHEN r <= 75 THEN '中高风险' ELSE '高风险' END AS risk_level FROM raw_risk),
doc_components AS (SELECT doc_id, count(*) AS claims, """
    + ", ".join(f"floor((0.6::DOUBLE * (sum({c}) / count(*)) + 0.4::DOUBLE * max({c})) * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS {c}" for c in X.COMPONENT_WEIGHTS)
    + """ FROM components GROUP BY doc_id),
doc_raw AS (SELECT *, 0.0::DOUBLE + 0.3::DOUBLE * text_risk + 0.4::DOUBLE * evidence_risk + 0.15::DOUBLE * external_risk + 0.15::DOUBLE * consistency_risk AS r FROM doc_components),
doc_risk AS (SELECT doc_id, claims, text_risk, evidence_risk, external_risk, consistency_risk, floor(r * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS gri,
  CASE WHEN r <= 25 THEN '低风险' WHEN r <= 50 THEN '中低风险' WHEN r <= 75 THEN '中高风险' ELSE '高风险' END AS risk_level FROM doc_raw)"""
)
SUMMARY_SQL = RISK_SQL + """,
sin_summary AS (SELECT doc_id, sin, count(*) AS hit_count, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, min(ord) AS first_ord, min(sin_ord) AS sin_ord FROM sin_hits GROUP BY doc_id, sin),
concerns AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY 3 * high + 2 * medium + low DESC, first_ord, sin_ord)::INT AS place, sin, hit_count, 3 * high + 2 * medium + low AS weighted FROM sin_summary)"""
REGISTRY_SQL = "registry(id, name_en, name_zh, type, region, domain, founded_year) AS (VALUES " + ", ".join(f"('{c[0]}', {sql_text(c[1])}, {sql_text(c[2])}, '{c[3]}', '{c[4]}', {sql_list(c[5])}, {c[6]})" for c in X.CERTIFICATES) + ")"
MENTIONS_SQL = WIDE_SQL + ",\nmentions AS (SELECT doc_id, ord, claim_id, unnest(certs) AS cert_id FROM wide)"


def _q(chain: str, select: str) -> str:
    return f"WITH {chain}\n{select}"


def _edge_sql(name: str) -> str:
    return _q(EDGES_SQL, f"SELECT doc_id, type, severity, claim_a, claim_b FROM {name}")


def _sin_sql(name: str) -> str:
    return _q(SINS_SQL, f"SELECT doc_id, claim_id, sin, severity FROM sin_hits WHERE sin = '{name}'")


_CQ = "doc_id, claim_id"
_LARGE = f"""lexicon AS (SELECT 'benchmark' AS category, 0 AS ord, term FROM (SELECT DISTINCT unnest(regexp_extract_all(lower("text"), '[a-z]+')) AS term FROM benchmark) UNION ALL SELECT * FROM (VALUES {", ".join(f"('{c}', {i}, {sql_text(t)})" for c, terms in X.LEXICON.items() for i, t in enumerate(terms))})),
hits AS (SELECT doc_id, category, row_number() OVER (PARTITION BY doc_id, category ORDER BY ord, term)::INT AS hit, term FROM (SELECT doc_id, lower("text") AS low FROM documents) d JOIN lexicon ON contains(low, term))"""
_LONG = " UNION ALL ".join(f"SELECT doc_id, ord, claim_id, '{c}' AS category, generate_subscripts(m_{c}, 1)::INT AS hit, unnest(m_{c}) AS term FROM features" for c in X.LEXICON)
_SPAN_TERMS = " UNION ALL ".join(f"SELECT doc_id, text, '{c}' AS category, unnest(list_filter({sql_list(t)}, lambda t: contains(lower(text), t))) AS term FROM docs" for c, t in X.LEXICON.items())
ORACLE_SQL = {
    "D1_match_lexicon": _q(FEATURES_SQL, f"SELECT {_CQ}, category, hit, term FROM ({_LONG})"),
    "D1_match_lexicon_automaton": _q(FEATURES_SQL, f"SELECT {_CQ}, category, hit, term FROM ({_LONG})"),
    "D1_match_lexicon_large": _q(_LARGE, "SELECT * FROM hits"),
    "D1_match_lexicon_joined": _q(_LARGE, "SELECT * FROM hits"),
    "D8_term_coverage_large": _q(_LARGE, "SELECT category, term, count(DISTINCT doc_id) AS docs, round(count(DISTINCT doc_id) / (SELECT count(DISTINCT doc_id) FROM documents)::DOUBLE, 9) AS share FROM hits GROUP BY category, term"),
    "D2_lexicon_counts": _q(FEATURES_SQL, f"SELECT {_CQ}, {', '.join(COUNTS)}, {', '.join(f"array_to_string({m}, '|') AS {m}" for m in LISTS)}, n_proof > 0 AS proof_present, n_scope > 0 AS scope_present FROM features"),
    "D3_flags_v2": _q(FEATURES_SQL, f"SELECT {_CQ}, quantified, timeline FROM features"),
    "D4_flags_v1": _q(C.CLAIMS_SQL, f"SELECT {_CQ}, regexp_matches(lower(text), {sql_text(X.QUANTITY_V1)}) AS quantified, {_m(X.TIMELINE_V1)} AS timeline FROM claims"),
    "D5_approx_tokens": _q(C.CLAIMS_SQL, rf"SELECT {_CQ}, (len(regexp_extract_all(text, '\S+')) + ceil(len(regexp_extract_all(text, '[一-鿿]')) * 0.6::DOUBLE))::INT AS tokens FROM claims"),
    "D6_text_metrics": _q(C.DOCUMENTS_SQL, r"""SELECT *, latin_words + cjk AS tokens FROM (SELECT doc_id, len(regexp_extract_all(text, '[a-zA-Z]+(?:[-''][a-zA-Z]+)?'))::INT AS latin_words, len(regexp_extract_all(text, '[一-鿿]'))::INT AS cjk, length(regexp_replace(text, '\s+', '', 'g'))::INT AS density FROM docs)"""),
    "D7_highlight_spans": _q(
        C.DOCUMENTS_SQL,
        f"""SELECT doc_id, category, term, (list_sum(list_transform(pieces[1:n], lambda p: length(p))) + (n - 1) * length(term))::INT AS start, (list_sum(list_transform(pieces[1:n], lambda p: length(p))) + n * length(term))::INT AS "end"
FROM (SELECT *, unnest(range(1, len(pieces))) AS n FROM (SELECT doc_id, category, term, string_split(lower(text), term) AS pieces FROM ({_SPAN_TERMS})))""",
    ),
    "D8_term_coverage": _q(FEATURES_SQL, f"SELECT category, term, count(DISTINCT doc_id) AS docs, round(count(DISTINCT doc_id) / (SELECT count(DISTINCT doc_id) FROM claims)::DOUBLE, 9) AS share FROM ({_LONG}) GROUP BY category, term"),
    "D9_breakdown_v2": _q(FEATURES_SQL, "SELECT doc_id, round(avg((n_vague > 0)::INT::DOUBLE) * 25, 6) AS vague, round(avg((n_proof = 0)::INT::DOUBLE) * 25, 6) AS no_proof, round(avg((n_absolute > 0)::INT::DOUBLE) * 25, 6) AS absolute, round(avg((n_future > 0)::INT::DOUBLE) * 25, 6) AS future FROM features GROUP BY doc_id"),
    "G1_parse_metric": _q(STRUCTURE_SQL, f"SELECT {_CQ}, metric_value, metric_unit FROM structured"),
    "G2_parse_ghg_scope": _q(STRUCTURE_SQL, f"SELECT {_CQ}, array_to_string(ghg_scope, ',') AS ghg_scope FROM structured"),
    "G3_parse_baseline_year": _q(STRUCTURE_SQL, f"SELECT {_CQ}, baseline_year FROM structured"),
    "G4_parse_target_year": _q(STRUCTURE_SQL, f"SELECT {_CQ}, target_year FROM structured"),
    "G5_infer_claim_type": _q(STRUCTURE_SQL, f"SELECT {_CQ}, claim_type FROM structured"),
    "G6_normalize_structure": _q(C.CLAIMS_SQL, f"SELECT {_CQ}, CASE WHEN ord % 4 = 0 THEN 'vision' ELSE 'disclosure' END AS claim_type, 'Energy Use' AS metric_name, (doc_id % 90)::DOUBLE AS metric_value, 'kWh' AS metric_unit, CASE WHEN ord % 4 = 0 THEN 'company' ELSE 'unknown' END AS boundary, CASE WHEN ord = 2 THEN '1,2,3' ELSE '1,3' END AS ghg_scope, CASE WHEN ord % 4 = 0 THEN 1.0 ELSE 0.6 END::DOUBLE AS confidence FROM claims WHERE ord % 2 = 0"),
    "G7_structure_claims": _q(STRUCTURE_SQL, f"""SELECT {_CQ}, CASE WHEN ord % 4 = 0 THEN 'vision' WHEN ord % 2 = 0 THEN 'disclosure' ELSE claim_type END AS claim_type, CASE WHEN ord % 2 = 0 THEN (doc_id % 90)::DOUBLE ELSE metric_value END AS metric_value, CASE WHEN ord % 2 = 0 THEN 'kWh' ELSE metric_unit END AS metric_unit,
  CASE WHEN ord = 2 THEN '1,2,3' WHEN ord % 2 = 0 THEN '1,3' ELSE array_to_string(ghg_scope, ',') END AS ghg_scope, CASE WHEN ord % 2 = 1 THEN baseline_year END AS baseline_year, CASE WHEN ord % 2 = 1 THEN target_year END AS target_year, CASE WHEN ord % 4 = 0 THEN 1.0 WHEN ord % 2 = 0 THEN 0.6 ELSE 0.4 END::DOUBLE AS confidence, CASE WHEN ord % 2 = 0 THEN 'llm' ELSE 'fallback-regex' END AS structure_source FROM structured"""),
    "H1_match_certifications": _q(MENTIONS_SQL, f"SELECT {_CQ}, cert_id, (list_position({sql_list([c[0] for c in X.CERTIFICATES])}, cert_id) - 1)::INT AS cert_ord FROM mentions"),
    "H2_fold_cited_evidence": _q(MENTIONS_SQL + ",\n" + REGISTRY_SQL, """SELECT doc_id, claim_id, cert_id, NULL::VARCHAR AS cited_name FROM mentions UNION ALL
SELECT doc_id, claim_id, NULL, name FROM (SELECT doc_id, claim_id, unnest(['ISO 14064', 'GRI Standards', 'House Seal']) AS name FROM claims WHERE ord % 3 = 0) c
WHERE NOT EXISTS (SELECT 1 FROM mentions m JOIN registry r ON m.cert_id = r.id WHERE m.doc_id = c.doc_id AND m.claim_id = c.claim_id AND (contains(lower(name_en), lower(name)) OR contains(lower(name_zh), lower(name)) OR contains(cert_id, replace(lower(name), ' ', '_'))))"""),
    "H3_false_label_signals": _q(WIDE_SQL, f"SELECT {_CQ}, s AS signal, CASE s WHEN 'self_certified' THEN 'high' WHEN 'vague_certification_claim' THEN 'low' ELSE 'medium' END AS severity FROM (SELECT {_CQ}, unnest(signal_names) AS s FROM wide)"),
    "H4_cert_summary": _q(WIDE_SQL, f"SELECT {_CQ}, len(certs)::INT AS recognized, len(signal_names)::INT AS suspicious FROM wide"),
    "H5_cert_rollup": _q(MENTIONS_SQL + ",\n" + REGISTRY_SQL, "SELECT type, region, d AS domain, count(*) AS mentions, grouping(type, region, d)::BIGINT AS grouping FROM (SELECT type, region, unnest(domain) AS d FROM mentions JOIN registry ON cert_id = id) GROUP BY CUBE (type, region, d)"),
    "I1_metric_key": _q(EDGES_SQL, f"SELECT {_CQ}, metric_key FROM keyed"),
    "I2_numeric_contradictions": _edge_sql("numeric_edges"),
    "I3_target_year_contradictions": _edge_sql("year_edges"),
    "I4_scope_contradictions": _edge_sql("scope_edges"),
    "I5_contradictions": _edge_sql("edges"),
    "I5_conflict_counts": _q(EDGES_SQL, """SELECT doc_id, claim_id, count(*) FILTER (type = 'numeric_metric_mismatch' AND severity = 'high') AS high, count(*) FILTER (type = 'numeric_metric_mismatch' AND severity = 'medium') AS medium,
  count(*) FILTER (type = 'target_year_mismatch') AS year, count(*) FILTER (type = 'absolute_vs_partial_scope') AS scope FROM (SELECT doc_id, claim_a AS claim_id, type, severity FROM edges UNION ALL SELECT doc_id, claim_b, type, severity FROM edges) GROUP BY doc_id, claim_id"""),
    "I6_sin_hidden_tradeoff": _sin_sql("hidden_tradeoff"),
    "I7_sin_no_proof": _sin_sql("no_proof"),
    "I8_sin_vagueness": _sin_sql("vagueness"),
    "I9_sin_false_labels": _sin_sql("false_labels"),
    "I10_sin_irrelevance": _sin_sql("irrelevance"),
    "I11_sin_hits": _q(SINS_SQL, f"SELECT {_CQ}, sin, severity FROM sin_hits"),
    "I12_sin_summary": _q(SUMMARY_SQL, "SELECT doc_id, sin, hit_count, high, medium, low FROM sin_summary"),
    "I13_consistency_summary": _q(SINS_SQL, "SELECT d.doc_id, coalesce(e.n, 0) AS contradictions, coalesce(h.n, 0) AS sin_hits FROM (SELECT DISTINCT doc_id FROM claims) d LEFT JOIN (SELECT doc_id, count(*) AS n FROM edges GROUP BY doc_id) e ON d.doc_id = e.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM sin_hits GROUP BY doc_id) h ON d.doc_id = h.doc_id"),
    "J1_text_risk": _q(RISK_SQL, f"SELECT {_CQ}, text_risk FROM components"),
    "J2_evidence_risk": _q(RISK_SQL, f"SELECT {_CQ}, evidence_risk FROM components"),
    "J3_external_risk": _q(RISK_SQL, f"SELECT {_CQ}, external_risk FROM components"),
    "J4_consistency_risk": _q(RISK_SQL, f"SELECT {_CQ}, consistency_risk FROM components"),
    "J5_claim_risk": _q(RISK_SQL, f"SELECT {_CQ}, claim_risk, risk_level FROM claim_risks"),
    "J6_claim_sins": _q(SINS_SQL, f"SELECT c.doc_id, c.claim_id, coalesce(s.sins, '') AS sins FROM claims c LEFT JOIN (SELECT {_CQ}, string_agg(sin, ',' ORDER BY f) AS sins FROM (SELECT *, min(ord * 100 + sin_ord) OVER (PARTITION BY doc_id, sin) AS f FROM sin_hits) GROUP BY {_CQ}) s ON c.doc_id = s.doc_id AND c.claim_id = s.claim_id"),
    "J7_document_risk": _q(RISK_SQL, "SELECT * FROM doc_risk"),
    "J8_top_concerns": _q(SUMMARY_SQL, "SELECT * FROM concerns WHERE place <= 5"),
    "J9_run_pipeline": _q(
        SUMMARY_SQL + ",\nmentions AS (SELECT unnest(certs) AS c FROM wide), signals AS (SELECT unnest(signal_names) AS s FROM wide)",
        "SELECT 'fast' AS mode, 'features' AS part, count(*) AS rows FROM claims UNION ALL SELECT 'standard', unnest(['features', 'structure']), count(*) FROM claims UNION ALL SELECT 'comprehensive', unnest(['features', 'structure', 'claim_risk']), count(*) FROM claims"
        + "".join(f" UNION ALL SELECT 'comprehensive', '{p}', count(*) FROM {t}" for p, t in (("certificates", "mentions"), ("signals", "signals"), ("contradictions", "edges"), ("sin_hits", "sin_hits"), ("document_risk", "doc_risk"), ("top_concerns", "concerns WHERE place <= 5"))),
    ),
    "J10_portfolio_rollup": _q(RISK_SQL + ",\n" + C.COMPANIES_SQL, "SELECT sector, year, company, count(*) AS documents, round(avg(gri), 6) AS mean_gri, max(gri) AS max_gri, grouping(sector, year, company)::INT AS grouping FROM doc_risk JOIN companies USING (doc_id) GROUP BY ROLLUP (sector, year, company)"),
}

_EVERY = {
    "D2_lexicon_counts_every": _q(FEATURES_SQL, f"SELECT {_CQ}, {', '.join(COUNTS)}, {', '.join(f"array_to_string({m}, '|') AS {m}" for m in LISTS)} FROM features"),
    "G1_structure_every": _q(STRUCTURE_SQL, f"SELECT {_CQ}, metric_value, metric_unit, array_to_string(ghg_scope, ',') AS ghg_scope, baseline_year, target_year, claim_type FROM structured"),
    "H1_match_certifications_every": ORACLE_SQL["H1_match_certifications"],
    "H3_false_label_signals_every": ORACLE_SQL["H3_false_label_signals"],
    "J7_document_risk_every": ORACLE_SQL["J7_document_risk"],
}
_EVERY["H1_certification_details"] = _q(
    MENTIONS_SQL + ",\n" + REGISTRY_SQL + ",\nsources(id, authority, url) AS (VALUES " + ", ".join(f"('{i}', {sql_text(a)}, {sql_text(u)})" for i, a, u in X.CERTIFICATE_SOURCES) + ")",
    f"SELECT {_CQ}, cert_id, name_en, type, authority, url AS verification_url, true AS official FROM mentions JOIN registry ON cert_id = registry.id JOIN sources ON cert_id = sources.id",
)
ORACLE_SQL |= {k: s.replace(C.CLAIMS_SQL, C.every_claim_sql()) for k, s in _EVERY.items()}
