"""Queries over pages and documents: cleaning, extraction, kinds of texts, whole-text risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.semantics import sql_list, sql_text
from ..operators import cleaning as B
from ..operators import extraction as E
from ..operators import scoring_v1 as S
from ..sources import corpus as C
from .claims_v2 import _m

#: Raw page text: documents with page ends, empty lines, a table, an index line and debris. Read by both engines.
RAW = "concat(replace(replace(text, '. A', concat('.', chr(12), 'A')), '. T', concat('.', chr(10), chr(10), 'T')), chr(10), 'Unit  2023  2024  2025', chr(10), 'Water  12  34  56', chr(10), chr(10), 'Waste  7  8  9', chr(10), 'Read more on pages 4-5 of this report', chr(13), chr(10), '12', chr(10), '-')"
RAW_SQL = f"raw AS (SELECT doc_id, {RAW} AS raw_text FROM documents WHERE text IS NOT NULL)"


def raw_pages(spark: SparkSession, sf: str) -> DataFrame:
    return C.table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", F.expr(RAW).alias("raw_text"))


def _pages(spark, sf):
    return B.split_pages(raw_pages(spark, sf))


def _lines(spark, sf, repair=False):
    pages = _pages(spark, sf)
    pages = pages.withColumn("text", B.repair_letter_spacing(F.col("text"))) if repair else pages
    return B.tag_table_rows(B.split_lines(pages))


def _blocks(spark, sf, repair=False):
    return B.flag_reference_index(B.build_blocks(_lines(spark, sf, repair)))


def b1(spark, sf):
    return C.table(spark, sf, "documents").select("doc_id", F.md5(B.normalize(F.coalesce("text", F.lit("")))).alias("text_md5"))


def b2(spark, sf):
    return _pages(spark, sf).select("doc_id", "page", F.md5("text").alias("text_md5"))


def b3(spark, sf):
    """Documents with their first words spaced out by letters, repaired."""
    spaced = F.concat(F.regexp_replace(F.substring("text", 1, 40), "([A-Za-z])(?=[A-Za-z])", "$1 "), F.lit("\n"), F.col("text"))
    rows = C.table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", spaced.alias("spaced"))
    return rows.select("doc_id", B.repair_letter_spacing(F.col("spaced")).alias("text"))


def b4(spark, sf):
    return _lines(spark, sf).select("doc_id", "page", "line", F.md5("text").alias("text_md5"))


def b5(spark, sf):
    return _lines(spark, sf).select("doc_id", "page", "line", "is_table")


def b6(spark, sf):
    rows = B.build_blocks(_lines(spark, sf))
    return rows.select("doc_id", "page", F.col("block").cast("int").alias("block"), "type", F.size("lines").alias("n_lines"), F.md5(F.array_join("lines", "|")).alias("lines_md5"))


def b7(spark, sf):
    return B.build_blocks(_lines(spark, sf, True)).filter("type = 'paragraph'").select("doc_id", "page", "block", "text")


def b8(spark, sf):
    return _blocks(spark, sf).select("doc_id", "page", F.col("block").cast("int").alias("block"), "hidden", "hidden_reason")


def b9(spark, sf):
    return B.assemble_documents(_blocks(spark, sf, True))


def b10(spark, sf):
    blocks = _blocks(spark, sf)
    return B.cleaning_stats(raw_pages(spark, sf), blocks, B.assemble_documents(blocks)).select("doc_id", "original_length", "lines_removed", "table_blocks")


def b11(spark, sf):
    return B.segment_blocks(_blocks(spark, sf, True))


def b12(spark, sf):
    return B.sentence_bounds(C.table(spark, sf, "documents").filter("text IS NOT NULL"))


def b13(spark, sf):
    out = B.chunk_documents(C.table(spark, sf, "documents").filter("text IS NOT NULL"))
    return out.select("doc_id", "chunk", "first_token", "tokens", F.md5("text").alias("text_md5"))


def b14(spark, sf):
    files = _pages(spark, sf).groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("pages"))
    return B.choose_chunk_profile(files)


def c1(spark, sf):
    return E.split_paragraphs(C.documents(spark, sf))


def c2(spark, sf):
    return E.split_sentences(E.split_paragraphs(C.documents(spark, sf)))


def c3(spark, sf):
    return E.extract_claims(C.documents(spark, sf)).select("doc_id", "claim_id", "text", "claim_type")


def c4(spark, sf):
    docs = C.documents(spark, sf)
    return E.locate_claims(docs, E.extract_claims(docs)).select("doc_id", "claim_id", "start", "end")


def c5(spark, sf):
    docs = C.documents(spark, sf)
    located = E.locate_claims(docs, E.extract_claims(docs))
    return E.locate_paragraph(located, E.paragraph_ranges(docs)).select("doc_id", "claim_id", "paragraph_idx")


def c6(spark, sf):
    return C.claims(spark, sf).select("doc_id", "claim_id", E.claim_language(F.col("text")).alias("language"))


def c7(spark, sf):
    return C.claims(spark, sf).select("doc_id", "claim_id", F.col("text").rlike("[0-9]").alias("has_data"))


def c8(spark, sf):
    return E.dedupe_claims(C.claims(spark, sf))


def c9(spark, sf):
    return E.cap_claims(C.claims(spark, sf), 3).select("doc_id", "claim_id")


#: Model claims of an order, made from its lines: some texts empty or long, pages and types off. Read by both engines.
PARSED = "doc_id, ord, CASE WHEN ord % 3 = 0 THEN claim_id END AS claim_id, CASE WHEN ord % 5 = 0 THEN '  ' WHEN ord % 4 = 0 THEN repeat(text, 4) ELSE text END AS claim_text, CASE WHEN ord % 4 <> 1 THEN CAST(ord - 3 AS INT) END AS page_number, CASE CAST(ord % 4 AS INT) WHEN 0 THEN 'P' WHEN 1 THEN 'C' WHEN 2 THEN 'Z' END AS claim_type"


def c10(spark, sf):
    parsed = spark.sql(f"SELECT {PARSED} FROM {{claims}}", claims=C.claims(spark, sf))
    return E.validate_claims(parsed).select("doc_id", "claim_id", "claim_text", "page_number", "claim_type")


def c11(spark, sf):
    return E.split_midpoint(C.table(spark, sf, "documents").filter("text IS NOT NULL"))


def c12(spark, sf):
    return E.document_profile(C.documents(spark, sf))


def e1(spark, sf):
    return S.language_confidence(C.documents(spark, sf)).select("doc_id", "language", "language_confidence")


def e2(spark, sf):
    return S.classify_context(C.documents(spark, sf)).select("doc_id", "context", "context_confidence", F.array_join("context_matches", "|").alias("context_matches"))


def e3(spark, sf):
    return S.classify_sector(C.documents(spark, sf)).select("doc_id", "sector", "sector_confidence", F.array_join("sector_matches", "|").alias("sector_matches"))


OVERRIDE = "CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN 'report' WHEN 1 THEN 'auto' WHEN 2 THEN 'nonsense' END"
MODEL = "CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN 'policy' WHEN 1 THEN 'unknown' END"


def e4(spark, sf):
    rows = S.classify_context(C.documents(spark, sf)).withColumn("override", F.expr(OVERRIDE))
    return S.resolve_choice(rows, "context", "override", list(X.CONTEXTS)).select("doc_id", "selected", "source")


def e5(spark, sf):
    rows = S.classify_context(C.documents(spark, sf)).withColumns({"override": F.expr(OVERRIDE), "model": F.expr(MODEL)})
    return S.merge_classification(rows, "context", "model", "override", list(X.CONTEXTS)).select("doc_id", "selected", "source")


def _scored(spark, sf):
    return S.score_documents(C.documents(spark, sf))


def _of(*columns):
    return lambda spark, sf: _scored(spark, sf).select("doc_id", *columns)


def _num(c):
    return F.round(F.col(c).cast("double"), 9).alias(c)


def _list(c):
    return F.array_join(c, "|").alias(c)


QUERIES = {
    "B1_normalize_text": b1, "B2_split_pages": b2, "B3_repair_letter_spacing": b3, "B4_split_lines": b4, "B5_tag_table_rows": b5, "B6_build_blocks": b6, "B7_merge_lines": b7, "B8_flag_reference_index": b8, "B9_assemble_document": b9, "B10_cleaning_stats": b10, "B11_segment_blocks": b11, "B12_sentence_bounds": b12, "B13_chunk_documents": b13, "B14_choose_chunk_profile": b14,
    "C1_split_paragraphs": c1, "C2_split_sentences": c2, "C3_extract_claims": c3, "C4_locate_claims": c4, "C5_locate_paragraph": c5, "C6_claim_language": c6, "C7_claim_has_data": c7, "C8_dedupe_claims": c8, "C9_cap_claims": c9, "C10_validate_claims": c10, "C11_split_midpoint": c11, "C12_document_profile": c12,
    "E1_language_confidence": e1, "E2_classify_context": e2, "E3_classify_sector": e3, "E4_resolve_choice": e4, "E5_merge_classification": e5,
    "F1_claim_gate": lambda s, d: _scored(s, d).select("doc_id", _num("claim_prob"), "is_claim"),
    "F2_v1_vagueness": _of("vagueness"), "F3_v1_evidence": _of("evidence"), "F4_v1_overclaim": _of("overclaim"), "F5_v1_promise": _of("promise"), "F6_v1_emotional": _of("emotional"), "F7_v1_risk": _of("risk"),
    "F8_v1_confidence": lambda s, d: _scored(s, d).select("doc_id", _num("confidence")),
    "F9_v1_level": _of("level", "tone", "summary"),
    "F10_v1_factors": lambda s, d: _scored(s, d).select("doc_id", _list("factors")),
    "F11_v1_signals": lambda s, d: _scored(s, d).select("doc_id", _list("signals")),
    "F12_score_documents": lambda s, d: _scored(s, d).select("doc_id", "mode", "risk", "vagueness", "evidence", "overclaim", "promise", "emotional", _num("confidence"), "context", "sector"),
}

TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
PAGES_SQL = RAW_SQL + ", pages AS (SELECT doc_id, generate_subscripts(p, 1)::INT AS page, unnest(p) AS text FROM (SELECT doc_id, string_split(raw_text, chr(12)) AS p FROM raw))"
LINES_SQL = (
    PAGES_SQL
    + rf""", split_lines AS (SELECT doc_id, page, (generate_subscripts(l, 1) - 1)::INT AS line, {TRIM.format('unnest(l)')} AS text FROM (SELECT doc_id, page, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS l FROM pages)),
lines AS (SELECT *, gaps >= 3 OR (gaps >= 1 AND (blanks / n > 0.35 OR digits / n > 0.4)) AS is_table FROM (SELECT *, len(regexp_extract_all(text, '[ \t]{{2,}}')) AS gaps, len(regexp_extract_all(text, '[ \t]')) AS blanks, len(regexp_extract_all(text, '[0-9]')) AS digits, greatest(1, length(text)) AS n FROM split_lines)
  WHERE NOT (length(text) <= 2 AND regexp_matches(text, '^[^A-Za-z_]+$')))"""
)
BLOCKS_SQL = (
    LINES_SQL
    + """, gaps AS (SELECT *, sum((text = '')::INT) OVER (PARTITION BY doc_id, page ORDER BY line) AS since FROM lines),
texts AS (SELECT *, lag(is_table) OVER w AS was_table, lag(since) OVER w AS was_since FROM gaps WHERE text <> '' WINDOW w AS (PARTITION BY doc_id, page ORDER BY line)),
marked AS (SELECT *, sum((was_table IS NULL OR was_table <> is_table OR (NOT is_table AND since > was_since))::INT) OVER (PARTITION BY doc_id, page ORDER BY line)::INT AS block FROM texts),
blocks AS (SELECT doc_id, page, block, CASE WHEN first(is_table) THEN 'table' ELSE 'paragraph' END AS type, count(*)::INT AS n_lines, string_agg(text, '|' ORDER BY line) AS ls, string_agg(text, ' ' ORDER BY line) AS flat FROM marked GROUP BY doc_id, page, block)"""
)
# The repair of letter spacing needs each character's neighbours: a row per character.
_RUN = "ch = ' ' AND regexp_matches(b, '^[A-Za-z]$') AND regexp_matches(coalesce(bb, ' '), '^\\s$') AND regexp_matches(a, '^[A-Za-z]$') AND NOT regexp_matches(coalesce(aa, ' '), '^[A-Za-z]$')"
_HAN = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]"
REPAIR_SQL = rf"""chars AS (SELECT key, generate_subscripts(c, 1) AS i, unnest(c) AS ch FROM (SELECT key, string_split(text, '') AS c FROM spaced)),
near AS (SELECT *, lag(ch) OVER w AS b, lag(ch, 2) OVER w AS bb, lead(ch) OVER w AS a, lead(ch, 2) OVER w AS aa FROM chars WINDOW w AS (PARTITION BY key ORDER BY i)),
runs AS (SELECT *, coalesce({_RUN}, false) AS mark FROM near),
judged AS (SELECT *, (mark AND (coalesce(lag(mark, 2) OVER w, false) OR coalesce(lead(mark, 2) OVER w, false))) OR (ch = ' ' AND coalesce(regexp_matches(b, '^{_HAN}$') AND regexp_matches(a, '^{_HAN}$'), false)) AS gone FROM runs WINDOW w AS (PARTITION BY key ORDER BY i)),
repaired AS (SELECT key, coalesce(string_agg(ch, '' ORDER BY i) FILTER (NOT gone), '') AS text FROM judged GROUP BY key)"""
_PAGES_REPAIRED = f"{PAGES_SQL}, spaced AS (SELECT {{'d': doc_id, 'p': page}} AS key, text FROM pages), {REPAIR_SQL}, mended AS (SELECT key.d AS doc_id, key.p AS page, text FROM repaired)"
_in = lambda marks: ", ".join(sql_text(m) for m in marks)
MERGED_SQL = rf"""merged AS (SELECT doc_id, page, block, first(is_table) AS is_table, count(*) AS n_lines, string_agg(text, chr(10) ORDER BY line) AS whole, list_reduce(list(text ORDER BY line), lambda acc, x: CASE WHEN acc[-1] IN ({_in(B.DASHES)}) THEN acc[:-2] || x
 WHEN acc[-1] NOT IN ({_in(B.SENTENCE_ENDS)}) AND regexp_matches(x, '^([\p{{Ll}}0-9\-—–]|{_HAN})') THEN CASE WHEN (regexp_matches(acc[-1], '{_HAN}') OR regexp_matches(x[1], '{_HAN}')) AND regexp_matches(acc[-1], '[\p{{Ll}}0-9]|{_HAN}') AND regexp_matches(x[1], '[\p{{Ll}}0-9]|{_HAN}') THEN acc || x ELSE acc || ' ' || x END
 ELSE acc || chr(10) || x END) AS text FROM marked GROUP BY doc_id, page, block)"""
REPAIRED_SQL = BLOCKS_SQL.replace(PAGES_SQL, _PAGES_REPAIRED).replace("AS l FROM pages))", "AS l FROM mended))") + ", " + MERGED_SQL

SENTENCES_SQL = (
    C.DOCUMENTS_SQL
    + r""", paragraphs AS (SELECT doc_id, generate_subscripts(p, 1)::INT - 1 AS paragraph, unnest(p) AS text FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS p FROM docs)),
pieces AS (SELECT doc_id, paragraph, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?。！？])\s+', '\1' || chr(31), 'g'), '([。！？])' || chr(31) || '?', '\1' || chr(31), 'g'), chr(31)), lambda s: trim(s)), lambda s: s <> '') AS ss FROM paragraphs),
sentences AS (SELECT doc_id, paragraph, generate_subscripts(ss, 1)::INT - 1 AS sentence, unnest(ss) AS text FROM pieces),
extracted AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph, sentence) AS o, paragraph, text FROM sentences WHERE length(text) >= 5),
found AS (SELECT doc_id, 'L0-' || lpad(o::VARCHAR, 3, '0') AS claim_id, text, paragraph FROM extracted),
located AS (SELECT f.*, (strpos(d.text, f.text) - 1)::INT AS start FROM found f JOIN docs d USING (doc_id)),
ranges AS (SELECT doc_id, paragraph, (sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY paragraph) - length(text) - 2)::INT AS lo, length(text) AS n FROM paragraphs)"""
)
_han, _latin = "len(regexp_extract_all(text, '[一-鿿]'))", "len(regexp_extract_all(text, '[a-zA-Z]'))"
LANGUAGE_SQL = f"CASE WHEN {_han} + {_latin} = 0 THEN 'unknown' WHEN {_han} / ({_han} + {_latin}) > 0.7::DOUBLE THEN 'zh' WHEN {_han} / ({_han} + {_latin}) < 0.3::DOUBLE THEN 'en' ELSE 'mixed' END"


def _classify_sql(kind: str, signals: dict, fallback: str) -> str:
    rows = ", ".join(f"{{'v': '{v}', 'o': {i}, 'm': list_filter({sql_list(t)}, lambda t: contains(lower(text), t))}}" for i, (v, t) in enumerate(signals.items()))
    return f"""{kind}s AS (SELECT doc_id, CASE WHEN len(b.m) = 0 THEN '{fallback}' ELSE b.v END AS {kind}, CASE WHEN len(b.m) = 0 THEN 0.38::DOUBLE ELSE floor(least(0.92::DOUBLE, 0.52::DOUBLE + len(b.m) * 0.12::DOUBLE) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE END AS {kind}_confidence, array_to_string(b.m[1:6], '|') AS {kind}_matches
  FROM (SELECT doc_id, list_reduce([{rows}], lambda x, y: CASE WHEN len(y.m) > len(x.m) THEN y ELSE x END) AS b FROM docs))"""


CLASS_SQL = C.DOCUMENTS_SQL + ",\n" + _classify_sql("context", X.CONTEXTS, "marketing") + ",\n" + _classify_sql("sector", X.SECTORS, "general")
V1_SQL = (
    CLASS_SQL
    + ",\nterms AS (SELECT *, "
    + ", ".join(f"list_filter({sql_list(t)}, lambda t: contains(lower(text), t)) AS m_{c}" for c, t in X.LEXICON.items())
    + f""", regexp_matches(lower(text), {sql_text(X.QUANTITY_V1)}) AS q, {_m(X.TIMELINE_V1)} AS tl, len(regexp_extract_all(text, '[a-zA-Z]+(?:[-''][a-zA-Z]+)?')) + {_han} AS tokens, length(regexp_replace(text, '\\s+', '', 'g')) AS density FROM docs JOIN contexts USING (doc_id) JOIN sectors USING (doc_id)),
counts AS (SELECT *, """
    + ", ".join(f"len(m_{c}) AS {c[0]}{c[1]}" for c in X.LEXICON)
    + """ FROM terms),
gate AS (SELECT *, gr >= 2 AND prob >= 42 AND tokens >= 15 AS ok FROM (SELECT *, least(100.0::DOUBLE, 18 + gr * 16 + gr / greatest(1.0::DOUBLE, density / 24.0::DOUBLE) * 16) AS prob FROM counts)),
parts AS (SELECT *, CASE WHEN ok THEN least(35, va * 8 + CASE WHEN q THEN 0 ELSE 12 END + CASE WHEN tl THEN 0 ELSE 6 END) ELSE 5 END::INT AS vagueness,
  CASE WHEN ok THEN least(38, CASE WHEN pr = 0 THEN 18 ELSE 0 END + CASE WHEN q THEN 0 ELSE 10 END + CASE WHEN sc = 0 THEN 7 ELSE 0 END + CASE WHEN ab > 0 AND pr = 0 THEN 8 ELSE 0 END) ELSE 4 END::INT AS evidence,
  CASE WHEN ok THEN least(28, ab * 10 + CASE WHEN va >= 2 AND NOT q THEN 7 ELSE 0 END + CASE WHEN context IN ('marketing', 'product') AND ab > 0 THEN 5 ELSE 0 END) ELSE 2 END::INT AS overclaim,
  CASE WHEN ok THEN least(28, fu * 5 + CASE WHEN fu > ac THEN 10 ELSE 0 END + CASE WHEN tl AND ac = 0 THEN 4 ELSE 0 END) ELSE 2 END::INT AS promise,
  least(30, em * 7 + CASE WHEN va > 0 THEN 4 ELSE 0 END + CASE WHEN fu > 0 THEN 4 ELSE 0 END)::INT AS emotional FROM gate),
v1 AS (SELECT *, CASE WHEN NOT ok THEN 8 ELSE greatest(6, least(92, 12 + vagueness + evidence + overclaim + promise - CASE WHEN pr > 0 THEN 10 ELSE 0 END - CASE WHEN q AND tl THEN 8 ELSE 0 END - CASE WHEN ac > 0 AND q THEN 6 ELSE 0 END
    + CASE WHEN sector IN ('energy', 'fashion', 'aviation', 'manufacturing') THEN 5 ELSE 0 END + CASE WHEN context = 'report' AND tokens > 90 AND pr = 0 THEN 4 ELSE 0 END)) END::INT AS risk,
  CASE WHEN ok THEN greatest(35, least(88, 48 + least(tokens, 140) * 0.22::DOUBLE + gr * 4 + CASE WHEN pr > 0 THEN 8 ELSE 0 END)) ELSE 54 + least(tokens, 80) * 0.35::DOUBLE END AS confidence FROM parts)"""
)


def _v1(columns: str) -> str:
    return f"WITH {V1_SQL}\nSELECT doc_id, {columns} FROM v1"


_F = {t: f"CASE WHEN {c} THEN '{t}' END" for t, c in zip(S.FACTORS, ["va > 0", "NOT q", "NOT tl", "pr = 0", "fu > ac", "ab > 0", "sc = 0", "sector IN ('energy', 'fashion', 'aviation', 'manufacturing')"], strict=True)}
ORACLE_SQL = {
    "B1_normalize_text": r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(coalesce("text", ''), chr(13) || chr(10), chr(10)), chr(160), ' '), '[\t ]+', ' ', 'g'), ' +\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS text_md5 FROM documents""",
    "B2_split_pages": f"WITH {PAGES_SQL} SELECT doc_id, page, md5(text) AS text_md5 FROM pages",
    "B4_split_lines": f"WITH {LINES_SQL} SELECT doc_id, page, line, md5(text) AS text_md5 FROM lines",
    "B5_tag_table_rows": f"WITH {LINES_SQL} SELECT doc_id, page, line, is_table FROM lines",
    "B6_build_blocks": f"WITH {BLOCKS_SQL} SELECT doc_id, page, block, type, n_lines, md5(ls) AS lines_md5 FROM blocks",
    "B8_flag_reference_index": f"WITH {BLOCKS_SQL} SELECT doc_id, page, block, type = 'paragraph' AND {_m(X.REFERENCE_INDEX, 'flat')} AS hidden, CASE WHEN type = 'paragraph' AND {_m(X.REFERENCE_INDEX, 'flat')} THEN 'reference_index' END AS hidden_reason FROM blocks",
    "B13_chunk_documents": r"""WITH t AS (SELECT doc_id, regexp_extract_all("text", '\S+') AS w FROM documents WHERE "text" IS NOT NULL),
c AS (SELECT doc_id, w, unnest(range(0, greatest(0, len(w) - 101) // 412 + 1))::INT AS chunk FROM t WHERE len(w) > 0)
SELECT doc_id, chunk, chunk * 412 AS first_token, len(w[chunk * 412 + 1:chunk * 412 + 512])::INT AS tokens, md5(array_to_string(w[chunk * 412 + 1:chunk * 412 + 512], ' ')) AS text_md5 FROM c""",
    "B14_choose_chunk_profile": f"WITH {PAGES_SQL}, f AS (SELECT doc_id, sum(strlen(text))::BIGINT AS bytes, count(*) AS pages FROM pages GROUP BY doc_id), p AS (SELECT *, CASE WHEN bytes / 1024 / pages > 15 THEN 'data_heavy' WHEN bytes / 1024 / pages < 6 THEN 'narrative' ELSE 'standard' END AS profile FROM f) SELECT *, CASE profile WHEN 'data_heavy' THEN 500 WHEN 'narrative' THEN 350 ELSE 512 END AS chunk_tokens, CASE profile WHEN 'data_heavy' THEN 80 WHEN 'narrative' THEN 50 ELSE 100 END AS overlap_tokens FROM p",
    "C1_split_paragraphs": f"WITH {SENTENCES_SQL} SELECT * FROM paragraphs",
    "C2_split_sentences": f"WITH {SENTENCES_SQL} SELECT * FROM sentences",
    "C3_extract_claims": f"WITH {SENTENCES_SQL} SELECT doc_id, claim_id, text, 'disclosure' AS claim_type FROM found",
    "C4_locate_claims": f"""WITH {SENTENCES_SQL} SELECT doc_id, claim_id, start, (start + length(text))::INT AS "end" FROM located""",
    "C5_locate_paragraph": f"WITH {SENTENCES_SQL} SELECT l.doc_id, claim_id, r.paragraph AS paragraph_idx FROM located l LEFT JOIN ranges r ON l.doc_id = r.doc_id AND start >= lo AND start < lo + n",
    "C6_claim_language": f"WITH {C.CLAIMS_SQL} SELECT doc_id, claim_id, {LANGUAGE_SQL} AS language FROM claims",
    "C7_claim_has_data": f"WITH {C.CLAIMS_SQL} SELECT doc_id, claim_id, regexp_matches(text, '[0-9]') AS has_data FROM claims",
    "C8_dedupe_claims": f"WITH {C.CLAIMS_SQL} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o)::INT AS ord, 'L0-' || lpad((row_number() OVER (PARTITION BY doc_id ORDER BY o))::VARCHAR, 3, '0') AS claim_id, text FROM (SELECT doc_id, text, min(ord) AS o FROM claims GROUP BY doc_id, text)",
    "C9_cap_claims": f"WITH {C.CLAIMS_SQL} SELECT doc_id, claim_id FROM claims WHERE ord <= 3",
    "C10_validate_claims": f"WITH {C.CLAIMS_SQL}, parsed AS (SELECT {PARSED} FROM claims) SELECT doc_id, coalesce(claim_id, 'C' || lpad(ord::VARCHAR, 3, '0')) AS claim_id, CASE WHEN length(claim_text) > 300 THEN claim_text[1:297] || '...' ELSE claim_text END AS claim_text, greatest(1, coalesce(page_number, 1))::INT AS page_number, CASE WHEN claim_type IN ('P', 'D', 'C') THEN claim_type ELSE 'D' END AS claim_type FROM parsed WHERE trim(claim_text) <> ''",
    "C12_document_profile": f"WITH {SENTENCES_SQL} SELECT d.doc_id, length(text)::INT AS length, {LANGUAGE_SQL} AS language, len(string_split(text, chr(10) || chr(10)))::INT AS paragraphs, coalesce(n, 0) AS claims FROM docs d LEFT JOIN (SELECT doc_id, count(*) AS n FROM found GROUP BY doc_id) f ON d.doc_id = f.doc_id",
    "E1_language_confidence": f"WITH {C.DOCUMENTS_SQL}, n AS (SELECT doc_id, {_han}::DOUBLE AS h, {_latin}::DOUBLE AS l FROM docs) SELECT doc_id, CASE WHEN h + l = 0 THEN 'unknown' WHEN least(h, l) / (h + l) > 0.12::DOUBLE THEN 'mixed' WHEN h >= l THEN 'zh' ELSE 'en' END AS language, CASE WHEN h + l = 0 THEN 0.0::DOUBLE WHEN least(h, l) / (h + l) > 0.12::DOUBLE THEN floor((least(h, l) / (h + l) + 0.64::DOUBLE) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE ELSE floor(greatest(h, l) / (h + l) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE END AS language_confidence FROM n",
    "E2_classify_context": f"WITH {CLASS_SQL} SELECT * FROM contexts",
    "E3_classify_sector": f"WITH {CLASS_SQL} SELECT * FROM sectors",
    "E4_resolve_choice": f"WITH {CLASS_SQL} SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'report' ELSE context END AS selected, CASE WHEN doc_id % 5 = 0 THEN 'manual' ELSE 'keyword' END AS source FROM contexts",
    "E5_merge_classification": f"WITH {CLASS_SQL} SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'report' WHEN doc_id % 3 = 0 THEN 'policy' ELSE context END AS selected, CASE WHEN doc_id % 5 = 0 THEN 'manual' WHEN doc_id % 3 = 0 THEN 'llm' ELSE 'keyword' END AS source FROM contexts",
    "F1_claim_gate": _v1("round(prob, 9) AS claim_prob, ok AS is_claim"),
    **{f"F{i}_v1_{c}": _v1(c) for i, c in enumerate(["vagueness", "evidence", "overclaim", "promise", "emotional", "risk"], 2)},
    "F8_v1_confidence": _v1("round(confidence, 9) AS confidence"),
    "F9_v1_level": _v1("CASE WHEN NOT ok OR risk < 28 THEN '低风险' WHEN risk >= 75 THEN '高风险' WHEN risk >= 50 THEN '中高风险' ELSE '中低风险' END AS level, CASE WHEN NOT ok OR risk < 28 THEN 'green' WHEN risk >= 75 THEN 'red' WHEN risk >= 50 THEN 'amber' ELSE 'teal' END AS tone, CASE WHEN NOT ok THEN 'no_claim' WHEN risk >= 75 THEN 'needs_review' WHEN risk >= 50 THEN 'needs_evidence' WHEN risk >= 28 THEN 'checkable' WHEN pr > 0 AND q AND tl THEN 'documented' ELSE 'low' END AS summary"),
    "F10_v1_factors": _v1(f"CASE WHEN NOT ok THEN 'no_strong_claim' ELSE coalesce(nullif(array_to_string(list_filter([{', '.join(_F.values())}], lambda x: x IS NOT NULL), '|'), ''), 'complete') END AS factors"),
    "F11_v1_signals": _v1("array_to_string(CASE WHEN ok THEN list_concat(list_concat(list_transform(m_green, lambda t: 'green: ' || t), list_transform(m_vague, lambda t: 'vague: ' || t)), list_concat(list_transform(m_absolute, lambda t: 'absolute: ' || t), list_transform(m_future[1:3], lambda t: 'future: ' || t)))[1:7] ELSE m_green[1:4] END, '|') AS signals"),
    "F12_score_documents": _v1("CASE WHEN ok THEN 'green-claim-risk' ELSE 'non-green-claim-baseline' END AS mode, risk, vagueness, evidence, overclaim, promise, emotional, round(confidence, 9) AS confidence, context, sector"),
}


def midpoint_sql(table: str) -> str:
    """first_half and second_half of the texts of a table."""
    return rf"""sizes AS (SELECT doc_id, text, length(text) AS n, length(text) // 2 AS mid FROM {table}),
marks AS (SELECT *, strpos(substr(text, mid + 1), chr(10) || chr(10)) AS para, length(regexp_extract(substr(text, mid + 1, 300), '^[^。.！!？?]*[。.！!？?]')) AS mark, strpos(substr(text, mid + 1), ' ') AS blank FROM sizes),
cuts AS (SELECT *, CASE WHEN n < 200 THEN n WHEN para > 0 AND mid + para - 1 < 0.8::DOUBLE * n THEN mid + para - 1 WHEN mark > 0 THEN mid + mark WHEN blank > 0 THEN mid + blank - 1 ELSE mid END AS cut_at FROM marks),
halved AS (SELECT doc_id, {TRIM.format("substr(text, 1, cut_at)")} AS first_half, {TRIM.format("substr(text, cut_at + 1)")} AS second_half FROM cuts)"""


ORACLE_SQL["B3_repair_letter_spacing"] = rf"""WITH spaced AS (SELECT doc_id AS key, regexp_replace(regexp_replace("text"[1:40], '([A-Za-z])([A-Za-z])', '\1 \2', 'g'), '([A-Za-z])([A-Za-z])', '\1 \2', 'g') || chr(10) || "text" AS text FROM documents WHERE "text" IS NOT NULL), {REPAIR_SQL} SELECT key AS doc_id, text FROM repaired"""
ORACLE_SQL["B7_merge_lines"] = f"WITH {REPAIRED_SQL} SELECT doc_id, page, block, text FROM merged WHERE NOT is_table"
_last = lambda m: f"CASE WHEN strpos(reverse(cut), {m}) > 0 THEN length(cut) - strpos(reverse(cut), {m}) + 1 ELSE 0 END"
ORACLE_SQL["B9_assemble_document"] = rf"""WITH {REPAIRED_SQL}, joined AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page, block) AS t FROM merged WHERE NOT is_table GROUP BY doc_id),
tidy AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[ \t]{{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '(?m)^[ \t]+', '', 'g'), '(?m)[ \t]+$', '', 'g') AS whole FROM joined),
cuts AS (SELECT *, whole[1:{B.LIMIT}] AS cut FROM tidy), ends AS (SELECT *, greatest({', '.join(_last(m) for m in ("chr(10)", "'。'", "'.'", "' '"))}) AS last FROM cuts)
SELECT doc_id, regexp_replace(CASE WHEN length(whole) > {B.LIMIT} AND last - 1 > 0.7 * {B.LIMIT} THEN cut[1:last] ELSE cut END, '^\s+|\s+\z', '', 'g') AS text, length(whole) > {B.LIMIT} AS truncated FROM ends"""
ORACLE_SQL["B10_cleaning_stats"] = rf"""WITH {BLOCKS_SQL}, {MERGED_SQL}, per AS (SELECT doc_id, sum(CASE WHEN is_table THEN n_lines ELSE len(string_split(text, chr(10))) END) AS kept, count_if(is_table) AS table_blocks FROM merged GROUP BY doc_id)
SELECT doc_id, length(raw_text)::INT AS original_length, (len(string_split(replace(regexp_replace(raw_text, '\r\n?', chr(10), 'g'), chr(12), chr(10)), chr(10))) - coalesce(kept, 0))::BIGINT AS lines_removed, coalesce(table_blocks, 0)::BIGINT AS table_blocks FROM raw LEFT JOIN per USING (doc_id)"""
ORACLE_SQL["B11_segment_blocks"] = f"""WITH RECURSIVE {REPAIRED_SQL}, shown AS (SELECT doc_id, page, block, length(CASE WHEN is_table THEN whole ELSE text END) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY page, block) AS i FROM merged WHERE is_table OR NOT {_m(X.REFERENCE_INDEX, 'text')}),
filled AS (SELECT doc_id, i, n AS total, 1 AS segment FROM shown WHERE i = 1 UNION ALL SELECT s.doc_id, s.i, CASE WHEN total = 0 OR total + n <= 2200 THEN total + n ELSE n END, CASE WHEN total = 0 OR total + n <= 2200 THEN segment ELSE segment + 1 END FROM filled f JOIN shown s ON s.doc_id = f.doc_id AND s.i = f.i + 1)
SELECT doc_id, page, block, segment FROM filled JOIN shown USING (doc_id, i)"""
ORACLE_SQL["B12_sentence_bounds"] = r"""WITH p AS (SELECT doc_id, list_filter(regexp_extract_all("text", '[^.!?。！？…\n]*(?:[.!?。！？…]+|\n|\z)'), lambda x: x <> '') AS ps FROM documents WHERE "text" IS NOT NULL), r AS (SELECT doc_id, generate_subscripts(ps, 1) AS i, unnest(ps) AS p FROM p), e AS (SELECT *, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM r)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i)::INT AS sentence, (e - length(p))::INT AS start, e::INT AS "end" FROM e WHERE trim(replace(p, chr(10), '')) <> ''"""
ORACLE_SQL["C11_split_midpoint"] = f'WITH source_texts AS (SELECT doc_id, "text" AS text FROM documents WHERE "text" IS NOT NULL), {midpoint_sql("source_texts")} SELECT * FROM halved'
