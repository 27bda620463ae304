"""Golden rows: texts with known results."""

import pytest
from pyspark.sql import functions as F

from claimloom.operators import certificates as H
from claimloom.operators import cleaning as B
from claimloom.operators import consistency as I
from claimloom.operators import evidence as O
from claimloom.operators import extraction as E
from claimloom.operators import features as D
from claimloom.operators import history as Q
from claimloom.operators import responses as W
from claimloom.operators import risk as J
from claimloom.operators import scoring_v1 as S
from claimloom.operators import sentiment as K
from claimloom.operators import structure as G
from claimloom.plans.claims_v2 import analyzed, run_pipeline
from claimloom.sources import tables as A


def docs(spark, *texts, **more):
    rows = [(i, t, *[v[i] for v in more.values()]) for i, t in enumerate(texts)]
    kinds = "".join(f", {k} string" for k in more)
    return spark.createDataFrame(rows, f"doc_id long, text string{kinds}")


def claims(spark, *texts):
    rows = [(1, i + 1, f"C{i + 1}", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, ord int, claim_id string, text string")


def scored(spark, text, context, sector):
    return S.score_documents(docs(spark, text, context=[context], sector=[sector])).first()


def test_promise_without_proof_is_risky(spark):
    r = scored(spark, "我们承诺到2030年实现碳中和，打造更绿色的未来。", "marketing", "general")
    assert r["mode"] == "green-claim-risk" and r["risk"] >= 75


def test_measured_and_proven_is_not(spark):
    text = "In 2024, we reduced Scope 1 and 2 carbon emissions by 27% against a 2020 baseline, verified by third-party assurance under GRI methodology for climate reporting."
    assert scored(spark, text, "report", "general")["risk"] < 28


@pytest.mark.parametrize("text", ["This quarter our customer support satisfaction improved and calls were shorter than before in most regions.", "Green eco future promise"])
def test_no_claim_has_the_base_risk(spark, text):
    r = scored(spark, text, "marketing", "general")
    assert (r["mode"], r["risk"]) == ("non-green-claim-baseline", 8)


def test_blank_text_is_empty(spark):
    r = scored(spark, " \n ", "marketing", "general")
    assert (r["mode"], r["risk"], r["claim_prob"]) == ("empty", 0, 0)


def test_normalize(spark):
    assert docs(spark, "  hello   world\r\nfoo \n\n\n\nbar  ").select(B.normalize(F.col("text"))).first()[0] == "hello world\nfoo\n\nbar"


def test_letter_spacing(spark):
    cases = {"E t h i c a l  t r a d e and E S G governance": "Ethical  trade and ESG governance", "a b": "a b", "plan A B C.": "plan ABC.", "中 文 字": "中文字", "I am a b": "I am a b"}
    got = [r[0] for r in docs(spark, *cases).orderBy("doc_id").select(B.repair_letter_spacing(F.col("text"))).collect()]
    assert got == list(cases.values())


def test_blocks_of_a_page(spark):
    raw = "A first line that\ncontinues here.\n\nSecond para-\ngraph.\nName  1  2  3\n\nOther  4  5  6\n-\nafter the table\fNext page. Read more on pages 52-53 of it"
    pages = B.split_pages(spark.createDataFrame([(1, raw)], "doc_id long, raw_text string"))
    blocks = B.flag_reference_index(B.build_blocks(B.tag_table_rows(B.split_lines(pages)))).orderBy("page", "block").collect()
    assert [(b.page, b.type, b.text, b.rows, b.hidden) for b in blocks] == [
        (1, "paragraph", "A first line that continues here.", None, False),
        (1, "paragraph", "Second paragraph.", None, False),
        (1, "table", None, ["Name  1  2  3", "Other  4  5  6"], False),
        (1, "paragraph", "after the table", None, False),
        (2, "paragraph", "Next page. Read more on pages 52-53 of it", None, True),
    ]


def test_assembled_documents_are_cut_at_a_break(spark):
    rows = spark.createDataFrame([(1, 1, 1, "paragraph", "word " * 30), (1, 2, 1, "paragraph", "x" * 40)], "doc_id long, page int, block int, type string, text string")
    r = B.assemble_documents(rows, 160).first()
    assert r.truncated and r.text == ("word " * 30).strip()


def test_segments_fill_up(spark):
    rows = [(1, 1, i, "x" * n) for i, n in enumerate([1000, 1000, 500, 3000, 10])]
    blocks = spark.createDataFrame(rows, "doc_id long, page int, block int, text string").withColumns({"rows": F.lit(None).cast("array<string>"), "hidden": F.lit(False)})
    assert [r.segment for r in B.segment_blocks(blocks).orderBy("block").collect()] == [1, 1, 2, 3, 4]


def test_sentence_bounds(spark):
    got = B.sentence_bounds(docs(spark, "One. Two?!\nThree")).orderBy("sentence").collect()
    assert [(r.start, r.end) for r in got] == [(0, 4), (4, 10), (11, 16)]


def test_extracted_claims(spark):
    rows = docs(spark, "First sentence. Second sentence.\n\nNew paragraph here. Another one.", "Ok. Real sentence with content here.", "")
    got = E.extract_claims(rows).orderBy("doc_id", "ord").collect()
    assert [(r.doc_id, r.claim_id, r.paragraph) for r in got] == [(0, "L0-001", 0), (0, "L0-002", 0), (0, "L0-003", 1), (0, "L0-004", 1), (1, "L0-001", 0)]
    profile = {r.doc_id: (r.paragraphs, r.claims) for r in E.document_profile(rows).collect()}
    assert profile == {0: (2, 4), 1: (1, 1), 2: (0, 0)}


def test_midpoint(spark):
    long = "a" * 120 + "\n\n" + "b" * 100
    sentence = "a" * 150 + ". " + "b" * 140
    got = {r.doc_id: (len(r.first_half), len(r.second_half)) for r in E.split_midpoint(docs(spark, "short", long, sentence, "c" * 300)).collect()}
    assert got == {0: (5, 0), 1: (120, 100), 2: (151, 140), 3: (150, 150)}


def test_structure(spark):
    r = G.structure(claims(spark, "Scope 1 and Scope 2 emissions reduced by 33% vs 2017 baseline by 2030.", "We will reach net zero by 2030.", "down vs 1999")).orderBy("ord").collect()
    assert (r[0].metric_value, r[0].metric_unit, r[0].ghg_scope, r[0].baseline_year, r[0].target_year, r[0].confidence) == (33.0, "%", [1, 2], 2017, 2030, 0.4)
    assert r[1].claim_type == "commitment" and r[2].baseline_year == 2099


def test_certificates(spark):
    rows = H.with_signals(H.with_certificates(claims(spark, "Reported per GRI Standards and verified to ISAE 3000 by KPMG; SBTi-aligned target.", "Our packaging is certified sustainable.", "Certified by FSC under the FSC Chain of Custody standard.", "通过SBTi认证"))).orderBy("ord").collect()
    assert set(rows[0].certs) == {"gri", "isae_3000", "sbti"} and rows[3].certs == ["sbti"]
    assert [s.signal for s in rows[1].signals] == ["vague_certification_claim"]
    assert rows[2].certs == ["fsc"] and rows[2].signals == []


def wide(spark, *texts):
    return analyzed(claims(spark, *texts))


def test_numeric_contradiction_is_symmetric(spark):
    for texts in (["Scope 1 fell 33%", "Scope 1 fell 50%"], ["Scope 1 fell 50%", "Scope 1 fell 33%"]):
        r = I.numeric_contradictions(wide(spark, *texts)).collect()
        assert [(x.severity, x.claim_a, x.claim_b) for x in r] == [("high", "C1", "C2")]


def test_component_risks(spark):
    edges = spark.createDataFrame([(1, "high", "C1", "C2"), (1, "medium", "C3", "C1"), (1, "high", "C2", "C3")], "doc_id long, severity string, claim_a string, claim_b string")
    own = J.consistency_risk(claims(spark, "a", "b", "c"), edges)
    assert {r.claim_id: r.consistency_risk for r in own.collect()} == {"C1": 45.0, "C2": 60.0, "C3": 45.0}
    four = spark.createDataFrame([(1, "C1", 50.0, 50.0, 50.0, 50.0), (2, "C2", 100.0, 0.0, 0.0, 0.0)], "doc_id long, claim_id string, text_risk double, evidence_risk double, external_risk double, consistency_risk double")
    assert {r.claim_id: r.claim_risk for r in J.claim_risk(four).collect()} == {"C1": 50.0, "C2": 30.0}


@pytest.mark.parametrize(("score", "level"), [(0, 0), (25, 0), (26, 1), (50, 1), (51, 2), (75, 2), (76, 3), (100, 3)])
def test_levels(spark, score, level):
    from claimloom.functions.fixed import LEVELS
    from claimloom.functions.semantics import level as at

    assert spark.range(1).select(at(F.lit(score))).first()[0] == LEVELS[level]


def test_bad_text_scores_above_clean(spark):
    bad = "Our eco-friendly green products are carbon neutral and best in class, a greener sustainable future for our children."
    clean = "We reduced Scope 1 and Scope 2 emissions by 33% vs 2017 baseline, verified to ISO 14064 under the GHG Protocol."
    risks = [run_pipeline(claims(spark, t), "comprehensive")["document_risk"].first().gri for t in (bad, clean)]
    assert risks[0] > risks[1]


def test_modes_build_what_they_ask_for(spark):
    own = claims(spark, "We aim to be green.", " ")
    assert list(run_pipeline(own, "nonsense")) == ["features"] and list(run_pipeline(own, "standard")) == ["features", "structure"]
    assert run_pipeline(own)["features"].count() == 1


def test_scores_stay_within_bounds(spark):
    rows = J.claim_risk(J.consistency_risk(J.external_risk(J.evidence_risk(J.text_risk(wide(spark, "", "绿色" * 50, "100% net zero guilt-free", "a" * 5000)))), spark.createDataFrame([], "doc_id long, severity string, claim_a string, claim_b string")))
    assert all(0 <= r[c] <= 100 for r in rows.collect() for c in ("text_risk", "evidence_risk", "external_risk", "consistency_risk", "claim_risk"))


def test_word_mode_of_the_lexicon(spark):
    own = claims(spark, "this claim aims", "we aim high")
    terms = {"vague": ["aim"]}
    assert D.match_lexicon(own, terms).count() == 2
    assert [r.claim_id for r in D.match_lexicon(own, terms, mode="word").collect()] == ["C2"]


def test_fused_emotion(spark):
    rows = spark.createDataFrame([(9, None, None, None, False, 50.0), (9, None, None, None, False, None)], "rule_emotional int, nlp_score double, nlp_sentiment string, nlp_specificity double, nlp_ok boolean, model_score double")
    got = K.fuse_emotion(rows).collect()
    assert (got[0].fused_score, got[0].layers) == (43.0, 2) and (got[1].fused_score, got[1].layers, got[1].consistency) == (30.0, 1, 0.0)


def test_model_answers(spark):
    raws = ['{"summary": "a"}', '```json\n{"summary": "b"}\n```', 'Well: {"summary": "c", "annotations": ["x",],} // done', "nothing", None, 'See [1], {"summary": "{d} // e"} and {f}', '{"summary": "http://x,]", /* y */ "annotations": ["z",], // "v"\n}']
    rows = spark.createDataFrame(list(enumerate(raws)), "i int, raw string")
    got = W.parse_answers(rows).orderBy("i").collect()
    assert [g.answer.summary if g.answer else None for g in got] == ["a", "b", "c", None, None, "{d} // e", "http://x,]"]
    assert [g.attempt for g in got] == [0, 1, 3, None, None, 2, 3]


def test_verdicts(spark):
    raws = ['[{"verdict": "contradicted"}]', "{}", "no"]
    got = O.normalize_verdicts(spark.createDataFrame(list(enumerate(raws)), "i int, raw string")).orderBy("i").collect()
    assert [(g.verdict, g.confidence, g.evidence_risk_score) for g in got] == [("contradicted", 0.5, 50.0), ("insufficient_evidence", 0.5, 50.0), ("insufficient_evidence", 0.2, 60.0)]


def test_report(spark):
    rows = spark.createDataFrame([(1, "C1", "supported", 20.0, 10.0), (1, "C2", "contradicted", 40.0, 45.0)], "doc_id long, claim_id string, verdict string, text_risk_score double, evidence_risk_score double")
    r = O.evidence_report(rows).first()
    assert (r.text_risk_score, r.evidence_risk_score, r.risk_level) == (30.0, 27.5, "中低风险")


def test_file_names(spark):
    rows = spark.createDataFrame([("Acme_Corp-2023_ESG.pdf",), ("20230101.pdf",), ("",), (None,)], "path string")
    got = A.filename_metadata(rows).collect()
    assert [(g.company, g.year, g.confidence) for g in got] == [("Acme Corp", 2023, 0.4), ("20230101", None, 0.4), (None, None, 0.0), (None, None, 0.0)]


def test_files_and_old_histories(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"junk%PDF-1.4 text")
    (tmp_path / "b.pdf").write_bytes(b"no mark")
    got = {r.path.rsplit("/", 1)[1]: (r.is_pdf, r.reason) for r in A.inventory_pdfs(A.read_files(spark, str(tmp_path), "*.pdf")).collect()}
    assert got == {"a.pdf": (True, None), "b.pdf": (False, "not_pdf")}
    none = spark.createDataFrame([("c.pdf", 0, b"")], "path string, length long, content binary")
    assert A.inventory_pdfs(none).first().reason == "empty"
    (tmp_path / "old.json").write_text('[{"id": "1", "createdAt": "2024-01-02T03:04:05Z", "text": "t"}, {"sector": "energy"}]')
    old = A.read_legacy_history(spark, str(tmp_path / "old.json")).orderBy("created_at").collect()
    assert [(r.sector, r.context_type, r.request_text) for r in old] == [("energy", "auto", ""), ("auto", "auto", "t")] and old[0].id
    (tmp_path / "dump.txt").write_text("page one\x00\fpage two")
    assert A.read_page_text(spark, str(tmp_path / "dump.txt")).first().raw_text == "page one\fpage two"
    (tmp_path / "lexicon.json").write_text('{"category": "green", "ord": 1, "term": "leaf"}')
    assert A.read_lexicon(spark, str(tmp_path / "lexicon.json")) == {"green": ["leaf"]}
    with pytest.raises(ValueError, match="no terms"):
        (tmp_path / "none.json").write_text("{}")
        A.read_lexicon(spark, str(tmp_path / "none.json"))


def test_history_limits(spark):
    assert (Q.bounded(None, 30, 1000), Q.bounded(0, 30, 1000), Q.bounded(5000, 30, 1000)) == (30, 1, 1000)


def test_stream_of_stalls_agrees_with_its_twin(spark):
    from compare import DATA

    from claimloom.plans import records as P

    sf = f"{DATA}/sf0.001"
    twin = {(r.job_id, r.stalled_after) for r in P.q11(spark, sf).collect()}
    told = {(r.job_id, r.stalled_after) for r in P.q11s(spark, sf).collect()}
    assert twin <= told  # the stream also tells jobs that stay silent to the end


def test_joins_with_a_missing_side(spark):
    """Model metadata and text scores are joined whole in the queries; here some rows have none."""
    from claimloom.operators.evidence import attach_text_risk
    from claimloom.sources.tables import metadata_merge

    own = spark.createDataFrame([(1, "Acme", 2020, "esg_report", 0.4), (2, None, None, "esg_report", 0.4)], "doc_id long, company string, year int, report_type string, confidence double")
    model = spark.createDataFrame([(2, " Corp ", 2021, "annual_report", 0.9, True)], "doc_id long, m_company string, m_year int, m_report_type string, m_confidence double, m_present boolean")
    got = {r.doc_id: (r.company, r.source) for r in metadata_merge(own, model, "doc_id").collect()}
    assert got == {1: ("Acme", "filename"), 2: ("Corp", "llm")}
    claims = spark.createDataFrame([(1, "C1"), (2, "C1")], "doc_id long, claim_id string")
    index = spark.createDataFrame([(2, 60.0, "x")], "doc_id long, tgri double, risk_level string")
    got = {r.doc_id: (r.text_risk_score, r.text_risk_level) for r in attach_text_risk(claims, index).collect()}
    assert got[1] == (0.0, "unknown") and got[2][0] == 60.0


def test_company_history_conflicts_finds_every_different_target(spark):
    from claimloom.operators.planned import company_history_conflicts

    claims = spark.createDataFrame([(1, 2030, None), (1, 2040, 10.0), (2, 2030, 10.2), (2, 2045, 30.0), (3, None, None)], "doc_id long, target_year int, metric_value double").selectExpr("*", "cast(null as array<int>) ghg_scope", "'t' metric_unit")
    meta = spark.createDataFrame([(1, "X", 2020), (2, "X", 2021), (3, "X", 2022)], "doc_id long, company string, year int")
    got = sorted((r.type, r.value_a, r.value_b, r.severity) for r in company_history_conflicts(claims, meta).collect())
    assert got == [("numeric_metric_mismatch", 10.0, 30.0, "high"), *[("target_year_mismatch", a, b, "medium") for a, b in ((2030.0, 2045.0), (2040.0, 2030.0), (2040.0, 2045.0))]]


def test_trend_across_days_and_nulls(spark):
    rows = spark.sql("""SELECT * FROM VALUES (1, timestamp'2024-01-01 10:00', 'a', '{"risk": 1}'), (2, timestamp'2024-01-02 10:00', 'a', '{"risk": 2}'), (3, timestamp'2024-01-05 10:00', 'a', '{"risk": 9}'), (4, null, 'a', '{"risk": 4}'), (5, null, null, 'x') AS t(id, created_at, sector, result_json)""")
    assert [r.sma for r in Q.risk_trend(rows).orderBy("id").collect()] == [2, 4, 6, 3, None]


def test_vectors_in_small_blocks(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 1.0]), (4, None)], "vec_id long, embedding array<double>")
    q = v.selectExpr("vec_id AS query_id", "embedding")
    got = {n: [tuple(r) for r in O.retrieve_vectors(v, q, 1, n, n).select("query_id", "vec_id").orderBy("query_id").collect()] for n in (1, 100)}
    assert got[1] == got[100] == [(1, 2), (2, 1), (3, 2)]
    assert O.retrieve_vectors(v.limit(0), q.limit(0)).count() == 0
