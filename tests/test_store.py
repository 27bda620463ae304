"""The stored history and the files of reports and feedback."""

import glob
import json
import tempfile

import pytest
from pyspark.sql import functions as F

from claimloom.operators import evidence as O
from claimloom.operators import history as Q
from claimloom.sources import tables as A
from claimloom.sources.history_store import HistoryStore

SCHEMA = "id long, created_at timestamp, sector string, feedback_json string, feedback_at timestamp"


def rows(spark, *some):
    df = spark.createDataFrame([(i, t, s) for i, t, s in some], "id long, t string, sector string")
    return df.select("id", F.col("t").cast("timestamp").alias("created_at"), "sector", F.lit(None).cast("string").alias("feedback_json"), F.lit(None).cast("timestamp").alias("feedback_at"))


@pytest.fixture
def store(spark):
    s = HistoryStore(spark, tempfile.mkdtemp(dir="/tmp"), SCHEMA)
    s.upsert(rows(spark, (1, "2024-01-05", "a"), (2, "2024-01-20", "b"), (3, "2024-02-01", "c"), (4, "2024-03-01", "d"), (5, None, "e")))
    return s


def content(df):
    return {(r.id, str(r.created_at)[:10], r.sector) for r in df.collect()}


def files(store):
    return {f: open(f, "rb").read() for f in glob.glob(f"{store.path}/data/*/*/*.parquet")}


def test_only_touched_months_are_written(spark, store):
    before, folders = store.months(), files(store)
    assert store.upsert(rows(spark, (2, "2024-01-21", "B"), (6, "2024-01-02", "f"))) == {"2024-01"}
    after = store.months()
    assert {m for m in after if after[m] != before[m]} == {"2024-01"} and set(after) == {"2024-01", "2024-02", "2024-03", "none"}
    assert {f: b for f, b in files(store).items() if f in folders} == folders  # no old file is changed
    assert content(store.read()) == {(1, "2024-01-05", "a"), (2, "2024-01-21", "B"), (6, "2024-01-02", "f"), (3, "2024-02-01", "c"), (4, "2024-03-01", "d"), (5, "None", "e")}
    assert content(store.read(["2024-02"])) == {(3, "2024-02-01", "c")}
    assert content(store.read(version=1)) == {(1, "2024-01-05", "a"), (2, "2024-01-20", "b"), (3, "2024-02-01", "c"), (4, "2024-03-01", "d"), (5, "None", "e")}


def test_a_row_may_move_to_another_month(spark, store):
    assert store.upsert(rows(spark, (1, "2024-03-09", "A"), (3, "2023-12-31", "old"))) == {"2023-12", "2024-01", "2024-02", "2024-03"}
    assert content(store.read()) == {(1, "2024-03-09", "A"), (2, "2024-01-20", "b"), (3, "2024-02-01", "c"), (4, "2024-03-01", "d"), (5, "None", "e")}  # the newest wins
    assert "2023-12" not in store.months()


def test_changes_give_what_the_operators_give(spark, store):
    """A chain of random changes beside the same operators on a plain table."""
    plain = spark.createDataFrame(store.read().collect(), SCHEMA)
    for step in range(4):
        new = rows(spark, *[((7 * step + 3 * i) % 11, f"2024-0{1 + (i + step) % 5}-1{i % 9}", f"s{step}{i}") for i in range(6)]).dropDuplicates(["id"])
        new = spark.createDataFrame(new.collect(), SCHEMA)
        store.upsert(new)
        plain = spark.createDataFrame(Q.upsert_history(plain, new).collect(), SCHEMA)
        gone = spark.createDataFrame([(step,), (99,)], "id long")
        store.delete(gone)
        plain = spark.createDataFrame(Q.delete_history(plain, gone).collect(), SCHEMA)
    assert content(store.read()) == content(plain)


def test_retention_drops_months_and_writes_one(spark, store):
    before = store.months()
    assert store.retain("2024-02-01") == {"2024-01"}
    assert content(store.read()) == {(3, "2024-02-01", "c"), (4, "2024-03-01", "d"), (5, "None", "e")}
    assert store.months()["2024-03"] == before["2024-03"] and store.months()["2024-02"] != before["2024-02"]
    assert store.retain("2024-02-15") == set() and "2024-02" not in store.months()


def test_feedback_goes_to_its_rows(spark, store):
    told = spark.createDataFrame([(1, '{"x": 1}', "2024-05-01"), (1, '{"x": 2}', "2024-05-02"), (3, "[1]", "2024-05-01"), (77, "{}", "2024-05-01")], "id long, feedback_json string, t string").withColumn("feedback_at", F.col("t").cast("timestamp")).drop("t")
    touched, rejects = store.attach_feedback(told)
    assert touched == {"2024-01", "2024-02"} and {(r.id, r.reason) for r in rejects.collect()} == {(3, "not_an_object"), (77, "unknown_id")}
    store.attach_feedback(told.filter("id = 3").withColumn("feedback_json", F.lit("{}")))
    assert {(r.id, r.feedback_json) for r in store.read().filter("feedback_json IS NOT NULL").collect()} == {(1, '{"x": 2}'), (3, "{}")}


@pytest.mark.filterwarnings("ignore")
def test_a_writer_that_dies_leaves_the_old_version(spark, store):
    before = content(store.read())
    dies = rows(spark, (1, "2024-01-06", "x"), (9, "2024-02-02", "y")).withColumn("sector", F.when(F.col("id") == 9, F.raise_error("dead")).otherwise(F.col("sector")))
    with pytest.raises(Exception, match="dead"):
        store.upsert(dies)
    assert store.versions() == [1] and content(store.read()) == before
    # one that dies between its rows and its version
    keep, HistoryStore._commit = HistoryStore._commit, lambda *a: (_ for _ in ()).throw(OSError("dead"))
    try:
        with pytest.raises(OSError):
            store.delete(store.read().filter("id < 3"))
    finally:
        HistoryStore._commit = keep
    assert content(store.read()) == before
    # a version without its mark isn't seen
    spark.createDataFrame([("2024-01", "nowhere")], "month string, path string").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", False).parquet(f"{store.path}/versions/2")
    assert store.versions() == [1] and content(store.read()) == before
    store.delete(spark.createDataFrame([(4,)], "id long"))
    assert store.versions() == [1, 3] and content(store.read()) == {x for x in before if x[0] != 4}


def test_vacuum_keeps_what_is_read(spark, store):
    for i in range(4):
        store.upsert(rows(spark, (1, f"2024-01-1{i}", f"v{i}")))
    gone = store.vacuum(keep=2)
    assert len(gone) == 2 and store.versions() == [4, 5]
    assert content(store.read(["2024-01"])) == {(1, "2024-01-13", "v3"), (2, "2024-01-20", "b")} and content(store.read(version=4))
    assert content(store.newest(2)) == {(4, "2024-03-01", "d"), (3, "2024-02-01", "c")} and store.newest(50).count() == 5


def test_an_empty_store(spark):
    s = HistoryStore(spark, tempfile.mkdtemp(dir="/tmp"), SCHEMA)
    assert s.read().count() == 0 and s.delete(spark.createDataFrame([(1,)], "id long")) == set() and s.retain("2024-01-01") == set() and s.versions() == []


def test_reports_as_files(spark):
    v = spark.createDataFrame([(d, f"C{i}", f"claim \"{i}\" é" * 20, O.VERDICTS[(d + i) % 4], 0.5, float(10 * i), 40.0) for d in range(6) for i in range(7)], "doc_id long, claim_id string, text string, verdict string, confidence double, evidence_risk_score double, text_risk_score double")
    path = tempfile.mkdtemp(dir="/tmp") + "/reports"
    A.write_reports(O.full_reports(v), path, 1)
    made = glob.glob(f"{path}/part-*")
    assert len([f for f in made if open(f).read()]) == 6  # a file for each report
    got = {r["doc_id"]: r for r in (json.loads(open(f).read()) for f in made if open(f).read())}
    assert got[0]["total_claims"] == 7 and [c["claim_id"] for c in got[0]["top_claims"]] == ["C6", "C5", "C4", "C3", "C2"] and len(got[0]["top_claims"][0]["claim_text"]) == 150
    assert got[1]["scoring"]["distribution"] == {"supported": 1, "partially_supported": 2, "contradicted": 2, "insufficient_evidence": 2}
    assert got[1]["scoring"]["document_gri"] == 35.0 and got[1]["findings"][0].startswith("2 claims") and len(got[1]["claims"]) == 7
    back = A.read_reports(spark, path, O.REPORT).filter("doc_id = 1").first()
    assert back.scoring.text_risk_score == 40.0 and len(back.claims) == 7


def test_a_failed_export_leaves_nothing(spark):
    path = tempfile.mkdtemp(dir="/tmp") + "/lines"
    bad = spark.range(0, 1000, 1, 4).select("id", F.when(F.col("id") == 900, F.raise_error("dead")).otherwise("{}").alias("feedback_json"))
    with pytest.raises(Exception, match="dead"):
        A.write_feedback(bad, path)
    assert not glob.glob(f"{path}/**/*.json", recursive=True) and not glob.glob(f"{path}/_SUCCESS")


def test_feedback_lines_roll(spark):
    path = tempfile.mkdtemp(dir="/tmp") + "/lines"
    rows_ = spark.range(25).select("id", F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.when(F.col("id") % 2 == 0, "{}").alias("feedback_json"))
    A.write_feedback(Q.export_feedback(rows_), path, 5)
    assert sorted(len(open(f).readlines()) for f in glob.glob(f"{path}/part-*")) == [3, 5, 5]
    assert [r.id for r in spark.read.schema("id long").json(path).orderBy(F.desc("id")).collect()] == list(range(24, -1, -2))
