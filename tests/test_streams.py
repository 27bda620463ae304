"""Streams over several files: late rows, restarts, batches that come twice."""

import os
import tempfile
from datetime import datetime, timedelta

import pyarrow.parquet as pq

from claimloom.streaming import jobs

START = datetime(2024, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


class Files:
    """A folder of Parquet files that a stream reads one by one, in the order in which they were added."""

    def __init__(self, spark, schema):
        self.spark, self.schema, self.path, self.n = spark, schema, tempfile.mkdtemp(dir="/tmp"), 0
        self.out, self.mark = (tempfile.mkdtemp(dir="/tmp") for _ in range(2))

    def add(self, rows):
        made = f"{self.path}/f{self.n}.parquet"
        pq.write_table(self.spark.createDataFrame(rows, self.schema).toArrow(), made)
        os.utime(made, (1_700_000_000 + self.n,) * 2)
        self.n += 1

    def run(self, job, mode="append"):
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.path)
        made = job(stream)
        q = made.writeStream.format("parquet").option("path", self.out).option("checkpointLocation", self.mark).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return self.spark.read.schema(made.schema).parquet(self.out), q


REQUESTS = "request_id long, ts timestamp, text string, context_type string, sector string, provider string, model string"


def request(i, seconds, text="a"):
    return (i, at(seconds), text, "c", "s", "p", "m")


def through(rows, ttl=300):
    last, out = {}, set()
    for i, t, text, *_ in sorted(rows, key=lambda r: (r[1], r[0])):
        if text not in last or t > last[text] + timedelta(seconds=ttl):
            last[text] = t
            out.add(i)
    return out


def test_requests_are_let_through_again_after_their_time(spark):
    """Exactly ttl is still too soon; the time counts from the last one let through, not from the last seen."""
    rows = [request(1, 0), request(2, 299), request(3, 300), request(4, 300.001), request(5, 600), request(6, 601), request(7, 0, "b"), request(8, 0, "b"), request(9, 2000, "b")]
    files = Files(spark, REQUESTS)
    files.add(rows)
    got, _ = files.run(jobs.dedupe_requests)
    assert {r.request_id for r in got.collect()} == through(rows) == {1, 4, 6, 7, 9}


def test_state_outlives_batches_and_restarts(spark):
    """The same requests file by file, with a restart after each half, give what one batch gives."""
    rows = [request(i, 37 * i, "ab"[i % 2]) for i in range(120)]
    files = Files(spark, REQUESTS)
    for half in (rows[:60], rows[60:]):
        for a in range(0, 60, 15):
            files.add(half[a : a + 15])
        got, _ = files.run(jobs.dedupe_requests)
    assert sorted(r.request_id for r in got.collect()) == sorted(through(rows))


def test_late_and_early_requests(spark):
    """A request before one that was let through is dropped; so is one later than the watermark of the batch
    before the last allows (Spark tells late rows by that one)."""
    files = Files(spark, REQUESTS)
    files.add([request(1, 1000)])
    files.add([request(4, 5000)])
    files.add([request(2, 995), request(3, 400, "b")])
    files.add([request(5, 4985, "c"), request(6, 4995, "d"), request(7, 5400)])
    got, q = files.run(jobs.dedupe_requests)
    assert {r.request_id for r in got.collect()} == {1, 4, 6, 7} and jobs.dropped_late(q) == 2


RISKS = "user_id long, ts timestamp, risk double"


def test_windows_that_the_watermark_has_passed(spark):
    files = Files(spark, RISKS)
    files.add([(1, at(60 * m), float(m)) for m in (0, 10, 50, 130)])
    files.add([(2, at(60 * 125), 7.0)])
    files.add([(1, at(60 * 55), 99.0), (1, at(60 * 200), 1.0)])  # 55 minutes: later than 130 - 10 allows
    for job, want in (
        (lambda s: jobs.windowed(s), {(0, 60, 3, 50.0), (120, 180, 2, 130.0)}),
        (lambda s: jobs.windowed(s, "2 hours", "1 hour"), {(-60, 60, 3, 50.0), (0, 120, 3, 50.0), (60, 180, 2, 130.0)}),
        (lambda s: jobs.session_windows(s, "user_id"), {(0, 40, 2, 10.0), (50, 80, 1, 50.0), (130, 160, 1, 130.0), (125, 155, 1, 7.0)}),
    ):
        files.out, files.mark = (tempfile.mkdtemp(dir="/tmp") for _ in range(2))
        got, q = files.run(job)
        minutes = lambda t: round((t - START).total_seconds() / 60)
        assert {(minutes(r.start), minutes(r.end), r.n, r.max_risk) for r in got.collect()} == want
        assert jobs.dropped_late(q) >= 1


def test_a_batch_that_comes_again_replaces_itself(spark):
    out = tempfile.mkdtemp(dir="/tmp")
    sink = jobs.batch_folder(out)
    df = spark.range(5)
    for n in (0, 1, 1, 0):
        sink(df, n)
    assert spark.read.option("recursiveFileLookup", True).schema("id long").parquet(out).count() == 10
