"""Streaming versions of scoring, request reuse, job status and stalls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.responses import response_key
from ..operators.scoring_v1 import score_documents


def stream_scores(docs: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, tasks: int | None = None) -> StreamingQuery:
    """Scores of documents as they come. Scoring is stateless; each micro-batch goes to sink with its number,
    by which a sink can write exactly once: a batch that is run again has the same number. All that is
    there is taken, then the query ends. tasks: over how many a batch is dealt before it is scored, as a file of one
    row group is read by one task (default: as many as shuffles have)."""
    dealt = docs.repartition(tasks or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return score_documents(dealt).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batch_folder(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps each micro-batch in a folder of its number: a batch that comes again replaces itself."""
    return lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")


def dedupe_requests(requests: DataFrame, ttl: int = 300, late: str = "10 seconds") -> DataFrame:
    """key, request_id and ts of the requests that are let through: the first of its key, and then the first
    that comes more than ttl seconds after the last one let through.

    A key's state is the time of the last request let through; it goes when the watermark has passed its time
    to live, so the state holds only keys of the last ttl seconds. Requests of a micro-batch are taken in
    order of (ts, request_id). One that comes after a later one was let through, is dropped; so are
    those that are later than the watermark allows."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        none = pd.DataFrame({"key": [], "request_id": [], "ts": []})
        if state.hasTimedOut:
            state.remove()
            yield none
            return
        rows = pd.concat(frames).sort_values(["ts", "request_id"], ignore_index=True)
        at = rows["ts"].to_numpy("datetime64[us]").astype("int64")
        last = state.get[0] if state.exists else None
        through = []
        i = 0 if last is None else int(at.searchsorted(last + ttl * 1_000_000, "right"))
        while i < len(at):  # as many steps as rows let through
            through.append(i)
            last = int(at[i])
            i = int(at.searchsorted(last + ttl * 1_000_000, "right"))
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + 1 + ttl * 1000, state.getCurrentWatermarkMs() + 1))
        yield rows.loc[through, ["request_id", "ts"]].assign(key=key[0])[["key", "request_id", "ts"]] if through else none

    rows = response_key(requests).withWatermark("ts", late).select("key", "request_id", "ts")
    return rows.groupBy("key").applyInPandasWithState(step, "key string, request_id long, ts timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def latest_status(events: DataFrame) -> DataFrame:
    """The latest patch per job, for output mode `update` or `complete`."""
    return events.groupBy("job_id").agg(F.max_by(F.struct("status", "stage", "progress"), F.struct("ts", "event_id")).alias("s"), F.max("ts").alias("ts")).select("job_id", "ts", "s.status", "s.stage", "s.progress")


def stalled(events: DataFrame, seconds: int = 8, late: str = "10 seconds") -> DataFrame:
    """Jobs that run and say nothing for seconds of event time. A job's state is its last update; a gap is
    told by the next update, or by the watermark passing the time-out."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            last, running = state.get
            if running:
                out.append((key[0], pd.Timestamp(last, unit="us")))
            state.remove()
        else:
            last, running = state.get if state.exists else (None, False)
            rows = pd.concat(frames).sort_values(["ts", "event_id"])
            for t, s in zip(rows["ts"], rows["status"], strict=True):
                now = t.value // 1000
                if last is not None and now < last:
                    continue
                if running and now - last > seconds * 1_000_000:
                    out.append((key[0], pd.Timestamp(last, unit="us")))
                last, running = now, s == "running"
            state.update((last, running))
            state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["job_id", "stalled_after"])

    rows = events.withWatermark("ts", late).select("job_id", "ts", "event_id", "status")
    return rows.groupBy("job_id").applyInPandasWithState(step, "job_id long, stalled_after timestamp", "last long, running boolean", "append", GroupStateTimeout.EventTimeTimeout)


def windowed(scores: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Windows of risk; rows later than `late` are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = scores.withWatermark("ts", late).groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.avg("risk").alias("mean_risk"), F.max("risk").alias("max_risk"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean_risk", "max_risk")


def session_windows(scores: DataFrame, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a key: rows less than gap apart. A session is told when the watermark passes its end."""
    w = F.session_window("ts", gap).alias("w")
    out = scores.withWatermark("ts", late).groupBy(key, w).agg(F.count("*").alias("n"), F.max("risk").alias("max_risk"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "max_risk")


def dropped_late(query: StreamingQuery) -> int:
    """What stateful operators of a query have dropped as later than the watermark: rows, or for windows the
    groups of rows that a task had already summed."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Take all that is there into an in-memory table; for small results and tests."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
