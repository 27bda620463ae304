"""The history of analyses, feedback on it, and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RETENTION_DAYS = 2 * 365
FEEDBACK = "reviewer string, overall string, per_claim array<struct<claim_id: string, correct: boolean, correct_sin: string, note: string>>, gri_override double, note string"


def bounded(limit: int | None, default: int, most: int) -> int:
    return max(1, min(most, default if limit is None else limit))


def upsert_history(history: DataFrame, new: DataFrame) -> DataFrame:
    """Rows replaced by id; the newest wins, and a new row over an old one of the same time."""
    rows = history.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("id").orderBy(F.desc("created_at"), F.desc("__new"))
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r", "__new")


def recent_history(history: DataFrame, limit: int | None = None) -> DataFrame:
    return history.orderBy(F.desc("created_at"), F.desc("id")).limit(bounded(limit, 30, 1000))


def export_feedback(history: DataFrame, limit: int | None = None) -> DataFrame:
    rows = history.filter("feedback_json IS NOT NULL")
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(bounded(limit, 10_000, 100_000))


def apply_retention(history: DataFrame, now: Column, days: int = RETENTION_DAYS) -> DataFrame:
    return history.filter(F.col("created_at") >= now - F.expr(f"INTERVAL {days} DAYS"))


def delete_history(history: DataFrame, ids: DataFrame) -> DataFrame:
    return history.join(ids.select("id"), "id", "left_anti")


def attach_feedback(history: DataFrame, feedback: DataFrame) -> tuple[DataFrame, DataFrame]:
    """history with the latest feedback of each id, and the rejects: unknown ids, or texts that are no JSON object."""
    known = feedback.join(history.select("id").distinct().withColumn("__known", F.lit(True)), "id", "left")
    ok = F.json_object_keys("feedback_json").isNotNull()
    rejects = known.filter(F.col("__known").isNull() | ~ok).select("id", "feedback_json", "feedback_at", F.when(F.col("__known").isNull(), "unknown_id").otherwise("not_an_object").alias("reason"))
    latest = known.filter(F.col("__known") & ok).groupBy("id").agg(F.max(F.struct("feedback_at", "feedback_json")).alias("f"))
    out = history.drop("feedback_json", "feedback_at").join(latest, "id", "left").select("*", F.col("f.feedback_json").alias("feedback_json"), F.col("f.feedback_at").alias("feedback_at")).drop("f")
    return out, rejects


def compact_history(history: DataFrame, n: int = 50) -> DataFrame:
    """Six columns of the newest n."""
    rows = history.orderBy(F.desc("created_at"), F.desc("id")).limit(n)
    return rows.select("id", "created_at", "context_type", "sector", F.get_json_object("result_json", "$.risk").cast("int").alias("risk"), F.get_json_object("result_json", "$.level").alias("level"))


def history_summary(history: DataFrame) -> DataFrame:
    """Mix of sectors and contexts by grouping sets, with the first and last risk of each in time."""
    risk = F.get_json_object("result_json", "$.risk").cast("int")
    rows = history.select("sector", "context_type", "created_at", "id", risk.alias("risk"))
    at = F.struct("created_at", "id")
    return rows.groupingSets([["sector"], ["context_type"], []], "sector", "context_type").agg(F.count("*").alias("n"), F.avg("risk").alias("mean_risk"), F.min_by("risk", at).alias("first_risk"), F.max_by("risk", at).alias("last_risk"))


def common_factors(history: DataFrame, n: int = 10) -> DataFrame:
    rows = history.select(F.explode(F.from_json(F.get_json_object("result_json", "$.factors"), "array<string>")).alias("factor"))
    return rows.groupBy("factor").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "factor").limit(n)


def risk_trend(history: DataFrame, by: str = "sector", unit: str = "day") -> DataFrame:
    """Centred mean of three analyses in time, rounded half up; a trend per group of `by`.

    A group is ordered one unit of time at a time, so a busy one spreads over tasks. What lies across the
    edges comes from the first and last row of each unit, of which a calendar bounds the number."""
    risk = F.get_json_object("result_json", "$.risk").cast("int")
    rows = history.select("id", by, "created_at", risk.alias("risk"), F.date_trunc(unit, "created_at").alias("__unit"))
    row = F.struct("created_at", "id", "risk")
    ends = rows.groupBy(by, "__unit").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    units = Window.partitionBy(by).orderBy("__unit")
    ends = ends.select(F.col(by).alias("__by"), F.col("__unit").alias("__at"), F.lag("last.risk").over(units).alias("__before"), F.lead("first.risk").over(units).alias("__after"))
    inside = Window.partitionBy(by, "__unit").orderBy("created_at", "id")
    near = lambda f, edge: F.when(f(F.lit(1)).over(inside).isNull(), F.col(edge)).otherwise(f("risk").over(inside))
    rows = rows.join(ends, F.col(by).eqNullSafe(F.col("__by")) & F.col("__unit").eqNullSafe(F.col("__at")))
    three = F.array_compact(F.array(near(F.lag, "__before"), F.col("risk"), near(F.lead, "__after")))
    mean = F.aggregate(three, F.lit(0), lambda a, x: a + x) / F.nullif(F.size(three), F.lit(0))
    return rows.select("id", by, "created_at", "risk", F.floor(mean + 0.5).cast("int").alias("sma"))


def feedback_metrics(history: DataFrame) -> DataFrame:
    """Judgements by overall verdict, and the mean error of overridden indices."""
    f = F.from_json("feedback_json", FEEDBACK)
    rows = history.filter("feedback_json IS NOT NULL").select(f.alias("f"), F.get_json_object("result_json", "$.risk").cast("double").alias("risk"))
    return rows.groupBy(F.col("f.overall").alias("overall")).agg(F.count("*").alias("n"), F.avg(F.abs(F.col("f.gri_override") - F.col("risk"))).alias("override_error"))


def sin_precision(history: DataFrame) -> DataFrame:
    """Share of claims judged correct, by the sin that reviewers name."""
    f = F.from_json("feedback_json", FEEDBACK)
    rows = history.filter("feedback_json IS NOT NULL").select(F.explode(f["per_claim"]).alias("c"))
    return rows.groupBy(F.col("c.correct_sin").alias("sin")).agg(F.count("*").alias("n"), F.avg(F.col("c.correct").cast("int")).alias("precision"))


def job_status(events: DataFrame) -> DataFrame:
    """The latest patch of each job."""
    last = F.max(F.struct("ts", "event_id", "status", "stage", "progress")).alias("l")
    return events.groupBy("job_id").agg(last, F.count("*").alias("patches")).select("job_id", F.col("l.ts").alias("ts"), F.col("l.status").alias("status"), F.col("l.stage").alias("stage"), F.col("l.progress").alias("progress"), "patches")


def stalled_jobs(events: DataFrame, seconds: int = 8) -> DataFrame:
    """Gaps of more than seconds after an update of a running job: the batch twin of the streaming job."""
    w = Window.partitionBy("job_id").orderBy("ts", "event_id")
    rows = events.withColumn("next_ts", F.lead("ts").over(w))
    gap = F.col("next_ts").cast("double") - F.col("ts").cast("double")
    return rows.filter((F.col("status") == "running") & (gap > seconds)).select("job_id", F.col("ts").alias("stalled_after"), "next_ts")


def newest_jobs(jobs: DataFrame, n: int = 100) -> DataFrame:
    return jobs.orderBy(F.desc("ts"), F.desc("job_id")).limit(n)


def verify_progress(verdicts: DataFrame) -> DataFrame:
    """60 + floor(25 done / total) per document."""
    return verdicts.groupBy("doc_id").agg(F.count_if("done").alias("done"), F.count("*").alias("total")).withColumn("progress", F.floor(60 + 25 * F.col("done") / F.col("total")).cast("int"))


def windowed_risk(scores: DataFrame, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Tumbling (or sliding) windows of risk."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return scores.groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.avg("risk").alias("mean_risk"), F.max("risk").alias("max_risk")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean_risk", "max_risk")


def session_risk(scores: DataFrame, key: str, gap: str = "30 minutes") -> DataFrame:
    w = F.session_window("ts", gap).alias("w")
    return scores.groupBy(key, w).agg(F.count("*").alias("n"), F.max("risk").alias("max_risk")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "max_risk")
