"""Baselines of sectors, a company's own history, queues for review, agreement of annotators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .consistency import TOLERANCE, gap_severity, metric_key, value_gap

SHARES = [0.1, 0.25, 0.5, 0.75, 0.9]


def sector_baselines(metrics: DataFrame, keys: list[str], exact: bool = True) -> DataFrame:
    """p10 to p90 of value by keys. exact=False: sketches of fixed size, for groups of any size."""
    f = F.percentile("value", SHARES) if exact else F.percentile_approx("value", SHARES, 10_000)
    rows = metrics.groupBy(*keys).agg(F.count("*").alias("n"), f.alias("p"))
    return rows.select(*keys, "n", *[F.col("p")[i].alias(f"p{int(s * 100)}") for i, s in enumerate(SHARES)])


#: Size of a sketch: its ranks are off by about 0.6 % of a group at most, whatever the group's size.
SKETCH_K = 400


def baseline_sketches(metrics: DataFrame, keys: list[str], period: str, k: int = SKETCH_K) -> DataFrame:
    """keys, period, n and sketch: a quantile sketch of fixed size of each group's values in a period. Made by partial
    sketches in the tasks, so no group meets as values; kept as a table, and a new period adds rows."""
    return metrics.groupBy(*keys, period).agg(F.count("value").alias("n"), F.kll_sketch_agg_double("value", k).alias("sketch"))


def baselines_of_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """p10 to p90 by keys from the sketches of all periods, merged. No value is read."""
    rows = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return rows.select(*keys, "n", *[F.kll_sketch_get_quantile_double("sketch", F.lit(s)).alias(f"p{int(s * 100)}") for s in SHARES])


def rank_errors(metrics: DataFrame, baselines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n and error: how far the ranks of the percentiles are from their shares, at most, of the group. A value
    that occurs often has a range of ranks, and counts by the nearest of it."""
    rows = metrics.filter("value IS NOT NULL").join(baselines.drop("n"), keys)
    names = [f"p{int(s * 100)}" for s in SHARES]
    below = [x for p in names for x in (F.count_if(F.col("value") < F.col(p)).alias(f"{p}_lo"), F.count_if(F.col("value") <= F.col(p)).alias(f"{p}_hi"))]
    rows = rows.groupBy(*keys).agg(F.count("*").alias("n"), *below)
    off = [F.greatest(F.col(f"{p}_lo") / F.col("n") - s, s - F.col(f"{p}_hi") / F.col("n"), F.lit(0.0)) for p, s in zip(names, SHARES, strict=True)]
    return rows.select(*keys, "n", F.greatest(*off).alias("error"))


def baseline_position(metrics: DataFrame, baselines: DataFrame, keys: list[str]) -> DataFrame:
    """The percentile band of a value among its baselines."""
    rows = metrics.join(baselines, keys, "left")
    band = F.when(F.col("p10").isNull(), "unknown")
    low = "<p10"
    for s in SHARES:
        p = f"p{int(s * 100)}"
        band = band.when(F.col("value") < F.col(p), low)
        low = f"{p}+"
    return rows.withColumn("band", band.otherwise(low))


def company_history_conflicts(claims: DataFrame, meta: DataFrame) -> DataFrame:
    """Contradictions between what a company told in two report years about one metric: every pair of
    different target years, and of measured values the pair that is furthest apart, if that is over the
    tolerance of contradictions inside a document.

    A company, metric and report year meets others as its distinct target years, which a calendar
    bounds, and as its least and greatest value (of values from zero up, the furthest pair has one of
    each), so a busy company isn't squared."""
    rows = metric_key(claims.filter("target_year IS NOT NULL OR metric_value IS NOT NULL")).join(meta.select("doc_id", "company", "year"), "doc_id")
    key, pair = ["company", "metric_key"], lambda t: (t.alias("a"), t.alias("b"))
    same = (F.col("a.company") == F.col("b.company")) & (F.col("a.metric_key") == F.col("b.metric_key")) & (F.col("a.year") < F.col("b.year"))
    names = [*[F.col(f"a.{k}").alias(k) for k in key], F.col("a.year").alias("year_a"), F.col("b.year").alias("year_b")]
    a, b = pair(rows.filter("target_year IS NOT NULL").select(*key, "year", F.col("target_year").cast("double").alias("v")).distinct())
    targets = a.join(b, same & (F.col("a.v") != F.col("b.v"))).select(*names, F.lit("target_year_mismatch").alias("type"), F.lit("medium").alias("severity"), F.col("a.v").alias("value_a"), F.col("b.v").alias("value_b"))
    a, b = pair(rows.filter("metric_value IS NOT NULL").groupBy(*key, "metric_unit", "year").agg(F.min("metric_value").alias("lo"), F.max("metric_value").alias("hi")))
    unit = F.col("a.metric_unit").isNull() | F.col("b.metric_unit").isNull() | (F.col("a.metric_unit") == F.col("b.metric_unit"))
    fall, rise = (F.struct(value_gap(F.col(x), F.col(y)).alias("gap"), F.abs(F.col(x) - F.col(y)).alias("far"), F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("a.hi", "b.lo"), ("a.lo", "b.hi")))
    values = a.join(b, same & unit).select(*names, F.greatest(fall, rise).alias("w")).filter(F.col("w.gap") > TOLERANCE)
    values = values.select("company", "metric_key", "year_a", "year_b", F.lit("numeric_metric_mismatch").alias("type"), gap_severity(F.col("w.gap")).alias("severity"), F.col("w.x").alias("value_a"), F.col("w.y").alias("value_b"))
    return targets.unionByName(values)


def review_candidates(docs: DataFrame, n: int = 100) -> DataFrame:
    """The documents that may be among the first n of review_queue by their confidence alone: those up to the nth least
    one, with all that are equal to it. docs are read twice, so they should be a table."""
    first = docs.orderBy("confidence").limit(n).agg(F.count("*").alias("n"), F.max("confidence").alias("most")).first()
    if first["n"] < n:
        return docs
    return docs.filter(F.col("confidence").isNull() if first["most"] is None else F.col("confidence").isNull() | (F.col("confidence") <= first["most"]))


def review_queue(docs: DataFrame, n: int = 100) -> DataFrame:
    """Low confidence and high index first."""
    return docs.orderBy("confidence", F.desc("gri"), "doc_id").limit(n)


def annotator_kappa(labels: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two label columns, from one table of counts."""
    cells = labels.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    by_a = cells.groupBy(F.col("a").alias("v")).agg(F.sum("n").alias("na"))
    by_b = cells.groupBy(F.col("b").alias("v")).agg(F.sum("n").alias("nb"))
    chance = by_a.join(by_b, "v").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("c"))
    rows = total.crossJoin(F.broadcast(chance))  # one row each
    agree, by_chance = F.col("same") / F.col("t"), F.col("c") / (F.col("t") * F.col("t"))
    return rows.select(F.col("t").alias("n"), agree.alias("agreement"), ((agree - by_chance) / (1 - by_chance)).alias("kappa"))
