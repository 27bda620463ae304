"""Risk of claims and documents from four components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import COMPONENT_WEIGHTS
from ..functions.semantics import clamp, level, round_up
from .certificates import severity_risk

COMPONENTS = list(COMPONENT_WEIGHTS)


def text_risk(claims: DataFrame) -> DataFrame:
    n = F.col
    points = F.when((n("n_green") >= 1) & (n("n_vague") >= 1), 20).otherwise(0) + F.least(F.lit(30), n("n_vague") * 8)
    points += F.when((n("n_absolute") >= 1) & (n("n_proof") == 0), 18).otherwise(0) + F.when(n("n_emotional") >= 2, 12).otherwise(0)
    points += F.when(n("n_action") >= 1, -15).otherwise(0) + F.when(n("quantified"), -10).otherwise(0) + F.when(n("claim_type") == "vision", 10).otherwise(0)
    return claims.withColumn("text_risk", clamp(points).cast("double"))


def evidence_risk(claims: DataFrame) -> DataFrame:
    n = F.col
    has = {"metric_value": 10, "ghg_scope": 15, "baseline_year": 12, "target_year": 8}
    points = F.lit(50) - F.least(F.lit(30), F.size("certs") * 15)
    for c, p in has.items():
        points -= F.when(n(c).isNotNull(), p).otherwise(0)
    bare = (n("n_absolute") >= 1) & n("ghg_scope").isNull() & n("baseline_year").isNull() & n("metric_value").isNull()
    return claims.withColumn("evidence_risk", clamp(points + F.when(bare, 25).otherwise(0)).cast("double"))


def external_risk(claims: DataFrame) -> DataFrame:
    points = F.aggregate("signals", F.lit(0), lambda a, s: a + severity_risk(s["severity"]))
    return claims.withColumn("external_risk", clamp(points).cast("double"))


def consistency_risk(claims: DataFrame, found: DataFrame) -> DataFrame:
    """Points of the contradictions that touch the claim at either end. found: counts for each claim, from
    consistency.conflict_counts, or listed pairs (claim_a, claim_b, severity)."""
    if "claim_a" in found.columns:
        ends = found.select("doc_id", F.explode(F.array("claim_a", "claim_b")).alias("claim_id"), severity_risk(F.col("severity")).alias("p"))
        points = ends.groupBy("doc_id", "claim_id").agg(F.sum("p").alias("__p"))
    else:
        p = severity_risk(F.lit("high")) * F.col("high") + severity_risk(F.lit("medium")) * (F.col("medium") + F.col("year") + F.col("scope"))
        points = found.select("doc_id", "claim_id", p.alias("__p"))
    out = claims.join(points, ["doc_id", "claim_id"], "left")
    return out.withColumn("consistency_risk", clamp(F.coalesce("__p", F.lit(0))).cast("double")).drop("__p")


def combined(prefix: str = ""):
    total = F.lit(0.0)
    for c, w in COMPONENT_WEIGHTS.items():
        total = total + F.lit(w) * F.col(prefix + c)
    return clamp(total)


def claim_risk(claims: DataFrame) -> DataFrame:
    """claim_risk to one decimal; the level is that of the unrounded value."""
    return claims.withColumn("__r", combined()).withColumns({"claim_risk": round_up(F.col("__r"), 1), "risk_level": level(F.col("__r"))}).drop("__r")


def claim_sins(claims: DataFrame, hits: DataFrame) -> DataFrame:
    """sins of each claim, in the order in which they first appear in the document."""
    first = F.min(F.col("ord") * 100 + F.col("sin_ord")).over(Window.partitionBy("doc_id", "sin"))
    lists = hits.withColumn("f", first).groupBy("doc_id", "claim_id").agg(F.sort_array(F.collect_list(F.struct("f", "sin"))).alias("s")).select("doc_id", "claim_id", F.col("s.sin").alias("sins"))
    return claims.join(lists, ["doc_id", "claim_id"], "left").withColumn("sins", F.coalesce("sins", F.array().cast("array<string>")))


def document_risk(claims: DataFrame) -> DataFrame:
    """0.6 of the mean and 0.4 of the maximum of each component, to one decimal, then combined."""
    blend = [round_up(0.6 * (F.sum(c) / F.count("*")) + 0.4 * F.max(c), 1).alias(c) for c in COMPONENTS]
    docs = claims.groupBy("doc_id").agg(F.count("*").alias("claims"), *blend)
    return docs.withColumn("__r", combined()).withColumns({"gri": round_up(F.col("__r"), 1), "risk_level": level(F.col("__r"))}).drop("__r")


def top_concerns(summary: DataFrame, n: int = 5) -> DataFrame:
    """The n heaviest sins of each document; ties in first-seen order."""
    heavy = summary.withColumn("weighted", 3 * F.col("high") + 2 * F.col("medium") + F.col("low"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("weighted"), "first_ord", "sin_ord")
    return heavy.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select("doc_id", "place", "sin", "hit_count", "weighted")


def portfolio_rollup(docs: DataFrame, meta: DataFrame) -> DataFrame:
    """Document risk by company, year and sector, with all totals."""
    rows = docs.join(meta, "doc_id")
    return rows.rollup("sector", "year", "company").agg(F.count("*").alias("documents"), F.avg("gri").alias("mean_gri"), F.max("gri").alias("max_gri"), F.grouping_id().alias("grouping"))
