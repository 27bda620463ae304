"""Quantities, scopes, years and kinds of claims, read from their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import BASELINE_YEAR, DONE_WORD, FUTURE_WORD, METRIC, SCOPE_EN, SCOPE_ZH, TARGET_YEAR
from ..functions.semantics import matches, or_null, pattern

CLAIM_TYPES = ["achievement", "commitment", "vision", "disclosure", "process", "performance"]
BOUNDARIES = ["unknown", "company", "product", "site", "supply_chain"]


def first(text: Column, p: str, group: int) -> Column:
    return or_null(F.regexp_extract(text, pattern(p), group))


def metric_value(text: Column) -> Column:
    return first(text, METRIC, 1).cast("double")


def ghg_scope(text: Column) -> Column:
    """Sorted scopes 1-3; null if there are none."""
    zh = F.translate(F.concat_ws(",", F.regexp_extract_all(text, F.lit(pattern(SCOPE_ZH)), F.lit(1))), "一二三", "123")
    both = F.concat(F.regexp_extract_all(text, F.lit(pattern(SCOPE_EN)), F.lit(1)), F.filter(F.split(zh, ","), lambda x: x != ""))
    scopes = F.array_sort(F.array_distinct(F.transform(both, lambda x: x.cast("int"))))
    return F.when(F.size(scopes) > 0, scopes)


def target_year(text: Column) -> Column:
    return F.coalesce(first(text, TARGET_YEAR, 1), first(text, TARGET_YEAR, 2)).cast("int")


def baseline_year(text: Column) -> Column:
    raw = first(text, BASELINE_YEAR, 1).cast("int")
    return F.when(raw < 100, raw + 2000).otherwise(raw)


def parsed(claims: DataFrame) -> DataFrame:
    """metric_value, metric_unit, ghg_scope, baseline_year, target_year."""
    t = F.col("text")
    return claims.withColumns({"metric_value": metric_value(t), "metric_unit": first(t, METRIC, 2), "ghg_scope": ghg_scope(t), "baseline_year": baseline_year(t), "target_year": target_year(t)})


def infer_claim_type(claims: DataFrame) -> DataFrame:
    """claim_type: a given one other than disclosure stays."""
    given = F.col("claim_type") if "claim_type" in claims.columns else F.lit("disclosure")
    kind = F.when(F.coalesce(given, F.lit("disclosure")) != "disclosure", given)
    kind = kind.when(F.col("target_year").isNotNull() & matches(F.col("text"), FUTURE_WORD), "commitment").when(F.col("metric_value").isNotNull() & matches(F.col("text"), DONE_WORD), "performance")
    return claims.withColumn("claim_type", kind.otherwise("disclosure"))


def structure(claims: DataFrame) -> DataFrame:
    """Everything that text alone tells, with confidence 0.4 and the source of the reading."""
    return infer_claim_type(parsed(claims)).withColumns({"confidence": F.lit(0.4).cast("double"), "structure_source": F.lit("fallback-regex")})


MODEL_SCHEMA = """claim_type string, metric struct<name: string, value: double, unit: string>, scope struct<boundary: string, ghg_scope: array<int>>,
 baseline struct<type: string, reference_year: int, reference_value: double>, time_horizon struct<start_year: int, target_year: int>,
 evidence_cited array<struct<type: string, name: string, identifier: string>>, confidence double"""


def normalize_structure(parsed: DataFrame, column: str = "structure_json") -> DataFrame:
    """Model answers as columns like those of structure(): unknown enums become defaults, scopes stay
    within 1-3, confidence within 0 and 1 (0.6 if missing). Rows that aren't JSON become null fields."""
    s = F.from_json(column, MODEL_SCHEMA, {"mode": "PERMISSIVE"})
    rows = parsed.withColumn("__s", s)
    scopes = F.array_sort(F.array_distinct(F.filter(F.col("__s.scope.ghg_scope"), lambda x: x.between(1, 3))))
    kind = F.when(F.col("__s.claim_type").isin(CLAIM_TYPES), F.col("__s.claim_type")).otherwise("disclosure")
    return rows.withColumns({
        "claim_type": kind,
        "metric_name": F.col("__s.metric.name"),
        "metric_value": F.col("__s.metric.value"),
        "metric_unit": F.col("__s.metric.unit"),
        "boundary": F.when(F.col("__s.scope.boundary").isin(BOUNDARIES), F.col("__s.scope.boundary")).otherwise("unknown"),
        "ghg_scope": F.when(F.size(scopes) > 0, scopes),
        "baseline_year": F.col("__s.baseline.reference_year"),
        "target_year": F.col("__s.time_horizon.target_year"),
        "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("__s.confidence", F.lit(0.6)))).cast("double"),
    }).drop("__s")


def structure_claims(claims: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """A claim's model answer where there is one (by doc_id, claim_id), else what its text tells."""
    own = structure(claims)
    if model is None:
        return own
    names = ["claim_type", "metric_value", "metric_unit", "ghg_scope", "baseline_year", "target_year", "confidence"]
    there = model.select("doc_id", "claim_id", F.struct(*names).alias("__m"))
    out = own.join(there, ["doc_id", "claim_id"], "left")
    has = F.col("__m").isNotNull()
    out = out.withColumns({n: F.when(has, F.col(f"__m.{n}")).otherwise(F.col(n)) for n in names})
    return out.withColumn("structure_source", F.when(has, "llm").otherwise(F.col("structure_source"))).drop("__m")
