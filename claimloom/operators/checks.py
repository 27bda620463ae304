"""Checks of results against each other, in long form: doc_id, check, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import TAG_KEYWORDS
from ..functions.semantics import each, terms_in

EVIDENCE_STATUSES = ["supported", "contradicted", "insufficient", "unknown"]
RANK = {"pass": 0, "warn": 1, "fail": 2}


def _long(rows: DataFrame, checks: list[tuple[Column | str, Column]]) -> DataFrame:
    """Checks with a null status don't apply."""
    all_ = F.array(*[F.struct((F.lit(n) if isinstance(n, str) else n).alias("check"), s.alias("status")) for n, s in checks])
    return each(rows, ["doc_id"], F.filter(all_, lambda c: c["status"].isNotNull()), "c").select("doc_id", "c.check", "c.status")


Check = tuple[Column | str, Column]


def of_classification() -> list[Check]:
    out: list[Check] = []
    for kind in ("context", "sector"):
        manual, low = F.col(f"{kind}_source") == "manual", F.col(f"{kind}_confidence") < 0.55
        name = F.when(manual, f"{kind}_manual_override").when(low, f"{kind}_low_confidence").otherwise(f"{kind}_confidence")
        out.append((name, F.when(manual, "pass").when(low, "warn").otherwise("pass")))
    return out


def of_rules_and_schema() -> list[Check]:
    on = F.coalesce("model_enabled", F.lit(False))
    low = F.col("confidence") < 55
    return [
        (F.when(low, "rule_confidence_low").otherwise("rule_confidence_ok"), F.when(low, "warn").otherwise("pass")),
        (F.when(on, "llm_enabled").otherwise("llm_disabled"), F.when(on, "pass").otherwise("warn")),
        ("llm_schema", F.when(on, F.when(F.coalesce(F.col("evidence_status").isin(EVIDENCE_STATUSES), F.lit(False)), "pass").otherwise("fail"))),
        ("llm_error", F.when(F.col("model_error").isNotNull(), "warn")),
    ]


def of_risk_gap() -> list[Check]:
    gap = F.abs(F.col("adjusted_risk") - F.col("risk"))
    name = F.when(F.col("adjusted_risk").isNull(), "llm_risk_missing").otherwise("llm_risk_gap")
    return [(name, F.when(F.col("model_enabled"), F.when(gap.isNull() | (gap > 25), "warn").otherwise("pass")))]


def of_tags() -> list[Check]:
    shared = F.array_intersect(local_tags(), model_tags(F.col("model_text")))
    return [("llm_tag_overlap", F.when(F.col("model_enabled"), F.when(F.size(shared) > 0, "pass").otherwise("warn")))]


def classification_checks(rows: DataFrame) -> DataFrame:
    """rows: <kind>_source, <kind>_confidence for context and sector."""
    return _long(rows, of_classification())


def rule_and_schema_checks(rows: DataFrame) -> DataFrame:
    """rows: confidence, model_enabled, evidence_status, model_error."""
    return _long(rows, of_rules_and_schema())


def risk_gap_check(rows: DataFrame) -> DataFrame:
    """rows: risk, adjusted_risk, model_enabled."""
    return _long(rows, of_risk_gap())


def tag_overlap_check(rows: DataFrame) -> DataFrame:
    """rows: the columns of local_tags, model_enabled, model_text."""
    return _long(rows, of_tags())


def all_checks(rows: DataFrame) -> DataFrame:
    """Every check, in one pass over rows, which have the columns of all of them."""
    return _long(rows, [*of_classification(), *of_rules_and_schema(), *of_risk_gap(), *of_tags()])


def local_tags() -> Column:
    c = F.col
    tests = {"quantified": ~c("quantified"), "evidence": c("n_proof") == 0, "scope": c("n_scope") == 0, "promise": c("promise") > 0, "absolute": c("overclaim") > 0, "action": c("n_action") == 0}
    return F.array_compact(F.array(*[F.when(t, n) for n, t in tests.items()]))


def model_tags(text: Column) -> Column:
    there = terms_in(F.lower(text), [t for terms in TAG_KEYWORDS.values() for t in terms])
    return F.array_compact(F.array(*[F.when(F.arrays_overlap(there, F.array(*map(F.lit, terms))), tag) for tag, terms in TAG_KEYWORDS.items()]))


def overall_status(checks: DataFrame) -> DataFrame:
    rank = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])[F.col("status")]
    worst = checks.groupBy("doc_id").agg(F.max(rank).alias("r"), F.count("*").alias("checks"))
    return worst.select("doc_id", F.element_at(F.array(*map(F.lit, RANK)), F.col("r") + 1).alias("overall"), "checks")
