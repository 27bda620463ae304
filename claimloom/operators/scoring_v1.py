"""Kinds of texts, and the risk of whole texts from their terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import CONTEXTS, HIGH_IMPACT, LEVELS, LEXICON, SECTORS
from ..functions.semantics import clamp, round_up
from .features import THERE, flags_v1, lexicon_counts, own_terms, text_metrics, with_terms

#: The claim gate.
MIN_GREEN, MIN_PROBABILITY, MIN_TOKENS = 2, 42, 15


def language_confidence(docs: DataFrame) -> DataFrame:
    """language and its confidence to two decimals: mixed if the rarer script has over 12 %."""
    han, latin = F.regexp_count("text", F.lit("[\\u4e00-\\u9fff]")), F.regexp_count("text", F.lit("[a-zA-Z]"))
    rows = docs.withColumns({"__h": han, "__l": latin})
    both = F.col("__h") + F.col("__l")
    minor, major = F.try_divide(F.least("__h", "__l"), both), F.try_divide(F.greatest("__h", "__l"), both)
    value = F.when(both == 0, "unknown").when(minor > 0.12, "mixed").when(F.col("__h") >= F.col("__l"), "zh").otherwise("en")
    sure = F.when(both == 0, F.lit(0.0)).when(minor > 0.12, round_up(minor + F.lit(0.64).cast("double"), 2)).otherwise(round_up(major, 2))
    return rows.withColumns({"language": value, "language_confidence": sure}).drop("__h", "__l")


def classify(docs: DataFrame, kind: str, signals: dict[str, list[str]], fallback: str) -> DataFrame:
    """<kind>, <kind>_confidence and <kind>_matches (six at most): the label with the most terms, the first
    declared of equal ones. Labels are columns of one projection."""
    rows = docs if THERE in docs.columns else with_terms(docs, signals)
    lists = {f"__m{i}": own_terms(t) for i, t in enumerate(signals.values())}
    best = F.least(*[F.struct((-F.size(f"__m{i}")).alias("minus"), F.lit(i).alias("ord"), F.lit(v).alias("value"), F.col(f"__m{i}").alias("m")) for i, v in enumerate(signals)])
    rows = rows.withColumns(lists).withColumn("__b", best).drop(*lists)
    rows = rows if THERE in docs.columns else rows.drop(THERE)
    n = -F.col("__b.minus")
    sure = F.least(F.lit(0.92).cast("double"), F.lit(0.52).cast("double") + n * F.lit(0.12).cast("double"))
    return rows.withColumns({kind: F.when(n == 0, fallback).otherwise(F.col("__b.value")), f"{kind}_confidence": F.when(n == 0, F.lit(0.38).cast("double")).otherwise(round_up(sure, 2)), f"{kind}_matches": F.slice("__b.m", 1, 6)}).drop("__b")


def classify_context(docs: DataFrame) -> DataFrame:
    return classify(docs, "context", CONTEXTS, "marketing")


def classify_sector(docs: DataFrame) -> DataFrame:
    return classify(docs, "sector", SECTORS, "general")


def resolve_choice(rows: DataFrame, detected: str, override: str, labels: list[str]) -> DataFrame:
    """selected and source: a valid override (not `auto`) wins."""
    manual = F.coalesce(F.col(override).isin(labels), F.lit(False))
    return rows.withColumns({"selected": F.when(manual, F.col(override)).otherwise(F.col(detected)), "source": F.when(manual, "manual").otherwise("keyword")})


def merge_classification(rows: DataFrame, detected: str, model: str, override: str, labels: list[str]) -> DataFrame:
    """Override before model before keywords."""
    manual, by_model = (F.coalesce(F.col(c).isin(labels), F.lit(False)) for c in (override, model))
    return rows.withColumns({"selected": F.when(manual, F.col(override)).when(by_model, F.col(model)).otherwise(F.col(detected)), "source": F.when(manual, "manual").when(by_model, "llm").otherwise("keyword")})


def document_features(docs: DataFrame) -> DataFrame:
    return text_metrics(flags_v1(lexicon_counts(docs)))


def claim_gate(docs: DataFrame) -> DataFrame:
    n = F.col("n_green")
    density = n / F.greatest(F.lit(1.0), F.col("density") / 24)
    rows = docs.withColumn("claim_prob", clamp(18 + n * 16 + density * 16))
    return rows.withColumn("is_claim", (n >= MIN_GREEN) & (F.col("claim_prob") >= MIN_PROBABILITY) & (F.col("tokens") >= MIN_TOKENS))


def _if(cond: Column, points: int) -> Column:
    return F.when(cond, points).otherwise(0)


def _fixed(value: int, points: Column) -> Column:
    """points for claims, a constant for other texts."""
    return F.when(F.col("is_claim"), points).otherwise(value)


def components(docs: DataFrame) -> DataFrame:
    """vagueness, evidence, overclaim, promise, emotional."""
    n = {c: F.col(f"n_{c}") for c in ("vague", "absolute", "proof", "future", "emotional", "action", "scope")}
    q, t, has = F.col("quantified"), F.col("timeline"), lambda c: n[c] > 0
    vague = clamp(n["vague"] * 8 + _if(~q, 12) + _if(~t, 6), 0, 35)
    evidence = clamp(_if(~has("proof"), 18) + _if(~q, 10) + _if(~has("scope"), 7) + _if(has("absolute") & ~has("proof"), 8), 0, 38)
    over = clamp(n["absolute"] * 10 + _if((n["vague"] >= 2) & ~q, 7) + _if(F.col("context").isin("marketing", "product") & has("absolute"), 5), 0, 28)
    promise = clamp(n["future"] * 5 + _if(n["future"] > n["action"], 10) + _if(t & ~has("action"), 4), 0, 28)
    emotional = clamp(n["emotional"] * 7 + _if(has("vague"), 4) + _if(has("future"), 4), 0, 30)
    return docs.withColumns({"vagueness": _fixed(5, vague), "evidence": _fixed(4, evidence), "overclaim": _fixed(2, over), "promise": _fixed(2, promise), "emotional": emotional})


def risk(docs: DataFrame) -> DataFrame:
    c = F.col
    total = 12 + c("vagueness") + c("evidence") + c("overclaim") + c("promise") - _if(c("n_proof") > 0, 10) - _if(c("quantified") & c("timeline"), 8) - _if((c("n_action") > 0) & c("quantified"), 6)
    total = total + _if(c("sector").isin(HIGH_IMPACT), 5) + _if((c("context") == "report") & (c("tokens") > 90) & (c("n_proof") == 0), 4)
    return docs.withColumn("risk", _fixed(8, clamp(total, 6, 92)))


def confidence(docs: DataFrame) -> DataFrame:
    c = F.col
    full = clamp(48 + F.least(c("tokens"), F.lit(140)) * F.lit(0.22).cast("double") + c("n_green") * 4 + _if(c("n_proof") > 0, 8), 35, 88)
    base = clamp(54 + F.least(c("tokens"), F.lit(80)) * F.lit(0.35).cast("double"))
    return docs.withColumn("confidence", F.when(c("is_claim"), full).otherwise(base))


def level_tone(docs: DataFrame) -> DataFrame:
    r, c = F.col("risk"), F.col("is_claim")
    at = lambda names: F.when(~c, names[0]).when(r >= 75, names[3]).when(r >= 50, names[2]).when(r >= 28, names[1]).otherwise(names[0])
    documented = (F.col("n_proof") > 0) & F.col("quantified") & F.col("timeline")
    summary = F.when(~c, "no_claim").when(r >= 75, "needs_review").when(r >= 50, "needs_evidence").when(r >= 28, "checkable").when(documented, "documented").otherwise("low")
    return docs.withColumns({"level": at(LEVELS), "tone": at(["green", "teal", "amber", "red"]), "summary": summary})


FACTORS = ["vague_wording", "not_quantified", "no_timeline", "no_proof", "promises_exceed_actions", "absolute_wording", "no_scope", "high_impact_sector"]


def factors(docs: DataFrame) -> DataFrame:
    """Reasons in order; texts that are no claims, and claims without any, have one reason of their own."""
    c = F.col
    tests = [c("n_vague") > 0, ~c("quantified"), ~c("timeline"), c("n_proof") == 0, c("n_future") > c("n_action"), c("n_absolute") > 0, c("n_scope") == 0, c("sector").isin(HIGH_IMPACT)]
    listed = F.array_compact(F.array(*[F.when(t, name) for t, name in zip(tests, FACTORS, strict=True)]))
    return docs.withColumn("factors", F.when(~c("is_claim"), F.array(F.lit("no_strong_claim"))).when(F.size(listed) == 0, F.array(F.lit("complete"))).otherwise(listed))


def signals(docs: DataFrame) -> DataFrame:
    """Labelled matches: green, vague, absolute, three future ones; seven at most. Of other texts four green ones."""
    label = lambda name, col, n=99: F.transform(F.slice(col, 1, n), lambda t: F.concat(F.lit(f"{name}: "), t))
    listed = F.slice(F.concat(label("green", "m_green"), label("vague", "m_vague"), label("absolute", "m_absolute"), label("future", "m_future", 3)), 1, 7)
    return docs.withColumn("signals", F.when(F.col("is_claim"), listed).otherwise(F.slice("m_green", 1, 4)))


def _trimmed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+\z", ""))


def document_confidence(docs: DataFrame) -> DataFrame:
    """The confidence of score_documents alone, which takes two lists of terms and the lengths: all other lists would
    leave Python for nothing."""
    rows = lexicon_counts(_trimmed(docs), {c: LEXICON[c] for c in ("green", "proof")})
    rows = confidence(claim_gate(text_metrics(rows)))
    return rows.withColumn("confidence", F.when(F.col("text") == "", 0).otherwise(F.col("confidence")))


def score_documents(docs: DataFrame) -> DataFrame:
    """All of the above in one projection; blank texts have mode `empty` and zeros."""
    rows = _trimmed(docs)
    kinds = "context" not in docs.columns
    rows = with_terms(rows, LEXICON, *([CONTEXTS, SECTORS] if kinds else []))
    rows = classify_sector(classify_context(rows)) if kinds else rows
    rows = signals(factors(level_tone(confidence(risk(components(claim_gate(document_features(rows))))))))
    empty = F.col("text") == ""
    rows = rows.withColumn("mode", F.when(empty, "empty").when(F.col("is_claim"), "green-claim-risk").otherwise("non-green-claim-baseline"))
    zeros = ["risk", "claim_prob", "confidence", "vagueness", "evidence", "overclaim", "promise", "emotional"]
    return rows.withColumns({z: F.when(empty, 0).otherwise(F.col(z)) for z in zeros})
