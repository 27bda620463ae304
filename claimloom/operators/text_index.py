"""A text index from vagueness, framing and the gap between commitment and action."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import LEXICON, NET_ZERO, TGRI_VAGUE
from ..functions.semantics import clamp, found, level, matches
from .features import approx_tokens, flags_v2, own_terms, with_terms

#: Terms that qualify or limit a statement.
BALANCE = ["challenge", "however", "limitation", "uncertain", "not yet", "gap", "挑战", "不足", "局限", "不确定"]
#: Added where level 1 is over 30 % of the claims or a net-zero claim stands at level 1 or 2.
GAP_BONUS = 15
#: Vagueness and gap above this are both high.
HIGH = 50


def vagueness(docs: DataFrame) -> DataFrame:
    """m3. docs: text, n_<category>, quantified, timeline. Markers of specificity: quantities, dates, scope, proof, action."""
    v = F.col("n_tgri") if "n_tgri" in docs.columns else F.size(found(F.col("text"), TGRI_VAGUE))
    marks = sum((F.when(c, 1).otherwise(0) for c in (F.col("quantified"), F.col("timeline"), F.col("n_scope") > 0, F.col("n_proof") > 0, F.col("n_action") > 0)), F.lit(0))
    rows = docs.withColumns({"__v": v, "__s": marks, "__t": approx_tokens(F.col("text"))})
    ratio = F.col("__v") / F.greatest(F.col("__v") + F.col("__s"), F.lit(1))
    density = F.col("__v") / F.greatest(F.col("__t"), F.lit(1))
    d = lambda x: F.lit(x).cast("double")
    return rows.withColumn("m3", (ratio * d(0.65) + F.least(density * 10, d(1)) * d(0.35)) * 100).drop("__v", "__s", "__t")


def framing(docs: DataFrame) -> DataFrame:
    """m4, with the counts of positive and balancing signals."""
    b = F.col("n_balance") if "n_balance" in docs.columns else F.size(found(F.col("text"), BALANCE))
    rows = docs.withColumns({"positive": F.col("n_absolute") + F.col("n_emotional"), "balance": F.col("n_scope") + b})
    score = (F.col("positive") - F.col("balance")) / F.greatest(F.col("positive") + F.col("balance"), F.lit(1))
    return rows.withColumn("m4", (score + 1) / 2 * 100)


#: What vagueness and framing count.
COUNTED = {c: LEXICON[c] for c in ("absolute", "emotional", "scope", "proof", "action")} | {"tgri": TGRI_VAGUE, "balance": BALANCE}


def indexed(docs: DataFrame) -> DataFrame:
    """m3 and m4 of texts: one search for all terms, of which only the lists that count leave Python."""
    rows = with_terms(docs, COUNTED)
    rows = rows.withColumns({f"n_{c}": F.size(own_terms(terms)) for c, terms in COUNTED.items()})
    return framing(vagueness(flags_v2(rows)))


def claim_direction(docs: DataFrame) -> DataFrame:
    p, b = F.col("positive"), F.col("balance")
    return docs.withColumn("direction", F.when(p > b, "positive_claim").when(b > p, "balanced_disclosure").otherwise("mixed"))


def claim_level(claims: DataFrame) -> DataFrame:
    """4 done with results or proof, 3 planned with a time or a quantity, 2 intended, 1 wished for."""
    n = F.col
    plan = n("n_future") > 0
    four = (n("n_action") > 0) & (n("quantified") | (n("n_proof") > 0))
    return claims.withColumn("level", F.when(four, 4).when(plan & (n("target_year").isNotNull() | n("quantified")), 3).when(plan | (n("n_action") > 0), 2).otherwise(1))


def commitment_gap(claims: DataFrame) -> DataFrame:
    """m5 per document."""
    bold = matches(F.lower("text"), NET_ZERO) & (F.col("level") <= 2)
    docs = claims.groupBy("doc_id").agg(F.avg("level").alias("mean_level"), F.avg((F.col("level") == 1).cast("int")).alias("level1_share"), F.bool_or(bold).alias("bold"))
    base = (1 - (F.col("mean_level") - 1) / 3) * 100
    bonus = F.when((F.col("level1_share") > 0.3) | F.col("bold"), GAP_BONUS).otherwise(0)
    return docs.select("doc_id", "mean_level", "level1_share", clamp(base + bonus).cast("double").alias("m5"))


def total(docs: DataFrame) -> DataFrame:
    """tgri, risk_level, primary_type from m3, m4, m5; the first of equal modules names the type."""
    m3, m4, m5 = F.col("m3"), F.col("m4"), F.col("m5")
    d = lambda x: F.lit(x).cast("double")
    rows = docs.withColumn("tgri", m3 * d(0.4) + m4 * d(0.2) + m5 * d(0.4))
    top = F.greatest(m3, m4, m5)
    kind = F.when((m3 > HIGH) & (m5 > HIGH), "模糊修辞+空洞承诺复合型").when(m3 == top, "模糊修辞型").when(m4 == top, "过度包装型").otherwise("空洞承诺型")
    return rows.withColumns({"risk_level": level(F.col("tgri")), "primary_type": kind})
