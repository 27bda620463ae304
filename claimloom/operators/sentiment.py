"""Emotion scores from phrases, model labels and answers, and their fusion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import EMOTION_WEIGHTS
from ..functions.semantics import clamp, round_up

SENTIMENT = {"opportunity": 70, "neutral": 30, "risk": 15}


def zh_emotion_score(docs: DataFrame, weights: dict[str, int] = EMOTION_WEIGHTS) -> DataFrame:
    """Weights of contained phrases over twentieths of the characters that aren't blank, times 20."""
    total = F.lit(0)
    for phrase, w in weights.items():
        if w:
            total = total + F.when(F.contains("text", F.lit(phrase)), w).otherwise(0)
    units = F.greatest(F.lit(1), F.length(F.regexp_replace("text", r"\s+", "")))
    score = clamp(total / F.greatest(units / 20, F.lit(1.0)) * 20)
    return docs.withColumn("emotion_score", F.bround(score, 0).cast("int"))


def normalize_labels(raw: DataFrame) -> DataFrame:
    """raw: sentiment_label, commitment_label, specificity_label, specificity_raw."""
    s, c, p = (F.lower(F.coalesce(F.col(f"{x}_label"), F.lit(d))) for x, d in (("sentiment", "neutral"), ("commitment", "no commitment"), ("specificity", "")))
    score = F.when(F.coalesce("specificity_raw", F.lit(0.0)) == 0, 0.5).otherwise(F.col("specificity_raw"))
    unspecific = p.isin("unspec", "vague") | (~p.isin("spec", "specific") & (F.contains(p, F.lit("non")) | F.contains(p, F.lit("vague")) | F.contains(p, F.lit("not"))))
    return raw.withColumns({
        "climate_sentiment": F.when(F.contains(s, F.lit("opportunity")), "opportunity").when(F.contains(s, F.lit("risk")), "risk").otherwise("neutral"),
        "commitment_type": F.when(c.isin("yes", "commitment", "action") | (F.contains(c, F.lit("commitment")) & ~F.contains(c, F.lit("no"))), "commitment").otherwise("no commitment"),
        "specificity_score": F.round(F.when(unspecific, 1 - score).otherwise(score), 4),
    })


def sentiment_points(c: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in SENTIMENT.items() for x in kv])[c], F.lit(30))


def climate_emotion_score(labels: DataFrame) -> DataFrame:
    score = sentiment_points(F.col("climate_sentiment")) * F.lit(0.6).cast("double") + (1 - F.col("specificity_score")) * 40 * F.lit(0.4).cast("double")
    return labels.withColumn("emotion_score", clamp(score))


def route_language(docs: DataFrame) -> DataFrame:
    """The given language, else mixed if both scripts occur, zh if Han characters prevail, en."""
    han, latin = F.regexp_count("text", F.lit("[\\u4e00-\\u9fff]")), F.regexp_count("text", F.lit("[A-Za-z]"))
    given = F.lower(F.coalesce("language", F.lit("auto")))
    return docs.withColumn("route", F.when(given.isin("zh", "en", "mixed"), given).when((han > 0) & (latin > 0), "mixed").when(han > latin, "zh").otherwise("en"))


def predict_batches(claims: DataFrame, make_predictor: Callable, schema: str, columns: list[str]) -> DataFrame:
    """Rows of a caller's predictor: make_predictor() runs once per task and returns a function from a
    pandas frame of columns to one of schema. Partitions bound how many run at once."""

    def run(frames):
        predict = make_predictor()
        for frame in frames:
            yield predict(frame)

    return claims.select(*columns).mapInPandas(run, schema)


def fuse_emotion(rows: DataFrame) -> DataFrame:
    """rows: rule_emotional (0-30), nlp_score, nlp_sentiment, nlp_specificity, nlp_ok, model_score. Weights
    of missing layers are dealt to the others; consistency falls with the variance around the fused score.
    rule_part, nlp_part and model_part are the layers' own scores, null for a missing layer."""
    d = lambda x: F.lit(x).cast("double")
    c = F.col
    rule = F.coalesce("rule_emotional", F.lit(0)) / 30 * 100
    ok = F.coalesce("nlp_ok", F.lit(False))
    nlp = F.when(ok, F.least(d(100), F.coalesce("nlp_score", d(0)) * d(0.5) + sentiment_points(c("nlp_sentiment")) * d(0.3) + (1 - F.coalesce("nlp_specificity", d(0.5))) * 40 * d(0.2)))
    rows = rows.withColumns({"__r": rule.cast("double"), "__n": nlp, "__m": c("model_score").cast("double"), "__wr": F.when(ok, d(0.2)).otherwise(d(0.35)), "__wm": F.when(c("model_score").isNull(), d(0)).when(ok, d(0.35)).otherwise(d(0.65)), "__wn": F.when(ok, d(0.45)).otherwise(d(0))})
    zero = lambda x: F.coalesce(c(x), d(0))
    total = c("__wr") + c("__wn") + c("__wm")
    rows = rows.withColumn("fused_score", round_up((c("__r") * c("__wr") + zero("__n") * c("__wn") + zero("__m") * c("__wm")) / total))
    layers = F.lit(1) + F.when(ok, 1).otherwise(0) + F.when(c("model_score").isNotNull(), 1).otherwise(0)
    off = lambda x: F.coalesce((c(x) - c("fused_score")) * (c(x) - c("fused_score")), d(0))
    variance = F.when(layers > 1, (off("__r") + off("__n") + off("__m")) / layers).otherwise(d(2500))
    s = c("fused_score")
    return rows.withColumns({"consistency": round_up(F.greatest(d(0), 1 - variance / 2500) * 100), "layers": layers, "rule_part": round_up(c("__r")), "nlp_part": round_up(c("__n")), "model_part": round_up(c("__m")), "level": F.when(s >= 71, "high").when(s >= 46, "medium").when(s >= 21, "low").otherwise("none")}).drop("__r", "__n", "__m", "__wr", "__wn", "__wm")
