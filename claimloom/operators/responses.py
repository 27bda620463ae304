"""Tables of model answers: parsing, keys, reuse, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import round_up

ANSWER = "summary string, annotations array<string>, adjustedRisk double, evidenceStatus string, vagueExplanations array<string>, contradictions array<string>, credibilityNotes array<string>, rewriteSuggestion string, emotionAnalysis struct<score: double, level: string, rationale: string, signals: array<string>>"
EMOTION_LEVELS = ["none", "low", "medium", "high"]


#: A JSON string, so that what looks like a comment or a comma inside one is left alone.
_STRING = r'("[^"\\]*+(?:\\.[^"\\]*+)*+")'


def json_candidates(raw: Column) -> list[tuple[int, Column]]:
    """Attempts: 0 the text itself; 1 without code fences; 2 from its first brace, or else its first bracket,
    on; 3 those without comments and trailing commas. Readers stop after the first value, so what follows a
    value doesn't matter."""
    bare = F.trim(F.regexp_replace(raw, r"(?i)^\s*```(?:json)?\s*|\s*```\s*\z", ""))
    starts = [F.regexp_extract(bare, p, 0) for p in (r"(?s)\{.*", r"(?s)\[.*")]
    clean = [F.regexp_replace(F.regexp_replace(x, rf"(?s){_STRING}|//[^\n]*+|/\*.*?\*/", "$1"), rf"(?s){_STRING}|,(\s*[\}}\]])", "$1$2") for x in starts]
    return [(0, raw), (1, bare), *[(2, x) for x in starts], *[(3, x) for x in clean]]


def parse_answers(rows: DataFrame, raw: str = "raw", schema: str = ANSWER) -> DataFrame:
    """answer: the first candidate that is JSON, or null; attempt: which (0-3). A row is never dropped."""
    tries = F.array(*[F.struct(F.lit(i).alias("attempt"), x.alias("json")) for i, x in json_candidates(F.col(raw))])
    good = F.get(F.filter(tries, lambda t: is_json(t["json"])), F.lit(0))
    return rows.withColumn("__g", good).withColumns({"answer": F.from_json("__g.json", schema, {"mode": "PERMISSIVE"}), "attempt": F.col("__g.attempt")}).drop("__g")


def is_json(x: Column) -> Column:
    """JSON objects and lists only. json_object_keys and json_array_length are null for anything else."""
    return (F.json_object_keys(x).isNotNull() | F.json_array_length(x).isNotNull())


def normalize_responses(rows: DataFrame) -> DataFrame:
    """Defaults for missing fields; risks that aren't numbers are null."""
    a = F.col("answer")
    listed = lambda c: F.coalesce(a[c], F.array().cast("array<string>"))
    return rows.withColumns({
        "summary": F.coalesce(a["summary"], F.col("raw")), "annotations": listed("annotations"), "adjusted_risk": F.when(~F.isnan(a["adjustedRisk"]), a["adjustedRisk"]),
        "evidence_status": F.coalesce(F.when(a["evidenceStatus"] != "", a["evidenceStatus"]), F.lit("unknown")), "vague_explanations": listed("vagueExplanations"), "contradictions": listed("contradictions"),
        "credibility_notes": listed("credibilityNotes"), "rewrite_suggestion": F.when(a["rewriteSuggestion"] != "", a["rewriteSuggestion"]), "emotion": normalize_emotion(a["emotionAnalysis"]),
    })


def normalize_emotion(e: Column) -> Column:
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), e["score"]))
    fields = F.struct(F.when(e["score"].isNotNull(), score).alias("score"), F.when(e["level"].isin(EMOTION_LEVELS), e["level"]).alias("level"), F.coalesce(e["rationale"], F.lit("")).alias("rationale"), F.coalesce(e["signals"], F.array().cast("array<string>")).alias("signals"))
    return F.when(e.isNotNull(), fields)


def response_key(requests: DataFrame) -> DataFrame:
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("text", "context_type", "sector", "provider", "model")]
    return requests.withColumn("key", F.sha2(F.concat_ws("\x1f", *parts), 256))


#: An as-of search cuts ttl into so many slots; a slot of a key with more requests than CROWD is dealt to several tasks.
SLOTS, CROWD = 16, 100_000
#: Slots of a key are looked through in stretches of so many.
STRETCH = 4096


def reuse_responses(requests: DataFrame, responses: DataFrame, ttl: int = 300, crowd: int = CROWD, stretch: int = STRETCH) -> DataFrame:
    """requests (request_id, key, ts) with response, the newest one for the key that is not older than ttl
    seconds, and hit. Answers of one time: the greatest text.

    Requests and answers are dealt by key and slot of time and merged in order of time, so a request meets
    the newest answer before it and no other. The newest answer of the slots before comes from a table of one
    row for each key and slot, in which a window looks back over ttl; such a window spans a stretch of
    slots, and repeats the last ones of the stretch before. Slots with over crowd requests are cut by request,
    each part with the answers of the slot. So no key, however busy, meets in one task.

    Requests without a key or time hit nothing. A newest answer that is null is no hit."""
    slot = F.floor(F.col("ts").cast("double") / (ttl / SLOTS))
    told = responses.select("key", slot.alias("__slot"), F.col("ts").alias("__at"), F.struct(F.col("ts").alias("ts"), "response").alias("__a"))
    asked = without_columns(requests, ["response", "hit"]).withColumn("__slot", slot)
    cells = told.groupBy("key", "__slot").agg(F.max("__a").alias("__new"), F.lit(0).cast("long").alias("__n"))
    cells = cells.unionByName(asked.groupBy("key", "__slot").agg(F.count("*").alias("__n")), allowMissingColumns=True).groupBy("key", "__slot").agg(F.max("__new").alias("__new"), F.sum("__n").alias("__n"))
    # stretches, each with the last slots of the one before
    own = F.floor(F.col("__slot") / stretch)
    cells = cells.withColumn("__era", F.explode(F.array_distinct(F.array(own, F.floor((F.col("__slot") + SLOTS + 1) / stretch)))))
    back = Window.partitionBy("key", "__era").orderBy("__slot").rangeBetween(-SLOTS - 1, -1)
    cells = cells.withColumn("__before", F.max("__new").over(back)).filter(F.col("__era") == own)
    cells = cells.filter("__n > 0").select("key", "__slot", "__before", F.ceil(F.col("__n") / crowd).alias("__parts"))
    rows = asked.join(cells, ["key", "__slot"], "left")
    rows = rows.withColumns({"__part": F.pmod(F.xxhash64("request_id"), F.coalesce("__parts", F.lit(1))), "__at": F.col("ts"), "__kind": F.lit(1)})
    copies = told.join(cells, ["key", "__slot"]).select("key", "__slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1)).alias("__part"), "__at", F.lit(0).alias("__kind"), "__a")
    up_to = Window.partitionBy("key", "__slot", "__part").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    merged = rows.unionByName(copies, allowMissingColumns=True).withColumn("__best", F.coalesce(F.max("__a").over(up_to), "__before")).filter("__kind = 1")
    fresh = F.col("ts").cast("double") - F.col("__best.ts").cast("double") <= ttl
    found = F.when(F.col("key").isNotNull() & fresh, F.col("__best.response"))
    return merged.select(*[c for c in asked.columns if c != "__slot"], found.alias("response")).withColumn("hit", F.col("response").isNotNull())


def without_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*[c for c in df.columns if c in names])


def merge_split_responses(halves: DataFrame) -> DataFrame:
    """halves: doc_id, part, n (characters), adjusted_risk, emotion_score, emotion_level, summary, annotations.
    Means weighted by length of what is there, the highest level, concatenated lists, first texts."""
    # an answer to an empty half alone counts as it is
    w = lambda c: F.coalesce(F.try_divide(F.sum(F.when(F.col(c).isNotNull(), F.col(c) * F.col("n"))), F.sum(F.when(F.col(c).isNotNull(), F.col("n")))), F.max(c))
    rank = F.array_position(F.array(*map(F.lit, EMOTION_LEVELS)), F.coalesce("emotion_level", F.lit("none")))
    parts = F.sort_array(F.collect_list(F.struct("part", "summary", "annotations")))
    out = halves.groupBy("doc_id").agg(round_up(w("adjusted_risk")).alias("adjusted_risk"), round_up(w("emotion_score")).alias("emotion_score"), F.max(rank).alias("__l"), parts.alias("__p"))
    summary = F.array_join(F.filter(F.col("__p.summary"), lambda s: s.isNotNull() & (s != "")), "\n\n")
    return out.select("doc_id", "adjusted_risk", "emotion_score", F.element_at(F.array(*map(F.lit, EMOTION_LEVELS)), F.col("__l").cast("int")).alias("emotion_level"), summary.alias("summary"), F.flatten("__p.annotations").alias("annotations"))


def merge_prior_findings(deep: DataFrame, prior: DataFrame, classification: DataFrame) -> DataFrame:
    """Deep results with what is known before: direction, five findings, 200 characters of summary."""
    rows = deep.join(prior, "doc_id", "left").join(classification, "doc_id", "left")
    p, b = F.coalesce(F.size("positive_signals"), F.lit(0)), F.coalesce(F.size("balance_signals"), F.lit(0))
    direction = F.when(p > b, "positive_claim").when(b > p, "balanced_disclosure").otherwise("mixed")
    return rows.select("doc_id", direction.alias("claim_direction"), F.array_compact(F.array("selected")).alias("text_types"), F.substring(F.coalesce("summary", F.lit("")), 1, 200).alias("one_line"), F.slice(F.coalesce("annotations", F.array().cast("array<string>")), 1, 5).alias("key_findings"), F.array_compact(F.array("rewrite_suggestion")).alias("recommendations"))

