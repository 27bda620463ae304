"""Contradictions between claims of a document, and the sins of single claims.

Claims come wide: doc_id, ord, claim_id, text, n_<category>, quantified, metric_value, metric_unit,
ghg_scope, target_year, certs, signals. Lists of contradictions are equi-joins on document and metric: as
many rows as there are pairs. What risks and summaries need of them are counts for each claim, which
conflict_counts takes from one sweep over sorted values, without any pair, where a document is large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import CFC_FREE, NET_ZERO, SINS
from ..functions.semantics import each, matches

#: Values that are closer than this part of the larger one don't contradict each other.
TOLERANCE, HIGH = 0.05, 0.25
#: Documents of more claims are swept instead of paired, and lists of more rows are swept in parts.
SMALL, LIST_ROWS = 64, 200_000
EDGE = ["doc_id", "type", "severity", "a_ord", "b_ord", "claim_a", "claim_b"]


def metric_key(claims: DataFrame) -> DataFrame:
    name = F.col("metric_name") if "metric_name" in claims.columns else F.lit(None).cast("string")
    name = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\s+", "_")
    scope = F.when(F.col("ghg_scope").isNotNull(), F.concat(F.lit("_scope"), F.array_join(F.col("ghg_scope").cast("array<string>"), ""))).otherwise("")
    return claims.withColumn("metric_key", F.concat(F.when(name == "", "unnamed_metric").otherwise(name), scope))


def _sides(claims: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    a = claims.select("doc_id", "metric_key", *[F.col(c).alias(f"a_{c}") for c in columns])
    b = claims.select("doc_id", "metric_key", *[F.col(c).alias(f"b_{c}") for c in columns])
    return a, b


def value_gap(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0))


def gap_severity(gap: Column) -> Column:
    return F.when(gap > HIGH, "high").otherwise("medium")


def numeric_contradictions(claims: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    keyed = metric_key(claims.filter("metric_value IS NOT NULL"))
    a, b = _sides(keyed, ["ord", "claim_id", "metric_value", "metric_unit"])
    same_unit = F.col("a_metric_unit").isNull() | F.col("b_metric_unit").isNull() | (F.col("a_metric_unit") == F.col("b_metric_unit"))
    gap = value_gap(F.col("a_metric_value"), F.col("b_metric_value"))
    pairs = a.join(b, ["doc_id", "metric_key"]).filter((F.col("a_ord") < F.col("b_ord")) & same_unit).withColumn("gap", gap).filter(F.col("gap") > tolerance)
    return pairs.select("doc_id", F.lit("numeric_metric_mismatch").alias("type"), gap_severity(F.col("gap")).alias("severity"), "a_ord", "b_ord", F.col("a_claim_id").alias("claim_a"), F.col("b_claim_id").alias("claim_b"))


def target_year_contradictions(claims: DataFrame) -> DataFrame:
    a, b = _sides(metric_key(claims.filter("target_year IS NOT NULL")), ["ord", "claim_id", "target_year"])
    pairs = a.join(b, ["doc_id", "metric_key"]).filter("a_ord < b_ord AND a_target_year <> b_target_year")
    return pairs.select("doc_id", F.lit("target_year_mismatch").alias("type"), F.lit("medium").alias("severity"), "a_ord", "b_ord", F.col("a_claim_id").alias("claim_a"), F.col("b_claim_id").alias("claim_b"))


def scope_contradictions(claims: DataFrame) -> DataFrame:
    """Net-zero claims beside claims of scopes without scope 3."""
    bold = claims.filter((F.col("n_absolute") > 0) & matches(F.lower("text"), NET_ZERO)).select("doc_id", F.col("ord").alias("a_ord"), F.col("claim_id").alias("claim_a"))
    part = claims.filter(F.col("ghg_scope").isNotNull() & ~F.array_contains("ghg_scope", 3)).select("doc_id", F.col("ord").alias("b_ord"), F.col("claim_id").alias("claim_b"))
    pairs = bold.join(part, "doc_id").filter("a_ord <> b_ord")
    return pairs.select("doc_id", F.lit("absolute_vs_partial_scope").alias("type"), F.lit("medium").alias("severity"), "a_ord", "b_ord", "claim_a", "claim_b")


def contradictions(claims: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    return numeric_contradictions(claims, tolerance).unionByName(target_year_contradictions(claims)).unionByName(scope_contradictions(claims))


def bound(v: Column, tolerance: float, side: int) -> Column:
    """The last value above (side 1) or below (side -1) v that value_gap still lets pass, as doubles go.

    First in real numbers: between values of 1 at most the gap is their distance, else their distance
    through the larger size. Then the steps of rounding around that are tried with value_gap itself. Values
    of up to 15 digits are on the same side of the bound as value_gap puts them."""
    x = side * v  # mirrored, the value looked for is above v
    near = x + tolerance * F.greatest(F.abs(x), F.lit(1.0))  # where the size of v counts
    far = F.when(x > 0, x / (1 - tolerance)).otherwise(near)  # where the other one's does
    guess = F.greatest(near, F.when(far > 1, far).otherwise(near))
    step = F.greatest(F.abs(guess) * 2.0**-53, F.lit(2.0**-60))
    tries = F.transform(F.array(*[F.lit(float(k)) for k in range(-16, 17)]), lambda k: side * (guess + step * k))
    good = F.filter(tries, lambda t: value_gap(v, t) <= tolerance)
    return F.array_max(good) if side > 0 else F.array_min(good)


def _events(claims: DataFrame, tolerance: float, bare: bool) -> DataFrame:
    """Values and questions of claims, by list: doc_id, key, list, pos, kind, claim_id, measure, sign.

    A value (kind 1, no measure) stands at its place; a question asks how many values of its list stand
    before it (kind 0) or up to it (kind 2). Lists: values by unit (`u`, and `a` for all units together, which
    claims without a unit ask; those without a unit are in `n`, which claims with one also ask), years, and
    the two sides of net-zero claims. A claim's count of a measure is the sum of sign * answer."""
    end = F.lit(float("inf"))
    c = F.col

    def event(key, name, pos, kind, measure="", sign=0):
        return F.struct(key.alias("key"), name.alias("list"), pos.alias("pos"), F.lit(kind).alias("kind"), F.lit(measure).alias("measure"), F.lit(sign).alias("sign"))

    def within(key, name, measure):
        """All values less those within the limit of the measure."""
        return [event(key, name, end, 2, measure, 1), event(key, name, c(f"{measure}_to"), 2, measure, -1), event(key, name, c(f"{measure}_from"), 0, measure, 1)]

    key, v, unit = c("metric_key"), c("metric_value").cast("double"), F.concat(F.lit("u"), c("metric_unit"))
    limits = {"over": tolerance, "high": HIGH}
    bounds = {f"{m}_{name}": F.when(v.isNotNull(), bound(v, t, side)) for m, t in limits.items() for name, side in (("from", -1), ("to", 1))}
    asks = lambda name: [e for m in limits for e in within(key, F.lit(name) if isinstance(name, str) else name, m)]
    with_unit = [event(key, unit, v, 1), *asks(unit)]
    if bare:  # some values have no unit
        with_unit += [event(key, F.lit("a"), v, 1), *asks("n")]
    without_unit = [event(key, F.lit("a"), v, 1), event(key, F.lit("n"), v, 1), *asks("a")]
    year = c("target_year").cast("double")
    years = [event(key, F.lit("y"), year, 1), event(key, F.lit("y"), end, 2, "year", 1), event(key, F.lit("y"), year, 2, "year", -1), event(key, F.lit("y"), year, 0, "year", 1)]
    bold = (c("n_absolute") > 0) & matches(F.lower("text"), NET_ZERO)
    part = c("ghg_scope").isNotNull() & ~F.array_contains("ghg_scope", 3)
    none, zero = F.lit(""), F.lit(0.0)
    bolds = [event(none, F.lit("b"), zero, 1), event(none, F.lit("p"), end, 2, "scope", 1)]
    parts = [event(none, F.lit("p"), zero, 1), event(none, F.lit("b"), end, 2, "scope", 1)]
    nothing = F.array().cast("array<struct<key:string,list:string,pos:double,kind:int,measure:string,sign:int>>")
    of = lambda ok, events: F.when(ok, F.array(*events)).otherwise(nothing)
    events = [of(v.isNotNull() & c("metric_unit").isNotNull(), with_unit), of(year.isNotNull(), years), of(bold, bolds), of(part, parts)]
    if bare:
        events.append(of(v.isNotNull() & c("metric_unit").isNull(), without_unit))
    return metric_key(claims).withColumns(bounds).select("doc_id", "claim_id", (bold & part).cast("int").alias("own"), F.explode_outer(F.concat(*events)).alias("e")).filter("e IS NOT NULL").select("doc_id", "claim_id", "own", "e.*")


def pair_counts(edges: DataFrame) -> DataFrame:
    """doc_id, claim_id, high, medium, year, scope: in how many of the listed pairs a claim is."""
    kind = F.when(F.col("type") == "target_year_mismatch", "year").when(F.col("type") == "absolute_vs_partial_scope", "scope").otherwise(F.col("severity"))
    ends = edges.select("doc_id", F.explode(F.array("claim_a", "claim_b")).alias("claim_id"), kind.alias("kind"))
    return ends.groupBy("doc_id", "claim_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("high", "medium", "year", "scope")])


def conflict_counts(claims: DataFrame, tolerance: float = TOLERANCE, small: int = SMALL, list_rows: int = LIST_ROWS) -> DataFrame:
    """For each claim that contradicts another: doc_id, claim_id, high, medium (numbers), year, scope.

    These are the numbers of pairs that the claim is in. Documents of at most `small` claims list their
    pairs, of which a claim then has fewer than that; larger ones are swept. claims are read several
    times, so they should be a table."""
    sizes = claims.groupBy("doc_id").agg(F.count("*").alias("n"))
    if (sizes.agg(F.max("n")).first()[0] or 0) <= small:
        return pair_counts(contradictions(claims, tolerance))
    large = sizes.filter(F.col("n") > small).select("doc_id")
    counts = pair_counts(contradictions(claims.join(large, "doc_id", "left_anti"), tolerance))
    return counts.unionByName(sweep_counts(claims.join(large, "doc_id", "left_semi"), tolerance, list_rows))


def sweep_counts(claims: DataFrame, tolerance: float = TOLERANCE, list_rows: int = LIST_ROWS) -> DataFrame:
    """The same from one sorted pass over values and questions, without any pair.

    Where a document may have lists of over list_rows rows, lists are cut into ranges of values; the counts
    of the ranges before are added, so no list meets in one task. A claim is both sides of no
    contradiction: net-zero claims of partial scope don't count themselves."""
    size = claims.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("metric_value").isNotNull() & F.col("metric_unit").isNull()).alias("b")).agg(F.max("n").alias("n"), F.sum("b").alias("b")).first()
    events = _events(claims, tolerance, bool(size["b"]))
    value = (F.col("kind") == 1).cast("int")
    parts = ["doc_id", "key", "list"]
    if 14 * (size["n"] or 0) > list_rows:  # a claim has up to 14 rows in a list
        events = events.withColumn("range", (F.signum("pos") * F.floor(256 * F.log1p(F.abs("pos")))).cast("long"))
        in_range = events.groupBy(*parts, "range").agg(F.sum(value).alias("n"))
        before = in_range.withColumn("before", F.sum("n").over(Window.partitionBy(*parts).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).drop("n")
        parts = [*parts, "range"]
        events = events.join(before, parts)
    else:
        events = events.withColumn("before", F.lit(0))
    running = F.sum(value).over(Window.partitionBy(*parts).orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0))
    answers = events.withColumn("n", F.col("sign") * (running + F.col("before"))).filter("sign <> 0")
    of = lambda m: F.sum(F.when(F.col("measure") == m, F.col("n")).otherwise(0))
    # both sides of a net-zero claim of partial scope counted the claim itself
    sums = answers.groupBy("doc_id", "claim_id").agg(of("over").alias("over"), of("high").alias("high"), of("year").alias("year"), (of("scope") - 2 * F.max("own")).alias("scope"))
    return sums.filter("over + year + scope > 0").select("doc_id", "claim_id", "high", (F.col("over") - F.col("high")).alias("medium"), "year", "scope")


def sin_columns(claims: DataFrame) -> DataFrame:
    """sin_<name>: the severity of each sin of a claim, or null."""
    n = F.col
    recognized = F.size("certs")
    severities = F.col("signals.severity")
    worst = F.when(F.array_contains(severities, "high"), "high").when(F.array_contains(severities, "medium"), "medium").when(F.size("signals") > 0, "low")
    no_scope3 = ~F.coalesce(F.array_contains("ghg_scope", 3), F.lit(False))
    return claims.withColumns({
        "sin_hidden_tradeoff": F.when((n("n_green") >= 1) & (n("n_scope") == 0) & no_scope3, F.when(n("n_green") >= 3, "medium").otherwise("low")),
        "sin_no_proof": F.when((n("n_green") >= 1) & (n("n_proof") == 0) & (recognized == 0), F.when(n("n_green") >= 3, "high").otherwise("medium")),
        "sin_vagueness": F.when((n("n_vague") >= 2) & ~n("quantified"), F.when(n("n_vague") >= 4, "high").when(n("n_vague") >= 3, "medium").otherwise("low")),
        "sin_false_labels": worst,
        "sin_irrelevance": F.when(matches(n("text"), CFC_FREE), "medium"),
    })


def sin_hits(claims: DataFrame, sins: list[str] = SINS) -> DataFrame:
    """Long form, with the sin's place in declared order."""
    hits = F.array_compact(F.array(*[F.when(F.col(f"sin_{s}").isNotNull(), F.struct(F.lit(s).alias("sin"), F.lit(i).alias("sin_ord"), F.col(f"sin_{s}").alias("severity"))) for i, s in enumerate(sins)]))
    return sin_columns(claims).select("doc_id", "ord", "claim_id", hits.alias("h")).transform(each, ["doc_id", "ord", "claim_id"], "h", "h").select("doc_id", "ord", "claim_id", "h.sin", "h.sin_ord", "h.severity")


def sin_summary(hits: DataFrame) -> DataFrame:
    """Hits by document and sin, with counts by severity and where the sin was first seen."""
    of = lambda s: F.count_if(F.col("severity") == s)
    return hits.groupBy("doc_id", "sin").agg(F.count("*").alias("hit_count"), of("high").alias("high"), of("medium").alias("medium"), of("low").alias("low"), F.min(F.struct("ord", "sin_ord")).alias("__f")).select("doc_id", "sin", "hit_count", "high", "medium", "low", F.col("__f.ord").alias("first_ord"), F.col("__f.sin_ord").alias("sin_ord"))


def consistency_summary(docs: DataFrame, counts: DataFrame, hits: DataFrame) -> DataFrame:
    """Contradictions and sin hits of each document of docs (zeros where there are none). Both claims of a
    contradiction have counted it."""
    e = counts.groupBy("doc_id").agg((F.sum(F.col("high") + F.col("medium") + F.col("year") + F.col("scope")) / 2).cast("long").alias("contradictions"))
    h = hits.groupBy("doc_id").agg(F.count("*").alias("sin_hits"))
    return docs.select("doc_id").distinct().join(e, "doc_id", "left").join(h, "doc_id", "left").fillna(0, ["contradictions", "sin_hits"])
