"""Mixing sources to target weights by temperature, with DataFrame functions only.

A source with the share p of all tokens gets the weight p**a / sum(p**a). The exponent a is bisected
over k / 2**STEPS: the smallest a (the flattest mixture) for which no source is repeated more than
max_repeats times. Or, with target_entropy, the largest a whose weights reach that part of the
entropy of equal weights, but never an a below the repetition limit. The budget gives the most
repeated-down source exactly one pass, so no document is left out: weights below the natural share
are reached by repeating the others. A budget in tokens can be given instead.

Weights become rows as budgeted block permutations: rows of a source are dealt into blocks by a
seeded hash; for a partial pass the blocks are permuted (and the rows inside them) by another hash
and taken while the tokens taken before stay below the rest of the budget; full passes take all.

Token sums by source are aggregated in Spark; each bisection job evaluates 15 inner points of the
bracket (four halvings) and returns one number. Cumulated tokens come from block sums and from
windows inside blocks, which stay small, so a hot source meets in no task.

Defined cases: a null source is a source of its own; null and empty texts have one token, so that
each row counts; one source gives the weight 1; no rows give no rows; repeated rows are mixed like
any others; existing columns named as the results are replaced."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANKS, without, written
from .sharding import leading, seeded

SEED = "mix-1"
STEPS = 20
MAX_REPEATS = 2.0


def source_shares(rows: DataFrame) -> DataFrame:
    """__s, __tokens, __p of each source."""
    sums = rows.groupBy("__s").agg(F.sum("__tok").alias("__tokens"))
    total = sums.agg(F.sum("__tokens").alias("__all"))
    return sums.crossJoin(F.broadcast(total)).select("__s", "__tokens", (F.col("__tokens") / F.col("__all")).alias("__p"))  # total is one row


def bisected(shares: DataFrame, fits) -> float:
    """The smallest a = k / 2**STEPS in [0, 1] with fits(sums at a); fits must hold from some a on.

    shares: the written table of sources. fits gets columns a, z = sum(p**a), zlog = sum(p**a * ln p),
    top (largest p), low (smallest p), n."""
    lo, hi = -1, 1 << STEPS  # lo fails or is below all, hi fits
    while hi - lo > 1:
        points = sorted({lo + (hi - lo) * i // 16 for i in range(1, 16)} - {lo, hi})
        if not points:
            points = [lo + 1]
        a = F.explode(F.array(*[F.lit(k) for k in points])).alias("k")
        at = shares.select("__p", a).withColumn("a", F.col("k") / float(1 << STEPS))
        power = F.pow("__p", F.col("a"))
        sums = at.groupBy("k", "a").agg(F.sum(power).alias("z"), F.sum(power * F.log("__p")).alias("zlog"), F.max("__p").alias("top"), F.min("__p").alias("low"), F.count("*").alias("n"))
        best = sums.filter(fits).agg(F.min("k")).first()[0]
        if best is None:
            lo = points[-1]
        else:
            hi, lo = best, max([lo, *[k for k in points if k < best]])
    return hi / float(1 << STEPS)


def repeats_within(limit: float):
    """One pass of the largest source: a source of share p is repeated (top / p)**(1 - a) times."""
    return F.pow(F.col("top") / F.col("low"), 1 - F.col("a")) <= limit


def entropy_below(part: float):
    """Entropy of w = p**a / z is ln z - a * zlog / z; it falls as a grows."""
    return F.log("z") - F.col("a") * F.col("zlog") / F.col("z") < part * F.log("n")


def temperature_mix(docs: DataFrame, source: str = "source", text_col: str = "text", key: str = "doc_id", max_repeats: float = MAX_REPEATS, target_entropy: float | None = None, budget: int | None = None, seed: str = SEED) -> DataFrame:
    """docs with n_tokens, epoch (0-based pass), weight and repeats of its source; a row for each pass that takes it."""
    docs = without(docs, ["n_tokens", "epoch", "weight", "repeats"])
    columns = docs.columns
    n_blocks = math.isqrt(max(0, docs.count() - 1)) + 1  # as many blocks as rows in a block
    tokens = F.greatest(F.lit(1), F.size(F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), BLANKS + "+"), lambda w: w != ""))).cast("long")
    rows = docs.withColumns({"__tok": tokens, "__t": F.xxhash64(*columns), "__s": F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n")), "__h": seeded(seed, key)})
    shares = written(source_shares(rows.select("__s", "__tok")), "shares")
    a = bisected(shares, repeats_within(max_repeats))
    if target_entropy is not None:
        first_below = bisected(shares.unionByName(shares.limit(0)), entropy_below(target_entropy) | (F.col("a") >= 1))
        a = max(a, first_below - 1 / float(1 << STEPS))
    w = F.pow("__p", F.lit(a))
    sums = shares.agg(F.sum(w).alias("__z"), F.max(F.col("__p")).alias("__top"), F.sum("__tokens").alias("__all"), F.max(w).alias("__wtop"))
    # one pass of the largest source: budget = all * top * z / top**a
    whole = F.lit(float(budget)) if budget is not None else F.col("__all") * F.col("__top") * F.col("__z") / F.col("__wtop")
    plan = shares.crossJoin(F.broadcast(sums)).select("__s", (w / F.col("__z")).alias("weight"), F.round(w / F.col("__z") * whole / F.col("__tokens"), 9).alias("repeats"), "__tokens")  # sums is one row
    plan = plan.withColumn("__full", F.floor("repeats").cast("int")).withColumn("__rest", F.floor((F.col("repeats") - F.col("__full")) * F.col("__tokens")).cast("long"))

    # blocks of the partial pass, in permuted order, with the tokens of the blocks before
    rows = rows.withColumn("__b", (leading("__h") * n_blocks / F.lit(float(1 << 32))).cast("int"))
    rows = rows.withColumn("__o", F.md5(F.concat(F.col("__h"), F.lit("|partial"))))
    blocks = rows.groupBy("__s", "__b").agg(F.sum("__tok").alias("__bt"))
    blocks = blocks.withColumn("__bo", F.md5(F.concat(F.lit(seed + "|"), F.col("__s"), F.lit("|"), F.col("__b").cast("string"))))
    blocks = blocks.withColumn("__before", F.sum("__bt").over(Window.partitionBy("__s").orderBy("__bo").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__bt"))
    plan = blocks.join(plan, "__s").select("__s", "__b", "__before", "weight", "repeats", "__full", "__rest")
    inside = Window.partitionBy("__b", "__s").orderBy("__o", "__t").rowsBetween(Window.unboundedPreceding, 0)
    taken = rows.withColumn("__in", F.sum("__tok").over(inside) - F.col("__tok")).join(plan, ["__b", "__s"])
    partial = (F.col("__before") + F.col("__in") < F.col("__rest")).cast("int")
    taken = taken.withColumn("__n", F.col("__full") + partial).filter("__n > 0")
    return taken.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).select(*columns, F.col("__tok").alias("n_tokens"), "epoch", "weight", "repeats")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = temperature_mix(docs)
    return out.select("doc_id", "source", "n_tokens", "epoch", F.round("weight", 9).alias("weight"), F.round("repeats", 6).alias("repeats"))


#: The bisection as the smallest k by a walk of halvings in a recursive query.
MIX_SQL = r"""mdocs AS (SELECT *, coalesce('s' || source, 'n') AS s, md5('{seed}|' || coalesce(doc_id::VARCHAR, 'null')) AS h,
  greatest(1, len(list_filter(regexp_split_to_array(coalesce("text", ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')))::BIGINT AS tok FROM {documents}),
mshares AS (SELECT s, sum(tok)::BIGINT AS tokens, sum(tok)::DOUBLE / (SELECT sum(tok)::DOUBLE FROM mdocs) AS p FROM mdocs GROUP BY s),
mrange AS (SELECT max(p) AS top, min(p) AS low, sum(tokens)::DOUBLE AS all_tokens FROM mshares),
halving AS (SELECT -1 AS lo, {steps} AS hi UNION ALL
  SELECT CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END FROM (
    SELECT lo, hi, (lo + hi) // 2 AS mid, pow(top / low, 1 - ((lo + hi) // 2) / {steps}.0::DOUBLE) <= {repeats} AS ok FROM halving, mrange WHERE hi - lo > 1)),
exponent AS (SELECT min(hi) / {steps}.0::DOUBLE AS a FROM halving),
mweights AS (SELECT s, tokens, p, pow(p, a) AS w FROM mshares, exponent),
msums AS (SELECT sum(w) AS z, max(w) AS wtop FROM mweights),
mplan AS (SELECT s, tokens, w / z AS weight, round(w / z * (all_tokens * top * z / wtop) / tokens, 9) AS repeats FROM mweights, msums, mrange),
mfull AS (SELECT *, floor(repeats)::INT AS passes, floor((repeats - floor(repeats)) * tokens)::BIGINT AS rest FROM mplan),
mrows AS (SELECT *, ('0x' || h[1:8])::BIGINT * (SELECT ceil(sqrt(count(*)))::BIGINT FROM mdocs) // 4294967296 AS b, md5(h || '|partial') AS o FROM mdocs),
mblocks AS (SELECT s, b, sum(sum(tok)) OVER (PARTITION BY s ORDER BY md5('{seed}|' || s || '|' || b)) - sum(tok) AS before FROM mrows GROUP BY s, b),
mtaken AS (SELECT r.*, weight, repeats, passes + (before + sum(tok) OVER (PARTITION BY r.s, r.b ORDER BY o ROWS UNBOUNDED PRECEDING) - tok < rest)::INT AS n
  FROM mrows r JOIN mblocks k ON r.s = k.s AND r.b = k.b JOIN mfull f ON r.s = f.s),
mixed AS (SELECT *, unnest(range(n))::INT AS epoch FROM mtaken)
"""

QUERIES = {"op3_mixing": op3_mixing}
ORACLE_SQL = {
    "op3_mixing": "WITH RECURSIVE " + MIX_SQL.format(seed=SEED, steps=1 << STEPS, repeats=MAX_REPEATS, documents="documents") + "SELECT doc_id, source, tok AS n_tokens, epoch, round(weight, 9) AS weight, round(repeats, 6) AS repeats FROM mixed"
}
