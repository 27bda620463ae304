"""Quality rules at the level of hosts.

Each document is tested against rules; failures are aggregated by host (here: `source`); the rate
of each host is shrunken towards the mean rate by a beta prior whose two parameters are estimated
from the counts of all hosts, as beta-binomial: what their rates differ by less what chance alone would make
them differ by. A host is distrusted when its posterior rate is above HOST_FACTOR times the mean with
a probability of about 99 % (SURE standard deviations of the posterior), and the verdict is joined back: of
a distrusted host only documents that pass every rule stay. So hosts are judged against each other,
whatever the rate of the whole corpus, and hosts that differ by chance alone are left alone.

Defined cases: a null or empty text has no words and fails the base rule; a null host is a host of
its own; no rows give no rows; with a single host, or hosts that differ no more than by chance, the prior is
the mean rate with weight PRIOR_MAX; repeated rows are judged and counted each; existing columns named
as the results are replaced."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_text_columns, without, written

SYMBOLS = "#*$%&|<>"
BLANK_CHARS = " \t\n\x0b\x0c\r"
WINDOW = 8
#: Soft rules, beside the base rule. They only count for hosts and within distrusted hosts.
MEAN_WORD = (2, 15)
#: A host is distrusted if its rate is above so many times the mean rate of failing documents, by so many
#: standard deviations of its posterior.
HOST_FACTOR, SURE = 1.2, 2.33
#: Bounds of the weight of the prior, in documents.
PRIOR_MIN, PRIOR_MAX = 2.0, 1000.0

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[bytes], doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Per document, words inside WINDOW-word windows that occur twice or more in it.

    Equal windows get equal numbers by doubling: from numbers of words to those of 2, 4 and 8 words,
    each from the pairs of numbers before it, so no hash can collide."""
    if len(words) < WINDOW:
        return np.zeros(n_docs, np.int64)
    number: dict[bytes, int] = {}
    word = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    rank = np.unique(doc * len(number) + word, return_inverse=True)[1]
    step = 1
    while step < WINDOW:
        pair = rank[:-step] * (rank.max() + 1) + rank[step:]
        if 2 * step < WINDOW:
            rank = np.unique(pair, return_inverse=True)[1]
        step *= 2
    _, rank, count = np.unique(pair, return_inverse=True, return_counts=True)
    twice = (count[rank] > 1) & (doc[: len(pair)] == doc[WINDOW - 1 :])
    # windows that cross documents can't equal one that doesn't: the numbers hold the document
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n_docs)


def text_stats(texts: list[str | None]) -> list:
    words: list[bytes] = []
    n_words, chars, symbols, dup = ([0] * len(texts) for _ in range(4))
    for i, t in enumerate(texts):
        if not t:
            continue
        own = t.encode("utf-8", "surrogatepass").split()  # bytes.split() knows ASCII blanks only
        words += own
        n_words[i] = len(own)
        chars[i] = len(t) - sum(map(t.count, BLANK_CHARS))
        symbols[i] = sum(map(t.count, SYMBOLS))
        lines = [x for x in t.split("\n") if x.strip(BLANK_CHARS)]
        dup[i] = len(lines) - len(set(lines))
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), n_words)
    return [n_words, chars, symbols, dup, repeated_words(words, doc, len(texts))]


def document_stats(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with the columns of STATS. One pass over whole texts, no shuffle."""
    return add_text_columns(docs, text_col, [T.StructField(c, T.LongType()) for c in STATS], lambda: text_stats, keep)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rule_failed() -> Column:
    """Any rule: the base rule, symbols over a tenth of the words, a mean word length outside MEAN_WORD,
    or over a third of the words' worth of repeated lines."""
    n = F.col("n_words")
    return base_failed() | (10 * F.col("n_symbols") > n) | (F.col("word_chars") < MEAN_WORD[0] * n) | (F.col("word_chars") > MEAN_WORD[1] * n) | (30 * F.col("n_dup_lines") > n)


def host_verdicts(stats: DataFrame, host: str) -> DataFrame:
    """One row per host: n, failed, rate (shrunken), distrusted. stats has a boolean rule_failed.

    Prior: k hosts of n_i documents, N in all, with mean rate m. S = sum n_i (p_i - m)^2 is, for hosts alike,
    (k - 1) m (1 - m) by chance; each unit of variance v of the true rates adds N - sum n_i^2 / N - (k - 1).
    So v follows from S; a + b = m (1 - m) / v - 1, kept within [PRIOR_MIN, PRIOR_MAX]; a = m (a + b). Only
    sums over hosts are needed, one row, joined by a constant."""
    hosts = stats.groupBy(F.col(host).alias("__host")).agg(F.count("*").alias("n"), F.sum(F.col("rule_failed").cast("long")).alias("failed"))
    d = lambda c: F.col(c).cast("double")
    sums = hosts.agg(F.count("*").cast("double").alias("k"), F.sum("n").cast("double").alias("t"), F.sum("failed").cast("double").alias("f"), F.sum(d("failed") * d("failed") / d("n")).alias("q"), F.sum(d("n") * d("n")).alias("nn"))
    sums = sums.withColumn("m", F.col("f") / F.col("t")).withColumn("noise", F.col("m") * (1 - F.col("m")))
    spread = (F.col("q") - F.col("f") * F.col("m") - (F.col("k") - 1) * F.col("noise")) / (F.col("t") - F.col("nn") / F.col("t") - (F.col("k") - 1))
    sums = sums.withColumn("v", F.when((F.col("t") - F.col("nn") / F.col("t") - (F.col("k") - 1)) > 0, spread))
    weight = F.when(F.col("v") > 1e-12, F.least(F.lit(PRIOR_MAX), F.greatest(F.lit(PRIOR_MIN), F.col("noise") / F.col("v") - 1))).otherwise(F.lit(PRIOR_MAX))
    rate = (F.col("failed") + F.col("m") * F.col("w")) / (F.col("n") + F.col("w"))
    with_prior = hosts.crossJoin(F.broadcast(sums.select("m", weight.alias("w")))).withColumn("rate", rate)  # one row
    low = F.col("rate") - SURE * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("w") + 1))
    return with_prior.select("__host", "n", "failed", "rate", (low > HOST_FACTOR * F.col("m")).alias("distrusted"))


def host_quality(docs: DataFrame, host: str = "source", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with STATS, base_failed, rule_failed, host_rate and kept. keep: columns of docs to carry.

    The statistics are written once to the shared folder and then read twice: for the hosts and for
    the verdicts. The join is on the host; Spark broadcasts the hosts if they are few, and else splits
    hot hosts at run time."""
    docs = without(docs, [*STATS, "base_failed", "rule_failed", "host_rate", "kept"])
    carried = list(dict.fromkeys([*(keep or docs.columns), host]))
    stats = document_stats(docs, text_col, carried).withColumn("base_failed", base_failed()).withColumn("rule_failed", rule_failed())
    stats = written(stats, "quality")
    verdicts = host_verdicts(stats, host).select("__host", F.col("rate").alias("host_rate"), F.col("distrusted").alias("__distrusted"))
    out = stats.join(verdicts, stats[host].eqNullSafe(verdicts["__host"]), "left")
    out = out.withColumn("kept", ~F.col("base_failed") & ~(F.col("__distrusted") & F.col("rule_failed")))
    return out.drop("__host", "__distrusted", *([] if keep is None or host in keep else [host]))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return host_quality(docs, keep=["doc_id"]).select("doc_id", *STATS, "base_failed", "kept", F.round("host_rate", 9).alias("host_rate"))


#: n_repeat_words by a window over word positions; everything else as in the contract.
STATS_SQL = r"""
docs AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, source, coalesce("text", '') AS t FROM {documents}),
words AS (SELECT r, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs),
windows AS (SELECT r, p, array_to_string(w[p:p + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS p FROM words)),
twice AS (SELECT r, unnest(ps) AS p FROM (SELECT r, list(p) AS ps FROM windows GROUP BY r, g HAVING count(*) > 1)),
covered AS (SELECT r, count(DISTINCT p + o) AS n FROM twice, range(8) AS k(o) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
stats AS (SELECT words.r, doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN lines ON words.r = lines.r LEFT JOIN covered ON words.r = covered.r),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 30 * n_dup_lines > n_words AS rule_failed FROM stats),
hosts AS (SELECT source, count(*) AS n, sum(rule_failed::BIGINT) AS failed FROM judged GROUP BY source),
sums AS (SELECT count(*)::DOUBLE AS k, sum(n)::DOUBLE AS t, sum(failed)::DOUBLE AS f, sum(failed::DOUBLE * failed / n) AS q, sum(n::DOUBLE * n) AS nn, f / t AS m, m * (1 - m) AS noise FROM hosts),
spread AS (SELECT m, noise, CASE WHEN t - nn / t - (k - 1) > 0 THEN (q - f * m - (k - 1) * noise) / (t - nn / t - (k - 1)) END AS v FROM sums),
prior AS (SELECT m, CASE WHEN v > 1e-12 THEN least(1000.0, greatest(2.0, noise / v - 1)) ELSE 1000.0 END AS w FROM spread),
verdicts AS (SELECT source, ((failed + m * w) / (n + w))::DOUBLE AS rate, rate - {sure}::DOUBLE * sqrt(rate * (1 - rate) / (n + w + 1)) > {factor}::DOUBLE * m AS distrusted FROM hosts, prior),
quality AS (SELECT judged.*, rate AS host_rate, NOT base_failed AND NOT (distrusted AND rule_failed) AS kept FROM judged LEFT JOIN verdicts ON judged.source IS NOT DISTINCT FROM verdicts.source)
"""


def stats_sql(documents: str) -> str:
    return STATS_SQL.format(documents=documents, factor=HOST_FACTOR, sure=SURE)


QUERIES = {"op4_quality_rules": op4_quality_rules}
ORACLE_SQL = {"op4_quality_rules": "WITH " + stats_sql("documents") + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, round(host_rate, 9) AS host_rate FROM quality"}
