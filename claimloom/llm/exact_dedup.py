"""Exact dedup with salted combining, with DataFrame functions only.

Texts are equal when they are identical without their blanks. Three aggregations, each grouped by digest
*and* full normalised text, so no digest alone ever decides:

1. locally: the map side of the first aggregation keeps one row per text and task;
2. salted: these rows meet by (digest, text, salt), the salt being the task's number modulo SALTS, so
   a text that every task holds is merged by SALTS tasks, each of which gets one row per task;
3. globally: the at most SALTS winners of a text meet by digest.

Of equal texts the row with the most code points in the original text stays, then the smallest key, a
null key being larger than any other; of rows that are still equal, one. The winners are a narrow
table; the documents find theirs by digest, without moving their texts again. Digests that stand for
several texts are told by a count, and their documents are joined by digest and text.

Defined cases: a null text is an empty one, equal to all texts of blanks only; repeated rows count, and
one of them stays; no rows give no rows; existing columns named as the results are replaced."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import without, written

BLANK_CHARS = " \t\n\x0b\x0c\r"
#: A text's rows from all tasks are first merged in so many groups.
SALTS = 32
RESULTS = ["keep_id", "group_size", "kept", "text_sha256"]


def normalised(text_col: str = "text") -> Column:
    return F.translate(F.coalesce(F.col(text_col), F.lit("")), BLANK_CHARS, "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def combined(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row for each text of rows (__d digest, __n text, __len, __id): __g, a number of its own, __d, __texts
    (texts of this digest), __n where there are several, __best (the row that stays), group_size. Written."""
    best = F.struct((-F.col("__len")).alias("neg"), F.col("__id").isNull().alias("no_id"), F.col("__id").alias("id"))
    salted = rows.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(salts))).groupBy("__d", "__n", "__salt").agg(F.min(best).alias("__best"), F.count("*").alias("__c"))
    texts = salted.repartition("__d").groupBy("__d", "__n").agg(F.min("__best").alias("__best"), F.sum("__c").alias("group_size"))
    texts = texts.withColumn("__texts", F.count("*").over(Window.partitionBy("__d")))  # already dealt and sorted so
    return written(texts.select(F.monotonically_increasing_id().alias("__g"), "__d", "__texts", F.when(F.col("__texts") > 1, F.col("__n")).alias("__n"), "__best", "group_size"), "texts")


def exact_dedup(docs: DataFrame, key: str = "doc_id", text_col: str = "text", keep: Sequence[str] | None = None, salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256. keep: the columns of docs that remain (all)."""
    docs = without(docs, RESULTS)
    carried = [c for c in docs.columns if keep is None or c in keep]
    rows = docs.select(*carried, F.col(key).alias("__id"), normalised(text_col).alias("__n"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("__len"))
    rows = rows.withColumns({"__d": digest(F.col("__n")), "text_sha256": F.sha2("__n", 256)})
    groups = combined(rows.select("__id", "__n", "__len", "__d"), salts)
    found = rows.drop("__n").join(groups.filter("__texts = 1").drop("__n"), "__d")
    if not groups.filter("__texts > 1").isEmpty():
        found = found.unionByName(rows.join(groups.filter("__texts > 1"), ["__d", "__n"]).drop("__n"))
    stays = (F.col("__len") == -F.col("__best.neg")) & F.col("__id").eqNullSafe(F.col("__best.id"))
    found = written(found.select(*carried, F.col("__best.id").alias("keep_id"), "group_size", "text_sha256", "__g", stays.alias("__stays"), F.monotonically_increasing_id().alias("__row")), "verdicts")
    # rows that tie with the one that stays: the first of them by its number in the written table
    first = found.filter("__stays").groupBy("__g").agg(F.min("__row").alias("__row")).select("__row", F.lit(True).alias("__first"))
    out = found.join(first, "__row", "left")
    return out.select(*carried, "keep_id", "group_size", F.coalesce("__first", F.lit(False)).alias("kept"), "text_sha256")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs, keep=["doc_id"])


QUERIES = {"op12_exact_dedup": op12_exact_dedup}
ORACLE_SQL = {
    "op12_exact_dedup": r"""WITH docs AS (SELECT doc_id, length(coalesce("text", '')) AS n, regexp_replace(coalesce("text", ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM docs WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id)"""
}
