"""Line dedup with levelled sorted runs, with DataFrame functions only.

A LineStore holds runs: tables of (line_hash, n_docs) sorted by hash, each hash once per run. A new
batch of documents counts its distinct lines per document, merge-anti-joins the hashes that the runs
have already shown to be frequent (their verdict can't change, so hot lines aren't counted again)
and adds the rest as a run of its own at level 0. FANOUT runs of a level are merged into one of the
next. Frequent are the hashes whose counts over all runs reach min_docs.

Only 16-byte hashes and counts are shuffled for counting, summed per task first; applying the
verdict sends each document's own distinct hashes to the frequent ones, and what must go back to the
documents. Hot lines are split by Spark's handling of skewed joins, so they need no cap.

Defined cases: null or empty text is one empty line; keys shorter than min_chars never go; repeated
documents (equal rows, too) count as documents; no rows give no rows; existing columns named as the
results are replaced."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, without, written

MIN_DOCS = 10
MIN_CHARS = 1
FANOUT = 2
BATCHES = 4

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines(text_col: str = "text") -> Column:
    return F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), UPPER, LOWER)


def line_hash(line: Column) -> Column:
    return F.unhex(F.md5(line_key(line)))


def countable(text_col: str, min_chars: int) -> Column:
    """The distinct hashes of a document's lines, without those of short keys."""
    return F.array_distinct(F.transform(F.filter(F.transform(lines(text_col), line_key), lambda k: F.length(k) >= min_chars), lambda k: F.unhex(F.md5(k))))


@dataclass
class LineStore:
    """Runs by level; levels[i] are the run tables of level i."""

    spark: SparkSession
    min_docs: int = MIN_DOCS
    min_chars: int = MIN_CHARS
    levels: list[list[DataFrame]] = field(default_factory=list)

    def _run(self, df: DataFrame) -> DataFrame:
        path = new_path(self.spark, "run")
        df.repartition("line_hash").sortWithinPartitions("line_hash").write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema("line_hash binary, n_docs long").parquet(path)

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def counts(self) -> DataFrame | None:
        runs = self.runs()
        if not runs:
            return None
        out = runs[0]
        for r in runs[1:]:
            out = out.unionByName(r)
        return out.groupBy("line_hash").agg(F.sum("n_docs").alias("n_docs"))

    def frequent(self) -> DataFrame:
        counts = self.counts()
        if counts is None:
            return self.spark.createDataFrame([], "line_hash binary, n_docs long")
        return counts.filter(F.col("n_docs") >= self.min_docs)

    def add(self, docs: DataFrame, text_col: str = "text") -> None:
        """Count a batch of documents into the store."""
        batch = docs.select(F.explode(countable(text_col, self.min_chars)).alias("line_hash")).groupBy("line_hash").agg(F.count("*").alias("n_docs"))
        if self.levels:
            batch = batch.join(self.frequent(), "line_hash", "left_anti")
        self.levels = [[*(self.levels[0] if self.levels else []), self._run(batch)], *self.levels[1:]]
        level = 0
        while len(self.levels[level]) > FANOUT:
            merged = self.levels[level][0]
            for r in self.levels[level][1:]:
                merged = merged.unionByName(r)
            merged = self._run(merged.groupBy("line_hash").agg(F.sum("n_docs").alias("n_docs")))
            self.levels[level] = []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(merged)
            level += 1


def drop_lines(docs: DataFrame, frequent: DataFrame, key: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with text less its frequent lines, n_lines and n_dropped.

    The documents that hold a frequent line get the hashes to drop by a join on a row identity: the
    key together with a hash of the text, so repeated or null keys do no harm."""
    docs = without(docs, ["n_lines", "n_dropped"])
    columns = docs.columns
    rows = docs.withColumns({"__k": F.coalesce(F.col(key).cast("string"), F.lit("null")), "__t": F.xxhash64(F.coalesce(text_col, F.lit("")))})
    own = rows.select("__k", "__t", F.explode(countable(text_col, min_chars)).alias("line_hash"))
    bad = own.join(frequent.select("line_hash"), "line_hash", "left_semi").groupBy("__k", "__t").agg(F.collect_set("line_hash").alias("__bad"))
    rows = rows.join(bad, ["__k", "__t"], "left")
    kept = F.when(F.col("__bad").isNull(), lines(text_col)).otherwise(F.filter(lines(text_col), lambda x: ~((F.length(line_key(x)) >= min_chars) & F.array_contains(F.col("__bad"), line_hash(x)))))
    out = rows.withColumn("__kept", kept).withColumn("n_lines", F.size(lines(text_col)).cast("long")).withColumn("n_dropped", (F.col("n_lines") - F.size("__kept")).cast("long"))
    text = F.when(F.col(text_col).isNull(), F.col(text_col)).otherwise(F.array_join("__kept", "\n"))
    return out.select(*[text.alias(c) if c == text_col else F.col(c) for c in columns], "n_lines", "n_dropped")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text_col: str = "text", batches: int = BATCHES, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """All of docs through a LineStore in batches (by a hash of the key), then the verdict over all lines."""
    store = LineStore(docs.sparkSession, min_docs, min_chars)
    batch = F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("null"))), F.lit(batches))
    for b in range(batches):
        store.add(docs.filter(batch == b), text_col)
    return drop_lines(docs, written(store.frequent(), "frequent"), key, text_col, min_chars)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


LINES_SQL = r"""lrows AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce("text", ''), chr(10)) AS ls FROM {documents}),
llines AS (SELECT r, generate_subscripts(ls, 1) AS p, unnest(ls) AS line FROM lrows),
lkeys AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM llines),
frequent AS (SELECT k FROM lkeys WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10),
judged AS (SELECT lkeys.*, frequent.k IS NOT NULL AS gone FROM lkeys LEFT JOIN frequent ON lkeys.k = frequent.k),
cleaned AS (SELECT r, count(*) AS n_lines, sum(gone::BIGINT)::BIGINT AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '') AS kept FROM judged GROUP BY r)
"""

QUERIES = {"op8_line_dedup": op8_line_dedup}
ORACLE_SQL = {"op8_line_dedup": "WITH " + LINES_SQL.format(documents="documents") + "SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM cleaned JOIN lrows USING (r)"}
