"""Target-distribution importance resampling with bit-sliced aggregation.

Features are hashed runs of 1 to N words. The raw and the target corpus are counted by bucket in Spark
(each task sums its own texts first); from the sums follows a whole-number gain for each bucket. A document's
weight is the mean gain of its features. It is computed on bits: the counts of its buckets are written
as binary planes (bit j of every bucket's count), the gains as planes of their magnitude, one set for gains
and one for losses; count plane j AND gain plane k has as many ones as buckets in which both bits are
set, each worth 2**(j + k). The sum is exact.

A document's score is its weight plus seeded Gumbel noise, so the highest scores are a sample without
replacement in proportion to exp(weight / 1000). Ranks are distributed: scores are written, dealt by
ranges of (score, key), sorted, numbered in their part, and moved by the rows of the parts before.

Through the driver go one sum per bucket (BUCKETS of them, whatever the corpus) and no rows.

Defined cases: a null or empty text has no words, no features and weight 0; a null key is hashed as `null`
and comes last in ties; rows with equal score and key take ranks in any order; documents below min_words
are never drawn; an empty target has zero counts; no rows give no rows; existing columns named as the
results are replaced."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, sized, split_words, translated, without, written
from .decontamination import FOLD
from .sharding import CRC_SQL

BUCKETS = 10_000
GRAMS = 2
SEED = "7"
PERCENT = 25
MIN_WORDS = 20
#: Characters and (document, plane) rows that a task has at a time.
BATCH_CHARS, PLANE_ROWS = 4_000_000, 4096
RESULTS = ["n_words", "n_features", "weight", "score", "rank"]


class Crc:
    """crc32 of joined texts from the crc32 of their parts: crc(a + b) = after(crc(a), len(b)) ^ crc(b).

    after(x, n) runs x through n zero bytes. This is linear in the bits of x, so it is the exclusive or of
    one table entry for each byte of x: tables for n below 64, and for the powers of two from 64."""

    def __init__(self) -> None:
        x = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            x = (x >> np.uint32(1)) ^ np.where(x & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
        self.one = x
        byte = np.arange(256, dtype=np.uint32)
        tables = [np.stack([byte << np.uint32(8 * b) for b in range(4)])]
        for _ in range(64):
            t = tables[-1]
            tables.append((t >> np.uint32(8)) ^ self.one[t & np.uint32(255)])
        self.short = np.stack(tables[:64]).reshape(64, 1024)
        self.powers = [tables[64].reshape(1024)]

    @staticmethod
    def _look(table: np.ndarray, at: np.ndarray | int, x: np.ndarray) -> np.ndarray:
        out = table[at + (x & np.uint32(255))]
        for b in (1, 2, 3):
            out ^= table[at + (256 * b + (x >> np.uint32(8 * b) & np.uint32(255)))]
        return out

    def after(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = self._look(self.short.reshape(-1), (n & 63).astype(np.int64) * 1024, x)
        k, rest = 0, n >> 6
        while len(rest) and rest.max() >> k:
            if k == len(self.powers):
                self.powers.append(self._look(self.powers[-1], 0, self.powers[-1]))
            own = np.flatnonzero(rest >> k & 1)
            out[own] = self._look(self.powers[k], 0, out[own])
            k += 1
        return out


def features(texts: pa.Array, crc: Crc, buckets: int, grams: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, and the text and bucket of each feature (repeats included)."""
    words, index, bounds = split_words(translated(texts, FOLD))
    n_words = np.diff(bounds)
    doc = np.repeat(np.arange(len(n_words), dtype=np.int64), n_words)
    raw = words.cast(pa.large_binary()).to_pylist()
    own = np.fromiter((zlib.crc32(w) for w in raw), np.uint32, len(raw))[index]
    blank = np.fromiter((zlib.crc32(b" " + w) for w in raw), np.uint32, len(raw))[index]
    size = np.fromiter(map(len, raw), np.int64, len(raw))[index] + 1
    docs, hashes, run = [doc], [own], own
    for n in range(2, grams + 1):
        # a run of n words from each place: the run of n - 1, then a blank and the next word
        run = crc.after(run[:-1], size[n - 1 :]) ^ blank[n - 1 :]
        same = doc[: len(run)] == doc[n - 1 :]
        docs.append(doc[: len(run)][same])
        hashes.append(run[same])
    return n_words, np.concatenate(docs), (np.concatenate(hashes) % np.uint32(buckets)).astype(np.int64)


def text_batches(column: pa.Array):
    """Bounds of runs of texts of bounded size."""
    sizes = pc.fill_null(pc.binary_length(column.cast(pa.large_string())), 0).to_pylist()
    yield from sized(sizes, BATCH_CHARS)


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, grams: int = GRAMS) -> DataFrame:
    """bucket, n: at most `buckets` rows. A task sums all its texts before it sends anything."""

    def count(batches):
        crc, total = Crc(), np.zeros(buckets, np.int64)
        for batch in batches:
            for a, b in text_batches(batch.column(0)):
                total += np.bincount(features(batch.column(0).slice(a, b - a), crc, buckets, grams)[2], minlength=buckets)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(total[own], pa.int64())], names=["bucket", "n"])

    return docs.select(text_col).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, from counts of the raw and the target corpus."""
    counts = []
    for df in (raw, target):
        c = np.zeros(buckets, np.int64)
        for r in df.collect():  # one row per bucket at most
            c[r["bucket"]] = r["n"]
        counts.append(c)
    s, t = counts
    own, all_ = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((b + 1.0) * own / ((a + 1.0) * all_))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    return np.packbits(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64))), axis=1).view(np.uint64)


class Gains:
    """Gains as planes: plane k of gains (sign 1) and of losses (sign -1) has bit k of each magnitude."""

    def __init__(self, gains: np.ndarray):
        self.buckets, self.planes = len(gains), []
        for sign in (1, -1):
            size = np.maximum(sign * gains, 0)
            for k in range(int(size.max(initial=0)).bit_length()):
                self.planes.append((sign << k, packed((size >> k & 1).astype(bool)[None])[0]))

    def sums(self, doc: np.ndarray, bucket: np.ndarray, n_docs: int) -> np.ndarray:
        """For each document the sum of the gains of its features."""
        cell, count = np.unique(doc * self.buckets + bucket, return_counts=True)
        d, b = cell // self.buckets, cell % self.buckets
        out = np.zeros(n_docs, np.int64)
        for j in range(int(count.max(initial=0)).bit_length()):
            own = np.flatnonzero(count >> j & 1)
            # one plane for each document with this bit anywhere, some at a time; cells are sorted by document
            docs, start = np.unique(d[own], return_index=True)
            ends = np.append(start, len(own))
            for a in range(0, len(docs), PLANE_ROWS):
                z = min(a + PLANE_ROWS, len(docs))
                part = own[ends[a] : ends[z]]
                bits = np.zeros((z - a, self.buckets), bool)
                bits[np.searchsorted(docs[a:z], d[part]), b[part]] = True
                plane, total = packed(bits), np.zeros(z - a, np.int64)
                for value, gain in self.planes:
                    total += value * np.bitwise_count(plane & gain).sum(1, dtype=np.int64)
                out[docs[a:z]] += total << j
        return out


def noise(key, seed: str = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray, key: str = "doc_id", text_col: str = "text", keep: Sequence[str] | None = None, grams: int = GRAMS, seed: str = SEED) -> DataFrame:
    """docs with n_words, n_features, weight and score."""
    docs = without(docs, RESULTS)
    kept = [c for c in docs.columns if keep is None or c in keep]
    frame = docs.select(*kept, F.col(key).cast("string").alias("__key"), F.col(text_col).alias("__text"))
    schema = T.StructType([*[frame.schema[c] for c in kept], *[T.StructField(c, T.LongType()) for c in RESULTS[:-1]]])
    sent = frame.sparkSession.sparkContext.broadcast(gains)  # one number per bucket

    def run(batches):
        crc, own = Crc(), Gains(sent.value)
        for batch in batches:
            keys, texts = batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1)
            for a, b in text_batches(texts):
                n_words, doc, bucket = features(texts.slice(a, b - a), crc, own.buckets, grams)
                n = np.bincount(doc, minlength=b - a)
                weight = own.sums(doc, bucket, b - a) // np.maximum(n, 1)
                score = weight + np.fromiter((noise(k, seed) for k in keys[a:b]), np.int64, b - a)
                new = [pa.array(x, pa.int64()) for x in (n_words, n, weight, score)]
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in range(len(kept))], *new], names=schema.names)

    return frame.mapInArrow(run, schema)


def ranked(rows: DataFrame, key: str = "doc_id", percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """rows with rank: 1, 2, ... for the highest scores among those of min_words, null for rows that aren't drawn."""
    spark = rows.sparkSession
    rows = written(rows.withColumn("__row", F.monotonically_increasing_id()), "scores")  # __row tells equal rows apart
    able = F.col("n_words") >= min_words
    order = [F.desc("score"), F.asc_nulls_last(key), F.asc("__row")]
    parts = rows.filter(able).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    parts = written(parts.withColumn("__at", F.monotonically_increasing_id()), "ranges")  # number of the part, place in it
    parts = parts.withColumns({"__part": F.shiftright("__at", 33), "__place": F.col("__at").bitwiseAND((1 << 33) - 1)})
    counts = parts.groupBy("__part").agg(F.count("*").alias("__c"))  # one row for each part
    before = counts.select("__part", (F.sum("__c").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__c")).alias("__before"))
    total = counts.agg(F.coalesce(F.sum("__c"), F.lit(0)).alias("__n"))
    placed = parts.join(before, "__part").crossJoin(F.broadcast(total))  # one row
    rank = F.col("__before") + F.col("__place") + 1
    drawn = placed.withColumn("rank", F.when(rank <= F.expr(f"{int(percent)} * __n div 100"), rank))
    rest = rows.filter(~able).withColumn("rank", F.lit(None).cast("long"))
    names = [c for c in rows.columns if c != "__row"]
    return drawn.select(*names, "rank").unionByName(rest.select(*names, "rank"))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text_col: str = "text", target_text_col: str = "text", keep: Sequence[str] | None = None, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, grams: int = GRAMS, seed: str = SEED) -> DataFrame:
    """docs with n_words, n_features, weight, score and rank; the drawn ones have a rank."""
    gains = bucket_gains(bucket_counts(docs, text_col, buckets, grams), bucket_counts(target, target_text_col, buckets, grams), buckets)
    return ranked(scored(docs, gains, key, text_col, keep, grams, seed), key, percent, min_words)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs.select("doc_id", "text"), bench, keep=["doc_id"]).select("doc_id", "n_features", "weight", "score", "rank")


def _features_sql(table: str, key: str) -> str:
    """Rows (key, g, n_words) of all features of a table."""
    return rf"""SELECT k, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS t
  FROM (SELECT {key} AS k, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table})"""


QUERIES = {"op11_importance": op11_importance}
ORACLE_SQL = {
    "op11_importance": rf"""WITH own AS ({_features_sql("documents", "doc_id")}), tests AS ({_features_sql("benchmark", "item_id")}),
hashed AS (SELECT t, ({CRC_SQL})::BIGINT % {BUCKETS} AS bucket FROM (SELECT t FROM own UNION SELECT t FROM tests)),
s AS (SELECT bucket, count(*) AS s FROM own JOIN hashed USING (t) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM tests JOIN hashed USING (t) GROUP BY bucket),
sums AS (SELECT (SELECT count(*) FROM own) AS all_s, (SELECT count(*) FROM tests) AS all_t),
gains AS (SELECT s.bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (all_s + {BUCKETS})::DOUBLE) / ((s + 1)::DOUBLE * (all_t + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t ON s.bucket = t.bucket, sums),
weights AS (SELECT k, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM own JOIN hashed USING (t) JOIN gains USING (bucket) GROUP BY k),
scores AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score,
  coalesce(n, 0) + {GRAMS - 1} >= {GRAMS} * {MIN_WORDS} AS able FROM documents LEFT JOIN weights ON k = doc_id),
places AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY able) AS able_n FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= {PERCENT} * able_n // 100 THEN place END AS rank FROM places"""
}
