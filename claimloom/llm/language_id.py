"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams in Spark, one row per (language, bucket); the driver gets at most CELLS sums, a
bound that no corpus size changes: there are 2**16 buckets, and fewer where there are more than 256
languages. Every language of the labels is learned; over MAX_LANGS of them are an error, not a cut.
Prediction broadcasts the matrix of log-probabilities and scores each batch from its sparse (document,
bucket) entries in numpy.

Defined cases: null text, or a text without any letter -> `und` with score 0; null lang or null
text is never learned from; no labelled row at all -> every text with letters is `und`, score 0;
ties go to the language that sorts first; repeated rows count and are scored each; existing columns
named as the results are replaced."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_text_columns, sub_batches

NGRAMS = (1, 2, 3)
BITS = 16
#: At most about so many documents of each language are learned from (all, where there are fewer).
TRAIN_DOCS_PER_LANG = 5000
#: Entries of the matrix at most, and languages.
CELLS, MAX_LANGS = 1 << 24, 1 << 15
CHUNK = 1 << 20

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts with each run of non-letters as one blank, and each one's text."""
    low = [" " + t.lower() + " " if t else " " for t in texts]
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(low), dtype=np.int64), [len(t) for t in low])
    code = np.where(letter_table()[code], code, np.uint32(32))
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32) | (doc[1:] != doc[:-1])
    return code[keep], doc[keep]


def ngram_entries(code: np.ndarray, doc: np.ndarray, bits: int):
    """(document, bucket) entries of all n-grams, in pieces of bounded size."""
    for start in range(0, len(code), CHUNK):
        for n in NGRAMS:
            c, d = code[start : start + CHUNK + n - 1], doc[start : start + CHUNK + n - 1]
            m = len(c) - n + 1
            if m <= 0:
                continue
            h = np.full(m, n, np.uint64)
            for j in range(n):
                h = h * np.uint64(1_000_003) + c[j : j + m]
            ok = d[:m] == d[n - 1 :]
            if n == 1:
                ok &= c != 32
            h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
            yield d[:m][ok], h[ok].astype(np.int64)


@dataclass
class Model:
    langs: list[str]
    bits: int
    log_prior: np.ndarray
    log_prob: np.ndarray  # languages x buckets


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", bits: int = BITS, per_lang: int = TRAIN_DOCS_PER_LANG, alpha: float = 0.05) -> Model:
    """Fit on about per_lang documents of each language: a language's share of rows is cut by a hash of
    the text, so the choice doesn't depend on order or partitions."""
    labelled = docs.select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("g")).filter("t IS NOT NULL AND g IS NOT NULL")
    sizes = {r.g: r.n for r in labelled.groupBy("g").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()}
    langs = sorted(sizes)
    if len(langs) > MAX_LANGS:
        raise ValueError(f"over {MAX_LANGS} different labels: they are no languages")
    if not langs:
        return Model([], bits, np.zeros(0), np.zeros((0, 1 << bits), np.float32))
    bits = min(bits, (CELLS // len(langs)).bit_length() - 1)
    share = F.create_map(*[F.lit(x) for g in langs for x in (g, min(1.0, per_lang / sizes[g]))])
    sample = labelled.filter(F.pmod(F.xxhash64("t"), F.lit(1_000_000)) < share[F.col("g")] * 1_000_000)
    index = {g: i for i, g in enumerate(langs)}

    def count(batches):
        for batch in batches:
            texts, of = batch.column(0).to_pylist(), np.array([index[g] for g in batch.column(1).to_pylist()], np.int64)
            for a, b in sub_batches(texts):
                code, doc = encode(texts[a:b])
                for d, h in ngram_entries(code, doc, bits):
                    cell, n = np.unique((of[a:b][d] << bits) + h, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(cell >> bits, pa.int32()), pa.array(cell & (1 << bits) - 1, pa.int32()), pa.array(n, pa.int64())], names=["g", "h", "n"])

    sums = sample.mapInArrow(count, "g int, h int, n long").groupBy("g", "h").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((len(langs), 1 << bits))
    table[sums.g, sums.h] = sums.n
    log_prob = np.log(table + alpha) - np.log(table.sum(1, keepdims=True) + alpha * table.shape[1])
    prior = np.array([sizes[g] for g in langs], float)
    return Model(langs, bits, np.log(prior / prior.sum()), log_prob.astype(np.float32))


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with lang_pred and score (the posterior of the best language)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def f(texts: list) -> list:
            code, doc = encode(texts)
            letters = np.bincount(doc[code != 32], minlength=len(texts)) > 0
            if not m.langs:
                return [["und"] * len(texts), np.zeros(len(texts))]
            total = np.tile(m.log_prior, (len(texts), 1))
            for d, h in ngram_entries(code, doc, m.bits):
                for g in range(len(m.langs)):
                    total[:, g] += np.bincount(d, m.log_prob[g][h], minlength=len(texts))
            best = total.argmax(1)
            score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            return [[m.langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], np.where(letters, score, 0.0)]

        return f

    return add_text_columns(docs, text_col, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], make, keep)


def held_out(doc_id: Column) -> Column:
    """A third of the documents, by their id alone; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    out = predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op1_language_id": op1_language_id}
ORACLE_SQL: dict[str, str] = {}
