"""Benchmark decontamination by winnowing.

Of each window of W consecutive K-gram hashes the minimum is kept as a fingerprint, on both sides;
two texts that share K + W - 1 words in a row share a fingerprint, so with K + W - 1 = 10 no shared
10-word window is missed. Items of fewer than 10 words are one window each; their few lengths are
looked up as whole n-grams.

The windows of the test items are a table that Spark makes: length, hash, fingerprint, words, items.
Documents look for fingerprints in numpy: their distinct hashes go to the tasks as sorted arrays, at most
BLOCK windows at once (24 bytes each); with more, documents are read once per block, so what a
task holds is bounded for any test set. A found fingerprint is extended to the windows around it whose
hash is known. These candidates, of which clean text has hardly any, are rows: Spark joins them with
the table on length and hash, confirms them word by word, and gathers spans and items per document.
Documents without a candidate are never shuffled; a passage that very many documents share is a
hot key of that join only, which Spark broadcasts or splits by size.

Defined cases: a null or empty text has no words and is clean; items without words match nothing; a
null item_id counts as the id `null`; equal ids are one item; no items: all clean; repeated
documents are judged each; existing columns named as the results are replaced."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_text_columns, without, written

WINDOW = 10
K = 5
W = WINDOW - K + 1
#: Windows of the test items whose hashes are broadcast at once.
BLOCK = 1 << 21

#: Lower-cases A-Z; every other ASCII character than a-z and 0-9 becomes a blank.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c > 127 else 32 for c in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """xxh64 of words, remembered up to a bound."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[w] = h = xxhash.xxh64_intdigest(w)
        return h


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def gram_hashes(word: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    if len(word) < n:
        return np.zeros(0, np.uint64)
    m = len(word) - n + 1
    h = np.full(m, n, np.uint64)
    for j in range(n):
        h = (h ^ word[j : j + m]) * MIX
        h ^= h >> np.uint64(29)
    return h


def minima(h: np.ndarray) -> np.ndarray:
    """Which K-grams are the minimum of a window of W (all of equal ones; one shorter window if there are fewer)."""
    if len(h) <= W:
        return h == h.min() if len(h) else np.zeros(0, bool)
    m = len(h) - W + 1
    low = h[:m].copy()
    for j in range(1, W):
        np.minimum(low, h[j : j + m], out=low)
    keep = np.zeros(len(h), bool)
    for j in range(W):
        keep[j : j + m] |= h[j : j + m] == low
    return keep


TESTS = "n int, g long, print long, words binary, item string"


def test_windows(bench: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """n, g (hash), print (fingerprint of a window of WINDOW words), words and item of all windows of the items, written."""

    def windows(batches):
        hashes = Hashes()
        for batch in batches:
            for item, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words = words_of(text)
                if not words:
                    continue
                n = min(WINDOW, len(words))
                h = np.array([hashes[w] for w in words], np.uint64)
                g, prints = gram_hashes(h, n), np.zeros(len(words) - n + 1, np.uint64)
                if n == WINDOW:
                    grams = gram_hashes(h, K)
                    prints = sliding_window_view(grams, W).min(1)
                for a in range(0, len(g), 50_000):
                    own = slice(a, a + 50_000)
                    m = len(g[own])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([n] * m, pa.int32()), pa.array(g[own].view(np.int64)), pa.array(prints[own].view(np.int64)), pa.array([b" ".join(words[i : i + n]) for i in range(a, a + m)], pa.binary()), pa.array([item] * m, pa.string())],
                        names=["n", "g", "print", "words", "item"],
                    )

    rows = bench.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).alias("t"))
    return written(rows.mapInArrow(windows, TESTS).distinct(), "windows")


class Known:
    """The hashes of a block of windows, by length, and the fingerprints of those of WINDOW words."""

    def __init__(self, n: np.ndarray, g: np.ndarray, prints: np.ndarray):
        self.grams = {int(k): np.unique(g[n == k].view(np.uint64)) for k in np.unique(n)}
        self.prints = np.unique(prints[n == WINDOW].view(np.uint64))


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known) or not len(values):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def candidates(words: list[bytes], hashes: Hashes, known: Known) -> list[tuple[int, int, int, bytes]]:
    """Windows with a known hash: length, start, hash, words."""
    if not words:
        return []
    word, out = np.fromiter((hashes[w] for w in words), np.uint64, len(words)), []
    for n, grams in known.grams.items():
        if n == WINDOW:
            if len(words) < WINDOW:
                continue
            own = gram_hashes(word, K)
            prints = np.flatnonzero(minima(own))
            prints = prints[among(own[prints], known.prints)]
            if not len(prints):
                continue
            # a fingerprint at p is extended to the windows that start at p - W + 1 .. p
            starts = np.unique((prints[:, None] - np.arange(W)).ravel())
            starts = starts[(starts >= 0) & (starts <= len(words) - WINDOW)]
            h = np.full(len(starts), n, np.uint64)
            for j in range(n):
                h = (h ^ word[starts + j]) * MIX
                h ^= h >> np.uint64(29)
        else:
            h = gram_hashes(word, n)
            starts = np.arange(len(h))
        hit = among(h, grams)
        out += [(n, i, g, b" ".join(words[i : i + n])) for i, g in zip(starts[hit].tolist(), h[hit].view(np.int64).tolist(), strict=True)]
    return out


CANDIDATE = T.ArrayType(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("g", T.LongType()), T.StructField("words", T.BinaryType())]))


def known_blocks(windows: DataFrame, block: int):
    """Known for every block of windows."""
    hashes = windows.select("n", "g", "print").distinct()
    n_blocks = max(1, -(-hashes.count() // block))
    for i in range(n_blocks):
        rows = hashes.filter(F.pmod(F.xxhash64("n", "g"), F.lit(n_blocks)) == i).toArrow()  # about block rows
        yield Known(*[rows.column(c).to_numpy() for c in ("n", "g", "print")]), i + 1 == n_blocks


def spans_of(batches):
    """Spans of the union of each document's windows, from their starts and lengths."""
    for batch in batches:
        spans = []
        for starts, lengths in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            start, n = np.array(starts, np.int64), np.array(lengths, np.int64)
            order = np.argsort(start)
            start, end = start[order], np.maximum.accumulate((start + n)[order])
            first = np.append(True, start[1:] > end[:-1])
            spans.append(np.stack([start[first], end[np.append(first[1:], True)]], axis=1).ravel().astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(pa.int32()))], names=["__row", "spans"])


def find_leaks(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", bench_text: str = "text", keep: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """docs with n_words, n_hit, spans (word positions, start and end in turn) and items (sorted ids)."""
    docs = without(docs, ["n_words", "n_hit", "spans", "items"])
    names = list(keep or docs.columns)
    windows = test_windows(bench, item_col, bench_text)

    def looked(rows: DataFrame, known: Known, fields: list[T.StructField], carried: list[str]) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(known)

        def make():
            from pyspark import TaskContext

            known, hashes, row = shared.value, Hashes(), TaskContext.get().partitionId() << 40

            def f(texts: list) -> list:
                nonlocal row
                words = [words_of(t) for t in texts]
                found = {"__found": [candidates(w, hashes, known) for w in words], "__row": range(row, row + len(texts)), "n_words": list(map(len, words))}
                row += len(texts)
                return [list(found[x.name]) for x in fields]

            return f

        return add_text_columns(rows, text_col, fields, make, carried)

    found = T.StructField("__found", CANDIDATE)
    told, rows = None, None
    for known, last in known_blocks(windows, block):
        if rows is None:
            fields = [T.StructField("__row", T.LongType()), T.StructField("n_words", T.LongType()), found]
            rows = written(looked(docs, known, fields, list(dict.fromkeys([*names, *([] if last else [text_col])]))), "looked")
            told = rows
        else:
            told = told.select("__row", "__found").unionByName(written(looked(rows, known, [found], ["__row"]), "looked"))
    own = told.filter("size(__found) > 0").select("__row", F.explode("__found").alias("c")).select("__row", "c.*")
    hits = written(own.join(windows.select("n", "g", "words", "item"), ["n", "g", "words"]).select("__row", "n", "start", "item"), "hits")
    spans = hits.select("__row", "n", "start").distinct().groupBy("__row").agg(F.collect_list("start").alias("s"), F.collect_list("n").alias("l")).mapInArrow(spans_of, "__row long, spans array<int>")
    items = hits.select("__row", "item").distinct().groupBy("__row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    length = F.expr("aggregate(sequence(1, int(size(spans) div 2)), 0L, (n, i) -> n + spans[2 * i - 1] - spans[2 * i - 2])")
    hit = spans.join(items, "__row").select("__row", length.alias("n_hit"), "spans", "items")
    clean = [F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<int>").alias("spans"), F.array().cast("array<string>").alias("items")]
    if told is rows:  # documents without a candidate need no join
        bad = rows.filter("size(__found) > 0").join(hit, "__row", "left")
        good = rows.filter("size(__found) = 0").select(*names, "n_words", *clean)
    else:
        bad, good = rows.join(hit, "__row", "left"), None
    bad = bad.select(*names, "n_words", *[F.coalesce(x, d).alias(x) for x, d in zip(("n_hit", "spans", "items"), clean, strict=True)])
    return bad if good is None else good.unionByName(bad)


def without_leaks(docs: DataFrame, bench: DataFrame, text_col: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """docs less the rows with a hit word. Texts aren't carried along: hit rows are told by key and a hash
    of the text (equal rows are hit alike), and taken out by an anti-join."""
    told = {"__k": F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("n")), "__th": F.xxhash64(F.coalesce(text_col, F.lit("")))}
    rows = docs.withColumns(told)
    hit = find_leaks(rows.select("__k", "__th", text_col), bench, text_col, keep=["__k", "__th"], **options).filter("n_hit > 0")
    return rows.join(hit.select("__k", "__th").distinct(), ["__k", "__th"], "left_anti").select(*docs.columns)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = find_leaks(docs, bench, keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: A window join: every 10-word window of documents with those of the items, and the same for short items.
LEAK_SQL = r"""fold AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {documents}),
test AS (SELECT DISTINCT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
lengths AS (SELECT DISTINCT least(10, len(w)) AS n FROM test WHERE len(w) > 0),
test_windows AS (SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM test WHERE len(w) > 0)),
doc_windows AS (SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM fold, lengths)),
hits AS (SELECT r, d.n, p, item FROM doc_windows d JOIN test_windows t ON d.n = t.n AND d.g = t.g),
covered AS (SELECT r, count(DISTINCT p + o) AS n_hit FROM (SELECT DISTINCT r, n, p FROM hits) h, range(10) k(o) WHERE o < n GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY r),
leaks AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items, '') AS items
  FROM fold LEFT JOIN covered ON fold.r = covered.r LEFT JOIN found ON fold.r = found.r)
"""

QUERIES = {"op5_decontamination": op5_decontamination}
ORACLE_SQL = {"op5_decontamination": "WITH " + LEAK_SQL.format(documents="documents") + "SELECT doc_id, n_words, n_hit, n_items, sha256(items) AS items_sha256, n_hit > 0 AS contaminated FROM leaks"}
