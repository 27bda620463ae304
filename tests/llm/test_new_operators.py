"""Importance resampling, exact dedup and collocations: odd rows, hot groups, and plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimloom.llm import collocations, exact_dedup, importance

SCHEMA = "doc_id long, text string, lang string, source string"
LONG = " ".join(f"w{i}" for i in range(60_000))


def words(seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7))) for _ in range(n))


ROWS = [
    (1, words(1), "en", "a"), (2, None, "en", "a"), (3, "", None, "b"), (4, "   \n\t ", "fr", None), (5, LONG, "en", "a"), (None, words(2), "de", "b"),
    (7, words(1) + "  ", "en", "c"), (8, words(3), "fr", "c"), (8, words(3), "fr", "c"), (9, words(1) + " tail", None, None), (None, None, None, None), (10, words(1).replace(" ", "\v"), "und", "c"), (11, "é😀 " * 30, "en", "a"), (12, "é😀" * 30, "en", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit("mine") for c in ["keep_id", "group_size", "Kept", "text_sha256", "score", "rank", "weight", "n_words", "phrase", "a", "__x"]})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# exact dedup


def plain_groups(rows):
    groups = {}
    for k, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), k is None, k or 0, k))
    return groups


def dedup_checked(rows, got):
    groups = plain_groups(rows)
    want = Counter()
    for k, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        want[(k, min(groups[norm])[3], len(groups[norm]), hashlib.sha256(norm.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)  # one of each group, though rows repeat
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.length(c) % 3, lambda c: F.lit(0)])
def test_exact_dedup_of_odd_rows(odd, digest):
    """Also where digests stand for several texts: contents decide."""
    got = exact_dedup.exact_dedup(odd, digest=digest).collect()
    assert set(got[0].asDict()) == set(odd.drop("Kept").columns) | {"kept"} and len(got) == len(ROWS)
    dedup_checked([r[:2] for r in ROWS], got)


def test_exact_dedup_of_none_and_of_text_keys(spark, none):
    assert exact_dedup.exact_dedup(none).count() == 0
    got = exact_dedup.exact_dedup(spark.createDataFrame([("b", "x"), ("a", "x"), (None, "x")], "id string, body string"), "id", "body").collect()
    assert {(r["id"], r["keep_id"], r["kept"]) for r in got} == {("b", "a", False), ("a", "a", True), (None, "a", False)}


def test_exact_dedup_of_a_hot_group(spark):
    """A third of all rows is one text, in as many tasks as there are; each salt gets a row per task at most."""
    rows = [(i, "hot  text" if i % 3 else f"text {i // 6}") for i in range(3000)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(40), salts=4).collect()
    dedup_checked(rows, got)


def test_exact_dedup_keeps_texts_out_of_later_shuffles(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).select("doc_id", "text")
    plan = exact_dedup.exact_dedup(docs, keep=["doc_id"])._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan and "PythonUDF" not in plan and "__n" not in plan.split("== Physical Plan ==")[1]


# importance resampling


def plain_features(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return len(w), [zlib.crc32(g.encode()) % 10_000 for g in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]]


def plain_resample(rows, tests, percent=25, min_words=20):
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(plain_features(x)[1])
    for x in tests:
        t.update(plain_features(x)[1])
    big_s, big_t = s.total(), t.total()
    out = []
    for k, x in rows:
        n, f = plain_features(x)
        gains = [math.floor(1000 * math.log((t[b] + 1.0) * (big_s + 10_000.0) / ((s[b] + 1.0) * (big_t + 10_000.0)))) for b in f]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'null' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append((k, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {r[0]: i + 1 for i, r in enumerate(order[: percent * len(order) // 100])}
    return out, ranks


def test_importance_of_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(words(1, 30),), (None,), ("",), ("é😀 w5 w6",)], "text string")
    got = importance.resample(odd, bench).collect()
    want, _ = plain_resample([r[:2] for r in ROWS], [words(1, 30), None, "", "é😀 w5 w6"])
    assert Counter((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"]) for r in got) == Counter(want)
    able = sum(n >= 20 for _, n, *_ in want)
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, able * 25 // 100 + 1))
    assert importance.resample(none, bench).count() == 0 and importance.resample(odd, none.select("text")).count() == len(ROWS)


def test_importance_ranks(spark):
    """Ranks over many parts, with ties in the score, beside a plain sort."""
    r = random.Random(5)
    rows = [(i, words(i % 7, r.randrange(5, 90))) for i in range(400)]
    bench = spark.createDataFrame([(words(3),)], "text string")
    got = importance.resample(spark.createDataFrame(rows, "doc_id long, text string").repartition(13), bench).collect()
    want, ranks = plain_resample(rows, [words(3)])
    assert {(x["doc_id"], x["score"]) for x in got} == {(w[0], w[4]) for w in want}
    assert {x["doc_id"]: x["rank"] for x in got if x["rank"] is not None} == ranks
    ties = spark.createDataFrame([(i % 50, 30, i % 3) for i in range(600)], "doc_id long, n_words long, score long")
    got = importance.ranked(ties, percent=60).collect()
    order = sorted(((x["rank"], x["score"], x["doc_id"]) for x in got if x["rank"]))
    assert [x[0] for x in order] == list(range(1, 361)) and [x[1:] for x in order] == sorted((x[1:] for x in order), key=lambda x: (-x[0], x[1]))


def test_bit_sliced_sums_equal_plain_sums():
    g = np.random.default_rng(3)
    gains = g.integers(-20_000, 20_000, 777)
    doc, bucket = np.sort(g.integers(0, 40, 200_000)), g.integers(0, 777, 200_000)
    bucket[:30_000] = 5  # counts of many bits
    want = np.bincount(doc, gains[bucket], 40).astype(np.int64)
    assert (importance.Gains(gains).sums(doc, bucket, 40) == want).all()
    assert (importance.Gains(np.zeros(9, np.int64)).sums(doc, bucket % 9, 40) == 0).all()
    assert importance.Gains(gains).sums(doc[:0], bucket[:0], 3).tolist() == [0, 0, 0]


def test_crc_of_joined_texts():
    g, crc = random.Random(1), importance.Crc()
    parts = [(g.randbytes(g.randrange(9)), g.randbytes(n)) for n in [*range(200), 4095, 4096, 70_001]]
    got = crc.after(np.array([zlib.crc32(a) for a, _ in parts], np.uint32), np.array([len(b) for _, b in parts]))
    assert [int(x) ^ zlib.crc32(b) for x, (_, b) in zip(got, parts, strict=True)] == [zlib.crc32(a + b) for a, b in parts]


def test_features_of_long_words():
    texts = ["x" * 5000 + " y " + "z" * 70, "Ab-cD 12", None]
    n, doc, bucket = importance.features(pa.array(texts), importance.Crc(), 10_000, 2)
    assert n.tolist() == [3, 3, 0]
    for i, t in enumerate(texts):
        assert sorted(bucket[doc == i].tolist()) == sorted(plain_features(t)[1])


# collocations


def plain_phrases(rows, min_count, max_words, top, absorb):
    f, n = {}, Counter()
    for t, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        often = {p: a for p, a in c.items() if len(p) > 1 and a >= min_count}
        most = Counter()
        for p, a in often.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    most[p[i : i + k]] = max(most[p[i : i + k]], a)
        rows = []
        for p, a in often.items():
            score, _, left, right = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            if 100 * most[p] < absorb * a or not most[p]:
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def corpus(n, seed=0):
    r = random.Random(seed)
    vocabulary = ["new", "york", "city", "the", "Of", "é", "😀x", "10", "a-b", "z"]
    mark = [" ", " ", "\t", " ", "  ", ". ", ",", "\n", "! ", "\v"]
    return [(i, "".join(r.choice(vocabulary[: 3 + i % 8]) + r.choice(mark) for _ in range(r.randrange(40))), r.choice(["en", "en", "fr", None, "und"])) for i in range(n)]


@pytest.mark.parametrize("max_words, min_count", [(2, 1), (3, 10), (4, 7)])
def test_collocations_beside_a_plain_version(spark, max_words, min_count):
    rows = corpus(300, max_words)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(11)
    got = collocations.collocations(docs, min_count, max_words, top=40)
    assert got.columns == NAMES
    assert sorted(tuple(r) for r in got.collect()) == plain_phrases([r[1:] for r in rows], min_count, max_words, 40, 50)


def test_collocations_of_odd_rows(spark, odd, none):
    rows = [(r[1], r[2]) for r in ROWS]
    got = collocations.collocations(odd, min_count=1, top=10**6)
    assert sorted(tuple(r) for r in got.collect()) == plain_phrases(rows, 1, 3, 10**6, 50)
    assert collocations.collocations(none).count() == 0
    assert collocations.collocations(odd.limit(0)).count() == 0


def test_collocations_of_many_batches(spark, monkeypatch):
    """Batches, sums and sets of bits so small that all their edges occur."""
    monkeypatch.setattr(collocations, "BATCH_CHARS", 300)
    monkeypatch.setattr(collocations, "SUM_HASHES", 100)
    monkeypatch.setattr(collocations, "ROWS", 7)
    rows = corpus(200, 9)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    assert sorted(tuple(r) for r in collocations.collocations(docs, 10).collect()) == plain_phrases([r[1:] for r in rows], 10, 3, 2000, 50)


def test_a_full_set_of_bits_loses_nothing(spark):
    """Where every bit is set, all phrases are counted: the counts decide."""
    rows = corpus(100, 2)
    texts = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    full = np.full(1 << collocations.BITS >> 3, 255, np.uint8)
    counts = {(r["lang"], r["phrase"]): r["a"] for r in collocations.exact_counts(texts, full, 3).filter("words > 0").collect()}
    bits = collocations.locally_frequent(texts, 10, 3)
    some = {(r["lang"], r["phrase"]): r["a"] for r in collocations.exact_counts(texts, bits, 3).filter("words > 0").collect()}
    assert {k: v for k, v in counts.items() if v >= 10} == {k: v for k, v in some.items() if v >= 10} and set(some) <= set(counts)


def test_scores_beyond_64_bits(spark):
    a = 3 * 10**12 + 7
    rows = [("en", 1, "x", 4 * a), ("en", 1, "y", a + 5), ("en", 1, "z", a + 11), ("en", 2, "x y", a), ("en", 2, "y z", a - 1), ("en", 3, "x y z", a - 3)]
    got = {r["phrase"]: r for r in collocations.cut_scores(spark.createDataFrame(rows, "lang string, words int, phrase string, a long"), 3).collect()}
    assert got["x y"]["score"] == 10**6 * a * a // (4 * a * (a + 5)) and got["y z"]["score"] == 10**6 * (a - 1) ** 2 // ((a + 5) * (a + 11))
    cuts = [(10**6 * (a - 3) ** 2 // (4 * a * (a - 1)), 4 * a, a - 1), (10**6 * (a - 3) ** 2 // (a * (a + 11)), a, a + 11)]
    assert tuple(got["x y z"][c] for c in ("score", "l", "r")) == min(cuts)


def test_best_phrases_by_salts(spark):
    """Ties in all but the phrase, in UTF-8 byte order, far more rows than places."""
    rows = [("en", f"{chr(c)} {i}", 1, i % 3) for c in (97, 233, 0xFFFD, 0x1F600) for i in range(700)]
    df = spark.createDataFrame(rows, "lang string, phrase string, a long, score long")
    got = [(r["score"], r["phrase"]) for r in collocations.best(df, 900).orderBy("rank").collect()]
    assert got == [(s, p) for _, p, _, s in sorted(rows, key=lambda r: (-r[3], r[1].encode()))[:900]]
