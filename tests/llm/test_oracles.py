"""Queries beside their oracle SQL, and the others beside brute force, on the smallest tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from compare import DATA, difference
from tokenizers import Tokenizer

from claimloom.llm import language_id, registry, suffix_dedup

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_oracle(spark, name):
    assert difference(registry.QUERIES[name](spark, SF), registry.ORACLE_SQL[name], SF) == ""


def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


def brute_components(rows, percent):
    def low(t):
        return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")

    sets = {}
    for k, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    top = {k: k for k in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    return [(k, len(sets[k]), root(k), root(k) == k) for k in keys]


def brute_repeats(rows, length=100):
    seen, out = set(), []
    for k, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            g = b[i : i + length]
            if g in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(g)
        kept = bytes(c for c, x in zip(b, gone, strict=True) if not x)
        n = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((k, len(b), sum(gone), n, hashlib.sha256(kept).hexdigest()))
    return out


def test_near_dedup(spark):
    got = [tuple(r) for r in registry.QUERIES["op9_near_dedup"](spark, SF).orderBy("doc_id").collect()]
    assert got == brute_components(texts(spark), 85)


def test_suffix_dedup(spark):
    got = [tuple(r) for r in registry.QUERIES["op6_suffix_dedup"](spark, SF).orderBy("doc_id").collect()]
    assert got == brute_repeats(texts(spark))


def test_suffix_dedup_with_more_chunks_than_buckets(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = sorted(tuple(r) for r in suffix_dedup.repeated_substrings(docs).collect())
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 1 << 14)
    monkeypatch.setattr(suffix_dedup, "TABLE_BUCKETS", 3)
    got = suffix_dedup.repeated_substrings(docs)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_token_files(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, at = [], 0
    for k, text in texts(spark):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((k, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [tuple(r) for r in registry.QUERIES["op10_token_files"](spark, SF).orderBy("doc_id").collect()] == want


def brute_grams(text, bits):
    s = " " + text.lower() + " " if text else " "
    s = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in s))
    for n in (1, 2, 3):
        for i in range(len(s) - n + 1):
            if n > 1 or s[i] != " ":
                h = n
                for c in s[i : i + n]:
                    h = (h * 1_000_003 + ord(c)) % 2**64
                yield (h * 0x9E3779B97F4A7C15 % 2**64) >> (64 - bits)


def test_language_id_beside_plain_naive_bayes(spark):
    """Counts, logarithms and sums in plain Python, over every document of the smallest table."""
    bits, alpha = language_id.BITS, 0.05
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    counts, docs = {}, Counter()
    for r in rows:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            counts.setdefault(r.lang, Counter()).update(brute_grams(r.text, bits))
            docs[r.lang] += 1
    logs = {g: math.log(sum(c.values()) + alpha * 2**bits) for g, c in counts.items()}
    got = {r.doc_id: r for r in registry.QUERIES["op1_language_id"](spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        grams = Counter(brute_grams(r.text, bits))
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0)
            continue
        own = {g: math.log(docs[g] / docs.total()) + sum(n * (math.log(c[h] + alpha) - logs[g]) for h, n in grams.items()) for g, c in counts.items()}
        best = max(sorted(own), key=own.__getitem__)
        assert got[r.doc_id].lang_pred == best
        assert abs(got[r.doc_id].score - 1 / sum(math.exp(min(0, x - own[best])) for x in own.values())) < 1e-3


def test_language_id_on_held_out_documents(spark):
    sf = f"{DATA}/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = registry.QUERIES["op1_language_id"](spark, sf).join(docs, "doc_id").filter("held_out").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    assert all(0 <= r.score <= 1 for r in got)
