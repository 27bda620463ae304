"""Small cases in which an operator once did less than the whole job."""

from collections import Counter

import numpy as np
import xxhash

import corpus_pipeline
from claimloom.llm import lm_scoring, near_dedup


def lm(docs, head=1 << 17):
    return lm_scoring.vocabulary_of(lm_scoring.count_words(docs), head)


def test_lm_scoring_tells_all_words_apart(spark):
    rows = [(i, f"the w{i % 3} of Rare{i}") for i in range(300)] + [(None, "the w1\tof rare7"), (None, None), (301, " \n"), (302, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    own = Counter(x for _, t in rows for x in (t or "").lower().split())
    counts = {r.h: r.n for r in lm_scoring.count_words(docs).collect()}
    hashes = {w: xxhash.xxh64_intdigest(w.encode()) for w in own}
    hashes = {w: h - (1 << 64) if h >> 63 else h for w, h in hashes.items()}
    assert counts == {hashes[w]: n for w, n in own.items()}
    vocabulary, shares = lm(docs, 20)  # the, of, w0, w1 and w2 have ids of their own
    assert len(vocabulary.heads) == 5 and shares.count() == len(own) - 5
    flat, of = vocabulary.start(), Counter()
    p = vocabulary.unflat(flat)
    for w, h in hashes.items():
        if h not in vocabulary.heads:
            of[h % lm_scoring.RARE] += own[w]
    for limit in (1, 1 << 21):  # shares by a join, and broadcast
        got = {(r.doc_id, r.text): r for r in lm_scoring.score(docs, vocabulary, shares, flat, limit=limit).collect()}
        assert len(got) == len(set(rows))
        for (_, t), r in got.items():
            words = (t or "").lower().split()
            h = np.array([hashes[w] for w in words], np.int64)
            ids, at, _ = lm_scoring.placed(vocabulary.ids_of(h), np.array([0, len(h)]), vocabulary.pad)
            want = float(lm_scoring.log_probs(vocabulary, p, ids, at).sum()) if words else 0.0
            want += sum(np.log(own[w] / of[x % lm_scoring.RARE]) for w, x in zip(words, h.tolist(), strict=True) if x not in vocabulary.heads)
            assert r.n_words == len(words) and abs(r.log_prob - want) < 1e-3 and (r.mean_log_prob is None) == (not words)


def test_lm_probabilities_sum_to_one_and_start_as_frequencies():
    counts = np.array([50, 20, 20, 5, 0, 1, 1])
    v = lm_scoring.Vocabulary(np.zeros(0, np.int64), np.zeros(0, np.int64), counts)
    p = v.unflat(np.random.default_rng(3).normal(0, 1, v.parameters).astype(np.float64))
    around = np.tile([v.pad, 3, -1, 0, 2], 7)
    around[2::5] = np.arange(7)
    at = np.arange(2, 35, 5)
    log = lm_scoring.log_probs(v, p, np.append(around, [v.pad, v.pad]), at)
    assert abs(np.exp(log).sum() - 1) < 1e-9
    p = v.unflat(v.start())
    p["w"][:] = 0
    log = lm_scoring.log_probs(v, p, np.append(around, [v.pad, v.pad]), at)
    assert np.allclose(np.exp(log), (counts + 1) / (counts + 1).sum(), atol=1e-5)


def test_lm_gradients_equal_differences():
    r = np.random.default_rng(5)
    v = lm_scoring.Vocabulary(np.zeros(0, np.int64), np.zeros(0, np.int64), r.integers(0, 90, 30))
    flat = r.normal(0, 0.5, v.parameters)
    ids = np.concatenate([[v.pad] * 2, r.integers(0, 30, 40), [v.pad] * 4])
    at = np.arange(2, 42)
    got = np.zeros(v.parameters)
    for name, rows, g in lm_scoring.gradients(v, v.unflat(flat), ids, at):
        v.unflat(got)[name][rows] += g
    for i in r.choice(v.parameters, 200, replace=False):
        ends = []
        for step in (1e-5, -1e-5):
            moved = flat.copy()
            moved[i] += step
            ends.append(-lm_scoring.log_probs(v, v.unflat(moved), ids, at).mean())
        assert abs((ends[0] - ends[1]) / 2e-5 - got[i]) < 1e-6


def test_lm_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    seen = []
    for n in (1, 8):
        dealt = docs.repartition(n)
        vocabulary, shares = lm(dealt)
        flat = lm_scoring.train(dealt, vocabulary, shard_words=6000)
        seen.append((flat, {r.doc_id: r.log_prob for r in lm_scoring.score(dealt, vocabulary, shares, flat).collect()}))
    assert np.array_equal(seen[0][0], seen[1][0]) and np.abs(seen[0][0] - vocabulary.start()).max() > 0.05
    assert all(abs(x - seen[1][1][k]) < 1e-2 for k, x in seen[0][1].items())


def test_lm_training_gains_on_documents_that_it_has_not_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    vocabulary, shares = lm(docs)
    flat = lm_scoring.train(docs.filter("doc_id % 5 <> 0"), vocabulary)
    rest = docs.filter("doc_id % 5 = 0")
    first, last = (lm_scoring.score(rest, vocabulary, shares, x).selectExpr("sum(log_prob) / sum(n_words)").first()[0] for x in (vocabulary.start(), flat))
    assert last > first + 0.2  # nats a word; 0.35 when it was written


def test_near_duplicates_keep_one_row_of_each_group_whatever_its_ids(spark):
    text = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdef"]
    near = text[1].replace("b39", "z")
    rows = [(None, text[0], 1), (None, text[1], 2), (None, text[1], 3), (None, near, 4), (5, text[2], 5), (5, text[3], 6), (7, text[4], 7), (6, text[4], 8), (6, text[4], 9), (None, text[4], 10), (None, "", 11), (None, "", 12), (5, text[5], 13), (4, text[5], 14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    got = sorted((r.n, r.doc_id) for r in corpus_pipeline.near_duplicates_stage(spark, docs, "").collect())
    assert len(got) == 8 and [n for n, _ in got if n in (1, 5, 6, 11, 12, 14)] == [1, 5, 6, 11, 12, 14]
    assert sum(n in (2, 3, 4) for n, _ in got) == 1 and sum(n in (8, 9) for n, _ in got) == 1
    of = {r.n: r.component_id for r in near_dedup.near_duplicates(docs, percent=80).collect()}
    assert of[1] is None and of[4] is None and of[5] == of[6] == 5 and of[7] == of[10] == 6 and of[13] == 4
