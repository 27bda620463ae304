"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimloom.llm import common, decontamination, language_id, line_dedup, lm_scoring, mixing, near_dedup, quality, sharding, suffix_dedup, token_files

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["n_words", "kept", "shard", "slot", "position", "epoch", "weight", "repeats", "n_tokens", "spans", "items", "n_hit", "score", "lang_pred", "n_lines", "n_dropped", "component_id", "n_shingles", "log_prob", "k", "t", "th", "digest", "bucket", "page"]
LONG = " ".join(f"w{i}" for i in range(60_000))
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def words(seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, words(1), "en", "a", 1), (2, None, "en", "a", None), (3, "", None, "b", 0), (4, "   \n\t ", "fr", None, 5), (5, LONG, "en", "a", 9), (None, words(2), "de", "b", 3),
        (7, words(1), "en", "c", 1), (8, words(3), "fr", "c", 1), (8, words(3), "fr", "c", 1), (9, words(1) + " tail", None, None, None), (None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("mine") for c in CLASHING})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def bench_of(spark, *rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_language_id(spark, odd, none):
    got = language_id.predict(odd, language_id.train(odd)).orderBy("doc_id", "text").collect()
    assert len(got) == 11 and set(odd.columns) <= set(got[0].asDict())
    assert all((r.lang_pred == "und") == (r.text is None or not any(c.isalpha() for c in r.text)) for r in got)
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    unlearned = language_id.predict(odd, language_id.train(none)).collect()
    assert {r.lang_pred for r in unlearned} == {"und"} and language_id.predict(none, language_id.train(odd)).count() == 0


def test_language_id_does_not_depend_on_batches():
    texts = ["Hello there 12 World", None, "ñandú é", ""]
    whole = [(d.tolist(), h.tolist()) for d, h in language_id.ngram_entries(*language_id.encode(texts), 16)]
    alone = [sum(len(d) for d, _ in language_id.ngram_entries(*language_id.encode([t]), 16)) for t in texts]
    assert sum(len(d) for d, _ in whole) == sum(alone)


def test_sharding(spark, odd, none):
    got = sharding.interleave(odd, 4).collect()
    sizes = [sum(r["shard"] == s for r in got) for s in range(4)]
    assert len(got) == 11 and max(sizes) - min(sizes) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in enumerate(sizes))
    assert sorted(r["position"] for r in got) == list(range(11)) and sharding.interleave(none).count() == 0


def test_shards_match_the_mixture(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    share = rows.groupBy("source").count().collect()
    cells = {(r["source"], r["shard"]): r["count"] for r in sharding.interleave(rows, 8).groupBy("source", "shard").count().collect()}
    assert all(abs(cells.get((r["source"], s), 0) - r["count"] / 8) <= 2 for r in share for s in range(8))


def test_mixing(spark, odd, none):
    got = mixing.temperature_mix(odd).collect()
    assert len(got) >= 11 and all(1 <= r["repeats"] <= mixing.MAX_REPEATS + 1e-6 for r in got)
    plain = mixing.temperature_mix(odd.select("doc_id", "text", "source")).collect()
    assert {r["doc_id"] for r in plain} == {r["doc_id"] for r in odd.select("doc_id").collect()}
    assert mixing.temperature_mix(none).count() == 0


def test_mixing_meets_entropy_and_budget(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") < 2400, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 8)).alias("source"))
    got = mixing.temperature_mix(rows, max_repeats=3.0)
    sums = {r["source"]: (r["t"], r["w"], r["r"]) for r in got.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.first("weight").alias("w"), F.first("repeats").alias("r")).collect()}
    total = sum(t for t, _, _ in sums.values())
    assert abs(sum(w for _, w, _ in sums.values()) - 1) < 1e-9 and all(abs(t / total - w) < 0.01 for t, w, _ in sums.values())
    assert abs(max(r for _, _, r in sums.values()) - 3) < 1e-3
    flat = mixing.temperature_mix(rows, max_repeats=1e9, target_entropy=0.95).groupBy("source").agg(F.first("weight").alias("w")).collect()
    entropy = -sum(r["w"] * np.log(r["w"]) for r in flat)
    assert 0.95 <= entropy / np.log(9) < 0.951
    small = mixing.temperature_mix(rows, budget=6000).agg(F.sum("n_tokens")).first()[0]
    assert abs(small - 6000) <= 3 * 9


def test_quality(spark, odd, none):
    got = quality.host_quality(odd).collect()
    assert len(got) == 11 and not any(r["kept"] for r in got if not r["text"])
    assert [r["n_words"] for r in got if r["text"] and r["text"] == LONG] == [60_000]
    assert quality.host_quality(none).count() == 0


def test_quality_counts(spark):
    window = "a b c d e f g h"
    rows = [f"{window} x {window} y", "z\n z\nz\n\n\nz", "#tag *x* & $5", "a\xa0b \x1c c"]
    got = [[c[i] for c in quality.text_stats(rows)] for i in range(4)]
    assert got == [[18, 18, 0, 0, 16], [4, 4, 0, 2, 0], [4, 10, 5, 0, 0], [3, 5, 0, 0, 0]]


def test_distrusted_hosts(spark):
    rows = [(i, words(i, 40) if i % 10 else "#", "en", f"good{i % 3}", 0) for i in range(300)] + [(1000 + i, "# " * 30 if i % 10 else words(i, 40), "en", "bad", 0) for i in range(100)]
    rows += [(2000, words(5, 40) + " # # # # # # #", "en", "bad", 0), (2001, words(6, 40) + " # # # # # # #", "en", "good0", 0)]
    kept = {r.doc_id for r in quality.host_quality(spark.createDataFrame(rows, SCHEMA)).filter("kept").collect()}
    assert 2001 in kept and 2000 not in kept and 1000 in kept and 1 in kept and 1001 not in kept


def verdicts(spark, hosts):
    """hosts: (documents, failed) for each."""
    rows = [(f"h{i}", j < failed) for i, (n, failed) in enumerate(hosts) for j in range(n)]
    return {r["__host"]: r for r in quality.host_verdicts(spark.createDataFrame(rows, "host string, rule_failed boolean"), "host").collect()}


@pytest.mark.parametrize("n", [5, 20, 100, 1000])
def test_hosts_alike_are_not_distrusted(spark, n):
    """Hosts that differ by chance alone, of any size."""
    g = np.random.default_rng(n)
    got = verdicts(spark, [(n, int(k)) for k in g.binomial(n, 0.15, min(1000, 200_000 // n))])
    assert sum(r["distrusted"] for r in got.values()) < 0.01 * len(got)


def test_a_host_at_twice_the_rate_is_distrusted(spark):
    g = np.random.default_rng(8)
    sizes = [50, 500, 500, 2000, 5000, 400, 60, 30, 800, 700]
    got = verdicts(spark, [(n, int(g.binomial(n, 0.15))) for n in sizes] + [(500, 150), (4, 4)])
    assert [h for h, r in got.items() if r["distrusted"]] == ["h10"]  # not the host of four documents


def test_hosts_that_differ_are_judged_by_the_prior(spark):
    """Rates drawn from a beta distribution: the fitted weight is near its own, so rates are shrunken little."""
    g = np.random.default_rng(2)
    rates = g.beta(2, 10, 400)
    got = verdicts(spark, [(300, int(g.binomial(300, p))) for p in rates])
    r = got["h0"]
    weight = (r["failed"] - r["rate"] * r["n"]) / (r["rate"] - sum(x["failed"] for x in got.values()) / 120_000)
    assert 8 < weight < 16


def test_no_host_of_the_given_tables_stands_out(spark):
    """Their sources fail alike: only the base rule decides."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert quality.host_quality(docs).filter("kept = base_failed").count() == 0


def brute_hits(text, items):
    w, hit, found = decontamination.words_of(text), set(), set()
    for k, t in items:
        b = decontamination.words_of(t)
        n = min(10, len(b))
        for i in range(len(b) - n + 1 if b else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == b[i : i + n]:
                    hit |= set(range(p, p + n))
                    found.add(str(k))
    return len(w), len(hit), sorted(found)


def test_decontamination_finds_every_window(spark, odd, none):
    r = random.Random(4)
    items = [(i, " ".join(r.choice("abc") for _ in range(r.choice([1, 3, 9, 10, 11, 25])))) for i in range(12)] + [(50, None), (51, ""), (3, words(8))]
    texts = [" ".join(r.choice("abc") for _ in range(n)) for n in (0, 1, 5, 9, 10, 40, 200)] + [words(9, 30) + " " + words(8) + " " + words(9, 30), None, "A, b! C-a."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [brute_hits(t, items) for t in texts]
    for block in (decontamination.BLOCK, 20):
        got = decontamination.find_leaks(docs, bench_of(spark, *items), block=block).orderBy("doc_id").collect()
        assert [(g.n_words, g.n_hit, g["items"]) for g in got] == want
    assert decontamination.find_leaks(odd, bench_of(spark, (None, words(1)))).filter("n_hit > 0").count() == 3
    assert decontamination.find_leaks(none, bench_of(spark, (1, "a"))).count() == 0
    assert decontamination.find_leaks(odd, bench_of(spark)).filter("n_hit > 0").count() == 0
    left = decontamination.without_leaks(odd, bench_of(spark, (None, words(1))))
    assert left.columns == odd.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(["2", "3", "4", "5", "8", "8", "None", "None"])


def brute_repeats(rows, length):
    seen, out = set(), []
    for k, t in rows:
        b, gone = (t or "").encode(), set()
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone |= set(range(i, i + length))
            seen.add(b[i : i + length])
        out.append((k, len(b), len(gone), bytes(c for i, c in enumerate(b) if i not in gone)))
    return out


def test_suffix_dedup(spark, odd, none):
    r = random.Random(2)
    piece = words(1, 40)
    rows = [(i, "".join(r.choice(["x" * 50, "yz" * 40, piece, words(i), "é"]) for _ in range(6))) for i in range(12)] + [(20, None), (21, ""), (22, "x" * 99), (23, "x" * 100), (24, piece), (25, piece)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix_dedup.repeated_substrings(docs).orderBy("doc_id").collect()
    assert [(g.doc_id, g.n_bytes, g.n_removed, bytes(g.kept)) for g in got] == brute_repeats(rows, 100)
    assert all(sum(g.spans[1::2]) - sum(g.spans[::2]) == g.n_removed for g in got)
    many = suffix_dedup.repeated_substrings(odd).collect()
    assert len(many) == 11 and sum(g.n_removed > 0 for g in many) == 3  # 7 and the second 8 whole, 9 but for its tail
    assert suffix_dedup.repeated_substrings(none).count() == 0


def test_lm_scoring(spark, odd, none):
    vocabulary, shares = lm_scoring.vocabulary_of(lm_scoring.count_words(odd))
    flat = lm_scoring.train(odd, vocabulary)
    got = lm_scoring.score(odd, vocabulary, shares, flat).collect()
    assert len(got) == 11 and all((r["log_prob"] == 0) == (r["n_words"] == 0) and (r["mean_log_prob"] is None) == (r["n_words"] == 0) for r in got)
    assert [r["n_words"] for r in got if r["text"] == LONG] == [60_000]
    assert lm_scoring.score(none, vocabulary, shares, flat).count() == 0
    vocabulary, shares = lm_scoring.vocabulary_of(lm_scoring.count_words(none))
    assert (lm_scoring.train(none, vocabulary) == vocabulary.start()).all() and shares.count() == 0
    assert lm_scoring.score(odd, vocabulary, shares, vocabulary.start()).count() == 11


def test_line_dedup(spark, odd, none):
    rows = [(i, f"  Common\t\nown {i}\n\nRare {i % 3}") for i in range(12)] + [(50, None), (51, ""), (52, "common\ncommon")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs, batches=5).collect()}
    assert got[0].text == "own 0\n\nRare 0" and (got[0].n_lines, got[0].n_dropped) == (4, 1)
    assert got[50].text is None and got[50].n_lines == 1 and (got[52].text, got[52].n_dropped) == ("", 2)
    assert line_dedup.dedup_lines(odd).count() == 11 and line_dedup.dedup_lines(none).count() == 0


def test_line_store_compacts_and_agrees_with_one_batch(spark):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("a\nb "), (F.col("id") % 7).cast("string")).alias("text"))
    store = line_dedup.LineStore(spark, min_docs=9)
    for b in range(7):
        store.add(docs.filter(F.col("doc_id") % 7 == b))
    whole = line_dedup.LineStore(spark, min_docs=9)
    whole.add(docs)
    assert {bytes(r.line_hash) for r in store.frequent().collect()} == {bytes(r.line_hash) for r in whole.frequent().collect()}
    assert len(store.levels) > 1 and all(len(level) <= line_dedup.FANOUT for level in store.levels)


def test_near_dedup(spark, odd, none):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == 11 and all(r["component_id"] == 1 and r["kept"] == (r["doc_id"] == 1) for r in got if r["doc_id"] in (1, 7, 9))
    assert all(r["n_shingles"] == 0 and r["component_id"] == r["doc_id"] for r in got if not (r["text"] or "").strip())
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None, None]
    assert near_dedup.near_duplicates(none).count() == 0 and near_dedup.near_duplicates(none, keep=["doc_id"]).count() == 0


def test_near_dedup_of_a_crowd(spark):
    """A crowd of copies of one text with a few words changed each: some pairs link, most only share buckets."""
    r, base, rows = random.Random(3), words(7, 170).split(), []
    for i in range(150):
        w = base[:]
        for _ in range(r.randrange(1, 6)):
            w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from test_oracles import brute_components

    got = [tuple(x) for x in near_dedup.near_duplicates(docs, keep=["doc_id"]).orderBy("doc_id").collect()]
    assert got == brute_components(rows, 85)


@pytest.mark.parametrize("bits", [1, 8])
def test_token_files(spark, odd, none, bits):
    ids = np.random.default_rng(1).integers(0, 1 << 32, 200_001, dtype=np.uint64).astype("<u4")
    back = token_files.unpack(token_files.pack([None, 5], [1, 200_000], ids, bits))
    assert back[0] == [None, 5] and (back[3] == ids).all()
    files = token_files.write_files(odd, TOKENIZER, bits=bits, file_ids=50)
    got = token_files.read_files(files).orderBy("start").collect()
    assert len(got) == 11 and [g.doc_id for g in got] == sorted([g.doc_id for g in got], key=lambda k: (k is not None, k or 0))
    ends = np.cumsum([g.n_tokens for g in got])
    assert [g.start for g in got] == [0, *ends[:-1]] and all(len(g.ids) == 4 * g.n_tokens for g in got)
    assert token_files.read_files(token_files.write_files(none, TOKENIZER)).count() == 0


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    e, library = token_files.Encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    r = random.Random(1)
    letters = [*"ab'st 1\n\n\t  é中ß!<|\r\0.,", "'s", "<|endoftext|>", "  ", " a", "a.", "b,\n", "\xa0", "word"]
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(3000)] + [None, "", "\n", " ", "<|endoftext|>", "a <|endoftext|> b"]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for step in (7, len(texts)):
        got = [x.tolist() for i in range(0, len(texts), step) for x in e.encode(pa.array(texts[i : i + step], pa.string()))]
        assert got == want
    assert want[-2:] == [[50256], [64, 220, 50256, 275]]


def test_encoder_leaves_other_vocabularies_to_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Hello there, World", None, "a  b\nc", "1 <|endoftext|>"]
    e, library = token_files.Encoder(path), Tokenizer.from_file(path)
    assert not e.plain and [x.tolist() for x in e.encode(pa.array(texts))] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_pipeline_stages_take_odd_rows(spark, odd, none, tmp_path):
    bench = bench_of(spark, (1, words(3)), (2, None))
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    plain = odd.drop(*CLASHING)
    for docs in (plain, none, odd):
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            assert out.columns[: len(docs.columns)] == docs.columns or docs is odd, name
            assert out.count() <= 2 * docs.count(), name
            assert i == 4 or docs is odd or out.columns == docs.columns


def test_shared_folder_comes_from_the_session(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
