"""Collocation mining by SON partitioning.

1. Each shard is mined completely: all runs of 1 to MAX_WORDS words inside a piece of text are counted per
   shard and language, and those with at least ceil(min_count / SHARDS) stay. A phrase that has
   min_count in all has that many in one shard at least, whatever the shards are, so a shard is the
   tasks of one number modulo SHARDS: what a task sums beforehand isn't cut up. Phrases are hashes here;
   a collision can only let more through. A task sends its hashes sorted and cut by their leading
   bits, as blocks of bytes; all blocks with equal leading bits are merged by one task. There are GROUPS
   such parts for each shuffle partition, so a part is a small share of what a partition is sized for.
2. The union of the locally frequent phrases is a set of bits (2**BITS, whatever the corpus), in which
   every locally frequent hash is set. More phrases fill it up and let more pass, but never lose one.
3. One more pass over the texts counts every phrase whose bit is set: as words, not hashes, so counts are
   exact. Those below min_count go.

Scores, containment and ranks are joins on the table of frequent phrases. A language's best phrases are
chosen in three steps, by salts, so no language meets in one task.

Arithmetic is in decimals of 38 digits: counts may reach 10**14.

Defined cases: a null or empty text has no words; a null language is `und`, together with a language of
that name; repeated rows count each; a phrase never crosses a piece; no rows give no rows."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, sized, split_words, translated, written

MIN_COUNT = 10
MAX_WORDS = 3
#: A longer phrase with this part of the count of a phrase within takes its place.
ABSORB_PERCENT = 50
TOP = 2000
#: Shards of the first pass, and parts of hashes for each shuffle partition.
SHARDS, GROUPS = 4, 16
#: The set of locally frequent phrases has 2**BITS bits (32 MB).
BITS = 28
#: Characters that a task has at a time, and hashes that it sums before it sends them.
BATCH_CHARS, SUM_HASHES = 4_000_000, 1 << 21
ROWS = 200_000

#: Lower-cases A-Z, ends a piece by a new line and a word by a blank.
FOLD = bytes(c + 32 if 65 <= c <= 90 else 10 if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)


class Batch:
    """The words of some texts in pieces: distinct words, and for each word its number, piece and language."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        pieces = pc.split_pattern(translated(texts, FOLD), "\n")
        per_text = np.diff(pieces.offsets.to_numpy())
        self.words, self.word, bounds = split_words(pieces.flatten())
        size = np.diff(bounds)
        self.piece = np.repeat(np.arange(len(size)), size)
        coded = langs.dictionary_encode()
        self.langs = coded.dictionary
        self.lang = np.repeat(np.repeat(coded.indices.to_numpy(), per_text), size)

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words, and for each place that of its language."""
        own = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.words.cast(pa.large_binary()).to_pylist()), np.uint64, len(self.words))
        of_lang = np.fromiter((xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), seed=1) for x in self.langs.to_pylist()), np.uint64, len(self.langs))
        return own[self.word], of_lang[self.lang]

    def runs(self, max_words: int):
        """For n of 1 to max_words: n, the places at which a run of n words starts, and the runs' hashes."""
        word, run = self.hashes()
        for n in range(1, max_words + 1):
            m = max(0, len(word) - n + 1)
            run = (run[:m] ^ word[n - 1 :]) * MIX
            run ^= run >> np.uint64(29)
            at = np.flatnonzero(self.piece[:m] == self.piece[n - 1 :])
            yield n, at, run[at]


def text_batches(batches):
    """Texts and languages of bounded size."""
    for batch in batches:
        texts, langs = batch.columns
        for a, b in sized(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), BATCH_CHARS):
            yield Batch(texts.slice(a, b - a), langs.slice(a, b - a))
            pa.default_memory_pool().release_unused()


def tables(names: list[str], *columns: pa.Array):
    for a in range(0, len(columns[0]), ROWS):
        parts = [c.slice(a, ROWS) for c in columns]
        yield pa.RecordBatch.from_arrays([c.cast(pa.string()) if pa.types.is_large_string(c.type) else c for c in parts], names=names)


def locally_frequent(texts: DataFrame, min_count: int, max_words: int) -> np.ndarray:
    """2**BITS bits: those at the leading BITS of the hashes of phrases that are frequent in a shard, at its
    lowered support. Hashes have p + 32 bits: 2**p parts, and 4 bytes within."""
    lead = min(20, max(6, (GROUPS * partitions(texts.sparkSession) - 1).bit_length()))
    support = -(-min_count // SHARDS)

    def mine(batches):
        shard, held, n = TaskContext.get().partitionId() % SHARDS, [], 0

        def summed():
            keys = np.concatenate(held)
            held.clear()
            keys >>= np.uint64(32 - lead)
            keys.sort()
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            counts = np.diff(np.append(first, len(keys))).astype(np.uint32)
            keys = keys[first]
            part = (keys >> np.uint64(32)).astype(np.int64)
            starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            ends = np.append(starts[1:], len(part))
            keys = keys.astype(np.uint32)
            parts, shards = pa.array(part[starts], pa.int32()), pa.array(np.full(len(starts), shard, np.int32))
            blocks = [pa.array([x[a:z].tobytes() for a, z in zip(starts, ends, strict=True)], pa.binary()) for x in (keys, counts)]
            yield pa.RecordBatch.from_arrays([parts, shards, *blocks], names=["part", "shard", "keys", "counts"])

        for batch in text_batches(batches):
            for _, _, hashes in batch.runs(max_words):
                held.append(hashes)
                n += len(hashes)
            if n >= SUM_HASHES:
                yield from summed()
                n = 0
        if n:
            yield from summed()

    def merge(table: pa.Table) -> pa.Table:
        out = np.zeros(1 << BITS - lead, bool)
        shard = table.column("shard").to_numpy()
        keys, counts = ([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column(c)] for c in ("keys", "counts"))
        for s in np.unique(shard):
            own = np.flatnonzero(shard == s)
            key, count = (np.concatenate([x[i] for i in own]) for x in (keys, counts))
            order = np.argsort(key)
            key = key[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            total = np.add.reduceat(count[order], first, dtype=np.int64)
            out[key[first[total >= support]] >> np.uint32(32 + lead - BITS)] = True
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())})

    made = texts.mapInArrow(mine, "part int, shard int, keys binary, counts binary").groupBy("part").applyInArrow(merge, "part int, bits binary")
    out = np.zeros(1 << BITS >> 3, np.uint8)
    size = 1 << BITS - lead >> 3
    for r in made.toLocalIterator():  # 2**BITS bits, whatever the corpus
        out[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


def exact_counts(texts: DataFrame, known: np.ndarray, max_words: int) -> DataFrame:
    """lang, words, phrase, a: counts of all phrases whose bit is set; words = 0 has the words of a language."""
    sent = texts.sparkSession.sparkContext.broadcast(known)  # 2**BITS bits, whatever the corpus

    def count(batches):
        bits = sent.value
        for batch in text_batches(batches):
            per_lang = np.bincount(batch.lang, minlength=len(batch.langs))
            yield from tables(["lang", "words", "phrase", "a"], batch.langs, pa.array(np.zeros(len(per_lang), np.int32)), pa.array([""] * len(per_lang), pa.string()), pa.array(per_lang, pa.int64()))
            for n, at, hashes in batch.runs(max_words):
                bit = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
                at = at[bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 == 1]
                if not len(at):
                    continue
                # phrases by the numbers of their words, not by hash; numbered anew where a product would pass 62 bits
                number, top = batch.lang[at].astype(np.int64), len(batch.langs)
                for j in range(n):
                    if top * len(batch.words) >= 1 << 62:
                        number = np.unique(number, return_inverse=True)[1]
                        top = len(at)
                    number = number * len(batch.words) + batch.word[at + j]
                    top *= len(batch.words)
                _, first, counts = np.unique(number, return_index=True, return_counts=True)
                at = at[first]
                phrase = pc.binary_join_element_wise(*[batch.words.take(pa.array(batch.word[at + j])) for j in range(n)], pa.scalar(" ", batch.words.type))
                yield from tables(["lang", "words", "phrase", "a"], batch.langs.take(pa.array(batch.lang[at])), pa.array(np.full(len(at), n, np.int32)), phrase, pa.array(counts, pa.int64()))

    return texts.mapInArrow(count, "lang string, words int, phrase string, a long").groupBy("lang", "words", "phrase").agg(F.sum("a").alias("a"))


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, words, phrase, a: all phrases of 1 to max_words words with at least min_count, and a row of words = 0
    with the words of each language. Written."""
    texts = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    known = locally_frequent(texts, min_count, max_words)
    counts = exact_counts(texts, known, max_words)
    return written(counts.filter((F.col("a") >= min_count) | (F.col("words") == 0)), "phrases")


def exact(c: str) -> Column:
    return F.col(c).cast("decimal(15,0)")


def cut_scores(frequent: DataFrame, max_words: int) -> DataFrame:
    """The candidates with the lowest score of their cuts (the first of equal ones), and its l and r."""
    parts = frequent.filter("words > 0").select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    cuts = frequent.filter("words > 1").withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("right", F.expr("substring(phrase, length(left) + 2)"))
    for side, c in (("left", "l"), ("right", "r")):  # parts of a frequent phrase are frequent, so none is missing
        cuts = cuts.join(parts.select("lang", F.col("part").alias(side), F.col("f").alias(c)), ["lang", side])
    # a * a has 30 digits at most, a million times that 36 or 37: within 38
    score = F.expr("(1000000 * (cast(a AS decimal(15,0)) * cast(a AS decimal(15,0)))) div (cast(l AS decimal(15,0)) * cast(r AS decimal(15,0)))")
    low = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "words", "phrase", "a").agg(low).select("lang", "words", "phrase", "a", "cut.l", "cut.r", "cut.score")


def absorbed(frequent: DataFrame, max_words: int) -> DataFrame:
    """lang, phrase, most: phrases inside a longer frequent one, with the largest count of such."""
    inner = "flatten(transform(sequence(2, words - 1), n -> transform(sequence(1, words - n + 1), i -> array_join(slice(w, i, n), ' '))))"
    longer = frequent.filter("words > 2").withColumn("w", F.split("phrase", " "))
    return longer.select("lang", F.explode(F.expr(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))


def best(rows: DataFrame, top: int) -> DataFrame:
    """The first `top` rows of each language, with rank. Rows are dealt by a hash into 512 groups, of which
    each keeps its best; then into 16; then all that is left of a language is at most 16 * top rows."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for groups in (512, 16, 1):
        salt = F.pmod(F.xxhash64("phrase"), F.lit(groups))
        rows = rows.withColumn("__s", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__s").orderBy(*order))).filter(F.col("rank") <= top).drop("__s")
    return rows.withColumn("rank", F.col("rank").cast("long"))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, absorb_percent: int = ABSORB_PERCENT, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language."""
    frequent = frequent_phrases(docs, min_count, max_words, lang_col, text_col)
    scores = cut_scores(frequent, max_words).join(absorbed(frequent, max_words), ["lang", "phrase"], "left")
    alone = scores.filter(F.col("most").isNull() | (100 * exact("most") < absorb_percent * exact("a")))
    totals = frequent.filter("words = 0").select("lang", F.col("a").alias("n"))
    return best(alone, top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_GRAMS = " UNION ALL ".join(f"SELECT lang, {n} AS words, w[i:i + {n - 1}] AS p FROM (SELECT lang, w, unnest(range(1, len(w) - {n - 2})) AS i FROM pieces)" for n in range(1, MAX_WORDS + 1))
QUERIES = {"op13_collocations": op13_collocations}
ORACLE_SQL = {
    "op13_collocations": rf"""WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM texts)),
f AS (SELECT lang, words, p, count(*) AS a FROM ({_GRAMS}) GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
cuts AS (SELECT lang, words, p, a, unnest(range(1, words)) AS k FROM f WHERE words > 1),
scored AS (SELECT c.*, l.a AS l, r.a AS r, ((1000000::HUGEINT * c.a * c.a) // (l.a::HUGEINT * r.a))::BIGINT AS score FROM cuts c
  JOIN f l ON l.lang = c.lang AND l.p = c.p[1:k] JOIN f r ON r.lang = c.lang AND r.p = c.p[k + 1:]),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
longer AS (SELECT lang, p[1:2] AS p, a FROM f WHERE words = 3 UNION ALL SELECT lang, p[2:3], a FROM f WHERE words = 3),
most AS (SELECT lang, p, max(a) AS most FROM longer GROUP BY lang, p),
alone AS (SELECT s.lang, array_to_string(s.p, ' ') AS phrase, a, l, r, score FROM lowest s LEFT JOIN most m ON s.lang = m.lang AND s.p = m.p WHERE most IS NULL OR 100 * most < {ABSORB_PERCENT} * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM alone) JOIN totals USING (lang) WHERE rank <= {TOP}"""
}
