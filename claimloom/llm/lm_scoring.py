"""Scores of documents by masked pseudo-likelihood.

A network sees the two words on either side of a position, but not the word there, and predicts it:
the words' vectors (a table per side and distance) are summed and squashed; the word's path in a binary
tree over all ids (Huffman's, by frequency) gives the conditional probability as a product of one logistic
choice per node. A document's score is the sum of the log-probabilities of all its words.

Words are lower-cased (A-Z) and told apart by 64-bit hashes (chance of any two alike: n * n / 2**65).
Spark counts every word of all documents. Words of at least one in HEAD occurrences have ids of
their own (at most HEAD of them, ordered by frequency); every other word has one of RARE ids by its
hash, and its probability is that of the id in its context, times the word's share of the id's
occurrences, from the table of counts. So the probabilities sum to 1 over all words of the corpus, the
table grows with the input, and only as context do words of one RARE id look alike. Shares of at
most KNOWN words (of at least one in KNOWN occurrences) go to all tasks; other words meet theirs in a
join on the hash.

The network starts as the words' frequencies and is trained in numpy on every document, each once: of
its words one in MASKED is predicted, all are context.
Documents are dealt to shards by a hash of id and text and sorted in them; a shard has about SHARD_WORDS
words, or PER_PARAMETER for each parameter where that is more, so the copies of the parameters that
are averaged stay a fixed part of the input. In each round every shard starts from the same parameters,
trains on its documents of that round, and sends its parameters back; they are averaged, weighted by
words, in Spark (at most FAN in a group, level by level). The number of shards follows from the
documents alone, so scores don't depend on partitions or executors, but for the order of sums.

Defined cases: null or empty texts and texts without words have no words, the score 0 and no mean;
an empty table trains nothing (the first parameters stay); repeated rows are trained on and scored
each (rows equal in both id and text fall into one shard); very long texts are processed in batches of
positions; existing columns named as the results are replaced."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pa_type, sized, split_words, translated, without, written

DIM = 16
SIDES = (-2, -1, 1, 2)
#: Words of at least one in HEAD of all occurrences have ids of their own; the others share RARE ids.
HEAD, RARE = 1 << 17, 1024
#: Shares of at least one in KNOWN of all occurrences are broadcast.
KNOWN = 1 << 21
#: Positions of a step, and of a piece of documents that is turned into positions at once.
BATCH, HOLD = 1 << 12, 1 << 17
RATE = 0.1
#: In training, one of so many words of a document is masked and predicted; all are context. Scores predict all.
MASKED = 2
SHARD_WORDS, PER_PARAMETER = 1 << 22, 4
#: Parts of 16 of the documents, round by round.
ROUNDS = (1, 3, 12)
FAN = 256
SEED = 7
BLOCK_FLOATS = 8192
BATCH_BYTES = 8 << 20

#: Lower-cases A-Z; white space becomes a blank.
FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))

Params = dict[str, np.ndarray]


def tree_paths(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Huffman's tree over at least two ids: the bounds of each id's path, its nodes and signs, and the
    start bias of each node, by which the product along a path is the id's frequency."""
    n = len(counts)
    order = np.argsort(counts, kind="stable")
    mass, parent, sign = np.concatenate([counts[order] + 1.0, np.zeros(n - 1)]).tolist(), [0] * (2 * n - 1), [1] * (2 * n - 1)
    leaf, inner = 0, n
    for node in range(n, 2 * n - 1):
        for side in (1, -1):
            if leaf < n and (inner >= node or mass[leaf] <= mass[inner]):
                low, leaf = leaf, leaf + 1
            else:
                low, inner = inner, inner + 1
            parent[low], sign[low] = node, side
            mass[node] += mass[low]
    parent, sign, mass = np.array(parent), np.array(sign, np.float32), np.array(mass)
    first = np.zeros(2 * n - 1)
    np.add.at(first, parent[:-1][sign[:-1] > 0], mass[:-1][sign[:-1] > 0])
    bias = np.log(first[n:] / (mass[n:] - first[n:])).astype(np.float32)
    at, whose, nodes, signs = np.arange(n), [], [], []
    own = np.arange(n)
    while len(own):  # all paths a step further up
        whose.append(order[own]), nodes.append(parent[at] - n), signs.append(sign[at])
        at = parent[at]
        own, at = own[at < 2 * n - 2], at[at < 2 * n - 2]
    whose, nodes, signs = map(np.concatenate, (whose, nodes, signs))
    by_id = np.argsort(whose, kind="stable")
    return np.searchsorted(whose[by_id], np.arange(n + 1)), nodes[by_id].astype(np.int32), signs[by_id], bias


@dataclass
class Vocabulary:
    """The words with ids of their own, all ids' counts, and their paths in the tree."""

    heads: np.ndarray  # hashes, sorted
    ids: np.ndarray  # their ids: ranks by frequency
    counts: np.ndarray  # of ids

    def __post_init__(self):
        self.bounds, self.nodes, self.signs, self.bias = tree_paths(self.counts)
        self.size = self.pad = len(self.counts)
        self.lengths = np.diff(self.bounds).astype(np.int16)
        self.shapes = {"e": (len(SIDES) * (self.size + 1), DIM), "b": (DIM,), "w": (self.size - 1, DIM), "wb": (self.size - 1,)}
        self.parameters = sum(int(np.prod(s)) for s in self.shapes.values())

    def ids_of(self, hashes: np.ndarray) -> np.ndarray:
        rare = len(self.heads) + hashes % RARE
        if not len(self.heads):
            return rare
        at = np.minimum(np.searchsorted(self.heads, hashes), len(self.heads) - 1)
        return np.where(self.heads[at] == hashes, self.ids[at], rare)

    def unflat(self, x: np.ndarray) -> Params:
        out, at = {}, 0
        for k, s in self.shapes.items():
            n = int(np.prod(s))
            out[k], at = x[at : at + n].reshape(s), at + n
        return out

    def start(self) -> np.ndarray:
        """The words' frequencies, whatever the context."""
        x = np.zeros(self.parameters, np.float32)
        p = self.unflat(x)
        p["e"][:] = np.random.default_rng(SEED).normal(0, 0.1, p["e"].shape)
        p["wb"][:] = self.bias
        return x


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words of texts, each position's number among them, and the bounds of each
    text's positions."""
    words, index, bounds = split_words(translated(texts, FOLD))
    words = words.to_numpy(zero_copy_only=False).tolist()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64), index, bounds


def pieces(texts: pa.Array):
    """Bounds of pieces of texts of about BATCH_BYTES."""
    yield from sized(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).tolist(), BATCH_BYTES)


def placed(index: np.ndarray, bounds: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids, with pad twice around each text; the positions of words; each position's text."""
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n)
    out = np.full(len(index) + 2 * len(n) + 2, pad, np.int64)
    at = np.arange(len(doc)) + 2 * doc + 2
    out[at] = index
    return out, at, doc


def hidden(p: Params, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The squashed sums of the context's vectors, and the rows of these vectors."""
    step = len(p["e"]) // len(SIDES)
    rows = np.concatenate([ids[at + off] + s * step for s, off in enumerate(SIDES)])
    h = p["e"][rows].reshape(len(SIDES), len(at), DIM).sum(0) + p["b"]
    return np.tanh(h, out=h), rows


def by_length(v: Vocabulary, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of y by falling length of their paths, and how many of them have a node on each level."""
    n = v.lengths[y]
    order = np.argsort(-n, kind="stable")
    return order, len(y) - np.searchsorted(n[order[::-1]], np.arange(n.max()), "right")


def log_probs(v: Vocabulary, p: Params, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The conditional log-probability of the id at each position."""
    order, active = by_length(v, ids[at])
    at = at[order]
    first, (h, _) = v.bounds[ids[at]], hidden(p, ids, at)
    total = np.zeros(len(at), h.dtype)
    for level, m in enumerate(active):
        path = first[:m] + level
        nodes = v.nodes[path]
        z = np.einsum("ij,ij->i", h[:m], p["w"][nodes])
        z += p["wb"][nodes]
        z *= -v.signs[path]
        total[:m] -= np.log1p(np.exp(np.minimum(z, 60, out=z), out=z), out=z)
    out = np.empty_like(total)
    out[order] = total
    return out


def gradients(v: Vocabulary, p: Params, ids: np.ndarray, at: np.ndarray):
    """Of the mean negative log-probability: (name, rows of the table, their gradients)."""
    order, active = by_length(v, ids[at])
    at = at[order]
    first, (h, rows) = v.bounds[ids[at]], hidden(p, ids, at)
    dh, met, slopes = np.zeros_like(h), [], []
    for level, m in enumerate(active):
        path = first[:m] + level
        nodes, sign = v.nodes[path], v.signs[path]
        vectors = p["w"][nodes]
        z = np.einsum("ij,ij->i", h[:m], vectors)
        z += p["wb"][nodes]
        z *= sign
        np.exp(np.minimum(z, 60, out=z), out=z)
        z += 1
        np.divide(sign, z, out=z)  # the part of the choice that was not expected
        z *= -1 / len(at)
        vectors *= z[:, None]
        dh[:m] += vectors
        met.append(nodes), slopes.append(z)
    nodes, d = np.concatenate(met), np.concatenate(slopes)
    met = np.flatnonzero(np.bincount(nodes, minlength=len(p["wb"])))
    place = np.empty(len(p["wb"]), np.int64)
    place[met] = np.arange(len(met))
    nodes = place[nodes]
    yield "wb", met, np.bincount(nodes, d)
    yield "w", met, np.stack([np.bincount(nodes, np.concatenate([x[:m] for m in active]) * d) for x in np.ascontiguousarray(h.T)], axis=1).astype(h.dtype)
    dh *= 1 - h * h
    yield "b", slice(None), dh.sum(0)
    order = np.argsort(rows, kind="stable")
    start = np.flatnonzero(np.diff(rows[order], prepend=-1))
    yield "e", rows[order][start], np.add.reduceat(dh[order % len(dh)], start, axis=0)


class Trainer:
    """Adagrad over the documents that it is given; what it learns depends on their order alone."""

    def __init__(self, vocabulary: Vocabulary, flat: np.ndarray):
        self.vocabulary, self.flat, self.words = vocabulary, flat.copy(), 0
        self.params = vocabulary.unflat(self.flat)
        self.squares = vocabulary.unflat(np.full(len(flat), 1e-7, np.float32))
        self.held: list[np.ndarray] = []
        self.size = 0

    def see(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= HOLD:
            self.learn()

    def learn(self) -> None:
        if self.size:
            bounds = np.cumsum([0, *map(len, self.held)])
            ids, at, doc = placed(np.concatenate(self.held), bounds, self.vocabulary.pad)
            at = at[(np.arange(len(at)) - bounds[doc] + doc) % MASKED == 0]
            for a in range(0, len(at), BATCH):
                for name, rows, g in list(gradients(self.vocabulary, self.params, ids, at[a : a + BATCH])):
                    squares = self.squares[name][rows] + g * g
                    self.squares[name][rows] = squares
                    self.params[name][rows] -= RATE * g / np.sqrt(squares)
        self.words += self.size
        self.held, self.size = [], 0


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """h and n of every distinct word of all documents, written."""

    def count(batches):
        for batch in batches:
            for a, b in pieces(batch.column(0)):
                hashes, index, _ = word_hashes(batch.column(0).slice(a, b - a))
                n = np.bincount(index, minlength=len(hashes))
                yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(n.astype(np.int64))], names=["h", "n"])

    counts = docs.select(F.col(text_col).alias("t")).mapInArrow(count, "h long, n long")
    return written(counts.groupBy("h").agg(F.sum("n").alias("n")), "words")


def rare_id(h: Column) -> Column:
    return F.pmod(h, F.lit(RARE))


def vocabulary_of(words: DataFrame, limit: int = HEAD) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary, and h, n and log_share of the words without an id of their own, written."""
    total = words.agg(F.sum("n")).first()[0] or 0
    own = F.col("n") * limit >= total
    heads = words.filter(own).toArrow()  # at most limit rows
    h, n = heads.column("h").to_numpy(), heads.column("n").to_numpy()
    rank = np.lexsort((h, -n))
    rest = words.filter(~own)
    sums = rest.groupBy(rare_id(F.col("h")).alias("r")).agg(F.sum("n").alias("of"))  # at most RARE rows
    counts = np.concatenate([n[rank], np.zeros(RARE, np.int64)])
    for r in sums.collect():
        counts[len(h) + r["r"]] = r["of"]
    ids = np.empty(len(h), np.int64)
    ids[rank] = np.arange(len(h))
    order = np.argsort(h)
    shares = rest.withColumn("r", rare_id(F.col("h"))).join(F.broadcast(sums), "r").select("h", "n", F.log(F.col("n") / F.col("of")).alias("log_share"))
    return Vocabulary(h[order], ids[order], counts), written(shares, "shares")


PARTS = "task long, block int, words double, part binary"


def mean_of(table: pa.Table) -> pa.Table:
    """The mean of some shards' parts of one block, weighted by words."""
    table = table.sort_by("task")
    words = table.column("words").to_numpy()
    parts = np.stack([np.frombuffer(x, np.float32) for x in table.column("part").to_pylist()])
    mean = (words @ parts / words.sum()).astype(np.float32)
    return pa.table({"task": pa.array([table.column("task")[0].as_py() // FAN], pa.int64()), "block": table.column("block")[:1].cast(pa.int32()), "words": pa.array([words.sum()], pa.float64()), "part": pa.array([mean.tobytes()], pa.binary())})


def train(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text_col: str = "text", rounds: tuple[int, ...] = ROUNDS, shard_words: int = SHARD_WORDS) -> np.ndarray:
    """The parameters after all rounds."""
    flat, low = vocabulary.start(), 0
    n_shards = max(1, round(int(vocabulary.counts.sum()) / max(shard_words, PER_PARAMETER * vocabulary.parameters)))
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("k"), F.col(text_col).alias("t")).filter("t IS NOT NULL")
    rows = rows.withColumn("h", F.xxhash64("k", "t")).withColumn("shard", F.pmod("h", F.lit(n_shards)))
    deal = F.pmod(F.shiftrightunsigned("h", 24), F.lit(sum(rounds)))
    for share in rounds:
        mine = rows.filter((deal >= low) & (deal < low + share)).repartition(n_shards, "shard").sortWithinPartitions("shard", "h", "k", "t").select("shard", "t")
        low += share
        shared = docs.sparkSession.sparkContext.broadcast((vocabulary, flat))

        def fit(batches, shared=shared):
            words, flat = shared.value
            trainer, shard = None, None

            def result():
                trainer.learn()
                parts = [trainer.flat[i : i + BLOCK_FLOATS].tobytes() for i in range(0, len(flat), BLOCK_FLOATS)]
                n = len(parts)
                return pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([float(trainer.words)] * n), pa.array(parts, pa.binary())], names=["task", "block", "words", "part"])

            for batch in batches:
                own, texts = batch.column(0).to_numpy(), batch.column(1)
                for a, b in pieces(texts):
                    hashes, index, bounds = word_hashes(texts.slice(a, b - a))
                    ids = words.ids_of(hashes)[index]
                    for i in range(b - a):
                        if own[a + i] != shard:
                            if trainer and trainer.words + trainer.size:
                                yield result()
                            trainer, shard = Trainer(words, flat), own[a + i]
                        trainer.see(ids[bounds[i] : bounds[i + 1]])
            if trainer and trainer.words + trainer.size:
                yield result()

        parts, left = mine.mapInArrow(fit, PARTS), n_shards
        while left > 1:
            parts = parts.groupBy("block", (F.col("task") / FAN).cast("long").alias("of")).applyInArrow(mean_of, PARTS)
            left = -(-left // FAN)
        got = parts.select("block", "part").collect()  # one row per block of the model
        if got:
            flat = np.concatenate([np.frombuffer(r.part, np.float32) for r in sorted(got, key=lambda r: r.block)])
    return flat


def network(docs: DataFrame, vocabulary: Vocabulary, flat: np.ndarray, known: tuple[np.ndarray, np.ndarray], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with __row (tells rows apart), n_words, log_prob (of ids, and with the shares of known words)
    and __rest (the hashes of words without an id of their own or a known share)."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, flat, known))
    docs = without(docs, ["n_words", "log_prob", "mean_log_prob"])
    names = [c for c in docs.columns if keep is None or c in keep]
    frame = docs.select(*names, F.col(text_col).alias("__text"))
    fields = [T.StructField("__row", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("log_prob", T.DoubleType()), T.StructField("__rest", T.ArrayType(T.LongType(), False))]
    types = [pa_type(f.dataType) for f in fields]

    def run(batches):
        from pyspark import TaskContext

        words, flat, (keys, shares) = shared.value
        p, row = words.unflat(flat), TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch.column(len(names))
            for a, b in pieces(texts):
                hashes, index, bounds = word_hashes(texts.slice(a, b - a))
                own = words.ids_of(hashes)
                at_known = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
                is_known = keys[at_known] == hashes if len(keys) else np.zeros(len(hashes), bool)
                share = np.where(is_known, shares[at_known], 0.0) if len(keys) else np.zeros(len(hashes))
                ids, at, doc = placed(own[index], bounds, words.pad)
                total = np.bincount(doc, share[index], b - a)
                for i in range(0, len(at), BATCH):
                    total += np.bincount(doc[i : i + BATCH], log_probs(words, p, ids, at[i : i + BATCH]), b - a)
                open_ = ((own >= len(words.heads)) & ~is_known)[index]
                ends = np.concatenate([[0], np.cumsum(open_)])[bounds]
                rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes[index[open_]]))
                new = [pa.array(np.arange(row, row + b - a)), pa.array(np.diff(bounds)), pa.array(total), rest]
                row += b - a
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in range(len(names))], *[x.cast(t) for x, t in zip(new, types, strict=True)]], names=[*names, *[f.name for f in fields]])

    return frame.mapInArrow(run, T.StructType([*[frame.schema[c] for c in names], *fields]))


def score(docs: DataFrame, vocabulary: Vocabulary, shares: DataFrame, flat: np.ndarray, text_col: str = "text", keep: list[str] | None = None, limit: int = KNOWN) -> DataFrame:
    """docs with n_words, log_prob (the sum) and mean_log_prob."""
    total = int(vocabulary.counts.sum())
    known = shares.filter(F.col("n") * limit >= total).select("h", "log_share").toArrow()  # at most limit rows
    keys, values = known.column("h").to_numpy(), known.column("log_share").to_numpy()
    order = np.argsort(keys)
    rows = written(network(docs, vocabulary, flat, (keys[order], values[order].astype(np.float32)), text_col, keep), "scored")
    rest = rows.select("__row", F.explode("__rest").alias("h")).join(shares.select("h", "log_share"), "h")
    rest = rest.groupBy("__row").agg(F.sum("log_share").alias("__more"))
    out = rows.drop("__rest").join(rest, "__row", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("__more", F.lit(0.0)))
    return out.drop("__row", "__more").withColumn("mean_log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    vocabulary, shares = vocabulary_of(count_words(docs))
    return score(docs, vocabulary, shares, train(docs, vocabulary), keep=["doc_id"])


QUERIES = {"op7_lm_scoring": op7_lm_scoring}
ORACLE_SQL: dict[str, str] = {}
