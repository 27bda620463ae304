"""Exact substring dedup over the suffixes of all texts, bucket by bucket.

Removed is every byte covered by a string of LENGTH bytes that also starts earlier. Suffixes matter
up to LENGTH bytes, and only those that tie with another for so long. A difference cover finds them:
of any two positions, some shift k < 73 brings both onto cover samples, so if two suffixes tie for
LENGTH bytes, two cover samples in their first 73 positions tie for GRAM = LENGTH - 72 bytes.

1. Samples (9 of 73 positions of each text) are ranked by their first GRAM bytes: bucket by bucket,
   one task sorts the samples of a bucket and reports which tie.
2. Suffixes with a tied sample within reach are the long ties. They are sorted the same way, one
   suffix bucket at a time, by their LENGTH bytes; in a run of equal ones all but the earliest are
   repeats. Suffixes without a tied sample are never moved.
3. Repeats cover bytes; maximal covered runs are cut out.

The method's comparison is by 64-bit fingerprints of the compared bytes, not by order of the bytes,
because only equality for LENGTH bytes is asked for. (Chance of one false tie among n long ties:
n * n / 2**65, or n * n / 2**(57 + bits) with 2**bits buckets, where they are fewer than 256.) Memory is bounded by a chunk of texts in steps 1-3's maps, and by a bucket in sorts;
the number of buckets follows the input. A chunk tells each distinct string once, so a string shared by
very many documents is told once per chunk. Whole texts equal to an earlier text are settled by a
digest beforehand: their bytes are all covered.

Texts are written once as a table bucketed by chunk in the shared folder, so that the answers of the
sorts come back as one bit per suffix, joined by chunk without a shuffle of texts.

Defined cases: null is the empty text; texts shorter than LENGTH stay whole; equal doc_ids are told
apart in the order in which the table was written; a null doc_id comes before all others; no rows
give no rows; other columns of the input are not used. Keys must be integers, or cast to them: others
are an error."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, partitions, written

LENGTH = 100
PERIOD = 73
#: A perfect difference set: each nonzero residue of 73 is one difference of two of its members.
COVER = sorted(pow(2, i, PERIOD) for i in range(9))
CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 8 << 20
#: Spark allows a table no more buckets than this; beyond it a bucket holds several chunks, still one group each.
TABLE_BUCKETS = 100_000
BLOCK = 1 << 19
NULL_ID = -(1 << 63)

_M = np.uint64(0x9E3779B97F4A7C15 | 1)
_MINV = np.uint64(pow(int(_M), -1, 1 << 64))
_BYTE = np.random.default_rng(73).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def powers() -> tuple[np.ndarray, np.ndarray]:
    """M**i and M**-i modulo 2**64."""
    if not _powers:
        n = BLOCK + 4096
        for m in (_M, _MINV):
            x = np.full(n, m, np.uint64)
            x[0] = 1
            _powers.append(np.cumprod(x, dtype=np.uint64))
    return _powers[0], _powers[1]


def fingerprints(data: np.ndarray, a: int, b: int, length: int) -> np.ndarray:
    """64-bit fingerprints of data[p : p + length] for p in a .. b - 1 (at most BLOCK of them)."""
    up, down = powers()
    part = data[a : b + length - 1]
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(_BYTE[part] * down[: len(part)], out=sums[1:])
    h = (sums[length:] - sums[:-length]) * up[: len(part) - length + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


class Chunk:
    """Texts of a chunk in order, as one array; positions never look beyond their text."""

    def __init__(self, table: pa.Table, notes: pa.Table, bits: int, length: int):
        self.bits, self.length = bits, length
        table = table.sort_by([("k", "ascending"), ("rid", "ascending")])
        self.k, self.rid = table.column("k").to_numpy(), table.column("rid").to_numpy()
        texts = table.column("t").to_pylist()
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.end = np.cumsum([len(t) for t in texts])
        self.start = self.end - [len(t) for t in texts] if texts else self.end
        notes = {(s, b): m for s, b, m in zip(*[notes.column(c).to_pylist() for c in ("step", "bucket", "mask")], strict=True)}
        self.notes = notes
        self.copy = np.isin(self.rid, np.frombuffer(notes.get((0, 0), b""), np.int64))

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions of cover samples and their fingerprints, without texts that are copies."""
        gram = self.length - PERIOD + 1
        at, prints = [], []
        for d in np.flatnonzero(~self.copy & (self.end - self.start >= self.length)):
            s, e = int(self.start[d]), int(self.end[d])
            own = np.arange(0, e - s - gram + 1, PERIOD)[:, None] + np.array(COVER)
            own = own.ravel()
            at.append(own[own <= e - s - gram] + s)
        at = np.concatenate(at) if at else np.zeros(0, np.int64)
        for a in range(0, len(self.data), BLOCK):
            b = min(a + BLOCK, len(self.data) - gram + 1)
            lo, hi = np.searchsorted(at, [a, a + BLOCK])
            if hi > lo:
                prints.append(fingerprints(self.data, a, b, gram)[at[lo:hi] - a])
        return at, np.concatenate(prints) if prints else np.zeros(0, np.uint64)

    def named(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sample positions, their distinct shortened fingerprints (sorted), each one's place, and counts."""
        at, h = self.samples()
        return at, *np.unique(h >> np.uint64(32 - self.bits), return_inverse=True, return_counts=True)

    def bounds(self, top: np.ndarray) -> np.ndarray:
        """Where the buckets start in sorted bucket numbers."""
        return np.searchsorted(top, np.arange((1 << self.bits) + 1, dtype=np.uint64))

    def answers(self, step: int, bounds: np.ndarray) -> np.ndarray:
        """The bits that a sort has returned, in the order in which its input was sent."""
        out = np.zeros(bounds[-1], bool)
        for b in np.flatnonzero(np.diff(bounds)):
            n = bounds[b + 1] - bounds[b]
            out[bounds[b] : bounds[b + 1]] = np.unpackbits(np.frombuffer(self.notes[step, int(b)], np.uint8), count=n).astype(bool)
        return out

    def long_ties(self) -> np.ndarray:
        """Positions whose string of LENGTH bytes fits its text and has a tied sample within reach."""
        at, names, place, count = self.named()
        tied = self.answers(1, self.bounds(names >> np.uint64(32))) | (count > 1)
        hit = at[tied[place]]
        edge = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(edge, np.maximum(hit - PERIOD + 1, 0), 1)
        np.add.at(edge, hit + 1, -1)
        may = np.cumsum(edge[:-1]) > 0
        for s, e, c in zip(self.start.tolist(), self.end.tolist(), self.copy.tolist(), strict=True):
            may[s if c else max(s, e - self.length + 1) : e] = False
        return np.flatnonzero(may)

    def firsts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Long ties: positions whose string is the first of its kind here (by bucket, then by position),
        their fingerprints, and the positions whose string isn't."""
        at, prints = self.long_ties(), []
        for a in range(0, len(self.data), BLOCK):
            lo, hi = np.searchsorted(at, [a, a + BLOCK])
            if hi > lo:
                b = min(a + BLOCK, len(self.data) - self.length + 1)
                prints.append(fingerprints(self.data, a, b, self.length)[at[lo:hi] - a])
        h = np.concatenate(prints) if prints else np.zeros(0, np.uint64)
        _, first = np.unique(h, return_index=True)
        later = np.ones(len(at), bool)
        later[first] = False
        first.sort()
        first = first[np.argsort(h[first] >> np.uint64(64 - self.bits), kind="stable")]
        return at[first], h[first], at[later]


def send_samples(chunk: Chunk, number: int):
    _, names, _, _ = chunk.named()
    bounds = chunk.bounds(names >> np.uint64(32))
    keys = names.astype(np.uint32)
    for b in np.flatnonzero(np.diff(bounds)):
        yield int(b), number, int(bounds[b + 1] - bounds[b]), squeeze(keys[bounds[b] : bounds[b + 1]].astype("<u4")), b""


def send_suffixes(chunk: Chunk, number: int):
    at, h, _ = chunk.firsts()
    bounds = chunk.bounds(h >> np.uint64(64 - chunk.bits))
    doc = np.searchsorted(chunk.end, at, "right")
    keys = (h << np.uint64(chunk.bits)) >> np.uint64(8)
    for b in np.flatnonzero(np.diff(bounds)):
        part = slice(bounds[b], bounds[b + 1])
        which, runs = np.unique(doc[part], return_counts=True)  # positions are in document order
        raw = keys[part].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]
        head = np.concatenate([chunk.k[which], chunk.rid[which], runs]).astype("<i8").tobytes()
        yield int(b), number, int(bounds[b + 1] - bounds[b]), raw.tobytes(), zstandard.compress(head)


def squeeze(keys: np.ndarray) -> bytes:
    """Sorted 32-bit keys as compressed byte planes."""
    return zstandard.compress(keys.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary())])
SENT_SQL = "bucket int, chunk long, n int, keys binary, docs binary"
NOTE = pa.schema([("chunk", pa.int64()), ("step", pa.int32()), ("bucket", pa.int32()), ("mask", pa.binary())])
NOTE_SQL = "chunk long, step int, bucket int, mask binary"


def answer(table: pa.Table, step: int, repeat: np.ndarray) -> pa.Table:
    """A bit for each sent suffix, by chunk."""
    n = table.column("n").to_numpy()
    ends = np.cumsum(n)
    masks = [np.packbits(repeat[e - m : e]).tobytes() for e, m in zip(ends, n, strict=True)]
    return pa.table([table.column("chunk"), pa.array([step] * len(n), pa.int32()), table.column("bucket"), pa.array(masks, pa.binary())], schema=NOTE)


def sort_samples(table: pa.Table) -> pa.Table:
    keys = [np.frombuffer(zstandard.decompress(x), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel() for x in table.column("keys").to_pylist()]
    _, place, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    return answer(table, 1, count[place] > 1)


def sort_suffixes(table: pa.Table) -> pa.Table:
    """All but the earliest of equal suffixes."""
    keys, ks, rids, runs = [], [], [], []
    for raw, head in zip(table.column("keys").to_pylist(), table.column("docs").to_pylist(), strict=True):
        key = np.zeros((len(raw) // 7, 8), np.uint8)
        key[:, :7] = np.frombuffer(raw, np.uint8).reshape(-1, 7)
        keys.append(key.view("<u8").ravel())
        k, rid, run = np.frombuffer(zstandard.decompress(head), "<i8").reshape(3, -1)
        ks.append(k), rids.append(rid), runs.append(run)
    key, k, rid, run = map(np.concatenate, (keys, ks, rids, runs))
    order = np.lexsort((rid, k))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    rank = np.repeat(rank, run)
    order = np.lexsort((rank, key))
    repeat = np.zeros(len(key), bool)
    repeat[order[1:]] = key[order[1:]] == key[order[:-1]]
    return answer(table, 2, repeat)


def cut(chunk: Chunk) -> pa.Table:
    at, h, later = chunk.firsts()
    repeats = np.concatenate([later, at[chunk.answers(2, chunk.bounds(h >> np.uint64(64 - chunk.bits)))]])
    edge = np.zeros(len(chunk.data) + 1, np.int32)
    np.add.at(edge, repeats, 1)
    np.add.at(edge, repeats + chunk.length, -1)
    gone = np.cumsum(edge[:-1]) > 0
    spans, removed, kept = [], [], []
    for s, e, c in zip(chunk.start.tolist(), chunk.end.tolist(), chunk.copy.tolist(), strict=True):
        if c:
            gone[s:e] = True
        own = gone[s:e]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
        spans.append(edges.tolist())
        removed.append(int(own.sum()))
        kept.append(chunk.data[s:e][~own].tobytes())
    k = pa.array(chunk.k, pa.int64(), mask=chunk.k == NULL_ID)
    return pa.table([k, pa.array(chunk.end - chunk.start, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.binary())], names=["k", "n_bytes", "n_removed", "spans", "kept"])


def repeated_substrings(docs: DataFrame, key: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """For each row of docs: its key, n_bytes, n_removed, spans (byte offsets, start and end in turn) and
    kept (the bytes that stay)."""
    if length < PERIOD + 8:
        raise ValueError(f"length must be at least {PERIOD + 8}")
    spark = docs.sparkSession
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("k"), text.alias("t"))
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    scans = max(1, rows.rdd.getNumPartitions())
    split = max(1, round(total / scans / CHUNK_BYTES))  # chunks of a partition
    n_chunks = max(partitions(spark), scans * split)
    samples = total * len(COVER) // PERIOD
    bits = max(1, max(partitions(spark), samples * 4 // BUCKET_BYTES).bit_length())

    name = f"claimloom_suffix_{uuid.uuid4().hex}"
    chunk = F.spark_partition_id().cast("long") * split + F.pmod(F.xxhash64("k"), F.lit(split))
    rows = rows.select(chunk.alias("chunk"), "k", F.monotonically_increasing_id().alias("rid"), F.unhex(F.md5("t")).alias("digest"), "t")
    rows.write.format("parquet").option("compression", "zstd").option("path", new_path(spark, "texts")).bucketBy(min(n_chunks, TABLE_BUCKETS), "chunk").saveAsTable(name)
    table = spark.table(name)

    of_text = table.filter(F.length("t") >= length).select("chunk", "k", "rid", "digest")
    first = of_text.groupBy("digest").agg(F.min(F.struct("k", "rid")).alias("first"), F.count("*").alias("c")).filter("c > 1")
    copies = of_text.join(first, "digest").filter(F.struct("k", "rid") > F.col("first"))
    copies = copies.groupBy("chunk").agg(F.collect_list("rid").alias("rids"))

    def pack_rids(batches):
        for batch in batches:
            masks = [np.array(x, np.int64).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([0] * len(masks), pa.int32()), pa.array([0] * len(masks), pa.int32()), pa.array(masks, pa.binary())], schema=NOTE)

    notes = written(copies.mapInArrow(pack_rids, NOTE_SQL), "copies")
    texts = table.select("chunk", "k", "rid", "t")

    def send(how):
        def f(number: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return SENT.empty_table()
            out = list(how(Chunk(left, right, bits, length), number[0].as_py()))
            return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 5, SENT.types, strict=True)], schema=SENT)

        return f

    def per_chunk(f, notes: DataFrame, schema: str) -> DataFrame:
        return texts.groupBy("chunk").cogroup(notes.groupBy("chunk")).applyInArrow(f, schema)

    sent = per_chunk(send(send_samples), notes, SENT_SQL)
    notes = notes.unionByName(written(sent.groupBy("bucket").applyInArrow(sort_samples, NOTE_SQL), "sample_ties"))
    sent = per_chunk(send(send_suffixes), notes, SENT_SQL)
    notes = notes.unionByName(written(sent.groupBy("bucket").applyInArrow(sort_suffixes, NOTE_SQL), "repeats"))

    def finish(number: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            left = texts_schema.empty_table()
        return cut(Chunk(left, right, bits, length))

    texts_schema = pa.schema([("chunk", pa.int64()), ("k", pa.int64()), ("rid", pa.int64()), ("t", pa.binary())])
    out = per_chunk(finish, notes, "k long, n_bytes long, n_removed long, spans array<long>, kept binary")
    return out.withColumnRenamed("k", key)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = repeated_substrings(docs)
    return out.select("doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op6_suffix_dedup": op6_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}
