"""Token ids as binary files with shuffled bit planes.

A file holds whole documents in ascending doc_id order:

    header   magic "CLBP", version, plane bits (1 or 8), block size, ids, documents, planes of a block
    docs     doc_id (int64), has_id (uint8), first id (uint64), ids (uint64) of each document
    chunks   offset and length (uint64) of each plane of each block: the chunk index
    planes   each plane of each block of BLOCK ids, compressed with zstandard

A block of ids (little-endian unsigned 32-bit) is transposed: plane k holds bit k (or byte k) of all
its ids. Any block can be read alone by the chunk index.

Files are rows (part, file, n_docs, n_ids, payload) of a table in the shared folder: that store is
written by Spark, survives lost executors and needs no local disk. Documents are dealt by ranges of
doc_id and sorted within; a partition becomes as many files as FILE_IDS asks for. A file's place in
the whole stream follows from the sums of the parts before it, so texts are encoded once.

Defined cases: a null or empty text is the end id alone; a null doc_id sorts first and stays null;
rows with equal doc_id stay beside each other in any order; no rows give no files; ids of 32 bits at
most; existing columns don't matter. An added token of the tokenizer's file (such as its end mark) that
stands in a text is one id, as in the library's own encode. Keys must be integers (or cast to them)."""

from __future__ import annotations

import itertools
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, sized, utf8_size, written

BLOCK = 1 << 16
PLANE_BITS = 8
FILE_IDS = 1 << 21
END_ID = 2
MAGIC = b"CLBP"
HEADER = struct.Struct("<4sHHIQQI")
CACHE = 1_000_000
PART_BYTES = 32 << 20
#: UTF-8 bytes of texts that are encoded at a time.
BATCH_BYTES = 8 << 20
LATIN_END = 0x370


def planes_of(ids: np.ndarray, bits: int) -> list[bytes]:
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if bits == 8:
        return [raw[:, k].tobytes() for k in range(4)]
    cells = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(cells[:, k]).tobytes() for k in range(32)]


def ids_of(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    if bits == 8:
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        cells = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
        raw = np.packbits(cells, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").ravel()


def pack(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, bits: int = PLANE_BITS, block: int = BLOCK) -> bytes:
    n_planes = 32 // bits
    squeeze = zstandard.ZstdCompressor(level=3)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]) if counts else np.zeros(0)
    chunks, index, at = [], [], 0
    for i in range(0, len(ids), block):
        for plane in planes_of(ids[i : i + block], bits):
            chunks.append(squeeze.compress(plane))
            index.append((at, len(chunks[-1])))
            at += len(chunks[-1])
    docs = [np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is not None for d in doc_ids], np.uint8), starts.astype("<u8"), np.array(counts, "<u8")]
    return b"".join([HEADER.pack(MAGIC, 1, bits, block, len(ids), len(doc_ids), n_planes), *[x.tobytes() for x in docs], np.array(index, "<u8").tobytes(), *chunks])


def unpack(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, first ids, counts and all ids of a file."""
    magic, version, bits, block, n_ids, n_docs, n_planes = HEADER.unpack_from(payload)
    if magic != MAGIC or version != 1:
        raise ValueError("not a token file")
    at = HEADER.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(payload, kind, n, at)
        at += x.nbytes
        return x

    doc_id, has, start, count = take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs), take("<u8", n_docs)
    index = take("<u8", 2 * n_planes * -(-n_ids // block)).reshape(-1, n_planes, 2)
    expand, out = zstandard.ZstdDecompressor(), []
    for b, planes in enumerate(index):
        n = min(block, n_ids - b * block)
        out.append(ids_of([expand.decompress(payload[at + int(o) : at + int(o) + int(s)]) for o, s in planes], n, bits))
    ids = np.concatenate(out) if out else np.zeros(0, "<u4")
    return [int(d) if h else None for d, h in zip(doc_id, has, strict=True)], start.astype(np.int64), count.astype(np.int64), ids


class Encoder:
    """Byte-level BPE by the tokenizers library, with remembered words.

    The vocabulary's pattern always ends a piece before a single blank or line end that stands between
    two other characters, so texts are cut there and each distinct word of a batch is looked up once.
    Unknown words are encoded by the library, many at a time. Words of letters alone are one piece
    each, and go to the model without the pattern. Texts in which white space meets white space are cut
    only where it doesn't. Texts that hold an added token go to the library whole, and so do all texts
    if the file's normalizer, pre-tokenizer or post-processor is not the one that this rests on."""

    def __init__(self, path: str):
        import os
        import re

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        first = told["pre_tokenizer"] or {}
        plain = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space", True)
        self.plain = plain and told["model"]["type"] == "BPE" and not told["model"].get("dropout") and not told["normalizer"] and not told["truncation"] and not told["padding"]
        self.added = [x["content"] for x in told["added_tokens"]]
        if not self.plain:
            return
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.pieces = Tokenizer(self.tokenizer.model)
        self.known: dict[str, bytes] = {}
        self.runs, self.cut, self.blank = re.compile(r"\s\s"), re.compile(r"(?<!\s) (?!\s)"), re.compile(r"\s")
        self.rare = "[" + "".join(c for c in map(chr, range(0x110000)) if c.isspace() and c not in " \n") + "]"
        # letters up to here are the same in every version of Unicode that libraries use
        latin = "".join(c for c in map(chr, range(LATIN_END)) if c.isalpha())
        self.latin = re.compile(rf"(\n?[{latin}]+)([.,;:!?]?)")
        self.spelt = {ord(c): spell(c)[0][0] for c in latin + " "}
        self.spelt_end = spell("\n")[0][0]
        self.newline = self.ids(["\n"])[0]
        self.line_end = int.from_bytes(self.newline, "little")
        self.marks = dict(zip(".,;:!?", self.ids(list(".,;:!?")), strict=True))

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(c.ids, "<u4").tobytes() for c in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, text: str) -> list[str]:
        """Keys of a text with runs of white space: a word stands for a blank and itself, `\\n` and a word
        for what starts a line. The text's own start is the first line's."""
        if self.runs.search(text):
            head, *rest = self.cut.split(text)
            return ["\n" + head, *rest]
        return ("\n" + text).replace("\n", " \n").split(" ")[1:]

    def between(self, codes: list[int]) -> list[bytes]:
        """Ids of words that are told apart by line ends."""
        own = np.array(codes, "<u4")
        ends, raw = np.flatnonzero(own == self.line_end).tolist(), own.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *[e + 1 for e in ends]], [*ends, len(own)], strict=True)]

    def together(self, words: list[str], lead: str) -> list[bytes]:
        """The ids of lead and word, for words without white space: a line end between two is one id."""
        out = []
        for i in range(0, len(words), 1000):
            out += self.between(self.tokenizer.encode_batch_fast([lead + f"\n{lead}".join(words[i : i + 1000])], add_special_tokens=False)[0].ids)
        return out

    def letters(self, words: list[str], lead: str) -> list[bytes]:
        """The same for words of Latin letters alone. Each is one piece of the pattern, so the model gets
        it at once, its bytes written as the vocabulary writes them."""
        out = []
        for i in range(0, len(words), 1000):
            own = (lead + f"\n{lead}".join(words[i : i + 1000])).translate(self.spelt).split("\n")
            parts = [self.spelt_end] * (2 * len(own) - 1)
            parts[::2] = own
            out += self.between(self.pieces.encode_batch_fast([parts], is_pretokenized=True, add_special_tokens=False)[0].ids)
        return out

    def learn(self, missing: list[str]) -> None:
        known, letters = self.known, self.latin.fullmatch
        inside, starts, odd = [], [], []
        stems: dict[str, None] = {}
        marked = []  # a mark after letters is a piece of its own, so such words follow from the word without it
        for w in missing:
            if m := letters(w):
                stem, mark = m.groups()
                stems[stem] = None
                if mark:
                    marked.append((w, stem, mark))
            else:
                bare = w.removeprefix("\n")
                (odd if not bare or self.blank.search(bare) else inside if bare is w else starts).append(w)
        todo = [w for w in stems if w not in known]
        inner, first = [w for w in todo if w[0] != "\n"], [w for w in todo if w[0] == "\n"]
        for own, encode in ((inside, self.together), (inner, self.letters)):
            known.update(zip(own, encode(own, " "), strict=True))
        for own, encode in ((starts, self.together), (first, self.letters)):
            known.update(zip(own, [self.newline + x for x in encode([w[1:] for w in own], "")], strict=True))
        known.update(zip(odd, [self.newline + x if w[:1] == "\n" else x for w, x in zip(odd, self.ids([w[1:] if w[:1] == "\n" else " " + w for w in odd]), strict=True)], strict=True))
        marks = self.marks
        known.update([(w, known[stem] + marks[mark]) for w, stem, mark in marked])

    def of_words(self, words: pa.Array, bounds: np.ndarray) -> list[np.ndarray]:
        """The ids of texts whose keys are words[bounds[i] : bounds[i + 1]], less the line end that the first key brings."""
        coded = words.dictionary_encode()
        distinct, known = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.known
        missing = [w for w in distinct if w not in known]
        if len(known) + 2 * len(missing) > CACHE:  # the words that came first are the frequent ones
            self.known = known = dict(itertools.islice(known.items(), CACHE // 2))
            missing = [w for w in distinct if w not in known]
        self.learn(missing)
        own = [known[w] for w in distinct]
        ids = np.frombuffer(b"".join(own), "<u4")
        size = np.fromiter(map(len, own), np.int64, len(own)) // 4
        index = coded.indices.to_numpy()
        first, n = (np.cumsum(size) - size)[index], size[index]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = ids[np.repeat(first - ends[:-1], n) + np.arange(ends[-1])]
        at = ends[bounds].tolist()
        return [ids[a + 1 : b] for a, b in zip(at, at[1:], strict=False)]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text as little-endian 32-bit integers."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(texts)
        whole = pa.array(np.full(len(texts), not self.plain))
        for mark in self.added if self.plain else []:
            whole = pc.or_(whole, pc.match_substring(texts, mark))
        odd = pa.array(np.zeros(len(texts), bool))
        if self.plain:  # a plain search for each pair is much faster than a pattern
            for pair in ("  ", "\n\n", " \n", "\n "):
                odd = pc.or_(odd, pc.match_substring(texts, pair))
            odd = pc.or_(odd, pc.match_substring_regex(texts, self.rare))
        kind = np.where(whole.to_numpy(zero_copy_only=False), 2, odd.to_numpy(zero_copy_only=False).astype(int))
        rows = np.flatnonzero(kind == 2)
        for i, x in zip(rows.tolist(), self.ids(texts.take(pa.array(rows)).to_pylist()), strict=True):
            out[i] = np.frombuffer(x, "<u4")
        rows = np.flatnonzero(kind == 1)
        if len(rows):
            keys = [self.words(t) for t in texts.take(pa.array(rows)).to_pylist()]
            flat = pa.array(list(itertools.chain.from_iterable(keys)), pa.large_string())
            for i, x in zip(rows.tolist(), self.of_words(flat, np.cumsum([0, *map(len, keys)])), strict=True):
                out[i] = x
        rows = np.flatnonzero(kind == 0)
        if len(rows):
            own = texts if len(rows) == len(texts) else texts.take(pa.array(rows))
            own = pc.replace_substring(pc.binary_join_element_wise(pa.scalar("\n", pa.large_string()), own, pa.scalar("", pa.large_string())), "\n", " \n")
            lists = pc.split_pattern(own, " ")  # each starts with an empty word, which stands before the first line end
            flat, ends = lists.flatten(), lists.offsets.to_numpy()
            keep = np.ones(len(flat), bool)
            keep[ends[:-1] - ends[0]] = False
            bounds = ends - ends[0] - np.arange(len(ends))
            for i, x in zip(rows.tolist(), self.of_words(flat.filter(pa.array(keep)), bounds), strict=True):
                out[i] = x
        return out


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder of a Python worker: its words stay known from task to task."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_files(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text_col: str = "text", end_id: int = END_ID, bits: int = PLANE_BITS, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode docs and write the files; returns their table, read from the shared folder."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text_col).alias("t"))
    total = rows.agg(F.sum(utf8_size("t"))).first()[0] or 0
    n_parts = max(partitions(spark), total // PART_BYTES + 1)
    rows = rows.repartitionByRange(int(n_parts), "k").sortWithinPartitions("k")

    def files(batches):
        from pyspark import TaskContext

        encoder, end = encoder_of(tokenizer_path), np.array([end_id], "<u4")
        part, n_file, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal n_file, held, size
            ids = np.concatenate([y for _, x in held for y in (x, end)])
            payload = pack([k for k, _ in held], [len(x) + 1 for _, x in held], ids, bits)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n_file], pa.int32()), pa.array([len(held)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([payload], pa.binary())], names=["part", "file", "n_docs", "n_ids", "payload"])
            n_file, held, size = n_file + 1, [], 0
            return out

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in sized(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).tolist(), BATCH_BYTES):
                for k, x in zip(keys[a:b], encoder.encode(texts.slice(a, b - a)), strict=True):
                    held.append((k, x))
                    size += len(x) + 1
                    if size >= file_ids:
                        yield flush()
        if held:
            yield flush()

    return written(rows.mapInArrow(files, "part int, file int, n_docs long, n_ids long, payload binary"), "tokens")


def read_files(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """Every document of the files: doc_id, start (ids before it), n_tokens, ids_crc32, and ids (binary,
    little-endian) if wanted. All ids are decoded either way."""
    sizes = files.groupBy("part", "file").agg(F.sum("n_ids").alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("of_part")).withColumn("run", F.expr("part div 1024"))
    # one row per 1024 parts, of which there are total bytes / PART_BYTES
    runs = parts.groupBy("run").agg(F.sum("of_part").alias("of_run"))
    runs = runs.select("run", (F.sum("of_run").over(Window.orderBy("run")) - F.col("of_run")).alias("base"))
    parts = parts.join(runs, "run").withColumn("base", F.col("base") + F.sum("of_part").over(Window.partitionBy("run").orderBy("part")) - F.col("of_part"))
    sizes = sizes.join(parts.select("part", "base"), "part").withColumn("base", F.col("base") + F.sum("n").over(Window.partitionBy("part").orderBy("file")) - F.col("n"))
    docs = files.select("part", "file", "payload").mapInArrow(decoder(with_ids), "part int, file int, doc_id long, first long, n_tokens long, ids_crc32 long, ids binary")
    return docs.join(sizes.select("part", "file", "base"), ["part", "file"]).select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def decoder(with_ids: bool):
    return lambda batches: decode(batches, with_ids)


def decode(batches, with_ids: bool):
    for batch in batches:
        for part, file, payload in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            doc_ids, start, count, ids = unpack(payload)
            raw = memoryview(ids.tobytes())
            own = [raw[4 * s : 4 * (s + n)] for s, n in zip(start.tolist(), count.tolist(), strict=True)]
            n = len(own)
            kept = [bytes(x) for x in own] if with_ids else [None] * n
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array([file] * n, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(start, pa.int64()), pa.array(count, pa.int64()), pa.array([zlib.crc32(x) for x in own], pa.int64()), pa.array(kept, pa.binary())],
                names=["part", "file", "doc_id", "first", "n_tokens", "ids_crc32", "ids"],
            )


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = write_files(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return read_files(files, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {"op10_token_files": op10_token_files}
ORACLE_SQL: dict[str, str] = {}
