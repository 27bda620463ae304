"""Lexicons of any size: the time to match a text doesn't grow with the number of terms.

A lexicon that is small enough to be sent (its size is checked) becomes one automaton in each Python
worker, which finds all terms of a text in one pass. A larger one is a table that Spark joins with the runs of
characters of the texts that may be terms, told by a set of bits of bounded size. Both give the rows of
features.match_lexicon: a term counts once per text and category, wherever it stands, also inside a word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fixed import LEXICON
from ..functions.semantics import each
from ..sources.shared import written

#: A lexicon of at most so many bytes is sent to the workers.
SENT_BYTES = 4 << 20
#: Longer terms are looked for where their first HEAD characters stand.
HEAD = 16
BITS_A_TERM = 32
#: Characters of texts that are searched at once.
AT_ONCE = 1 << 20
#: The base of the hashes of runs, and what takes its powers back.
BASE = 0xD6E8FEB86659FD93
BACK = pow(BASE, -1, 1 << 64)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
SCHEMA = "category string, ord int, term string"


def read_lexicon_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """category, ord, term: from a JSON table at path, else the fixed lexicon."""
    if path is not None:
        return spark.read.schema(SCHEMA).json(path)
    return spark.createDataFrame([(c, i, t) for c, terms in LEXICON.items() for i, t in enumerate(terms)], SCHEMA)


_built: dict[int, object] = {}


def _automaton(number: int, terms: list[tuple[str, list[int]]]):
    """The automaton of a broadcast, built once in a worker; the last one is kept."""
    if number not in _built:
        import ahocorasick

        a = ahocorasick.Automaton()
        for term, places in terms:
            a.add_word(term, tuple(places))
        a.make_automaton()
        _built.clear()
        _built[number] = a
    return _built[number]


def _by_automaton(docs: DataFrame, terms: list[tuple[str, str]], text_col: str) -> DataFrame:
    """docs with one row per hit. terms: category and term, in the order in which hits are numbered."""
    spark = docs.sparkSession
    places: dict[str, list[int]] = {}
    for i, (_, t) in enumerate(terms):
        places.setdefault(t, []).append(i)
    categories = [c for c, _ in terms]
    first = np.array([i == 0 or c != categories[i - 1] for i, c in enumerate(categories)])
    sent = spark.sparkContext.broadcast((list(places.items()), categories, [t for _, t in terms], np.cumsum(first)))  # of checked size
    number = sent._jbroadcast.id()  # a number of its own in the session

    def run(texts):
        """The hits of each text as one array; its other columns stay where they are."""
        index, categories, names, group = sent.value
        automaton = _automaton(number, index)
        ends, found, row = [0], [], []
        for i, text in enumerate(texts.to_pylist()):
            if text:
                own = sorted({p for _, places in automaton.iter(text) for p in places})
                found += own
                row += [i] * len(own)
            ends.append(len(found))
        row, found = np.array(row, np.int64), np.array(found, np.int64)
        # places are sorted in a row, so a hit's number is its distance to the first of its row and category
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (group[found[1:]] != group[found[:-1]])
        start = np.maximum.accumulate(np.where(new, np.arange(len(row)), 0)) if len(row) else row
        at = pa.array(found)
        hits = [pa.array(categories, pa.string()).take(at), pa.array(np.arange(len(row)) - start + 1, pa.int32()), pa.array(names, pa.string()).take(at)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(hits, names=["category", "hit", "term"]))

    hits = F.arrow_udf(run, "array<struct<category: string, hit: int, term: string>>")(F.lower(text_col))
    return each(docs.withColumn("__hits", hits), docs.columns, "__hits", "__h").select(*docs.columns, "__h.category", "__h.hit", "__h.term")


def _mixed(points: np.ndarray) -> np.ndarray:
    return (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)


def _sums(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of BASE ** i * character i, and the powers that bring a run to the same hash wherever it stands."""
    n = len(points)
    up, down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (BASE, BACK))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(points) * up[:n])]), down


def _hashes(sums: np.ndarray, down: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Of the runs of n characters at the places at."""
    h = (sums[at + n] - sums[at]) * down[at]
    return h ^ (h >> np.uint64(29))


def _bit(hashes: np.ndarray, which: int, bits: int) -> np.ndarray:
    """The first or second bit of hashes."""
    return ((hashes * np.uint64(MIX[which])) >> np.uint64(64 - bits)).astype(np.int64)


def _known(terms: DataFrame, bits: int) -> np.ndarray:
    """2 ** bits bits: two of each term and of each head of a long one."""
    lead = min(bits - 3, 12)  # 2 ** bits / 8 bytes, cut into blocks
    size = 1 << (bits - lead)

    def blocks(batches):
        for b in batches:
            own = b.column(0).to_pylist()
            text = "".join(own)
            sums, down = _sums(_points(text))
            lengths = np.array([len(t) for t in own], np.int64)
            starts = np.cumsum(lengths) - lengths
            found = [_hashes(sums, down, starts[lengths == n], int(n)) for n in np.unique(lengths)]
            found = np.concatenate([*found, _hashes(sums, down, starts[lengths > HEAD], HEAD)])
            found = np.unique(np.concatenate([_bit(found, i, bits) for i in range(len(MIX))]))
            for part in np.unique(found // size):
                flags = np.zeros(size, bool)
                flags[found[found // size == part] % size] = True
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    def merge(table):
        out = np.zeros(size // 8, np.uint8)
        for x in table.column("bits"):
            out |= np.frombuffer(x.as_py(), np.uint8)
        return pa.table({"part": table.column("part")[:1], "bits": pa.array([out.tobytes()], pa.binary())})

    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in terms.select("term").mapInArrow(blocks, "part int, bits binary").groupBy("part").applyInArrow(merge, "part int, bits binary").toLocalIterator():
        out[r["part"] * (size // 8) : (r["part"] + 1) * (size // 8)] = np.frombuffer(r["bits"], np.uint8)
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _candidates(texts: list[str], lengths: list[int], known: np.ndarray, bits: int) -> tuple[list[int], list[str]]:
    """Places in texts, and the distinct runs in them whose bits are known."""
    text, points = "\n".join(texts), _points("\n".join(texts))
    sums, down = _sums(points)
    number = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])[: len(points)]

    def there(at, n):
        hashes = _hashes(sums, down, at, n)
        for i in range(len(MIX)):  # few places are left for the second bit
            b = _bit(hashes, i, bits)
            own = known[b >> 3] >> (b & 7).astype(np.uint8) & 1 == 1
            at, hashes = at[own], hashes[own]
        return at

    within = lambda at, n: at[number[at] == number[np.minimum(at + n - 1, len(points) - 1)]]
    upto = lambda at, n: at[at + n <= len(points)]
    every, rows, runs = np.arange(len(points)), [], []
    heads = there(upto(every, HEAD), HEAD) if max(lengths) > HEAD else None
    for n in lengths:
        at = within(there(upto(every if n <= HEAD else heads, n), n), n)
        if n <= 3:  # three characters are one number
            code = sum(points[at + i].astype(np.int64) << 21 * i for i in range(n))
            order = np.lexsort((code, number[at]))
            new = np.ones(len(at), bool)
            new[1:] = (np.diff(code[order]) != 0) | (np.diff(number[at][order]) != 0)
            at = at[order[new]]
        own = {(r, text[i : i + n]) for r, i in zip(number[at].tolist(), at.tolist(), strict=True)}
        rows += [r for r, _ in own]
        runs += [t for _, t in own]
    return rows, runs


def runs_in(base: DataFrame, terms: DataFrame, text_col: str) -> DataFrame:
    """__row and term: the runs of characters of lower-cased texts that may be terms, each once in a text. A set
    of bits (at least BITS_A_TERM for each term, 32 MB at most) tells which; nothing that is a term is left out."""
    sizes = terms.groupBy(F.length("term").alias("n")).agg(F.count("*").alias("terms")).collect()  # a row for each length
    lengths = sorted(r["n"] for r in sizes)
    bits = min(28, max(20, (BITS_A_TERM * sum(r["terms"] for r in sizes)).bit_length()))
    sent = base.sparkSession.sparkContext.broadcast(_known(terms, bits))  # 32 MB at most

    def run(batches):
        for b in batches:
            ids, texts, n = [], [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t:
                    ids.append(i)
                    texts.append(t)
                    n += len(t) + 1
                if n > AT_ONCE:
                    yield told(ids, texts)
                    ids, texts, n = [], [], 0
            if texts:
                yield told(ids, texts)

    def told(ids, texts):
        rows, runs = _candidates(texts, lengths, sent.value, bits)
        return pa.RecordBatch.from_pydict({"__row": pa.array(ids, pa.int64()).take(pa.array(rows, pa.int64())), "term": pa.array(runs, pa.string())})

    return base.select("__row", F.lower(text_col)).mapInArrow(run, "__row long, term string")


def _by_grams(docs: DataFrame, lexicon: DataFrame, text_col: str) -> DataFrame:
    """The same by a join of terms with the runs of characters that may be terms. Texts are sent once, at the end;
    before, only their numbers and those runs move."""
    columns = docs.columns
    base = written(docs.withColumn("__row", F.monotonically_increasing_id()), "texts")
    near = runs_in(base, lexicon.select("term").distinct(), text_col).join(lexicon, "term").select("__row", "category", "__order", "term")
    place = F.row_number().over(Window.partitionBy("__row", "category").orderBy("__order"))
    hits = near.repartition("__row").withColumn("hit", place).select("__row", "category", "hit", "term")
    return base.join(hits, "__row").select(*columns, "category", "hit", "term")


def match_terms(docs: DataFrame, lexicon: DataFrame, text_col: str = "text", sent_bytes: int = SENT_BYTES) -> DataFrame:
    """docs with category, hit (the number of the hit in its text and category, in the order of ord) and term.
    lexicon: category, ord, term; a term twice in a category counts at its first place; null or empty terms
    match nothing. Null texts have no hits. No terms are an error. Columns of docs named as the results
    are replaced."""
    docs = docs.drop(*[c for c in docs.columns if c in ("category", "hit", "term")])
    own = lexicon.filter("term <> '' AND category IS NOT NULL").groupBy("category", "term").agg(F.min("ord").alias("ord"))
    own = written(own.withColumn("__order", F.struct("ord", "term")), "lexicon")
    size = own.agg(F.sum(F.octet_length("term") + F.octet_length("category")).alias("n")).first()["n"]
    if size is None:
        raise ValueError("the lexicon has no terms")
    if size <= sent_bytes:
        terms = [(r["category"], r["term"]) for r in own.orderBy("category", "__order").collect()]  # sent_bytes at most
        return _by_automaton(docs, terms, text_col)
    return _by_grams(docs, own, text_col)


def coverage(hits: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents with each term, and their share of all documents of docs. Terms are made distinct per document first."""
    total = docs.agg(F.countDistinct(key).alias("all"))
    counts = hits.select(key, "category", "term").distinct().groupBy("category", "term").agg(F.count("*").alias("docs"))
    return counts.crossJoin(F.broadcast(total)).select("category", "term", "docs", (F.col("docs") / F.col("all")).alias("share"))  # one row
