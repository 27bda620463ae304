"""MinHash near-dedup with circulant permutations.

A document's set is its distinct five-word shingles, as 64-bit hashes. One permutation scatters the
hashes over a universe of 2**20 places; a second one, shifted circularly by k, gives coordinate k of
the signature: the minimum over the set. So all coordinates of a shingle are one slice of one table.
26 bands of 5 coordinates find pairs of similarity 0.85 but for a share of (1 - 0.85**5)**26 = 2e-7;
every link is confirmed by the exact Jaccard similarity of the full sets.

Documents with equal sets form a class (similarity 1) and go on as one node, so groups of copies
cost no pairs. Nodes of a bucket are linked to a centre of the bucket, round by round with other
centres; nodes that are already connected need no more comparison. At the end every pair of a bucket
that is neither connected nor compared is compared, so no link between components is lost. Links are
contracted to components by large-star and small-star steps. Tables between steps are written to the
shared folder; nothing of the corpus goes to the driver but counts.

Defined cases: null or empty texts, or texts without words, have an empty set, are linked with
nothing and are their own component; with fewer than five words the whole sequence is the one
shingle; rows with equal doc_id go by their own texts (labels of components are hashes of the sets,
the smallest doc_id is only reported); a null doc_id is
linked like others, its component is the smallest id reachable, null if none, and it is not kept; no rows give no rows;
existing columns named as the results are replaced. Keys must be integers, or cast to them: others are
an error."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_text_columns, without, written
from .decontamination import MIX, Hashes

SHINGLE = 5
BANDS, ROWS = 26, 5
COORDS = BANDS * ROWS
UNIVERSE_BITS = 20
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
STAR_ROUNDS = 2
#: Buckets of more classes are compared block by block; a block has about so many classes and shingles at most.
CROWD, BLOCK, BLOCK_SHINGLES = 32, 256, 400_000
#: Stands for null ids in joins.
NO_ID = 1 << 62
SEED = 20240229

#: Lower-cases A-Z, leaves all other bytes.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def circulant() -> np.ndarray:
    """Row s is the slice of the shifted permutation for place s: coordinates 0 .. COORDS - 1."""
    pi = np.random.default_rng(SEED).permutation(1 << UNIVERSE_BITS).astype(np.uint32)
    return sliding_window_view(np.concatenate([pi, pi[: COORDS - 1]]), COORDS)


def shingle_set(text: str | None, hashes: Hashes) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles of a text."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    n = min(SHINGLE, len(words))
    word = np.fromiter((hashes[w] for w in words), np.uint64, len(words))
    m = len(words) - n + 1
    h = np.full(m, n, np.uint64)
    for j in range(n):
        h = (h ^ word[j : j + m]) * MIX
        h ^= h >> np.uint64(29)
    return np.unique(h)


def bands_of(own: np.ndarray, table: np.ndarray) -> list[int]:
    """One hash per band; the band's number is part of it."""
    place = ((own * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)
    low = table[place[:2048]].min(0)
    for i in range(2048, len(place), 2048):
        np.minimum(low, table[place[i : i + 2048]].min(0), out=low)
    coords = low.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        h = (h ^ coords[:, r]) * MIX
        h ^= h >> np.uint64(31)
    return h.view(np.int64).tolist()


def signatures(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with n_shingles, digest (equal for equal sets) and bands (empty for an empty set)."""
    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType(), False))]

    def make():
        hashes, table = Hashes(), circulant()

        def f(texts: list) -> list:
            sets = [shingle_set(t, hashes) for t in texts]
            return [[len(x) for x in sets], [hashlib.md5(x.tobytes()).digest() for x in sets], [bands_of(x, table) if len(x) else [] for x in sets]]

        return f

    return add_text_columns(docs, text_col, fields, make, keep)


def with_sets(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    def make():
        hashes = Hashes()
        return lambda texts: [[shingle_set(t, hashes).view(np.int64) for t in texts]]

    return add_text_columns(docs, text_col, [T.StructField("shingles", T.ArrayType(T.LongType(), False))], make, keep)


def similar(a: Column, b: Column, percent: int) -> Column:
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= percent * (F.size(a) + F.size(b) - both)


def components(edges: DataFrame) -> DataFrame:
    """(a, root) for every a of edges (a, b) but the roots, which are the smallest of their components.

    Large-star and small-star steps, until the edges are stars: every a has one b, and no b is an a. Edges
    always lead from the larger to the smaller node, so the centre of a star is its smallest one. That test
    is one aggregation of the edges just written, and no round is run to see that nothing changes."""
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    while not edges.isEmpty():
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("up")), F.struct(F.col("b").alias("x"), F.lit(0).alias("up")))).alias("e")).groupBy("e.x").agg(F.sum("e.up").alias("up"), F.min("e.up").alias("low"))
        if ends.filter("up > 1 OR (up = 1 AND low = 0)").isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        edges = written(small, "edges")
    return edges.select("a", F.col("b").alias("root"))


def links_of_block(table: pa.Table) -> pa.Table:
    """Links between two blocks of a crowd, as few as connect what is linked: intersections come from
    products of incidence matrices, a slice of the shingles at a time."""
    sides = table.column("side").to_numpy()
    rows = table.column("digest").to_pylist()
    sets = table.column("shingles").combine_chunks()
    at = sets.offsets.to_numpy()
    size = np.diff(at)
    values, of = sets.values.to_numpy()[at[0] : at[-1]], np.repeat(np.arange(len(rows)), size)
    seen, place, count = np.unique(values, return_inverse=True, return_counts=True)
    often = np.cumsum(count > 1) - 1
    use = count[place] > 1
    place, of = often[place[use]], of[use]
    order = np.argsort(place, kind="stable")
    place, of = place[order], of[order]
    left, right = np.flatnonzero(sides != 1), np.flatnonzero(sides != 0)  # side 2: in both
    both = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(often[-1]) + 1 if len(often) else 0, 4096):
        a, b = np.searchsorted(place, [start, start + 4096])
        cells = np.zeros((len(rows), 4096), np.float32)
        cells[of[a:b], place[a:b] - start] = 1
        both += cells[left] @ cells[right].T
    both = both.astype(np.int64)
    percent = table.column("percent")[0].as_py()
    linked = 100 * both >= percent * (size[left][:, None] + size[right][None, :] - both)
    roots = table.column("root").to_pylist()
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        i, j = int(left[i]), int(right[j])
        x, y = top(roots[i]), top(roots[j])
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((rows[i], rows[j]))
    return pa.table({"a": pa.array([a for a, _ in out], pa.binary()), "b": pa.array([b for _, b in out], pa.binary())})


class Graph:
    """The classes, their buckets and full sets, and the labels that links found so far give them."""

    def __init__(self, docs: DataFrame, sig: DataFrame, percent: int):
        self.percent = percent
        # a class is told by one of its rows: smallest id, then text hash
        classes = sig.filter("n_shingles > 0").groupBy("digest").agg(F.min(F.struct(F.col("k").isNull().alias("z"), "k", "th")).alias("r"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
        self.classes = written(classes.select("digest", "n", "bands", "r.k", "r.th", F.xxhash64("digest").alias("root")), "classes")
        buckets = self.classes.select("digest", "n", F.explode("bands").alias("bucket"))
        sizes = buckets.groupBy("bucket").agg(F.count("*").alias("c")).filter("c > 1")
        self.buckets = written(buckets.join(sizes, "bucket"), "buckets")
        wanted = self.buckets.select("digest").distinct().join(self.classes, "digest").select("digest", F.coalesce("k", F.lit(-NO_ID)).alias("k"), "th")
        full = docs.withColumn("k", F.coalesce("k", F.lit(-NO_ID))).join(wanted, ["k", "th"])
        full = with_sets(full.select("digest", "t"), "t")
        self.sets = written(full.groupBy("digest").agg(F.first("shingles").alias("shingles")), "sets")
        self.labels = self.classes.select("digest", "root")
        self.checked: DataFrame | None = None

    def members(self) -> DataFrame:
        return self.buckets.join(self.labels, "digest")

    def connect(self, links: DataFrame) -> None:
        """Contract confirmed links (a, b) of classes."""
        a = self.labels.select(F.col("digest").alias("a"), F.col("root").alias("ra"))
        b = self.labels.select(F.col("digest").alias("b"), F.col("root").alias("rb"))
        moved = components(links.join(a, "a").join(b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        labels = self.labels.join(moved.select(F.col("a").alias("root"), F.col("root").alias("new")), "root", "left")
        self.labels = written(labels.select("digest", F.coalesce("new", "root").alias("root")), "labels")

    def confirm(self, pairs: DataFrame) -> None:
        """pairs: digest, n, root, other, m, oroot. Those of other roots, of fitting sizes and not compared before are compared."""
        pairs = pairs.filter("root <> oroot").filter(f"100 * least(n, m) >= {self.percent} * greatest(n, m)")
        pairs = pairs.select(F.least("digest", "other").alias("a"), F.greatest("digest", "other").alias("b")).distinct()
        if self.checked is not None:
            pairs = pairs.join(self.checked, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        self.checked = pairs if self.checked is None else self.checked.unionByName(pairs)
        left = self.sets.select(F.col("digest").alias("a"), F.col("shingles").alias("sa"))
        right = self.sets.select(F.col("digest").alias("b"), F.col("shingles").alias("sb"))
        links = pairs.join(left, "a").join(right, "b").filter(similar(F.col("sa"), F.col("sb"), self.percent))
        self.connect(written(links.select("a", "b"), "links"))

    def to_centres(self, r: int) -> None:
        """Each member of a bucket with the bucket's centre: its smallest root, or in later rounds another."""
        at = self.members()
        order = F.struct(F.col("root") if r == 0 else F.xxhash64("digest", F.lit(r)), "digest")
        centre = at.groupBy("bucket").agg(F.min_by(F.struct("digest", "n", "root"), order).alias("centre"))
        self.confirm(at.join(centre, "bucket").select("digest", "n", "root", F.col("centre.digest").alias("other"), F.col("centre.n").alias("m"), F.col("centre.root").alias("oroot")))

    def reported(self) -> DataFrame:
        """Of each class its root, and the row that tells its component: smallest id (null last), then text hash."""
        own = self.labels.join(self.classes.select("digest", "k", "th"), "digest")
        first = own.groupBy("root").agg(F.min(F.struct(F.col("k").isNull().alias("z"), "k", "th")).alias("r"))
        return self.labels.join(first.select("root", F.col("r.k").alias("rk"), F.col("r.th").alias("rth")), "root")

    def mixed(self) -> DataFrame:
        """Buckets that hold classes not connected yet."""
        return self.members().groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("bucket")

    def small_buckets(self) -> None:
        """All pairs of buckets of at most CROWD classes."""
        at = self.members().filter(F.col("c") <= CROWD).join(self.mixed(), "bucket", "left_semi")
        other = at.select("bucket", F.col("digest").alias("other"), F.col("n").alias("m"), F.col("root").alias("oroot"))
        self.confirm(at.join(other, "bucket").filter("digest < other"))

    def crowds(self) -> None:
        """Larger buckets that share classes form a crowd; its classes are compared block by block, each
        pair of blocks in a task of its own, and only links that connect something leave the task."""
        at = self.members().filter(F.col("c") > CROWD).join(self.mixed(), "bucket", "left_semi")
        at = written(at, "crowded")
        if at.isEmpty():
            return
        own = at.groupBy("digest").agg(F.min("bucket").alias("first"), F.first("n").alias("n"), F.first("root").alias("root"))
        edges = at.select("digest", "bucket").join(own, "digest").select(F.col("bucket").alias("a"), F.col("first").alias("b"))
        crowd = components(edges)
        own = own.join(crowd.select(F.col("a").alias("first"), F.col("root").alias("to")), "first", "left").withColumn("crowd", F.coalesce("to", "first")).drop("to", "first")
        blocks = own.groupBy("crowd").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
        own = own.join(blocks, "crowd").withColumn("i", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
        own = own.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        own = own.select("crowd", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), F.when(F.col("i") == F.col("j"), 2).when(F.col("i") < F.col("j"), 0).otherwise(1).alias("side"), "digest", "root", F.lit(self.percent).alias("percent"))
        links = own.join(self.sets, "digest").groupBy("crowd", "lo", "hi").applyInArrow(links_of_block, "a binary, b binary")
        self.connect(written(links, "crowd_links"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text_col: str = "text", percent: int = PERCENT, keep: list[str] | None = None, one_each: bool = False) -> DataFrame:
    """docs (or its columns keep) with n_shingles, component_id and kept (the document with that id).
    one_each: only one row of each component, also of one whose ids are null or repeated."""
    docs = without(docs, ["n_shingles", "component_id", "kept"])
    rows = docs.select(F.col(key).cast("long").alias("k"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.col(text_col).alias("t"))
    sig = written(signatures(rows, "t", ["k", "th"]), "signatures")
    graph = Graph(rows, sig, percent)
    for r in range(STAR_ROUNDS):
        graph.to_centres(r)
    graph.small_buckets()
    graph.crowds()
    found = sig.join(graph.reported(), "digest", "left").select("k", "th", "n_shingles", "root", F.when(F.col("n_shingles") == 0, F.col("k")).otherwise(F.col("rk")).alias("component_id"), (F.col("k").eqNullSafe(F.col("rk")) & (F.col("th") == F.col("rth"))).alias("tells"))
    found = found.withColumn("kept", F.coalesce(F.col("k") == F.col("component_id"), F.lit(False)))
    if keep == [key] and not one_each:
        return found.select(F.col("k").alias(key), "n_shingles", "component_id", "kept")
    # rows of equal id and text have equal results, and one of each is enough to join
    found = found.withColumn("k", F.coalesce("k", F.lit(-NO_ID))).dropDuplicates(["k", "th"])
    found = found.select(F.col("k").alias("__k"), F.col("th").alias("__th"), F.col("root").alias("__root"), F.col("tells").alias("__tells"), "n_shingles", "component_id", "kept")
    names = keep or docs.columns
    docs = docs.withColumns({"__k": F.coalesce(F.col(key).cast("long"), F.lit(-NO_ID)), "__th": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    out = docs.join(found, ["__k", "__th"], "left")
    if one_each:  # rows without words are components of their own
        lone = F.when(F.col("n_shingles") == 0, F.monotonically_increasing_id())
        out = out.filter("__tells OR n_shingles = 0").select(*names, "n_shingles", "component_id", "kept", "__root", lone.alias("__lone")).dropDuplicates(["__root", "__lone"])
    return out.select(*names, "n_shingles", "component_id", "kept")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, keep=["doc_id"])


QUERIES = {"op9_near_dedup": op9_near_dedup}
ORACLE_SQL: dict[str, str] = {}
