"""Nearest vectors by an index of cells.

Centres are fitted by k-means on a bounded sample (SAMPLE vectors, taken by a hash of the id); every vector
of the table is in the cell of its nearest centre, with its distance to it. A query looks into its nearest
cells. In the exact mode it then also looks into every other cell that may still hold a nearer vector: no
vector of a cell is nearer than the distance to the centre less the cell's radius.

Cosine order is the order of distances of unit vectors. Cells are cut by a hash of the id into parts of about
PART vectors and queries into blocks, so a crowded cell is many tasks. Scores count to six decimals and
the smaller id wins a tie, as in evidence.retrieve_vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Vectors that centres are fitted on at most, and centres at most.
SAMPLE, CELLS = 20_000, 1024
PART, BLOCK = 8192, 1024
#: Distances are compared with this slack, above the error of sums and of six decimals.
SLACK = 1e-3
ROUNDS = 10
#: Scores that a task holds at a time, and rows of queries that leave it at a time.
SCORES, ROWS = 1 << 19, 4096


def slices(n: int, width: int):
    """Slices of n rows, each of about SCORES values where a row has width of them."""
    step = max(1, SCORES // max(1, width))
    return (slice(i, i + step) for i in range(0, n, step))


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def fit_centres(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> np.ndarray:
    """Centres of unit length from at most about `sample` vectors; by default a cell for about 64 of them."""
    n = vectors.count()
    share = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(min(1.0, sample / max(n, 1)) * (1 << 20)) + 1
    rows = [r["embedding"] for r in vectors.filter(share).orderBy("vec_id").limit(2 * sample).collect()]
    if not rows:
        return np.zeros((0, 0))
    x = unit(np.array(rows, np.float64))
    k = min(cells or max(1, len(x) // 64), CELLS, len(x))
    centres = x[np.random.default_rng(11).permutation(len(x))[:k]]
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        full = np.bincount(own, minlength=k) > 0
        centres[full] = unit(sums[full])
    return centres


class VectorIndex:
    """The table of vectors with their cells, and one row for each cell."""

    def __init__(self, vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE):
        spark = vectors.sparkSession
        rows = vectors.select("vec_id", "embedding").filter("embedding IS NOT NULL")
        centres = fit_centres(rows, cells, sample)
        self.spark, self.sent = spark, spark.sparkContext.broadcast(centres)  # at most CELLS rows
        sent = self.sent

        def assign(frames):
            for f in frames:
                x = unit(stacked(f["embedding"]))
                own = np.concatenate([(x[i] @ sent.value.T).argmax(1) for i in slices(len(x), len(sent.value))])
                off = np.linalg.norm(x - sent.value[own], axis=1)
                yield f.assign(cell=own.astype(np.int32), off=off)

        schema = "vec_id long, embedding array<double>, cell int, off double"
        placed = rows.select("vec_id", F.col("embedding").cast("array<double>")).mapInPandas(assign, schema) if len(centres) else spark.createDataFrame([], schema)
        self.rows = written(placed, "cells")
        sizes = self.rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("off").alias("radius"))
        self.cells = {r["cell"]: (r["n"], r["radius"]) for r in sizes.collect()}  # at most CELLS rows

    def _asked(self, queries: DataFrame, pick) -> DataFrame:
        """query_id, embedding, cell: a row for each cell in which pick(distances, frame) looks."""
        sent, names = self.sent, [c for c in queries.columns]
        full = np.array([i in self.cells for i in range(len(sent.value))])
        radius = np.array([self.cells[i][1] if i in self.cells else 0.0 for i in range(len(sent.value))])

        def run(frames):
            for f in frames:
                for i in slices(len(f), len(sent.value)):
                    some = f.iloc[i]
                    away = np.sqrt(np.maximum(0, 2 - 2 * (unit(stacked(some["embedding"])) @ sent.value.T)))
                    row, cell = np.nonzero(pick(away, radius, some) & full)
                    for j in range(0, len(row), ROWS):  # a query may look into every cell
                        yield some.iloc[row[j : j + ROWS]].assign(cell=cell[j : j + ROWS].astype(np.int32))

        return queries.select(*names).mapInPandas(run, queries.schema.add("cell", "integer"))

    def _scan(self, asked: DataFrame, k: int) -> DataFrame:
        """The k nearest in each cell that a query looks into: query_id, vec_id, score."""
        parts = self.spark.createDataFrame([(c, max(1, -(-n // PART))) for c, (n, _) in self.cells.items()], "cell int, parts int")

        def nearest(some: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
            if not len(some) or not len(others):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
            ids, own = some["query_id"].to_numpy(), others["vec_id"].to_numpy()
            order = np.argsort(own, kind="stable")  # the smaller id wins a tie
            own, q, x = own[order], unit(stacked(some["embedding"])), unit(stacked(others["embedding"]))[order].T
            best, best_ids = [], []
            for i in slices(len(q), len(own)):
                score = np.round(q[i] @ x, 6)
                score[ids[i, None] == own[None, :]] = -2
                top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                best.append(np.take_along_axis(score, top, 1))
                best_ids.append(own[top])
            best, best_ids = np.concatenate(best), np.concatenate(best_ids)
            return pd.DataFrame({"query_id": np.repeat(ids, best.shape[1]), "vec_id": best_ids.ravel(), "score": best.ravel()})

        own = self.rows.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))  # at most CELLS rows
        left = asked.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        # a cell that many queries look into: blocks of queries, each with a copy of the part
        load = asked.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        left = left.join(load, "cell").withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(3)), F.col("blocks")).cast("int"))
        own = own.join(load, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        keys = ["cell", "part", "block"]
        met = left.select(*keys, "query_id", "embedding").groupBy(*keys).cogroup(own.select(*keys, "vec_id", "embedding").groupBy(*keys)).applyInPandas(nearest, "query_id long, vec_id long, score double")
        return met.filter("score >= -1.5")

    def search(self, queries: DataFrame, k: int = 5, probes: int = 8, exact: bool = True) -> DataFrame:
        """query_id, vec_id, score, rank of the k nearest vectors of each query (query_id, embedding), not
        counting itself. probes: cells that a query looks into first; exact=False looks into no others."""
        asked = queries.select("query_id", F.col("embedding").cast("array<double>")).filter("embedding IS NOT NULL")
        if not self.cells:
            return self.spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")
        n = min(probes, len(self.sent.value))
        near = lambda away: np.argsort(np.argsort(away, axis=1, kind="stable"), axis=1, kind="stable") < n
        first = written(self._scan(self._asked(asked, lambda away, radius, f: near(away)), k), "nearest")
        if exact:
            # the distance of the k-th so far; queries with fewer look everywhere
            place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
            kth = first.withColumn("r", place).filter(F.col("r") == k).select("query_id", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score"))).alias("limit"))
            rest = asked.join(kth, "query_id", "left").withColumn("limit", F.coalesce("limit", F.lit(9.0)))
            more = self._asked(rest, lambda away, radius, f: ~near(away) & (away - radius[None, :] <= f["limit"].to_numpy()[:, None] + SLACK))
            first = first.unionByName(self._scan(more.drop("limit"), k))
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
