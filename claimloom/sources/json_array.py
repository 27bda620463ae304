"""One large JSON array, read by many tasks.

Spark cuts the file into ranges of bytes and reads it as pieces between commas. Whether a range begins inside
a string, and how deep in brackets, follows from all before it: each range tells for both cases how it changes
the depth (one row for each range), and a running sum over ranges settles which case holds. Then each range is read
again and leaves as elements: a comma outside strings at depth one ends one. So no task reads more than its
range, and only the elements that ranges cut are dealt out, two for each range at most."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written

QUOTE, ESCAPE, BOM = 34, 92, b"\xef\xbb\xbf"
_KIND = np.zeros(256, np.int8)
_KIND[[ord("["), ord("{")]], _KIND[[ord("]"), ord("}")]], _KIND[QUOTE] = 1, -1, 2


def _runs(batches):
    """path, range, pieces (binary) and whether the run begins: what a batch has of each range, in order."""
    import pyarrow as pa
    import pyarrow.compute as pc

    before = None
    for b in batches:
        if not b.num_rows:
            continue
        paths, ranges = b.column(0), b.column(1).to_numpy(zero_copy_only=False)
        cuts = np.unique(np.concatenate([pc.run_end_encode(paths).run_ends.to_numpy(), np.flatnonzero(np.diff(ranges)) + 1])).tolist()
        start = 0
        for end in cuts:
            at = (paths[start].as_py(), int(ranges[start]))
            pieces = b.column(2).slice(start, end - start).cast(pa.binary())
            if at != before and not at[1] and (first := pieces[0].as_py()).startswith(BOM):
                pieces = pa.concat_arrays([pa.array([first[len(BOM) :]], pa.binary()), pieces.slice(1)])
            yield *at, pieces, at != before
            before, start = at, end


def _marks(pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quotes (2) and brackets (1, -1) that aren't escaped, and how many of them stand before each piece's end. An
    escape never spans a comma."""
    offsets = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1]
    raw, base = pieces.buffers()[2], int(offsets[0])
    data = np.frombuffer(raw, np.uint8)[base : int(offsets[-1])] if raw else np.zeros(0, np.uint8)
    kind, offsets = _KIND[data], offsets - base
    if len(slash := np.flatnonzero(data == ESCAPE)):
        begins = np.zeros(len(data) + 1, bool)
        begins[offsets] = True
        new = begins[slash]
        new[0] = True
        new[1:] |= np.diff(slash) > 1
        place = np.arange(len(slash))
        odd = (place - np.maximum.accumulate(np.where(new, place, 0))) % 2 == 0  # escapes what follows
        after = slash[odd] + 1
        kind[after[~begins[after]]] = 0
    at = np.flatnonzero(kind)
    return kind[at] == 2, np.where(kind[at] == 2, 0, kind[at]).astype(np.int64), np.searchsorted(at, offsets[1:])


def _opens(pieces) -> bool:
    return pieces[0].as_py().lstrip().startswith(b"[")


def _summed(batches):
    """A row for each range: its quotes, the change of depth if it begins outside and inside of a string, and whether an
    array begins in it."""
    import pyarrow as pa

    names, rows, own = ["path", "range", "quotes", "d0", "d1", "opens"], [], None
    for path, start, pieces, begins in _runs(batches):
        if begins:
            own = [path, start, 0, 0, 0, not start and _opens(pieces)]
            rows.append(own)
        quote, step, _ = _marks(pieces)
        inside = (own[2] + np.cumsum(quote)) % 2 == 1
        own[2] += int(quote.sum())
        own[3] += int(step[~inside].sum())
        own[4] += int(step[inside].sum())
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)


def _cut(starts):
    """Elements, from pieces: k counts those of the range from 0, open ones don't end in it. starts: whether a range
    after a file's first begins inside of a string, how deep, and whether the file is an array."""

    def cut(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def made(path, start, k, texts, closes, is_open):
            n = len(texts)
            return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array([start] * n, pa.int64()), pa.array(np.arange(k, k + n, dtype=np.int64)), texts, pa.array(closes, pa.bool_()), pa.array([is_open] * n, pa.bool_())], names=["path", "range", "k", "json", "closes", "open"])

        path = start = None
        odd, depth, k, array, rest, closed = 0, 0, 0, False, [], False
        for new_path, new_start, pieces, begins in _runs(batches):
            if begins:
                if rest:
                    yield made(path, start, k, pa.array([b",".join(rest)], pa.binary()), [closed], True)
                path, start, k, rest, closed = new_path, new_start, 0, [], False
                if start:
                    odd, depth, array = starts.value[path, start]
                else:
                    odd, depth, array = 0, 0, _opens(pieces)
            if not array:
                continue
            quote, step, upto = _marks(pieces)
            quotes = odd + np.concatenate([[0], np.cumsum(quote)])
            levels = depth + np.concatenate([[0], np.cumsum(np.where(quotes[1:] % 2 == 0, step, 0))])
            plain, level = quotes[upto] % 2 == 0, levels[upto]
            odd, depth = int(quotes[-1] % 2), int(levels[-1])
            ends, closes = np.flatnonzero(plain & (level == 1)) + 1, plain & (level == 0)
            if len(ends):
                own = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pieces.slice(0, int(ends[-1])))
                texts, last = pc.binary_join(own, b","), np.logical_or.reduceat(closes[: ends[-1]], np.concatenate([[0], ends[:-1]]))
                if rest:
                    texts = pa.concat_arrays([pa.array([b",".join([*rest, texts[0].as_py()])], pa.binary()), texts.slice(1)])
                    last[0] |= closed
                yield made(path, start, k, texts, last, False)
                k, rest, closed = k + len(ends), [], False
            tail = int(ends[-1]) if len(ends) else 0
            if tail < len(pieces):
                rest.append(b",".join(pieces.slice(tail).to_pylist()))
                closed = closed or bool(closes[tail:].any())
        if rest:
            yield made(path, start, k, pa.array([b",".join(rest)], pa.binary()), [closed], True)

    return cut


def _starts(sums: DataFrame) -> dict:
    """For each range but the first of a file, one for each split of it: what stands before it."""
    before = Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    rows = sums.withColumn("odd", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).cast("int"))
    rows = rows.withColumn("depth", F.coalesce(F.sum(F.when(F.col("odd") == 0, F.col("d0")).otherwise(F.col("d1"))).over(before), F.lit(0)))
    rows = rows.withColumn("opens", F.max("opens").over(Window.partitionBy("path")))
    return {(r["path"], r["range"]): (r["odd"], r["depth"], r["opens"]) for r in rows.filter("range > 0").collect()}


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """path, element (from 0) and json of each element of the arrays in the files of path (UTF-8). A file
    that doesn't begin with a bracket has no elements; neither has an empty array. Elements aren't checked:
    read them with from_json."""
    pieces = spark.read.option("lineSep", ",").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("range"), F.col("value").cast("binary").alias("value"))
    least = "spark.sql.files.minPartitionNum"
    kept = spark.conf.get(least, None)
    spark.conf.set(least, kept or str(spark.sparkContext.defaultParallelism))  # both readings have the same ranges
    try:
        starts = spark.sparkContext.broadcast(_starts(pieces.mapInArrow(_summed, "path string, range long, quotes long, d0 long, d1 long, opens boolean")))
        rows = written(pieces.mapInArrow(_cut(starts), "path string, range long, k long, json binary, closes boolean, open boolean"), "elements")
    finally:
        spark.conf.set(least, kept) if kept else spark.conf.unset(least)
    rows = rows.withColumn("json", F.col("json").cast("string"))
    before = Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ended = rows.groupBy("path", "range").agg(F.count_if(~F.col("open")).alias("ends")).withColumn("earlier", F.sum("ends").over(before))
    # one row for each split of a file, as starts
    rows = rows.join(F.broadcast(ended.filter("range > 0").select("path", "range", "earlier")), ["path", "range"], "left")
    rows = rows.withColumn("element", F.coalesce("earlier", F.lit(0)) + F.col("k"))
    apart = (F.col("k") == 0) | F.col("open")
    whole = rows.filter(~apart).select("path", "element", "json")
    met = rows.filter(apart).groupBy("path", "element").agg(F.sort_array(F.collect_list(F.struct("range", "json"))).alias("p"), F.max("closes").alias("closes"))
    text = F.array_join("p.json", ",")
    text = F.when(F.col("element") == 0, F.regexp_replace(text, r"^\s*\[", "")).otherwise(text)
    text = F.when(F.col("closes"), F.regexp_replace(text, r"\]\s*\z", "")).otherwise(text)
    blank = F.lit(" \t\n\x0b\f\r")
    return whole.unionByName(met.select("path", "element", text.alias("json"))).withColumn("json", F.btrim("json", blank)).filter("json <> ''")


def write_json_array(rows: DataFrame, path: str, order: str) -> None:
    """One file with the array of rows (a column json), in order. A single file is made by a single task."""
    n = rows.count()
    placed = rows.orderBy(order).coalesce(1).withColumn("__i", F.monotonically_increasing_id())
    line = F.concat(F.when(F.col("__i") == 0, "[").otherwise(""), F.col("json"), F.when(F.col("__i") == n - 1, "]").otherwise(","))
    placed.select(line.alias("value")).write.text(path)
