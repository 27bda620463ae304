"""Helpers that the operators share: written intermediate tables and batched text functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import new_path, shared_dir, written  # noqa: F401  the operators take them from here

#: Java and RE2 patterns of the contracts.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]"

#: A batch function gets texts of about so many characters at a time.
BATCH_CHARS = 2_000_000


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df less the columns that an operator is about to add: the operator's own values replace them."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def sized(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of sizes that sum to at most limit (a larger one is alone) and of 50,000 at most."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and (total + n > limit or i - start >= 50_000):
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def sub_batches(texts: list[str | None], limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of at most limit characters."""
    return sized([len(t) if t else 0 for t in texts], limit)


def translated(texts: pa.Array, table: bytes) -> pa.Array:
    """texts with every byte replaced by its entry of table, which changes ASCII alone; null becomes empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = bytes(memoryview(data)[ends[0] : ends[-1]]).translate(table) if data else b""
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).tobytes()), pa.py_buffer(data))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words between blanks of texts, the number among them of each word, and the bounds of
    each text's words."""
    lists = pc.split_pattern(texts, " ")
    bounds = lists.offsets.to_numpy()
    bounds = bounds - bounds[0]
    coded = lists.flatten().dictionary_encode()
    words, index = coded.dictionary, coded.indices.to_numpy()
    empty = pc.index(words, "").as_py()  # blanks beside blanks, or at an end
    if empty >= 0:
        full = index != empty
        bounds = np.concatenate([[0], np.cumsum(full)])[bounds]
        index = index[full]
        index = index - (index > empty)
        words = pa.concat_arrays([words.slice(0, empty), words.slice(empty + 1)])
    return words, index, bounds


def add_text_columns(df: DataFrame, text_col: str, fields: list[T.StructField], make: Callable[[], Callable[[list], list]], keep: list[str] | None = None) -> DataFrame:
    """df with columns computed from text_col by the function that make() returns on each executor.

    The function maps a list of texts to one list or array per field. Other columns pass through
    Arrow untouched (no detour by pandas, so long ids with nulls stay exact). keep: the columns of
    df that remain (default all)."""
    df = without(df, [f.name for f in fields if f.name != text_col])
    kept = [c for c in df.columns if keep is None or c in keep]
    frame = df.select(*dict.fromkeys([*kept, text_col]))
    schema = T.StructType([*[frame.schema[c] for c in kept], *fields])
    types = [pa_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            for a, b in sub_batches(texts):
                new = [pa.array(x, t) for x, t in zip(f(texts[a:b]), types, strict=True)]
                old = [batch.column(batch.schema.get_field_index(c)).slice(a, b - a) for c in kept]
                yield pa.RecordBatch.from_arrays([*old, *new], names=[*kept, *[x.name for x in fields]])

    return frame.mapInArrow(run, schema)


def pa_type(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def utf8_size(text_col: str = "text"):
    return F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
