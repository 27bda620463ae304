"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows of each source are ranked in a seeded random order; rank r of n rows stands at the fraction
(2r + 1) / 2n; rows sorted by that fraction are cut into shards of equal row counts, so each shard
holds each source in the proportion of the whole.

Both rankings are distributed: rows are dealt by the leading bits of a seeded hash (of the fraction
in the second ranking) into many small buckets of even size, ranked inside their bucket, and moved
by the counts of the buckets before. No source, however large, meets in one task.

Defined cases: a null source is a stratum of its own; a null doc_id is hashed as a fixed text; rows
with equal doc_id are told apart by a hash of the whole row, fully equal rows are interchangeable;
no rows give no rows; existing columns named shard, slot or position are replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, utf8_size, without

SHARDS = 16
SEED = "interleave-1"


def seeded(seed: str, key: str):
    """A hex hash of seed and key that DuckDB computes alike."""
    return F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col(key).cast("string"), F.lit("null"))))


def leading(hash_col: str):
    """The first 32 bits of a hex hash."""
    return F.conv(F.substring(hash_col, 1, 8), 16, 10).cast("long")


def interleave(docs: DataFrame, n_shards: int = SHARDS, key: str = "doc_id", source: str = "source", seed: str = SEED) -> DataFrame:
    """docs with position (0-based in the interleaved order), shard and slot (0-based in the shard)."""
    docs = without(docs, ["position", "shard", "slot"])
    spark, columns = docs.sparkSession, docs.columns
    n_buckets = 4 * partitions(spark)
    rows = docs.withColumns({"__s": F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n")), "__h": seeded(seed, key), "__t": F.xxhash64(*columns)})
    rows = rows.withColumn("__b", (leading("__h") * n_buckets / F.lit(float(1 << 32))).cast("int"))
    # counts by source and bucket: from the narrow columns only, summed before the shuffle
    cells = rows.groupBy("__s", "__b").agg(F.count("*").alias("__c"))
    of_source = Window.partitionBy("__s")
    cells = cells.select("__s", "__b", F.sum("__c").over(of_source).alias("__n"), (F.sum("__c").over(of_source.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__c")).alias("__before"))
    in_cell = Window.partitionBy("__b", "__s").orderBy("__h", "__t")
    ranked = rows.withColumn("__r", F.row_number().over(in_cell) - 1).join(cells, ["__b", "__s"])
    ranked = ranked.withColumn("__r", F.col("__r") + F.col("__before"))
    # the second ranking: bucket k of K holds the ranks with (2r + 1) K div 2n = k, so counts follow from n
    odd = 2 * F.col("__r") + 1
    ranked = ranked.withColumns({"__f": odd / (2 * F.col("__n")), "__k": F.expr(f"int((2 * __r + 1) * {n_buckets} div (2 * __n))")})
    sources = cells.groupBy("__s").agg(F.max("__n").alias("__n"))
    below = lambda k: f"((((2 * __n * {k} - 1) div {n_buckets}) + 1) div 2)"  # noqa: E731  ranks of a source in buckets before k
    grid = sources.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(n_buckets - 1)))).withColumn("__lo", F.expr(f"if(__k = 0, 0, {below('__k')})"))
    starts = grid.groupBy("__k").agg(F.sum("__lo").alias("__start"), F.sum("__n").alias("__total"))
    in_bucket = Window.partitionBy("__k").orderBy("__f", "__s", "__h", "__t")
    placed = ranked.drop("__n", "__before").withColumn("__i", F.row_number().over(in_bucket) - 1).join(starts, "__k")
    position = F.col("__start") + F.col("__i")
    placed = placed.withColumn("position", position.cast("long")).withColumn("shard", F.expr(f"int(position * {n_shards} div __total)"))
    first = F.expr(f"(shard * __total + {n_shards - 1}) div {n_shards}")
    return placed.withColumn("slot", (F.col("position") - first).cast("long")).select(*columns, "position", "shard", "slot")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "source", (utf8_size() + 1).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    out = interleave(rows)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _crc_table() -> str:
    table = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    return str(table)


#: crc32 of the bytes of t in DuckDB: a fold over the table of the reflected polynomial.
CRC_SQL = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::BIGINT)),
  lambda c, b: xor(c >> 8, {_crc_table()}[(xor(c, b) & 255) + 1]::BIGINT)), 4294967295::BIGINT)"""

ORDER_SQL = """docs AS (SELECT *, coalesce("text", '') AS t, coalesce('s' || source, 'n') AS s, md5('{seed}|' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM {documents}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY h) - 1 AS r, count(*) OVER (PARTITION BY s) AS n FROM docs),
placed AS (SELECT *, row_number() OVER (ORDER BY (2 * r + 1)::DOUBLE / (2 * n)::DOUBLE, s, h) - 1 AS position, count(*) OVER () AS total FROM ranked),
cut AS (SELECT *, (position * {n} // total)::INT AS shard, total FROM placed),
shards AS (SELECT *, (position - (shard * total + {n} - 1) // {n})::BIGINT AS slot FROM cut)
"""

QUERIES = {"op2_sharding": op2_sharding}
ORACLE_SQL = {
    "op2_sharding": "WITH " + ORDER_SQL.format(seed=SEED, n=SHARDS, documents="documents") + f"SELECT doc_id, (strlen(t) + 1)::BIGINT AS size, ({CRC_SQL})::BIGINT AS text_crc32, 'rows' AS law, shard, slot, NULL::INT AS grown_shard FROM shards"
}
