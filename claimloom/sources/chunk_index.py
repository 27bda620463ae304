"""A stored inverted index of chunks, added to batch by batch, so that queries read no texts.

Each batch of chunks has folders of its own, under its number: postings (doc_id, chunk, token, tf) dealt by ranges
of doc_id and sorted, so that files tell by their bounds which documents they hold; its tokens' numbers of
chunks; and its number of chunks. A batch that is added again replaces itself. Batches must not share
chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence as O

POSTINGS, TERMS, SIZES = "doc_id long, chunk int, token string, tf long", "token string, df long", "n long"


class ChunkIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/batch=*")

    def add(self, chunks: DataFrame, batch: int) -> None:
        """chunks: doc_id, chunk, text. Their texts are read once for the postings; the rest follows from these."""
        at = lambda name: f"{self.path}/{name}/batch={batch}"
        chunks.agg(F.count("*").alias("n")).write.mode("overwrite").parquet(at("sizes"))
        own = O.postings(chunks).select(F.col("doc_id").cast("long"), F.col("chunk").cast("int"), "token", "tf")
        own.repartitionByRange("doc_id", "token").sortWithinPartitions("doc_id", "token").write.mode("overwrite").parquet(at("postings"))
        made = self.spark.read.schema(POSTINGS).parquet(at("postings"))
        made.groupBy("token").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(at("terms"))

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """doc_id, claim_id, query_id, chunk, score, rank: as operators.evidence.retrieve_lexical over all chunks."""
        n = self._table("sizes", SIZES).agg(F.sum("n").alias("n"))
        df = self._table("terms", TERMS).groupBy("token").agg(F.sum("df").alias("df"))
        return O.search_postings(queries, self._table("postings", POSTINGS), O.inverse_frequency(df, n), k)
