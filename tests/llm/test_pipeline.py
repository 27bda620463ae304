"""The pipeline beside a slow version: SQL in DuckDB for the stages that it can express, pairs in Python for near duplicates."""

import duckdb
from compare import DATA
from test_oracles import brute_components

import corpus_pipeline
from claimloom.llm import decontamination, mixing, quality, sharding

SF = f"{DATA}/sf0.001"


def test_pipeline(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE TABLE {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")

    def keep(table: str, source: str, ids: list) -> None:
        con.execute(f"CREATE TABLE {table} AS SELECT * FROM {source} WHERE list_contains(?, doc_id)", [ids])

    keep("d1", "documents", [r[0] for r in con.execute("WITH " + quality.stats_sql("documents") + "SELECT doc_id FROM quality WHERE kept").fetchall()])
    keep("d2", "d1", [k for k, _, _, kept in brute_components(con.execute('SELECT doc_id, "text" FROM d1').fetchall(), 80) if kept])
    keep("d3", "d2", [r[0] for r in con.execute("WITH " + decontamination.LEAK_SQL.format(documents="d2") + "SELECT doc_id FROM leaks WHERE n_hit = 0").fetchall()])
    mix = "WITH RECURSIVE " + mixing.MIX_SQL.format(seed=mixing.SEED, steps=1 << mixing.STEPS, repeats=mixing.MAX_REPEATS, documents="d3")
    con.execute(f"CREATE TABLE d4 AS {mix} SELECT doc_id, source, \"text\" FROM mixed")
    order = "WITH " + sharding.ORDER_SQL.format(seed=sharding.SEED, n=sharding.SHARDS, documents="d4")
    want = sorted(con.execute(f"{order} SELECT doc_id, shard, slot FROM shards").fetchall())
    out = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.shard, r.slot) for r in out.collect()) == want
    assert 0 < con.execute("SELECT count(*) FROM d3").fetchone()[0] < con.execute("SELECT count(*) FROM documents").fetchone()[0]
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
