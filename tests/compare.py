"""python tests/compare.py SF NAME...: each query beside its oracle SQL in DuckDB (all names if none)."""

from __future__ import annotations

import math
import sys
import tempfile
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = "/root/testdata"


def session(cores: int = 8) -> SparkSession:
    tmp = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    conf = {"spark.driver.memory": "8g", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.local.dir": tmp, "spark.checkpoint.dir": f"{tmp}/shared", "spark.sql.warehouse.dir": f"{tmp}/warehouse"}
    spark = SparkSession.builder.master(f"local[{cores}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain(v):
    """Values of either engine in one form."""
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, (bytearray, bytes)):
        return bytes(v)
    return v


def rows_of(df: DataFrame) -> list[tuple]:
    names = sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)


def oracle_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=repr)


def difference(df: DataFrame, sql: str, sf_dir: str) -> str:
    """Empty if both have the same columns and rows."""
    names, want = oracle_rows(sql, sf_dir)
    if sorted(df.columns) != names:
        return f"columns {sorted(df.columns)} and {names}"
    got = rows_of(df)
    if got == want:
        return ""
    odd = next((f"{a} and {b}" for a, b in zip(got, want, strict=False) if a != b), "")
    return f"{len(got)} and {len(want)} rows; first difference ({names}): {odd}"


if __name__ == "__main__":
    import __spark_entry__ as e

    spark, sf_dir = session(), f"{DATA}/{sys.argv[1]}"
    found, sql = e.queries(), e.oracle_sql()
    bad = []
    for name in sys.argv[2:] or found:
        t = time.time()
        try:
            df = found[name](spark, sf_dir)
            said = difference(df, sql[name], sf_dir) if name in sql else f"{df.count()} rows, no SQL"
        except Exception as x:
            said = f"{type(x).__name__}: {str(x)[:600]}"
        if said and not said.endswith("no SQL"):
            bad.append(name)
        print(f"{name}: {said[:900] or 'equal'} ({time.time() - t:.1f} s)", flush=True)
    print("different:", *bad) if bad else print("all equal")
