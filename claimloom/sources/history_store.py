"""A stored history: a table by month with versions.

A version is a small table of (month, path): which folder holds the rows of each month. A change writes new
folders for the months it touches, then the next version's table; readers take the newest version whose
table is complete. So a writer that dies leaves the old version as it was, and months that a change doesn't
touch are neither read nor written. All files are written and read by Spark, below one folder of any store
that Spark writes.

Rows have id and created_at, and other columns at will; rows without created_at are in the month `none`.
One writer at a time: of two that make the same version, the later one fails, and nothing of it is seen."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history as Q

VERSION = "month string, path string"


def month() -> Column:
    return F.coalesce(F.date_format("created_at", "yyyy-MM"), F.lit("none"))


class HistoryStore:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        """schema: of the rows, with id and created_at."""
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    # versions

    def _folder(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _children(self, path: str) -> list[str]:
        at, fs = self._folder(path)
        return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []

    def versions(self) -> list[int]:
        """Numbers of complete versions: Spark marks a folder that it has written in full."""
        return sorted(int(n) for n in self._children(f"{self.path}/versions") if n.isdigit() and "_SUCCESS" in self._children(f"{self.path}/versions/{n}"))

    def months(self, version: int | None = None) -> dict[str, str]:
        """The folder of each month; one entry for each month since the first one."""
        known = self.versions()
        if not known:
            return {}
        rows = self.spark.read.schema(VERSION).parquet(f"{self.path}/versions/{known[-1] if version is None else version}")
        return {r["month"]: r["path"] for r in rows.collect()}

    def _commit(self, months: dict[str, str]) -> None:
        tried = [int(n) for n in self._children(f"{self.path}/versions") if n.isdigit()]  # complete or not
        made = self.spark.createDataFrame(sorted(months.items()), VERSION).coalesce(1)
        made.write.mode("error").parquet(f"{self.path}/versions/{max(tried, default=0) + 1}")

    # reading

    def read(self, months: list[str] | None = None, version: int | None = None) -> DataFrame:
        """All rows of the newest (or another) version, or those of some months."""
        paths = [f"{self.path}/data/{p}" for m, p in self.months(version).items() if months is None or m in months]
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    # changes

    def _replace(self, touched: set[str], rows: DataFrame) -> None:
        """The next version: rows are all that the touched months hold from now on."""
        made = uuid.uuid4().hex
        rows.select(*self.spark.createDataFrame([], self.schema).columns, month().alias("month")).write.partitionBy("month").mode("error").parquet(f"{self.path}/data/{made}")
        full = {n.split("=", 1)[1] for n in self._children(f"{self.path}/data/{made}") if n.startswith("month=")}
        kept = {m: p for m, p in self.months().items() if m not in touched}
        self._commit(kept | {m: f"{made}/month={m}" for m in full})

    def _months_of(self, ids: DataFrame) -> set[str]:
        """The months that hold rows of ids. Only ids and times of the store are read."""
        own = self.read().select("id", month().alias("month")).join(ids.select("id").distinct(), "id", "left_semi")
        return {r["month"] for r in own.select("month").distinct().collect()}

    def upsert(self, new: DataFrame) -> set[str]:
        """Rows replaced by id as in operators.history.upsert_history; tells the months that are written."""
        touched = {r["month"] for r in new.select(month().alias("month")).distinct().collect()} | self._months_of(new)
        if touched:
            self._replace(touched, Q.upsert_history(self.read(sorted(touched)), new))
        return touched

    def delete(self, ids: DataFrame) -> set[str]:
        touched = self._months_of(ids)
        if touched:
            self._replace(touched, Q.delete_history(self.read(sorted(touched)), ids))
        return touched

    def attach_feedback(self, feedback: DataFrame) -> tuple[set[str], DataFrame]:
        """The months that are written, and the rejects: unknown ids, or texts that are no JSON object."""
        touched = self._months_of(feedback)
        own = self.read(sorted(touched))
        before = own.select("id", F.col("feedback_json").alias("__f"), F.col("feedback_at").alias("__t"))
        kept, rejects = Q.attach_feedback(own, feedback)
        if touched:  # rows without new feedback keep theirs
            kept = kept.join(before, "id").withColumns({"feedback_json": F.coalesce("feedback_json", "__f"), "feedback_at": F.coalesce("feedback_at", "__t")})
            self._replace(touched, kept)
        return touched, rejects

    def retain(self, since: str) -> set[str]:
        """Rows from a time on. Whole months go with their entry; only the month of the time is written.
        Rows without created_at stay."""
        edge = since[:7]
        months = self.months()
        gone = {m for m in months if m != "none" and m < edge}
        if edge in months:
            self._replace(gone | {edge}, self.read([edge]).filter(F.col("created_at") >= F.lit(since).cast("timestamp")))
        elif gone:
            self._commit({m: p for m, p in months.items() if m not in gone})
        return gone

    def newest(self, n: int = 30) -> DataFrame:
        """The newest n rows. Months are read from the newest on, as many as hold n rows."""
        take, have = [], 0
        for m in sorted((m for m in self.months() if m != "none"), reverse=True):
            take.append(m)
            have += self.read([m]).count()
            if have >= n:
                break
        return Q.recent_history(self.read(take if have >= n else None), n)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Removes versions but the last `keep`, and folders that none of these has; tells the folders.
        Not while a writer is at work."""
        known = self.versions()
        for v in known[:-keep]:
            at, fs = self._folder(f"{self.path}/versions/{v}")
            fs.delete(at, True)
        used = {p.split("/")[0] for v in known[-keep:] for p in self.months(v).values()}
        gone = [n for n in self._children(f"{self.path}/data") if n not in used]
        for n in gone:
            at, fs = self._folder(f"{self.path}/data/{n}")
            fs.delete(at, True)
        return gone
