"""Batches of rows and removals that become visible with one commit record.

A batch's rows and removals are appended under its mark; the record, written last, makes the mark
visible. Readers join the tables with the records, so a batch whose record is missing, as after a
crash or a rollback, doesn't exist for them. A removal names keys, and hides the rows of those keys
that earlier versions wrote; a replacement is a removal and new rows in one batch.

Batches that begin together never see each other's rows; the first to commit wins, and the other
fails when it sees that its version is taken. Committing itself isn't guarded against a second
writer in the same instant.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = "batch string, versionid long, versiontime long, uniquifier int, snapshot string"
#: Columns that say which batch wrote a row, and under which version.
BATCH, VERSION = "_batch", "_version"


class Dataset:
    """Tables below a path, with the keys (table → columns) their rows are removed by."""

    def __init__(self, spark: SparkSession, path: str, keys: Mapping[str, list[str]] | None = None):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), dict(keys or {})

    def _read(self, name: str, schema: T.StructType | str | None = None) -> DataFrame | None:
        try:
            return (self.spark.read if schema is None else self.spark.read.schema(schema)).parquet(f"{self.path}/{name}")
        except Exception as e:  # the first batch makes the folder
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def commits(self) -> DataFrame:
        found = self._read("commits", RECORD)
        return self.spark.createDataFrame([], RECORD) if found is None else found

    def table(self, name: str, upto: int | None = None) -> DataFrame | None:
        """The rows of a table that are visible, at a version if one is given; None if nothing was
        ever written to it."""
        rows, marks = self._read(name), self.commits()
        if rows is None:
            return None
        # One short row for each commit: a broadcast, so that rows aren't shuffled by their few batches.
        marks = F.broadcast((marks if upto is None else marks.filter(F.col("versionid") <= upto)).select(F.col("batch").alias(BATCH)))
        rows = rows.join(marks, BATCH, "left_semi")
        removed = self._read(f"{name}.removed") if name in self.keys else None
        if removed is not None:
            keys = self.keys[name]
            gone = removed.join(marks, BATCH, "left_semi").groupBy(*[F.col(k).alias(f"_gone_{k}") for k in keys]).agg(F.max(VERSION).alias("_gone"))
            same = [F.col(k).eqNullSafe(F.col(f"_gone_{k}")) for k in keys]
            rows = rows.join(gone, [*same, F.col(VERSION) < F.col("_gone")], "left_anti")
        return rows.drop(BATCH, VERSION)

    def begin(self, now_millis: int, version: tuple[int, int, int] | None = None) -> Transaction:
        """A transaction, stamped with a time; commits of one millisecond differ in the uniquifier.
        A replicated one keeps its source's (versionid, versiontime, uniquifier)."""
        if version is not None:
            return Transaction(self, *version)
        last = self.commits().agg(F.max("versionid"), F.max(F.struct("versiontime", "uniquifier"))).first()
        time, uniq = now_millis, 0
        if last[1] is not None and last[1]["versiontime"] >= now_millis:
            time, uniq = last[1]["versiontime"], last[1]["uniquifier"] + 1
        return Transaction(self, (last[0] or 0) + 1, time, uniq)


class Transaction:
    def __init__(self, dataset: Dataset, versionid: int, time: int, uniquifier: int):
        self.dataset, self.versionid, self.time, self.uniquifier = dataset, versionid, time, uniquifier
        self.batch = uuid.uuid4().hex
        self.added: dict[str, list[DataFrame]] = {}
        self.removed: dict[str, list[DataFrame]] = {}

    def append(self, name: str, rows: DataFrame) -> None:
        self.added.setdefault(name, []).append(rows)

    def remove(self, name: str, gone: DataFrame) -> None:
        """Removes the committed rows whose keys `gone` has."""
        self.removed.setdefault(name, []).append(gone.select(*self.dataset.keys[name]))

    def replace(self, name: str, rows: DataFrame) -> None:
        """Puts rows in place of the committed ones of the same keys."""
        self.remove(name, rows)
        self.append(name, rows)

    def view(self, name: str) -> DataFrame | None:
        """The table as this transaction sees it: what is committed, with its own changes."""
        rows = self.dataset.table(name)
        for gone in self.removed.get(name, []):
            if rows is not None:
                keys = self.dataset.keys[name]
                same = [rows[k].eqNullSafe(F.col(f"_gone_{k}")) for k in keys]
                rows = rows.join(gone.select(*[F.col(k).alias(f"_gone_{k}") for k in keys]), same, "left_anti")
        for more in self.added.get(name, []):
            rows = more if rows is None else rows.unionByName(more)
        return rows

    def commit(self, snapshot: str | None = None) -> int:
        """Writes rows and removals, then the record, with the name of a snapshot if it is one."""
        commits = self.dataset.commits()
        if not commits.filter(F.col("versionid") == self.versionid).isEmpty():
            raise RuntimeError(f"version {self.versionid} was committed by another transaction")
        for name, frames in [*self.added.items(), *((f"{n}.removed", fs) for n, fs in self.removed.items())]:
            for rows in frames:
                marked = rows.withColumns({BATCH: F.lit(self.batch), VERSION: F.lit(self.versionid).cast("long")})
                marked.write.mode("append").parquet(f"{self.dataset.path}/{name}")
        record = self.dataset.spark.createDataFrame([(self.batch, self.versionid, self.time, self.uniquifier, snapshot)], RECORD)
        record.coalesce(1).write.mode("append").parquet(f"{self.dataset.path}/commits")
        self.rollback()
        return self.versionid

    def rollback(self) -> None:
        self.added.clear()
        self.removed.clear()
