"""Projection of a group into ordinary tables.

Without a checkpoint all live rows are written; with one, the delta between the two
versions. A snapshot is a new directory and then a pointer file with its number; the largest
number is the current state. Nothing that a reader may hold is changed or renamed, so a
crash between any two steps leaves the old or the new state and never a part of either.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdag.plans.schema import Schema


class ProjectionError(ValueError):
    """Names that collide in the target."""


def target_names(schema: Schema, tables: dict[str, str] | None = None, columns: dict[str, dict[str, str]] | None = None, id_column: str = "id", author_column: str = "author", sync: str = "_sync") -> dict[str, dict]:
    """table -> {"name", "sync", "columns"}; refuses two targets of one name."""
    out, used = {}, set()
    for t, table in schema.items():
        name = (tables or {}).get(t, t)
        renamed = {c: (columns or {}).get(t, {}).get(c, c) for c in table.columns}
        if len(set(renamed.values())) < len(renamed) or {id_column, author_column} & set(renamed.values()):
            raise ProjectionError(f"{t}: column names collide")
        if {name, name + sync} & used:
            raise ProjectionError(f"{t}: table name {name} is taken")
        used |= {name, name + sync}
        out[t] = {"name": name, "sync": name + sync, "columns": renamed}
    return out


def schema_actions(start: Schema, end: Schema) -> list[tuple]:
    """Drops before adds; a column of another type or incarnation is dropped and added."""
    drops, adds = [], []
    for t in sorted(start.keys() - end.keys()):
        drops.append(("drop-table", t))
    for t in sorted(end.keys()):
        if t not in start:
            adds.append(("create-table", t, end[t].types()))
            continue
        a, b = start[t], end[t]
        for c in sorted(a.columns):
            if c not in b.columns or a.columns[c]["type"] != b.columns[c]["type"] or a.incarnations.get(c) != b.incarnations.get(c):
                drops.append(("drop-column", t, c))
        for c in sorted(b.columns):
            if c not in a.columns or ("drop-column", t, c) in drops:
                adds.append(("add-column", t, c, b.columns[c]["type"]))
    return drops + adds


def row_actions(delta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(upserts: row_id, changes; deletes: row_id) of a row channel."""
    upserts = delta.filter("is_live").select("row_id", "changes")
    return upserts, delta.filter("was_live and not is_live").select("row_id")


def assign_ids(known: DataFrame, rows: DataFrame) -> DataFrame:
    """rowId, id: stable numbers, kept after a row is deleted; new rows count on.

    New rows are numbered by their place among the new ones: per-partition counts and
    one sum over the partitions, so no task sees them all.
    """
    top = known.agg(F.max("id")).first()[0] or 0
    new = rows.select("rowId").distinct().join(known, "rowId", "left_anti")
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = new.withColumn("__part", F.pmod(F.xxhash64("rowId"), F.lit(parts)))
    counts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = dealt.withColumn("at", F.row_number().over(Window.partitionBy("__part").orderBy("rowId")))
    fresh = numbered.join(F.broadcast(before), "__part").select("rowId", (F.col("at") + F.col("before") + F.lit(top)).cast("long").alias("id"))
    return known.select("rowId", "id").unionByName(fresh)


class Snapshot:
    """One keyed table, replaced as a whole at every write."""

    def __init__(self, spark: SparkSession, path: str, key: str = "rowId") -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def _fs(self) -> Any:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str) -> Any:
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def batch(self) -> int:
        """The number of the newest complete snapshot, -1 where there is none. A snapshot is
        complete when its pointer file is there; pointers are never changed."""
        fs, found = self._fs(), [-1]
        if fs.exists(self._path("")):
            found += [int(name[8:]) for f in fs.listStatus(self._path("")) if (name := f.getPath().getName()).startswith("current-") and name[8:].isdigit()]
        return max(found)

    def read(self) -> DataFrame | None:
        now = self.batch()
        return None if now < 0 else self.spark.read.parquet(f"{self.path}/v{now}")

    def upsert(self, rows: DataFrame, number: int, deleted: DataFrame | None = None) -> None:
        """Rows replace those of the same key; ``deleted`` (key) go; then the pointer is written.
        A ``number`` at or below the newest one has been written and does nothing."""
        if number <= self.batch():
            return
        old = self.read()
        if old is not None:
            stay = old.join(rows.select(self.key), self.key, "left_anti")
            if deleted is not None:
                stay = stay.join(deleted.select(self.key), self.key, "left_anti")
            rows = stay.unionByName(rows, allowMissingColumns=True)
        rows.write.mode("overwrite").parquet(f"{self.path}/v{number}")
        fs = self._fs()
        fs.create(self._path(f"current-{number}"), True).close()
        # of what came before, one state stays for those who read it now
        for f in fs.listStatus(self._path("")):
            name = f.getPath().getName()
            old_number = name.removeprefix("current-").removeprefix("v")
            if old_number.isdigit() and int(old_number) < number - 1:
                fs.delete(f.getPath(), True)
