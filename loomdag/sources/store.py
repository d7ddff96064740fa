"""A log store: Parquet partitioned by log, append-only.

    <path>/entries/dag_id=.../part-*.parquet    dag_id, hash, prev, payload, meta

An append is one committed write. Entries may arrive in any number of files; a hash that
is there already is not written again, and one that lacks a predecessor is refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from loomdag.operators.causal import chain_index, frontier

ENTRIES = "dag_id string, hash string, prev array<string>, payload string, meta map<string,array<string>>"


class LogStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, f"{path.rstrip('/')}/entries"

    def entries(self, dag_id: str | None = None) -> DataFrame:
        """All entries; one log's are read from its partition alone."""
        try:
            found = self.spark.read.schema(ENTRIES).parquet(self.path)
        except AnalysisException:
            found = self.spark.createDataFrame([], ENTRIES)
        return found if dag_id is None else found.filter(F.col("dag_id") == dag_id)

    def missing(self, new: DataFrame) -> DataFrame:
        """dag_id, hash of predecessors that neither the store nor ``new`` has; only the logs
        that ``new`` names are read."""
        have = self._of(new).unionByName(new.select("dag_id", "hash"))
        named = new.select("dag_id", F.explode("prev").alias("hash")).distinct()
        return named.join(have, ["dag_id", "hash"], "left_anti")

    def _of(self, new: DataFrame) -> DataFrame:
        """dag_id, hash of the stored entries of the logs in ``new``: their folders alone, where
        the join's keys prune partitions."""
        return self.entries().select("dag_id", "hash").join(F.broadcast(new.select("dag_id").distinct()), "dag_id", "left_semi")

    def append(self, new: DataFrame) -> None:
        lacking = self.missing(new).limit(5).collect()
        if lacking:
            raise ValueError(f"missing predecessors: {[r['hash'] for r in lacking]}")
        fresh = new.dropDuplicates(["dag_id", "hash"]).join(self._of(new), ["dag_id", "hash"], "left_anti")
        fresh.select("dag_id", "hash", "prev", "payload", "meta").write.mode("append").partitionBy("dag_id").parquet(self.path)

    def frontier(self) -> DataFrame:
        return frontier(self.entries())

    def logs(self) -> DataFrame:
        return self.entries().groupBy("dag_id").agg(F.count(F.lit(1)).alias("n_entries"))

    def indexed(self, dag_id: str | None = None) -> DataFrame:
        return chain_index(self.entries(dag_id), wide=True)

    def copy_to(self, other: LogStore, dag_id: str) -> None:
        other.append(self.entries(dag_id))

    def tail(self) -> DataFrame:
        """A stream of the entries as files arrive."""
        return self.spark.readStream.schema(ENTRIES).parquet(self.path)
