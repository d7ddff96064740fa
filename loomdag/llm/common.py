"""Shared pieces: a worker's memory, global prefix sums."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable
from types import ModuleType
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdag.sources.shared import write_table


def worker_memory(name: str, make: Callable[[], Any]) -> Any:
    """What a Python worker process keeps under ``name`` from task to task."""
    kept = sys.modules.setdefault("loomdag_worker_memory", ModuleType("loomdag_worker_memory"))
    if name not in vars(kept):
        vars(kept)[name] = make()
    return vars(kept)[name]


def give_back() -> None:
    """Return what a Python worker has freed to the system: workers outlive their tasks, and
    the next stage's find an executor's memory as these left it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def sealed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names that no operator uses, and the new name of each column."""
    names = {c: f"__in_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def opened(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The sealed columns alone, under their own names."""
    return df.select(*[F.col(n).alias(c) for c, n in names.items()])


def text_hash(text: Column) -> Column:
    """XXH64 of a text; a null text counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


#: A key that so many rows share is met by a broadcast: there is at most one such key in HOT rows.
HOT = 100_000


def join_hot(rows: DataFrame, groups: DataFrame, on: Column, size: str, hot: int = HOT) -> DataFrame:
    """``rows`` joined with their one row of ``groups`` by the equality ``on``, whatever a key's
    share of the rows: groups whose column ``size`` is ``hot`` or more are broadcast, and
    their rows stay where they are; the others meet by a shuffle."""
    large = F.broadcast(groups.filter(F.col(size) >= hot))
    return rows.join(large, on).unionByName(rows.join(large, on, "left_anti").join(groups.filter(F.col(size) < hot), on))


def without(docs: DataFrame, key: str, text: str, prints: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose key and text hash are in ``gone`` (__key, __hash); of
    rows that repeat both, one stays. ``prints`` has __key and __hash of every row.

    Rows are known by what they hold, not by their place: another reading of ``docs``
    may be split in another way.
    """
    pair = ["__key", "__hash"]
    gone = write_table(gone.select(*pair).distinct(), "rows-gone")
    twice = write_table(prints.groupBy(*pair).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*pair), "rows-repeated")
    rows, names = sealed(docs)
    known = rows.select("*", F.col(names[key]).alias("__own_key"), text_hash(F.col(names[text])).alias("__own_hash"))
    on = F.expr("__own_hash = __hash and __own_key <=> __key")
    left = known.join(gone, on, "left_anti")
    if not twice.isEmpty():
        once = left.join(twice, on, "left_semi").dropDuplicates(["__own_key", "__own_hash"])
        left = left.join(twice, on, "left_anti").unionByName(once)
    return opened(left, names)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def global_prefix(df: DataFrame, order: list[str], sums: list[str], name: str) -> DataFrame:
    """Add ``__index`` (0-based place in ``order``) and, for each column c of
    ``sums``, ``__before_<c>``: the sum of c over all earlier rows.

    Rows are dealt by range, so that a partition holds a contiguous stretch; one
    total per partition is summed over the partitions, and the rows add the
    running sum inside their own partition. No task sees more than its partition,
    and a last column of row numbers splits even a key that fills many partitions.
    The totals have one row per partition; that bounds what is broadcast.
    """
    dealt = (
        df.withColumn("__row", F.monotonically_increasing_id())
        .repartitionByRange(partitions(df.sparkSession), *order, "__row")
        .withColumn("__part", F.spark_partition_id())
    )
    table = write_table(dealt, name)
    parts = table.groupBy("__part").agg(
        F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(f"__sum_{c}") for c in sums]
    )
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)

    def earlier(c: Column, w: Window) -> Column:
        return F.coalesce(F.sum(c).over(w), F.lit(0)).cast("long")

    bases = parts.select(
        F.col("__part").alias("__base_part"),
        earlier(F.col("__n"), before).alias("__base_n"),
        *[earlier(F.col(f"__sum_{c}"), before).alias(f"__base_{c}") for c in sums],
    )
    inside = Window.partitionBy("__part").orderBy(*order, "__row")
    running = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = table.select(
        "*",
        (F.row_number().over(inside) - 1).cast("long").alias("__at"),
        *[earlier(F.col(c), running).alias(f"__run_{c}") for c in sums],
    )
    joined = rows.join(F.broadcast(bases), F.col("__part") == F.col("__base_part"))
    return joined.select(
        *df.columns,
        (F.col("__at") + F.col("__base_n")).alias("__index"),
        *[(F.col(f"__run_{c}") + F.col(f"__base_{c}")).alias(f"__before_{c}") for c in sums],
    )
