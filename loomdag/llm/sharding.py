"""Contiguous shards of nearly equal bytes, from global prefix sums.

Rows are put in one order; the bytes before each row are its partition's base plus
the running sum inside the partition. The total is cut at equal targets, and a row
goes to the shard that its middle byte falls into, so each cut is within half a row
of its target.

Defined results: a null text has no bytes; every row counts ``OVERHEAD`` bytes more,
so empty texts spread too; rows that tie on the order keys are told apart by CRC and
size; repeated rows may be swapped with each other; an empty table gives no rows;
there may be more shards than rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomdag.llm.common import global_prefix, write_table

OVERHEAD = 8


def assign_shards(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``key``, size, text_crc32, shard, slot."""
    whole = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(key).alias("__key"),
        (F.octet_length(whole) + OVERHEAD).cast("long").alias("__size"),
        F.crc32(whole.cast("binary")).alias("__crc"),
    )
    placed = write_table(global_prefix(narrow, ["__key", "__crc", "__size"], ["__size"], "shard-sizes"), "shard-prefixes")
    total = placed.agg(F.max(F.col("__before___size") + F.col("__size"))).first()[0] or 0
    middle = "(2 * __before___size + __size)"
    shard = F.expr(f"cast(least(cast({middle} as decimal(38,0)) * {shards} div {max(1, 2 * total)}, {shards - 1}) as int)")
    placed = write_table(placed.withColumn("__shard", shard), "shard-places")
    first = placed.groupBy(F.col("__shard").alias("__of")).agg(F.min("__index").alias("__first"))
    return placed.join(F.broadcast(first), F.col("__shard") == F.col("__of")).select(
        F.col("__key").alias(key), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"),
        F.col("__shard").alias("shard"), (F.col("__index") - F.col("__first")).alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``docs`` to ``path`` in one folder a shard (``shard=n``), a shard's rows by slot.

    Rows meet their places by key, size and CRC of the text; of rows that repeat all three
    each takes one place. A column named ``shard`` or ``slot`` gives way.
    """
    same = ["__k", "__s", "__c"]
    whole = F.coalesce(F.col(text), F.lit(""))
    sized = docs.drop("shard", "slot").withColumns(
        {"__k": F.col(key), "__s": (F.octet_length(whole) + OVERHEAD).cast("long"), "__c": F.crc32(whole.cast("binary"))}
    )
    where = assign_shards(docs, shards, key, text).select(F.col(key).alias("__k"), F.col("size").alias("__s"), F.col("text_crc32").alias("__c"), "shard", "slot")
    nth = lambda df, *order: df.withColumn("__nth", F.row_number().over(Window.partitionBy(*same).orderBy(*order)))
    at, there = nth(sized, F.lit(0)).alias("r"), nth(where, "shard", "slot").alias("w")
    on = F.expr("r.__k <=> w.__k and r.__s = w.__s and r.__c = w.__c and r.__nth = w.__nth")
    out = at.join(there, on).select("r.*", "w.shard", "w.slot").drop(*same, "__nth")
    out.repartitionByRange(shards, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)
