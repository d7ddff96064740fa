"""Ordinary tables as logs.

``events_log`` makes one log per user of the ``events`` table: an entry follows the one
three places earlier, and every fifth one merges with its neighbour. ``rows_view`` shows
a table as a linear group, every row one insert.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dag_id, hash, prev, seq and one operation per entry: row_id, action, author, column, value.

    The users' events are dealt once: the window over a user comes first, the one over a user's
    type finds them dealt; hashes are made after that."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    own = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    e = e.select("*", (F.row_number().over(order) - 1).alias("seq"), F.lag("event_id", 3).over(order).alias("p3"), F.lag("event_id", 1).over(order).alias("p1"))
    e = e.select("*", (F.row_number().over(own) - 1).alias("nth"))
    name = lambda c: F.sha2(F.col(c).cast("string"), 256)
    prev = F.filter(F.array(name("p3"), F.when((F.col("seq") % 5 == 0), name("p1"))), lambda p: p.isNotNull())
    return e.select(
        F.col("user_id").alias("dag_id"), name("event_id").alias("hash"), prev.alias("prev"), "seq", F.col("event_type").alias("row_id"),
        F.when(F.col("nth") == 0, "insert").when(F.col("nth") % 9 == 8, "delete").otherwise("update").alias("action"),
        F.concat(F.lit("u"), (F.col("event_id") % 4).cast("string")).alias("author"),
        F.concat(F.lit("c"), (F.col("event_id") % 3).cast("string")).alias("column"),
        F.col("value").cast("string").alias("value"),
    )


def rows_view(df: DataFrame, key: str, author: str | None = None) -> DataFrame:
    """rowId, uuid, rowAuthor and the columns of ``df``; ``key`` makes the row's identity."""
    uuid = F.col(key).cast("string")
    return df.select(F.base64(F.unhex(F.sha2(F.concat(F.lit('{"uuid":"'), uuid, F.lit('"}')), 256))).alias("rowId"), uuid.alias("uuid"), F.lit(author).cast("string").alias("rowAuthor"), *df.columns)
