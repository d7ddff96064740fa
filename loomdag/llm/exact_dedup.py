"""Exact deduplication by two passes over a Bloom filter, in DataFrame functions.

Pass one sets one bit per text hash and keeps the bits that two rows or more have set;
pass two tests every row against those bits, in the task that reads it. A row whose bit
is not among them has no equal and passes straight through; only the others shuffle.
None that has an equal is missed. What decides in the end is the SHA-256 of the whole text.

The filter has ``BITS_PER_ROW`` bits a row and ``MOST_BITS`` at most, in bitmaps of
``BITMAP`` bits; that bounds what is broadcast (64 MB), and the same steps run at every
size: beyond MOST_BITS / BITS_PER_ROW rows more unique rows are tested in vain. Pass one
and all decisions move hashes and keys alone. Texts are tested against a second filter,
of the rows that have to go, so that only those (and a few by chance) shuffle with text;
rows of a group of ``HOT`` copies or more don't shuffle at all: such groups are at most one
in HOT rows, and their list is broadcast.

Defined results: a null text counts as empty; empty texts equal each other; of rows
that repeat both the text and the key, one stays; a null key loses to any other;
an empty table gives an empty result; other columns are left alone, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdag.llm.common import HOT, join_hot, opened, sealed, write_table

BITS_PER_ROW = 32
MOST_BITS = 1 << 29
#: Fixed value: the bits of one bitmap of the engine's bitmap functions.
BITMAP = 32_768


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A narrow table, written once: __row, __key, __hash (XXH64) and __sha (hex SHA-256)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return write_table(
        docs.select(
            F.monotonically_increasing_id().alias("__row"),
            F.col(key).alias("__key"),
            F.xxhash64(whole).alias("__hash"),
            F.sha2(whole, 256).alias("__sha"),
        ),
        "dedup-prints",
    )


class Filter:
    """Bits of the hashes (__hash) that at least ``least`` rows have."""

    def __init__(self, rows: DataFrame, least: int, bits_per_row: int = BITS_PER_ROW, most: int = MOST_BITS) -> None:
        self.slots = min(most, max(1024, rows.count() * bits_per_row))
        found = rows.groupBy(self._slot().alias("__slot")).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= least)
        # the bitmap functions count from 1
        bits = found.groupBy(F.expr("bitmap_bucket_number(__slot + 1)").alias("__bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(__slot + 1))").alias("__bits"))
        self.bitmaps = F.broadcast(write_table(bits, "dedup-filter"))

    def _slot(self) -> Column:
        return F.expr(f"pmod(__hash, {self.slots}L)")

    def test(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with __hash) and __maybe, whether the row's bit is set."""
        slot = f"pmod(__hash, {self.slots}L)"
        byte = f"cast(conv(hex(substring(__bits, cast({slot} % {BITMAP} div 8 as int) + 1, 1)), 16, 10) as int)"
        met = rows.join(self.bitmaps, F.expr(f"bitmap_bucket_number({slot} + 1) = __bucket"), "left")
        return met.select(*rows.columns, F.expr(f"coalesce(shiftright({byte}, cast({slot} % 8 as int)) & 1, 0) = 1").alias("__maybe"))


def _judge(prints: DataFrame, hot: int, **limits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows that pass straight through; the others with __keep, __size and __kept; the groups."""
    tested = Filter(prints.select("__hash"), 2, **limits).test(prints)
    maybe = tested.filter("__maybe").drop("__maybe")
    groups = write_table(
        maybe.groupBy(F.col("__sha").alias("__group")).agg(
            F.max(F.struct("__key", "__row")).alias("__best"), F.count(F.lit(1)).alias("__size")
        ),
        "dedup-groups",
    )
    met = join_hot(maybe, groups, F.col("__sha") == F.col("__group"), "__size", hot)
    judged = met.select(
        "__row", "__key", "__hash", "__sha", F.col("__best.__key").alias("__keep"), "__size",
        (F.col("__row") == F.col("__best.__row")).alias("__kept"),
    )
    return tested.filter("not __maybe"), judged, groups


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT, **limits: int) -> DataFrame:
    """One row per input row: ``key``, keep_id, group_size, kept, text_sha256."""
    through, judged, _ = _judge(fingerprints(docs, key, text), hot, **limits)
    single = through.select(
        "__row", "__key", "__hash", "__sha", F.col("__key").alias("__keep"), F.lit(1).cast("long").alias("__size"), F.lit(True).alias("__kept")
    )
    return single.unionByName(judged).select(
        F.col("__key").alias(key), F.col("__keep").alias("keep_id"), F.col("__size").alias("group_size"),
        F.col("__kept").alias("kept"), F.col("__sha").alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT, **limits: int) -> DataFrame:
    """``docs`` without the rows that lose; all columns stay.

    A row is known by its key and SHA-256, not by its place: another reading of ``docs``
    may be split in another way.
    """
    prints = fingerprints(docs, key, text)
    _, judged, groups = _judge(prints, hot, **limits)
    # __all: every row of this key and text goes; else all but one
    go = judged.filter("not __kept").groupBy("__key", "__sha", "__hash").agg(F.max(~F.col("__key").eqNullSafe(F.col("__keep"))).alias("__all"), F.max("__size").alias("__of"))
    go = write_table(go, "dedup-losers")
    named = lambda df: df.select(F.col("__key").alias("__lost"), F.col("__sha").alias("__lost_sha"), "__all")
    rows, names = sealed(docs)
    whole = F.coalesce(F.col(names[text]), F.lit(""))
    rows = rows.select("*", F.col(names[key]).alias("__key"), F.xxhash64(whole).alias("__hash"), F.sha2(whole, 256).alias("__sha"))
    large = F.broadcast(groups.filter(F.col("__size") >= hot).select("__group", F.col("__best.__key").alias("__best")))
    rows = rows.join(large, F.expr("__sha = __group and not __key <=> __best"), "left_anti")
    left = go.filter(~F.col("__all") | (F.col("__of") < hot))
    tested = Filter(left.select("__hash"), 1, **limits).test(rows)
    met = tested.filter("__maybe").join(named(left), F.expr("__sha = __lost_sha and __key <=> __lost"), "left").filter("not coalesce(__all, false)")
    once = met.filter("__all is not null").dropDuplicates(["__key", "__sha"])
    rest = met.filter("__all is null").unionByName(once)
    return opened(tested.filter("not __maybe"), names).unionByName(opened(rest, names))
