"""WARC records and a Merkle audit of their fixity.

A page becomes a WARC/1.0 response record. Records are ordered by id; a record's range
is [start, end) in the bytes of the whole collection, by global prefix sums. A leaf is
the SHA-256 of a record; an inner node covers ``FANOUT`` neighbours and is the SHA-256 of
their ranges and digests in order, up to one root.

Two replicas are compared from the root down: a level's unlike nodes are joined with
their children, and only these are compared next. So the audit touches one path per
corrupted record, whatever the size of the collection.

Defined results: null url or html counts as empty; records that repeat an id follow each
other; a record that only one replica has is unlike; an empty collection has no root;
no group is larger than ``FANOUT``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdag.llm.common import global_prefix, write_table

FANOUT = 64
#: Fixed value: the head of a record; id, target, length of the payload.
HEAD = (
    "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%s>\r\nWARC-Target-URI: %s\r\n"
    "Content-Type: application/http; msgtype=response\r\nContent-Length: %s\r\n\r\n"
)


def records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key`` and record: the whole record as binary."""
    body = F.coalesce(F.col(html), F.lit(""))
    head = F.format_string(HEAD, F.col(key).cast("string"), F.coalesce(F.col(url), F.lit("")), F.octet_length(body).cast("string"))
    return pages.select(F.col(key), F.concat(head, body, F.lit("\r\n\r\n")).cast("binary").alias("record"))


def leaves(recs: DataFrame, key: str = "page_id") -> DataFrame:
    """index, ``key``, start, end, digest of every record, in order of ``key``."""
    narrow = recs.select(F.col(key), F.octet_length("record").cast("long").alias("__size"), F.sha2("record", 256).alias("digest"))
    placed = global_prefix(narrow, [key], ["__size"], "warc-leaves")
    return placed.select(
        F.col("__index").alias("index"), F.col(key), F.col("__before___size").alias("start"),
        (F.col("__before___size") + F.col("__size")).alias("end"), "digest",
    )


def build_tree(leaf_rows: DataFrame) -> list[DataFrame]:
    """Levels of nodes (index, start, end, digest), leaves first, root last."""
    level = write_table(leaf_rows.select("index", "start", "end", "digest"), "merkle")
    levels, n = [level], level.count()
    while n > 1:
        node = F.struct("index", F.concat_ws(":", "start", "end", "digest").alias("d"))
        level = write_table(
            level.groupBy(F.expr(f"index div {FANOUT}").alias("index")).agg(
                F.min("start").alias("start"), F.max("end").alias("end"),
                F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(node)), lambda x: x["d"]), "\n"), 256).alias("digest"),
            ),
            "merkle",
        )
        levels.append(level)
        n = -(-n // FANOUT)
    return levels


def audit(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """index, ours and theirs (digests) of the leaves that are unlike.

    Trees of unlike height are compared from the lower one's root level down.
    """
    height = min(len(ours), len(theirs))
    found = None
    for depth in range(height - 1, -1, -1):
        a, b = (t[depth].select(F.col("index"), F.struct("start", "end", "digest").alias(side)) for t, side in ((ours, "a"), (theirs, "b")))
        if found is not None:
            parents = found.select(F.col("index").alias("__up"))
            a, b = (x.join(parents, F.expr(f"index div {FANOUT}") == F.col("__up"), "left_semi") for x in (a, b))
        unlike = a.join(b, "index", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
        found = write_table(unlike, "merkle-unlike")
    return found.select("index", F.col("a.digest").alias("ours"), F.col("b.digest").alias("theirs"))


def damage(recs: DataFrame, key: str, every: int) -> DataFrame:
    """A replica in which every ``every``-th id's record has its last letter turned."""
    bad = F.pmod(F.col(key), F.lit(every)) == every - 1
    text = F.col("record").cast("string")
    turned = F.concat(F.substring(text, F.lit(1), F.length(text) - 1), F.lit("!")).cast("binary")
    return recs.select(F.col(key), F.when(bad, turned).otherwise(F.col("record")).alias("record"))


def parse(raw: bytes) -> list[tuple[dict[str, str], bytes]]:
    """The records of a WARC file's bytes: (head fields, payload)."""
    out, at = [], 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.0":
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        out.append((fields, raw[end + 4 : end + 4 + size]))
        at = end + 4 + size + 4
    return out
