"""Causal operators over a chain index.

Every log (``dag_id``) is cut greedily into chains: an entry continues a chain whose tail
is in its history, else it opens one, so a log has about as many chains as it ever had
entries side by side. ``vc[c]`` of an entry is the greatest place of chain c in its
history, so that

    a <= b   iff   get(b.vc, a.chain) >= a.idx

is one comparison, without traversal or recursion. Only the last entry of a chain can be
maximal in a set, so maxima are a grouped ``max_by`` per chain (combined map-side), then
a comparison among at most as many candidates as there are chains.

``entries``: dag_id, hash, prev array<string>, anything else.
Indexed entries add topo (int), chain (int), idx (int), vc array<int>.
Positions: dag_id, pos_id, hash (one row per hash of the position). Where they come from the
index they may keep its chain, idx and vc; then they are not looked up.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

INDEX = "topo int, chain int, idx int, vc array<int>"
PLACES = {"topo": pa.int32(), "chain": pa.int32(), "idx": pa.int32(), "vc": pa.list_(pa.int32())}


def sweep(hashes: list[str], prevs: list[list[str]]) -> list[tuple[int, int, int, list[int]] | None]:
    """(topo, chain, idx, vc) per entry of one log; None where a predecessor is missing.

    Topological order takes the smallest ready hash first, so it doesn't depend on the
    order of the rows.
    """
    import heapq

    at = {h: i for i, h in enumerate(hashes)}
    waiting = [0] * len(hashes)
    after: list[list[int]] = [[] for _ in hashes]
    for i, prev in enumerate(prevs):
        for p in set(prev) if len(prev) > 1 else prev:
            waiting[i] += 1
            if p in at:
                after[at[p]].append(i)
    ready = [(hashes[i], i) for i, n in enumerate(waiting) if n == 0]
    heapq.heapify(ready)
    out: list[tuple[int, int, int, list[int]] | None] = [None] * len(hashes)
    tails: list[int] = []
    topo = 0
    while ready:
        _, i = heapq.heappop(ready)
        own = [at[p] for p in prevs[i]]
        if len(own) > 1:
            own = sorted(set(own), key=hashes.__getitem__)
        vc = list(out[own[0]][3]) if own else []
        for p in own[1:]:
            other = out[p][3]
            vc += [-1] * (len(other) - len(vc))
            for c, top in enumerate(other):
                if top > vc[c]:
                    vc[c] = top
        chain = next((out[p][1] for p in own if tails[out[p][1]] == out[p][2]), None)
        if chain is None:  # any chain that ends in the history will do: its order is ancestry, not succession
            chain = next((c for c, top in enumerate(vc) if top == tails[c]), len(tails))
        if chain == len(tails):
            tails.append(-1)
        tails[chain] += 1
        vc += [-1] * (chain + 1 - len(vc))
        vc[chain] = tails[chain]
        out[i] = (topo, chain, tails[chain], vc)
        topo += 1
        for j in after[i]:
            waiting[j] -= 1
            if not waiting[j]:
                heapq.heappush(ready, (hashes[j], j))
    return out


def clustered(entries: DataFrame) -> DataFrame:
    """``entries`` with every log whole and in one piece of one partition, repeats of a hash
    once. The window asks for that and no more: nothing is shuffled where logs lie whole."""
    before = F.lag("hash").over(Window.partitionBy("dag_id").orderBy("hash"))
    return entries.withColumn("__again", before.eqNullSafe(F.col("hash"))).filter("not __again").drop("__again")


def spans(ids: list) -> list[tuple[int, int]]:
    """Where each log starts and ends in a column of log ids."""
    starts = [i for i in range(len(ids)) if not i or ids[i] != ids[i - 1]]
    return list(zip(starts, [*starts[1:], len(ids)]))


def whole_logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole logs, of the batches of a clustered partition. What is held is the
    last batch and the log that isn't at its end; a group of rows for each log would cost more than
    its sweep."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("dag_id").to_pylist()
        cut = spans(ids)[-1][0]
        if cut or (held and ids[0] != last):
            done = [*held, batch.slice(0, cut)]
            held = []
            yield pa.Table.from_batches(done)
        held.append(batch.slice(cut))
        last = ids[-1]
    if held:
        yield pa.Table.from_batches(held)


def lists(column: pa.ChunkedArray) -> list[list]:
    """A column of lists as Python's, a missing one empty; item by item pyarrow takes longer."""
    out: list[list] = []
    for chunk in column.chunks:
        flat, at = chunk.flatten().to_pylist(), 0
        for n in pc.list_value_length(chunk).to_pylist():
            out.append(flat[at : at + (n or 0)])
            at += n or 0
    return out


def arrow_rows(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values())], names=list(types))


def chain_index(entries: DataFrame, wide: bool = False) -> DataFrame:
    """``entries`` with the chain index; entries that lack a predecessor are left out.

    One sweep per log; repeats of a hash count once. Whole rows go through the sweep, so
    the logs are dealt once; with ``wide`` only (dag_id, hash, prev) do and the rest is joined,
    for payloads that a task can't hold beside a log.
    """
    if wide:
        index = chain_index(entries.select("dag_id", "hash", "prev")).drop("prev")
        return entries.dropDuplicates(["dag_id", "hash"]).join(index, ["dag_id", "hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_logs(batches):
            hashes, prevs = table.column("hash").to_pylist(), lists(table.column("prev"))
            rows: list[tuple[int, int, int, list[int]] | None] = []
            for a, b in spans(table.column("dag_id").to_pylist()):
                rows += sweep(hashes[a:b], prevs[a:b])
            if None in rows:
                table = table.filter(pa.array([r is not None for r in rows]))
            places = arrow_rows([r for r in rows if r is not None], PLACES)
            for name, column in zip(PLACES, places.columns):
                table = table.append_column(name, column)
            yield from table.to_batches(10_000)

    known = entries.filter("dag_id is not null and hash is not null")
    fields = [StructField(f.name, f.dataType) for f in entries.schema.fields]
    return clustered(known).mapInArrow(run, StructType([*fields, *StructType.fromDDL(INDEX).fields]))


def leq(a: str, b: str) -> Column:
    """Whether the entry with columns ``a``.chain/idx is in the history of ``b``.vc."""
    return F.coalesce(F.get(F.col(f"{b}.vc"), F.col(f"{a}.chain")) >= F.col(f"{a}.idx"), F.lit(False))


def _dominated(x: Column, y: Column) -> Column:
    """x < y for index structs."""
    return F.coalesce(F.get(y["vc"], x["chain"]) >= x["idx"], F.lit(False)) & ((x["chain"] != y["chain"]) | (x["idx"] != y["idx"]))


def maximal_structs(tops: Column) -> Column:
    """The maxima of an array of structs that have chain, idx and vc."""
    return F.filter(tops, lambda x: ~F.exists(tops, lambda y: _dominated(x, y)))


def maxima(entries: DataFrame, keys: list[str], carry: list[str]) -> DataFrame:
    """For each ``keys``: ``tops``, the maximal entries as structs (hash, chain, idx, vc, carry)."""
    top = F.struct("hash", "chain", "idx", "vc", *carry)
    chains = entries.groupBy(*keys, "chain").agg(F.max_by(top, "idx").alias("__top"))
    grouped = chains.groupBy(*keys).agg(F.collect_list("__top").alias("__tops"))
    return grouped.select(*keys, maximal_structs(F.col("__tops")).alias("tops"))


def _merge(vcs: Column) -> Column:
    """Element-wise maximum of an array of vectors."""
    return F.aggregate(
        vcs, F.array().cast("array<int>"), lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(F.coalesce(x, F.lit(-1)), F.coalesce(y, F.lit(-1))))
    )


def _placed(index: DataFrame, positions: DataFrame) -> DataFrame:
    """Positions with the chain, idx and vc of their entries."""
    place = ["chain", "idx", "vc"]
    if set(place) <= set(positions.columns):
        return positions.select("dag_id", "pos_id", "hash", *place)
    return positions.select("dag_id", "pos_id", "hash").distinct().join(index.select("dag_id", "hash", *place), ["dag_id", "hash"])


def at_positions(index: DataFrame, positions: DataFrame) -> DataFrame:
    """dag_id, pos_id, ``vc`` of the whole position and its ``members`` (chain, idx, vc)."""
    grouped = _placed(index, positions).groupBy("dag_id", "pos_id").agg(F.collect_list(F.struct("chain", "idx", "vc")).alias("members"))
    return grouped.withColumn("vc", _merge(F.transform("members", lambda m: m["vc"])))


def reach(positions: DataFrame) -> DataFrame:
    """__dag, pos_id, __chain, __upto: how far each position sees into each chain."""
    seen = positions.select(F.col("dag_id").alias("__dag"), "pos_id", F.posexplode("vc").alias("__chain", "__upto"))
    return seen.filter("__upto >= 0")


def history(index: DataFrame, positions: DataFrame) -> DataFrame:
    """hist(P): the rows of ``index`` in each position's history, with pos_id. Entries and
    positions meet by (log, chain), so that a large log is spread over its chains."""
    p = reach(at_positions(index, positions))
    inside = (F.col("dag_id") == F.col("__dag")) & (F.col("chain") == F.col("__chain")) & (F.col("idx") <= F.col("__upto"))
    return index.join(p, inside).drop("__dag", "__chain", "__upto")


def walk_back(index: DataFrame, positions: DataFrame, bounds: DataFrame) -> DataFrame:
    """The rows of ``index`` in each position's history that its bound hasn't seen, with pos_id:
    what a walk back from the position meets before it comes to the bound. Positions
    and bounds meet by (dag_id, pos_id); order by topo, descending, for the walk's order."""
    both = _both(index, positions, bounds)
    inside = F.expr("dag_id = __dag and chain = __chain and idx <= __a and idx > __b")
    return index.join(both.filter("__a > __b"), inside).drop("__dag", "__chain", "__a", "__b")


def concurrent(index: DataFrame, later: DataFrame, at: DataFrame) -> DataFrame:
    """conc(from, at): in the history of ``later``, neither before nor after any member of
    ``at``; positions meet by (dag_id, pos_id). What ``at`` has seen is left out where
    entries meet chains, so the members meet only what is later or beside."""
    a = at_positions(index, at).select(F.col("dag_id").alias("__dag"), F.col("pos_id").alias("__pos"), "members")
    own = walk_back(index, later, at).join(a, F.expr("dag_id = __dag and pos_id = __pos"))
    after = F.exists("members", lambda m: F.coalesce(F.get(F.col("vc"), m["chain"]) >= m["idx"], F.lit(False)))
    return own.filter(~after).drop("members", "__dag", "__pos")


def frontier(entries: DataFrame) -> DataFrame:
    """dag_id, hash of the entries that no entry names as predecessor."""
    named = entries.select("dag_id", F.explode("prev").alias("hash")).distinct()
    return entries.select("dag_id", "hash").distinct().join(named, ["dag_id", "hash"], "left_anti")


def _unnest(tops: DataFrame, keys: list[str]) -> DataFrame:
    return tops.select(*keys, F.explode("tops").alias("t")).select(*keys, F.col("t.hash").alias("hash"))


def minimal_cover(index: DataFrame, positions: DataFrame) -> DataFrame:
    """max(P): dag_id, pos_id, hash."""
    keys = ["dag_id", "pos_id"]
    return _unnest(maxima(_placed(index, positions), keys, []), keys)


def tips(index: DataFrame) -> DataFrame:
    """The frontier of every log of an index, with chain, idx and vc: the maxima of all."""
    return maxima(index, ["dag_id"], []).select("dag_id", F.explode("tops").alias("t")).select("dag_id", "t.*")


def cover(index: DataFrame, positions: DataFrame, accept: Column) -> DataFrame:
    """cover(at, accept): the maximal accepted entries of each history."""
    keys = ["dag_id", "pos_id"]
    return _unnest(maxima(history(index, positions).filter(accept), keys, []), keys)


def concurrent_cover(index: DataFrame, later: DataFrame, at: DataFrame, accept: Column) -> DataFrame:
    """ccover(from, at, accept)."""
    keys = ["dag_id", "pos_id"]
    return _unnest(maxima(concurrent(index, later, at).filter(accept), keys, []), keys)


def _both(index: DataFrame, left: DataFrame, right: DataFrame, vectors: bool = False) -> DataFrame:
    """__dag, pos_id, __chain and how far the left and the right position see into it (-1: not);
    with ``vectors`` also their whole vectors, __va and __vb."""
    a = at_positions(index, left).select(F.col("dag_id").alias("__dag"), "pos_id", F.col("vc").alias("__va"))
    b = at_positions(index, right).select(F.col("dag_id").alias("__dag"), "pos_id", F.col("vc").alias("__vb"))
    chains = a.join(b, ["__dag", "pos_id"]).select("*", F.posexplode(F.arrays_zip("__va", "__vb")).alias("__chain", "__x"))
    upto = [F.coalesce(F.col(f"__x.{v}"), F.lit(-1)).alias(n) for v, n in (("__va", "__a"), ("__vb", "__b"))]
    return chains.select("__dag", "pos_id", "__chain", *upto, *(["__va", "__vb"] if vectors else []))


def fork_frontier(index: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """dag_id, pos_id, hash: the maxima of what two positions have in common. Of each chain
    only the last common entry can be one, and it is looked up; no history is listed."""
    keys = ["dag_id", "pos_id"]
    top = _both(index, left, right).select("__dag", "pos_id", "__chain", F.least("__a", "__b").alias("__top")).filter("__top >= 0")
    entries = index.select("dag_id", "hash", "chain", "idx", "vc")
    found = entries.join(top, F.expr("dag_id = __dag and chain = __chain and idx = __top"))
    return _unnest(maxima(found, keys, []), keys)


def fork(index: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """dag_id, pos_id, hash, part: all of ``common``, its maxima ``frontier``, and all own
    entries ``left`` and ``right`` of two positions that meet by (dag_id, pos_id)."""
    keys = ["dag_id", "pos_id"]
    both = _both(index, left, right)
    inside = F.expr("dag_id = __dag and chain = __chain and idx <= greatest(__a, __b)")
    part = F.when(F.col("idx") > F.col("__b"), "left").when(F.col("idx") > F.col("__a"), "right").otherwise("common")
    parts = index.join(both, inside).select(*keys, "hash", part.alias("part"))
    return parts.unionByName(fork_frontier(index, left, right).withColumn("part", F.lit("frontier")))


def fork_position(index: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """The entries at the edge of a fork: ``left`` and ``right`` are own entries with a direct
    predecessor in common, ``common`` are those predecessors, ``frontier`` the maxima of
    all that is in common. ``index`` has prev.

    Only own entries are taken, chain by chain, and only their edges are looked up; the other
    end is in common if the other position's vector reaches it. What is in common isn't listed.
    """
    keys = ["dag_id", "pos_id"]
    both = _both(index, left, right, vectors=True).filter("__a != __b")
    inside = F.expr("dag_id = __dag and chain = __chain and idx > least(__a, __b) and idx <= greatest(__a, __b)")
    own = index.select("dag_id", "hash", "chain", "idx", "prev").join(both, inside)
    own = own.withColumn("part", F.when(F.col("idx") > F.col("__b"), "left").otherwise("right"))
    other = F.when(F.col("part") == "left", F.col("__vb")).otherwise(F.col("__va"))
    edges = own.select(*keys, "hash", "part", other.alias("__other"), F.explode("prev").alias("p"))
    places = index.select(F.col("dag_id").alias("__log"), F.col("hash").alias("__p"), F.col("chain").alias("__pc"), F.col("idx").alias("__pi"))
    met = edges.join(places, F.expr("dag_id = __log and p = __p"))
    edge = met.filter(F.coalesce(F.get("__other", F.col("__pc")) >= F.col("__pi"), F.lit(False)))
    ends = F.array(F.struct("hash", "part"), F.struct(F.col("p").alias("hash"), F.lit("common").alias("part")))
    found = edge.select(*keys, F.explode(ends).alias("e")).select(*keys, "e.*").distinct()
    return found.unionByName(fork_frontier(index, left, right).withColumn("part", F.lit("frontier")))


def meet(index: DataFrame, positions: DataFrame) -> DataFrame:
    """dag_id, hash: the maxima of what all positions (pos_id) of a log have in common, from
    the last entry of each chain that all of them see. No position of a log, no row."""
    n = positions.groupBy("dag_id").agg(F.count_distinct("pos_id").alias("__n"))
    seen = reach(at_positions(index, positions)).groupBy("__dag", "__chain").agg(F.min("__upto").alias("__top"), F.count(F.lit(1)).alias("__m"))
    tops = seen.join(n.withColumnRenamed("dag_id", "__log"), F.expr("__dag = __log and __m = __n"))
    entries = index.select("dag_id", "hash", "chain", "idx", "vc")
    found = entries.join(tops.select("__dag", "__chain", "__top"), F.expr("dag_id = __dag and chain = __chain and idx = __top"))
    return _unnest(maxima(found, ["dag_id"], []), ["dag_id"])


def meta_filter(keys: list[str] | None = None, values: dict[str, list[str]] | None = None) -> Column:
    """An entry filter: ``meta`` (map of string sets) has all ``keys`` and all ``values``."""
    out = F.lit(True)
    for k in keys or []:
        out = out & F.map_contains_key("meta", k)
    for k, vs in (values or {}).items():
        for v in vs:
            out = out & F.coalesce(F.array_contains(F.col("meta")[k], v), F.lit(False))
    return out
