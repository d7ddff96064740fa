"""SimHash near-duplicates by a self-join of the binary trie of fingerprints.

The fingerprints are the leaves of a binary trie, bit 63 first. Two nodes are
traversed together: their children are paired, a pair of unlike children costs one
differing bit, and a pair that has spent more than the budget is left. What remains
at the leaves are all pairs within the budget.

The upper trie is cut into nodes of at most ``BLOCK`` fingerprints, from counts alone.
Two nodes may hold a pair only if the bits they share in depth differ in at most the
budget; such node pairs are found by a join of the nodes' prefixes with up to that many of
their bits turned. All of it is a DataFrame: the driver sees depths, never a node or a
fingerprint. Each node pair belongs to one of its nodes; a task has one node and up to
``PARTNERS`` others, sorts their fingerprints and traverses the subtries as ranges of that
array, in chunks of bounded size, so what a task holds doesn't grow with the input. A task
emits only links that join two of its components, so a group of like copies of any size
gives fewer links than it has fingerprints. The links' components are then found by
large-star and small-star steps over DataFrames.

Equal fingerprints are one leaf, so copies never multiply. Defined results: a null or
empty text has no words and fingerprint 0, and is linked like any other; fewer words
than a shingle form one shingle; repeated shingles count as often as they occur; an
empty table gives no rows; rows that repeat a key, or have none, go by their own text;
other columns are left alone, whatever their names; texts are read whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomdag.llm.common import give_back, join_hot, text_hash, without, write_table

SEED = 42
#: Most fingerprints under one node of the upper trie.
BLOCK = 65_536
#: Nodes that a task compares with its own.
PARTNERS = 8
#: Most range pairs that a task holds in one chunk.
CHUNK = 1 << 18
#: Hashes that are counted at a time.
SLAB = 1 << 16


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; fewer words than a shingle form one."""
    digest, join = xxhash.xxh64_intdigest, b" ".join
    n = max(1, len(words) - width + 1)
    return np.fromiter((digest(join(words[i : i + width]), SEED) for i in range(n)), dtype="<u8", count=n)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    total = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), SLAB):
        bits = np.unpackbits(hashes[lo : lo + SLAB].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * total > len(hashes)).tolist()))


def fingerprint(text: bytes, width: int) -> int:
    """The unsigned 64-bit SimHash of a lower-cased text's word shingles."""
    words = text.lower().split()
    return majority(shingle_hashes(words, width)) if words else 0


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """__row, __key, __hash (XXH64 of the text) and __print (the fingerprint as a signed long), written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint((t or "").encode(), width) for t in batch.column(3).to_pylist()]
            prints = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], prints], names=["__row", "__key", "__hash", "__print"])
        give_back()

    rows = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(key).alias("__key"), text_hash(F.col(text)).alias("__hash"), F.col(text).alias("__text"))
    kind = rows.schema["__key"].dataType.simpleString()
    return write_table(rows.mapInArrow(run, f"__row long, __key {kind}, __hash long, __print long"), "simhash-prints")


# -- the upper trie -----------------------------------------------------------


def _mask(depth: int) -> int:
    """The upper ``depth`` bits, as a signed long."""
    return -(1 << (64 - depth)) if depth else 0


def upper_nodes(prints: DataFrame, block: int) -> DataFrame:
    """low, depth of nodes that tile the trie, each of at most ``block`` fingerprints.

    Counts are taken at 16 bits more at a time, under the nodes that are still too large;
    sums over the levels between give the highest nodes that are small enough.
    """
    levels, under = 16, None
    found: list[DataFrame] = []
    for depth in range(levels, 65, levels):
        prefix = F.shiftrightunsigned("__print", 64 - depth) if depth < 64 else F.col("__print")
        rows = prints.select(prefix.alias("p"))
        if under is not None:
            rows = rows.join(under, F.shiftrightunsigned("p", levels) == F.col("u"), "left_semi")
        counts = rows.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
        up = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("k")
        every = counts.select("p", "n", up).groupBy(F.expr("shiftrightunsigned(p, k)").alias("p"), (depth - F.col("k")).alias("d")).agg(F.sum("n").alias("n"))
        every = write_table(every, "trie-counts")
        large = every.filter((F.col("n") > block) & (F.col("d") < 64))
        small = every.filter((F.col("n") <= block) | (F.col("d") == 64))
        parent = large.select(F.col("p").alias("up"), (F.col("d") + 1).alias("at"))
        below = small.filter("d > 0").join(parent, F.expr("shiftrightunsigned(p, 1) = up and d = at"), "left_semi")
        found.append(below.unionByName(small.filter("d = 0")))
        under = large.filter(F.col("d") == depth).select(F.col("p").alias("u"))
        if under.isEmpty():
            break
    tiles = functools.reduce(DataFrame.unionByName, found)
    return write_table(tiles.select(F.expr("shiftleft(p, 64 - d)").alias("low"), F.col("d").alias("depth")), "trie-nodes")


def node_pairs(nodes: DataFrame, budget: int) -> DataFrame:
    """a, b: lows of nodes whose common bits differ in at most ``budget``; a pair once, a node
    with itself too. The deeper node's prefix, cut to the other's depth, has up to ``budget``
    bits turned and meets the other by equality."""
    spark = nodes.sparkSession
    depths = sorted(r[0] for r in nodes.select("depth").distinct().collect())
    turned = [
        (d, sum(1 << b for b in some) - (1 << 64 if 63 in some else 0))
        for d in depths for n in range(min(budget, d) + 1) for some in combinations(range(64 - d, 64), n)
    ]
    turns = spark.createDataFrame(turned, "at int, turn long")
    masks = spark.createDataFrame([(d, _mask(d)) for d in depths], "level int, mask long")
    near = nodes.join(F.broadcast(masks), F.col("level") <= F.col("depth")).join(F.broadcast(turns), F.col("at") == F.col("level"))
    near = near.select(F.col("low").alias("a"), F.col("depth").alias("deep"), F.col("level"), F.expr("(low & mask) ^ turn").alias("other"))
    other = nodes.select(F.col("low").alias("b"), F.col("depth").alias("flat"))
    met = near.join(other, F.expr("other = b and level = flat"))
    return met.filter("flat < deep or a <= b").select("a", "b")


# -- the subtries -------------------------------------------------------------


class _Forest:
    """Union-find over places in one array, with vectorised root lookup."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            s = self.up[r]
            if np.array_equal(r, s):
                self.up[x] = r
                return r
            r = s

    def link(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Join every pair; the pairs that joined two components."""
        ra, rb = self.roots(a), self.roots(b)
        new, up = [], self.up
        fresh = np.flatnonzero(ra != rb)
        for x, y in zip(a[fresh].tolist(), b[fresh].tolist()):
            p, q = x, y
            while up[p] != p:
                up[p] = up[up[p]]
                p = int(up[p])
            while up[q] != q:
                up[q] = up[up[q]]
                q = int(up[q])
            if p != q:
                up[max(p, q)] = min(p, q)
                new.append((x, y))
        return new


def _traverse(prints: np.ndarray, left: tuple[int, int], right: tuple[int, int], budget: int, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs within ``budget``, one from each range of sorted ``prints``.

    A chunk is five arrays: the two ranges of every node pair, and its differing bits.
    Ranges are split where bit ``63 - depth`` turns; a pair of ranges of a few prints
    is compared leaf by leaf.
    """
    start = tuple(np.array([v]) for v in (*left, *right)) + (np.array([0]),)
    stack = [(depth, start)]
    while stack:
        at, (a0, a1, b0, b1, spent) = stack.pop()
        if len(a0) > CHUNK:
            half = len(a0) // 2
            stack.append((at, tuple(v[half:] for v in (a0, a1, b0, b1, spent))))
            stack.append((at, tuple(v[:half] for v in (a0, a1, b0, b1, spent))))
            continue
        small = (a1 - a0) * (b1 - b0) <= 32
        if at == 64:
            small[:] = True
        if small.any():
            wa, wb = (a1 - a0)[small], (b1 - b0)[small]
            n = wa * wb
            owner = np.repeat(np.arange(len(n)), n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            x = a0[small][owner] + place // wb[owner]
            y = b0[small][owner] + place % wb[owner]
            near = (x < y) & (np.bitwise_count(prints[x] ^ prints[y]) <= budget)
            if near.any():
                yield x[near], y[near]
            a0, a1, b0, b1, spent = (v[~small] for v in (a0, a1, b0, b1, spent))
        if not len(a0):
            continue
        bit = np.uint64(1) << np.uint64(63 - at)

        def middle(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            """First place in [lo, hi) whose bit is set: all above it share the bits before."""
            mark = (prints[lo] | bit) & ~(bit - np.uint64(1))
            return np.clip(np.searchsorted(prints, mark), lo, hi)

        am, bm = middle(a0, a1), middle(b0, b1)
        same = (a0 == b0) & (a1 == b1)
        parts = []
        for x0, x1, y0, y1, cost, skip in (
            (a0, am, b0, bm, 0, None),
            (am, a1, bm, b1, 0, None),
            (a0, am, bm, b1, 1, None),
            (am, a1, b0, bm, 1, same),
        ):
            ok = (x1 > x0) & (y1 > y0) & (spent + cost <= budget)
            if skip is not None:
                ok &= ~skip
            parts.append(tuple(v[ok] for v in (x0, x1, y0, y1, spent + cost)))
        merged = tuple(np.concatenate(v) for v in zip(*parts))
        if len(merged[0]):
            stack.append((at + 1, merged))


def links(prints: DataFrame, budget: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all pairs of distinct __print within ``budget`` bits.

    Not all pairs: per task a spanning forest of them.
    """
    nodes = upper_nodes(prints, block)
    depths = [r[0] for r in nodes.select("depth").distinct().collect()]
    if not depths:
        return prints.sparkSession.createDataFrame([], "a long, b long")
    # a pair is worked on with one of its nodes, in turn, so that each node is copied to half its partners
    turn = F.pmod(F.xxhash64("a", "b"), F.lit(2)) == 0
    pairs = node_pairs(nodes, budget).select(F.when(turn, F.col("a")).otherwise(F.col("b")).alias("owner"), F.when(turn, F.col("b")).otherwise(F.col("a")).alias("other"))
    place = F.row_number().over(Window.partitionBy("owner").orderBy("other")) - 1
    work = write_table(pairs.select("owner", "other", F.floor(place / PARTNERS).cast("int").alias("part")), "trie-work")
    # a member is a node in a task: the owner, or one that is compared with it
    own = work.groupBy("owner", "part").agg(F.bool_or(F.col("owner") == F.col("other")).alias("own"))
    members = own.select(F.col("owner").alias("node"), "owner", "part", "own").unionByName(
        work.filter("owner != other").select(F.col("other").alias("node"), "owner", "part", F.lit(False).alias("own"))
    )
    lows = F.array(*[F.struct(F.lit(d).alias("at"), F.col("__print").bitwiseAND(F.lit(_mask(d)).cast("long")).alias("of")) for d in depths])
    placed = prints.select("__print", F.explode(lows).alias("x")).join(nodes, F.expr("x.of = low and x.at = depth")).select("__print", "low")
    dealt = placed.join(members, F.col("low") == F.col("node")).select("__print", "node", "owner", "part", "own")

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        whole = np.sort(pdf["__print"].to_numpy().view(np.uint64))
        nodes = np.unique(pdf["node"].to_numpy().view(np.uint64))
        edges = np.append(np.searchsorted(whole, nodes), len(whole)).tolist()
        mine = int(np.searchsorted(nodes, np.uint64(int(key[0]) % (1 << 64))))
        forest = _Forest(len(whole))
        out: list[tuple[int, int]] = []
        for k in range(len(nodes)):
            i, j = min(k, mine), max(k, mine)
            if k != mine or pdf["own"].any():
                for x, y in _traverse(whole, (edges[i], edges[i + 1]), (edges[j], edges[j + 1]), budget, 0):
                    out += forest.link(x, y)
        at = np.array(out, dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": whole[at[:, 0]].view(np.int64), "b": whole[at[:, 1]].view(np.int64)})

    return write_table(dealt.groupBy("owner", "part").applyInPandas(join, "a long, b long"), "simhash-links")


# -- components ---------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the component's least node.

    Large-star and small-star steps until nothing changes; every step is one grouped
    minimum and one join, so no neighbourhood is ever collected.
    """
    now = write_table(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    before = None
    while True:
        ends = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = write_table(ends.groupBy(F.col("u").alias("of")).agg(F.least(F.min("v"), F.col("of")).alias("m"), F.count(F.lit(1)).alias("n")), "star-least")
        large = join_hot(ends.filter("v > u"), least, F.col("u") == F.col("of"), "n").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = write_table(large.distinct(), "stars")
        lower = write_table(now.groupBy(F.col("u").alias("of")).agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "star-least")
        small = join_hot(now, lower, F.col("u") == F.col("of"), "n")
        now = write_table(
            small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u != v").distinct(),
            "stars",
        )
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, budget: int = 3, block: int = BLOCK) -> DataFrame:
    """One row per input row: __row, ``key``, __hash, __print, __root (the least fingerprint
    of its component, as a signed long), __class (the least key of the component)."""
    rows = fingerprints(docs, key, text, width)
    distinct = write_table(rows.groupBy("__print").agg(F.min("__key").alias("__least"), F.count(F.lit(1)).alias("__n")), "simhash-distinct")
    roots = write_table(components(links(distinct, budget, block)), "simhash-roots")
    classed = distinct.join(roots, F.col("__print") == F.col("node"), "left").select(
        "__print", "__least", "__n", F.coalesce("root", "__print").alias("__root")
    )
    classed = write_table(classed, "simhash-classed")
    least = write_table(classed.groupBy(F.col("__root").alias("__at")).agg(F.min("__least").alias("__class"), F.count(F.lit(1)).alias("__prints")), "simhash-least")
    named = join_hot(classed, least, F.col("__root") == F.col("__at"), "__prints")
    named = write_table(named.select(F.col("__print").alias("__of"), "__root", "__class", "__n"), "simhash-classes")
    return join_hot(rows, named, F.col("__print") == F.col("__of"), "__n").select(
        "__row", F.col("__key").alias(key), "__hash", "__print", "__root", "__class"
    )


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, budget: int = 3) -> DataFrame:
    """``docs`` with one row of each component: the one with the least key, and of rows that
    repeat that key the one with the least text hash."""
    found = write_table(near_duplicates(docs, key, text, width, budget).withColumnRenamed(key, "__key"), "simhash-found")
    return without(docs, key, text, found, losers(found, "__root"))


def losers(found: DataFrame, group: str) -> DataFrame:
    """Of ``found`` (__key, __hash and a group) the rows that aren't their group's first, by key
    (null last) and text hash. Rows that repeat both are one."""
    order = F.struct(F.col("__key").isNull().alias("n"), F.col("__key").alias("k"), F.col("__hash").alias("h"))
    best = found.groupBy(F.col(group).alias("__of")).agg(F.min(order).alias("b"), F.count(F.lit(1)).alias("__size"))
    best = write_table(best, "near-kept")
    return join_hot(found, best, F.col(group) == F.col("__of"), "__size").filter("__hash != b.h or not __key <=> b.k")
