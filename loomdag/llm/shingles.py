"""Near-duplicates by the Jaccard similarity of word shingles, confirmed pair by pair.

A text's shingles are hashed by XXH64; from them come its SimHash, its set, and the set's
MinHash signature. Candidates come from two sides. The trie self-join of ``simhash`` links
fingerprints within its budget. A similarity of 0.8 moves about ten of 64 bits, more than
a trie can be searched for, so texts that agree in all minima of one of ``BANDS`` bands of
``ROWS`` are candidates too: at similarity s with probability 1 - (1 - s^ROWS)^BANDS, which
misses 7 pairs of 0.8 in a million. Only a pair whose whole sets have at least the asked
similarity is a link, and the links' components are the classes.

Texts that share a band, or a fingerprint, are a bucket. A bucket of up to ``SMALL`` texts
gives all its pairs. In a larger one every text is compared with ``LEADERS`` of them, the
same in all buckets of a group; where that joins all into one component, nothing is left to
find, however large the group. In a bucket that stays in several components (texts that
share a passage and are otherwise unlike, or a family that is less alike than asked), the
texts outside the largest component are compared with ``LEADERS`` others of it and of the
rest, ``ROUNDS_MORE`` times, which joins what is joined by many links. What is in several
components after that is compared whole: each text outside the largest component with every
text of the bucket that isn't in its own. So no two texts of a bucket are left uncompared
but those that are in one class already.

A pair is first compared by marks: the parities of the numbers of shingles in ``BINS`` bins.
Marks differ in at most as many bins as the sets differ in shingles, so that a pair whose
marks differ in more than the similarity allows is no link, and its sets needn't meet.
The pairs of a large bucket are met and judged where they are made; none is written.

Defined results: words are those of the SimHash (lower-cased ASCII, split at white
space); fewer words than a shingle form one shingle; a null or empty text has one empty
shingle; a null key loses to any other; rows that repeat key and text are one; an empty
table gives no rows; texts are read whole; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdag.llm.common import give_back, join_hot, partitions, text_hash, without, write_table
from loomdag.llm import simhash
from loomdag.llm.exact_dedup import Filter
from loomdag.llm.simhash import SEED, SLAB, components, losers

BANDS, ROWS = 30, 5
#: Texts that a worker holds as Python objects at a time.
TEXTS = 256
#: Buckets of more texts than this give pairs with leaders first.
SMALL, LEADERS = 16, 2
#: How often what is still open in large buckets meets other leaders before all of it is compared.
ROUNDS_MORE = 2
#: Bins of a text's marks.
BINS = 2048
#: Texts on each side of a part of a large bucket that is compared whole.
PART = 8192
_RANDOM = np.random.default_rng(SEED)
_MASK = _RANDOM.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
_TIMES = _RANDOM.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def shingles(text: bytes, width: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(simhash.shingle_hashes(text.lower().split(), width))


def bands(found: np.ndarray) -> np.ndarray:
    """A hash of the minima of each band, as signed longs."""
    least = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    step = max(1, SLAB * 2 // len(least))
    for lo in range(0, len(found), step):
        np.minimum(least, ((found[None, lo : lo + step] ^ _MASK[:, None]) * _TIMES[:, None]).min(axis=1), out=least)
    parts = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(p.tobytes(), b) for b, p in enumerate(parts)], dtype=np.uint64).view(np.int64)


def marks(found: np.ndarray) -> np.ndarray:
    """The parity of the number of hashes in each bin, as signed longs."""
    odd = np.bincount((found >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64), minlength=BINS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _may_link(similarity: Fraction) -> str:
    """Whether the marks of x and y (structs of __n, __marks, ...) leave the similarity possible:
    sets of m elements together with at least p / q differ in at most m (q - p) / (q + p)."""
    p, q = similarity.numerator, similarity.denominator
    differ = " + ".join(f"bit_count(x.__marks[{i}] ^ y.__marks[{i}])" for i in range(BINS // 64))
    return f"least(x.__n, y.__n) * {q} >= greatest(x.__n, y.__n) * {p} and ({differ}) * {q + p} <= (x.__n + y.__n) * {q - p}"


def signatures(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """__row, __key, __hash (XXH64 of the text), __n (shingles), __print (SimHash) and __bands,
    one row for each key and text, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                n, prints, marks = [], [], []
                for t in batch.column(3).to_pylist():
                    words = (t or "").encode().lower().split()
                    hashes = simhash.shingle_hashes(words, width)
                    own = np.unique(hashes)
                    n.append(len(own))
                    prints.append(simhash.majority(hashes) if words else 0)
                    marks.append(bands(own))
                found = [pa.array(n, pa.int64()), pa.array(np.array(prints, dtype=np.uint64).view(np.int64)), pa.array(marks, type=pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *found], names=["__row", "__key", "__hash", "__n", "__print", "__bands"])
        give_back()

    rows = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(key).alias("__key"), text_hash(F.col(text)).alias("__hash"), F.col(text).alias("__text"))
    kind = rows.schema["__key"].dataType.simpleString()
    return write_table(rows.mapInArrow(run, f"__row long, __key {kind}, __hash long, __n long, __print long, __bands array<long>"), "shingle-bands")


def _ordered(pairs: DataFrame, similarity: Fraction) -> DataFrame:
    """Pairs (x, y: structs of __row, __n) as distinct (a < b), where the sizes allow the similarity."""
    p, q = similarity.numerator, similarity.denominator
    near = pairs.filter(f"x.__row != y.__row and least(x.__n, y.__n) * {q} >= greatest(x.__n, y.__n) * {p}")
    return near.select(F.least("x.__row", "y.__row").alias("a"), F.greatest("x.__row", "y.__row").alias("b")).distinct()


def trie_pairs(signed: DataFrame, budget: int, similarity: Fraction) -> DataFrame:
    """Pairs that the trie join links, by the first text of each fingerprint."""
    prints = write_table(signed.groupBy("__print").agg(F.min(F.struct("__row", "__n")).alias("x")), "shingle-prints")
    found = simhash.links(prints.select("__print"), budget)
    across = found.join(prints.select(F.col("__print").alias("a"), "x"), "a").join(prints.select(F.col("__print").alias("b"), F.col("x").alias("y")), "b")
    return _ordered(across.select("x", "y"), similarity)


def bucket_pairs(members: DataFrame, small: int, similarity: Fraction) -> tuple[DataFrame, DataFrame]:
    """Pairs of ``members`` (__bucket, __row, __n): all in buckets of up to ``small``, those with
    leaders in larger ones; and the members of the larger ones, of which ``links`` compares
    what the leaders leave open."""
    member = F.struct("__row", "__n")
    sizes = members.groupBy(F.col("__bucket").alias("__of")).agg(F.count(F.lit(1)).alias("__size"))
    sizes = write_table(sizes.filter("__size > 1"), "shingle-buckets")
    # nearly all places are the only one of their bucket, and aren't shuffled again
    shared = Filter(sizes.select(F.col("__of").alias("__hash")), 1).test(members.withColumnRenamed("__bucket", "__hash")).filter("__maybe")
    shared = shared.withColumnRenamed("__hash", "__bucket").select(*members.columns)
    met = write_table(join_hot(shared, sizes, F.col("__bucket") == F.col("__of"), "__size").select(*members.columns, "__size"), "shingle-members")
    few = met.filter(f"__size <= {small}").groupBy("__bucket").agg(F.collect_list(member).alias("__with"))
    few = few.select(F.explode("__with").alias("x"), "__with").select("x", F.explode("__with").alias("y")).filter("x.__row < y.__row")
    many = met.filter(f"__size > {small}").select(*members.columns)
    leaders = [F.min_by(member, F.xxhash64("__row", F.lit(k))) for k in range(LEADERS)]
    named = many.groupBy(F.col("__bucket").alias("__of")).agg(F.count(F.lit(1)).alias("__size"), F.array_distinct(F.array(*leaders)).alias("__leaders"))
    led = join_hot(many, write_table(named, "shingle-leaders"), F.col("__bucket") == F.col("__of"), "__size")
    return _ordered(few.unionByName(led.select(member.alias("x"), F.explode("__leaders").alias("y"))), similarity), many


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: Fraction) -> DataFrame:
    """The pairs (a, b) whose sets have at least the similarity."""
    p, q = similarity.numerator, similarity.denominator
    marked = sets.select("__row", F.struct("__n", "__marks"))
    near = pairs.join(marked.toDF("a", "x"), "a").join(marked.toDF("b", "y"), "b").filter(_may_link(similarity))
    near = write_table(near.select("a", "b"), "shingle-near")
    ends = near.select(F.col("a").alias("__row")).union(near.select("b")).distinct()
    wide = sets.select("__row", "__set").join(ends, "__row", "left_semi")
    whole = near.join(wide.toDF("a", "sa"), "a").join(wide.toDF("b", "sb"), "b")
    shared = whole.select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("n"), (F.size("sa") + F.size("sb")).alias("m"))
    return write_table(shared.filter(f"n * {q} >= (m - n) * {p}").select("a", "b"), "shingle-links")


def shingle_sets(docs: DataFrame, signed: DataFrame, wanted: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """__row, __n, __marks and __set of the wanted rows, from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = shingles((t or "").encode(), width)
                lists = [pa.array([v], type=pa.list_(pa.int64())) for v in (marks(own), own.view(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([len(own)], pa.int64()), *lists], names=["__row", "__n", "__marks", "__set"])
        give_back()

    named = write_table(signed.join(wanted.distinct(), "__row").select("__row", "__key", "__hash"), "shingle-wanted")
    texts = docs.select(F.col(key).alias("k"), text_hash(F.col(text)).alias("__hash"), F.col(text).alias("t"))
    # only texts that may be wanted are shuffled
    texts = Filter(named.select("__hash"), 1).test(texts).filter("__maybe").select("k", F.col("__hash").alias("h"), "t")
    read = texts.join(named, F.expr("h = __hash and k <=> __key")).select("__row", "t").dropDuplicates(["__row"])
    return write_table(read.mapInArrow(run, "__row long, __n long, __marks array<long>, __set array<long>"), "shingle-sets")


def open_members(many: DataFrame, roots: DataFrame) -> DataFrame:
    """``many`` with __root, of the buckets whose texts lie in more than one component."""
    placed = many.join(roots.toDF("__node", "__at"), F.col("__row") == F.col("__node"), "left")
    placed = write_table(placed.select(*many.columns, F.coalesce("__at", "__row").alias("__root")), "shingle-open")
    spread = placed.groupBy(F.col("__bucket").alias("__of")).agg(F.min("__root").alias("__low"), F.max("__root").alias("__high"), F.count(F.lit(1)).alias("__size"))
    several = write_table(spread.filter("__low != __high").select("__of", "__size"), "shingle-several")
    return join_hot(placed, several, F.col("__bucket") == F.col("__of"), "__size").select(*many.columns, "__root")


def placed_members(members: DataFrame) -> DataFrame:
    """``members`` with __rest (whether a text is outside the largest component of its bucket)
    and the number of the bucket's texts (__size) and of those outside (__open)."""
    sizes = members.groupBy("__bucket", "__root").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy(F.col("__bucket").alias("__of")).agg(
        F.max_by("__root", F.struct("n", "__root")).alias("__main"), F.sum("n").alias("__size"), (F.sum("n") - F.max("n")).alias("__open")
    )
    main = write_table(main, "shingle-main")
    placed = join_hot(members, main, F.col("__bucket") == F.col("__of"), "__size")
    return write_table(placed.select(*members.columns, (F.col("__root") != F.col("__main")).alias("__rest"), "__size", "__open"), "shingle-placed")


def rest_pairs(placed: DataFrame, turn: int, similarity: Fraction) -> DataFrame:
    """In each bucket the texts outside its largest component with leaders of that component
    and of the rest, drawn anew each ``turn``."""
    placed = placed.select("__bucket", F.struct("__row", "__n").alias("x"), "__rest")
    draw = lambda side, k: F.min_by(F.when(F.col("__rest") == side, F.col("x")), F.when(F.col("__rest") == side, F.xxhash64("x.__row", F.lit(1000 * turn + k))))
    leaders = [draw(side, k) for side in (False, True) for k in range(LEADERS)]
    led = placed.groupBy(F.col("__bucket").alias("__at")).agg(F.array_distinct(F.array(*leaders)).alias("__with"), F.count(F.lit(1)).alias("__size"))
    met = join_hot(placed.filter("__rest"), write_table(led, "shingle-leaders"), F.col("__bucket") == F.col("__at"), "__size")
    return _ordered(met.select("x", F.explode("__with").alias("y")), similarity)


def all_pairs(placed: DataFrame, sets: DataFrame, similarity: Fraction, part: int = PART) -> DataFrame:
    """Of each bucket every pair (a, b) of texts in different components that may link by size and marks.

    Every such pair has a text outside the largest component. Those texts and all texts of the
    bucket are cut into parts of about ``part``, and each part of the one meets each of the other.
    """
    text = F.struct("__row", "__n", "__root", "__rest", "__marks")
    rows = placed.join(sets.select(F.col("__row").alias("__own"), "__marks"), F.col("__row") == F.col("__own"))
    rows = rows.select("__bucket", text.alias("x"), F.ceil(F.col("__open") / part).alias("m"), F.ceil(F.col("__size") / part).alias("n"))
    rows = write_table(rows, "shingle-open-marks")
    mine = lambda parts: F.pmod(F.xxhash64("x.__row"), F.col(parts))
    each = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))
    keys = ["__bucket", "i", "j"]
    # a part's rows are few for the work in it, so they are dealt by their number, not by bytes
    tasks = partitions(placed.sparkSession)
    left = rows.filter("x.__rest").select("__bucket", "x", mine("m").alias("i"), each("n").alias("j")).repartition(tasks, *keys)
    right = rows.select("__bucket", F.col("x").alias("y"), each("m").alias("i"), mine("n").alias("j")).repartition(tasks, *keys)
    met = left.join(right.hint("shuffle_hash"), keys).filter("x.__root != y.__root and (not y.__rest or x.__row < y.__row)").filter(_may_link(similarity))
    return met.select(F.least("x.__row", "y.__row").alias("a"), F.greatest("x.__row", "y.__row").alias("b")).distinct()


def links(docs: DataFrame, signed: DataFrame, key: str, text: str, width: int, similarity: Fraction, budget: int, small: int = SMALL) -> DataFrame:
    """Links (a, b) between rows of ``signed`` of at least the similarity, enough to join every
    two texts of a bucket that have it."""
    members = signed.select("__row", "__n", F.explode(F.concat("__bands", F.array(F.xxhash64("__print")))).alias("__bucket"))
    pairs, many = bucket_pairs(members, small, similarity)
    pairs = write_table(pairs.union(trie_pairs(signed, budget, similarity)).distinct(), "shingle-pairs")
    wanted = pairs.select(F.col("a").alias("__row")).union(pairs.select("b")).union(many.select("__row"))
    sets = shingle_sets(docs, signed, wanted, key, text, width)
    found = confirmed(pairs, sets, similarity)
    for turn in range(1, ROUNDS_MORE + 2):
        if many.isEmpty():
            break
        many = write_table(open_members(many.select("__bucket", "__row", "__n"), write_table(components(found), "shingle-components")), "shingle-rest")
        if many.isEmpty():
            break
        placed = placed_members(many)
        pairs = rest_pairs(placed, turn, similarity) if turn <= ROUNDS_MORE else all_pairs(placed, sets, similarity)
        found = found.unionByName(confirmed(write_table(pairs, "shingle-pairs"), sets, similarity))
    return found


def drop_similar(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, similarity: Fraction = Fraction(4, 5), budget: int = 3, small: int = SMALL
) -> DataFrame:
    """``docs`` with one row of each class: the one with the least key, and of rows that
    repeat that key the one with the least text hash."""
    every = signatures(docs, key, text, width)
    signed = every
    if not every.groupBy("__key", "__hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        first = every.groupBy("__key", "__hash").agg(F.min(F.struct("__row", "__n", "__print", "__bands")).alias("s"))
        signed = write_table(first.select("__key", "__hash", "s.*"), "shingle-signed")
    roots = write_table(components(links(docs, signed, key, text, width, similarity, budget, small)), "shingle-roots")
    found = write_table(signed.join(roots, F.col("__row") == F.col("node")).select("__key", "__hash", "root"), "shingle-found")
    return without(docs, key, text, every, losers(found, "root"))
