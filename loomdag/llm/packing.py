"""Packing pieces into sequences by cutting-stock column generation.

Only the histogram of piece lengths comes to the driver; it has at most one row per
length. A linear program chooses how often to use each pattern (a multiset of lengths
that fits a sequence) so that all pieces are covered by the fewest sequences. Patterns
are made on demand: a knapsack dynamic program over the capacity, with the program's
dual prices as values, gives the pattern that lowers the objective most, and none is
left to find at the optimum. The solution is rounded down, and what it leaves is a
small histogram that largest-first patterns fill.

Pieces are ranked by (length, key, start) with global prefix sums, so that a pattern's
share of a length is one range of ranks, and a piece finds its sequence and offset from
its rank alone. The table of ranges grows with the number of lengths, not of pieces.

Defined results: no pieces give no sequences; pieces that tie are interchangeable; rows
that repeat key and start are pieces each; a null text is empty and has one piece, its
end; a piece longer than the capacity is refused; texts are read whole; other columns
are carried along, but for ``sequence_id`` and ``offset``, which give way to the results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdag.llm.common import global_prefix, sealed, write_table
from loomdag.llm.tokens import token_pieces

#: The program ends when its objective is proven to be this near the optimum.
GAP = 0.002
#: Most basis changes; what is found by then is still a feasible packing.
PIVOTS = 3000


def _largest_first(demand: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns with multiplicities that cover ``demand`` (by length), each filled from
    the largest length that still fits and repeated while all its lengths last."""
    left, out = demand.copy(), []
    while True:
        there = np.flatnonzero(left)
        if not len(there):
            return out
        pattern: dict[int, int] = {}
        room = capacity
        while room:
            at = np.searchsorted(there, room, side="right") - 1
            while at >= 0 and left[there[at]] <= pattern.get(int(there[at]), 0):
                at -= 1
            if at < 0:
                break
            w = int(there[at])
            n = min(room // w, int(left[w]) - pattern.get(w, 0))
            pattern[w] = pattern.get(w, 0) + n
            room -= n * w
        times = min(int(left[w]) // n for w, n in pattern.items())
        for w, n in pattern.items():
            left[w] -= n * times
        out.append((pattern, times))


def _knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of ``sizes`` of the highest price that fits ``capacity``."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            worth = best[c - sizes[:k]] + prices[:k]
            at = int(worth.argmax())
            if worth[at] > best[c]:
                best[c], took[c] = worth[at], at
    pattern = np.zeros(len(sizes))
    c = capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= sizes[took[c]]
    return float(best[capacity]), pattern


def solve(demand: np.ndarray, capacity: int, gap: float = GAP, pivots: int = PIVOTS) -> list[tuple[np.ndarray, float, np.ndarray]]:
    """The linear program by revised simplex: (sizes, use, pattern) of its basis.

    Largest-first patterns are priced before the dynamic program is asked.
    """
    sizes = np.flatnonzero(demand)
    m, d = len(sizes), demand[sizes].astype(float)
    if not m:
        return []
    at = {int(w): i for i, w in enumerate(sizes)}
    pool = np.zeros((0, m))
    if first := _largest_first(demand, capacity):
        pool = np.zeros((len(first), m))
        for row, (pattern, _) in enumerate(first):
            for w, n in pattern.items():
                pool[row, at[w]] = n
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    cost = np.ones(m)
    use = inverse @ d
    fullest = d @ sizes / capacity  # no packing uses fewer sequences
    for _ in range(pivots):
        if use @ cost <= fullest * (1 + gap):
            break
        prices = cost @ inverse
        if prices.min() < -1e-7:  # more than is asked for may be made
            column, price = np.zeros(m), 0.0
            column[int(prices.argmin())] = -1.0
        else:
            worth = pool @ prices
            k = int(worth.argmax()) if len(worth) else -1
            if k >= 0 and worth[k] > 1 + 1e-6:
                column, price = pool[k], 1.0
            else:
                value, column = _knapsack(sizes, np.maximum(prices, 0), capacity)
                price = 1.0
                if value <= 1 + 1e-7 or use @ cost - (d @ prices) / value <= gap * (use @ cost):
                    break
        some = np.flatnonzero(column)
        step = inverse[:, some] @ column[some]
        ratio = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        pivot = inverse[out] / step[out]
        use = np.maximum(use - step * ratio[out], 0)
        use[out] = ratio[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
        basis[:, out], cost[out] = column, price
    return [(sizes, float(use[j]), basis[:, j]) for j in range(m) if cost[j] > 0 and use[j] > 0]


def plan(counts: dict[int, int], capacity: int, gap: float = GAP, pivots: int = PIVOTS) -> tuple[np.ndarray, int]:
    """Ranges of ranks and the number of sequences.

    A range is (first rank, first sequence, pieces of it in a sequence, first offset,
    length); ranks count all pieces in order of length, and a range lasts to the next.
    """
    demand = np.zeros(capacity + 1, dtype=np.int64)
    for w, n in counts.items():
        if not 0 < w <= capacity:
            raise ValueError(f"a piece of {w} ids doesn't fit a sequence of {capacity}")
        demand[w] = n
    left = demand.copy()
    left[capacity] = 0
    used: list[tuple[dict[int, int], int]] = [({capacity: 1}, int(demand[capacity]))]
    for sizes, use, column in solve(left, capacity, gap, pivots):
        some = np.flatnonzero(column)
        pattern = {int(sizes[i]): int(round(column[i])) for i in some}
        times = min(int(use + 1e-6), *(int(left[w]) // n for w, n in pattern.items()))
        for w, n in pattern.items():
            left[w] -= n * times
        used.append((pattern, times))
    used += _largest_first(left, capacity)
    base = np.concatenate([[0], np.cumsum(demand)])
    taken = base[:-1].copy()
    ranges, sequence = [], 0
    for pattern, times in used:
        if not times:
            continue
        offset = 0
        for w, n in sorted(pattern.items(), reverse=True):
            ranges.append((int(taken[w]), sequence, n, offset, w))
            taken[w] += n * times
            offset += n * w
        sequence += times
    return np.array(sorted(ranges), dtype=np.int64).reshape(-1, 5), sequence


def pack(pieces: DataFrame, capacity: int, key: str = "doc_id", gap: float = GAP, pivots: int = PIVOTS) -> DataFrame:
    """``pieces`` (``key``, start, length, anything else) with sequence_id and offset; columns
    of those names give way."""
    pieces = pieces.drop("sequence_id", "offset")
    rows, names = sealed(pieces)
    table = write_table(rows.withColumn("__piece", F.monotonically_increasing_id()), "pack-pieces")
    counts = {r["w"]: r["n"] for r in table.groupBy(F.col(names["length"]).alias("w")).agg(F.count(F.lit(1)).alias("n")).collect()}
    ranges, _ = plan(counts, capacity, gap, pivots)
    shared = table.sparkSession.sparkContext.broadcast(ranges)
    # only the columns that order the pieces are dealt by rank; the pieces themselves move once
    order = table.select("__piece", F.col(names["length"]).alias("__length"), F.col(names[key]).alias("__key"), F.col(names["start"]).alias("__start"))
    ranked = global_prefix(order, ["__length", "__key", "__start"], [], "pack-ranks")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, sequence, each, offset, width = shared.value.T
        for batch in batches:
            rank = batch.column(1).to_numpy()
            at = np.searchsorted(first, rank, side="right") - 1
            past = rank - first[at]
            columns = [batch.column(0), pa.array(sequence[at] + past // each[at]), pa.array(offset[at] + past % each[at] * width[at])]
            yield pa.RecordBatch.from_arrays(columns, names=["__of", "__sequence", "__offset"])

    places = ranked.select("__piece", "__index").mapInArrow(place, "__of long, __sequence long, __offset long")
    met = table.join(write_table(places, "pack-places"), F.col("__piece") == F.col("__of"))
    return met.select(*[F.col(n).alias(c) for c, n in names.items()], F.col("__sequence").alias("sequence_id"), F.col("__offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token pieces of ``docs`` with their ids, sequence and offset."""
    return pack(token_pieces(docs, tokenizer, capacity, key, text), capacity, key)
