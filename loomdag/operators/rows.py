"""Rows of a table at a version pair (at, from): liveness, last-writer-wins, assembly.

``ops`` is one row per operation, with its entry's chain index:
dag_id, hash, topo, chain, idx, vc, table, row_id, uuid, author, action
(insert, update, delete), values map<string,string>. A key of ``values`` is a column's name,
or name and incarnation as ``cell_key`` joins them: a column that was dropped and added
again starts anew, as its old writes have another key.

``void`` names operations' entries that don't count (dag_id, hash); it leaves base
liveness alone and is removed first everywhere else, so that the winner of a column is
the maximum of what remains. Positions are (dag_id, pos_id, hash).
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdag.functions.predicates import SPARK_TYPES
from loomdag.operators.causal import concurrent, history, maxima

ROW = ["dag_id", "pos_id", "row_id"]
#: Stands between a column's name and its incarnation.
MARK = "\x1f"


def cell_key(column: str, incarnation: str | None) -> str:
    return column if incarnation is None else f"{column}{MARK}{incarnation}"


def without(ops: DataFrame, void: DataFrame | None) -> DataFrame:
    """A position may itself be void, so this comes after its history is taken."""
    return ops if void is None else ops.join(void.select("dag_id", "hash"), ["dag_id", "hash"], "left_anti")


def killed_concurrently(ops: DataFrame, at: DataFrame, later: DataFrame, void: DataFrame | None = None, barrier: Column | None = None) -> DataFrame:
    """dag_id, pos_id, row_id of rows that a delete concurrent with ``at`` removes; with
    ``barrier``, only deletes for which it holds do."""
    deletes = concurrent(ops, later, at).filter("action = 'delete'")
    return without(deletes if barrier is None else deletes.filter(barrier), void).select(*ROW).distinct()


def live_rows(
    ops: DataFrame, at: DataFrame, later: DataFrame | None = None, void: DataFrame | None = None, concurrent_deletes: bool | Column = True, base: bool = False
) -> DataFrame:
    """dag_id, pos_id, row_id, uuid, author of live rows.

    The insert of the larger hash wins. Any delete in the history removes the row for
    good; with ``base``, even a void one. With ``later``, deletes concurrent with ``at``
    remove it too where the table says so: for all of them, or by a Column that is asked
    at each delete.
    """
    void = None if base else void
    seen = without(history(ops, at), void)
    alive = (
        seen.groupBy(*ROW)
        .agg(
            F.max_by(F.when(F.col("action") == "insert", F.struct("uuid", "author")), F.when(F.col("action") == "insert", F.col("hash"))).alias("__won"),
            F.bool_or(F.col("action") == "delete").alias("__gone"),
        )
        .filter("__won is not null and not __gone")
    )
    if later is not None and concurrent_deletes is not False:
        barrier = concurrent_deletes if isinstance(concurrent_deletes, Column) else None
        alive = alive.join(killed_concurrently(ops, at, later, void, barrier), ROW, "left_anti")
    return alive.select(*ROW, F.col("__won.uuid").alias("uuid"), F.col("__won.author").alias("author"))


def column_writes(ops: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per written column, pruned to ``columns`` before anything is compared."""
    out = ops.filter("action != 'delete'").select("dag_id", "pos_id", "hash", "chain", "idx", "vc", "row_id", F.explode("values").alias("column", "value"))
    return out if columns is None else out.filter(F.col("column").isin(columns))


def winning_values(ops: DataFrame, at: DataFrame, void: DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
    """dag_id, pos_id, row_id, column, value, hash: of the maximal writes the larger hash."""
    writes = column_writes(without(history(ops, at), void), columns)
    tops = maxima(writes, [*ROW, "column"], ["value"])
    best = F.array_max(F.transform("tops", lambda t: F.struct(t["hash"].alias("hash"), t["value"].alias("value"))))
    return tops.select(*ROW, "column", best.alias("b")).select(*ROW, "column", F.col("b.value").alias("value"), F.col("b.hash").alias("hash"))


def table_view(
    ops: DataFrame, columns: dict[str, dict[str, Any]], at: DataFrame, later: DataFrame | None = None, void: DataFrame | None = None,
    concurrent_deletes: bool | Column = True, wanted: list[str] | None = None,
) -> DataFrame:
    """dag_id, pos_id, rowId, uuid, rowAuthor and the columns: written value, else
    default, else missing. A column may name its ``incarnation``."""
    names = [c for c in columns if wanted is None or c in wanted]
    keys = {c: cell_key(c, columns[c].get("incarnation")) for c in names}
    live = live_rows(ops, at, later, void, concurrent_deletes)
    cells = winning_values(ops, at, void, list(keys.values()))
    cells = cells.groupBy(*ROW).agg(*[F.max(F.when(F.col("column") == k, F.col("value"))).alias(f"__v_{c}") for c, k in keys.items()] or [F.lit(1).alias("__v")])
    typed = []
    for c in names:
        default, kind = columns[c].get("default"), SPARK_TYPES[columns[c]["type"]]
        value = F.col(f"__v_{c}").cast(kind)
        typed.append((value if default is None else F.coalesce(value, F.lit(default).cast(kind))).alias(c))
    return live.join(cells, ROW, "left").select("dag_id", "pos_id", F.col("row_id").alias("rowId"), "uuid", F.col("author").alias("rowAuthor"), *typed)


def row_delta(ops: DataFrame, start: DataFrame, end: DataFrame, later: DataFrame | None = None, void_start: DataFrame | None = None, void_end: DataFrame | None = None, cells_start: list[str] | None = None, cells_end: list[str] | None = None) -> DataFrame:
    """Rows whose liveness turns or whose written values move between two positions.

    dag_id, pos_id, row_id, was_live, is_live, changes array<struct<column, before,
    after>>. Defaults don't count; a row that is dead afterwards has no changes.
    ``cells_start`` and ``cells_end`` name the cell keys that either schema knows.
    """
    sides = []
    for position, void, known, side in ((start, void_start, cells_start, "a"), (end, void_end, cells_end, "b")):
        live = live_rows(ops, position, later if side == "b" else None, void)
        cell = F.struct(F.substring_index("column", MARK, 1).alias("column"), "value")
        cells = winning_values(ops, position, void, known).groupBy(*ROW).agg(F.map_from_entries(F.collect_list(cell)).alias("v"))
        sides.append(live.join(cells, ROW, "left").select(*ROW, F.lit(True).alias(f"live_{side}"), F.coalesce("v", F.create_map().cast("map<string,string>")).alias(f"v_{side}")))
    both = sides[0].join(sides[1], ROW, "full_outer")
    was, now = (F.coalesce(f"live_{s}", F.lit(False)) for s in "ab")
    empty = F.create_map().cast("map<string,string>")
    va, vb = F.coalesce("v_a", empty), F.coalesce("v_b", empty)
    names = F.array_sort(F.array_union(F.map_keys(va), F.map_keys(vb)))
    moved = F.filter(names, lambda c: ~va[c].eqNullSafe(vb[c]))
    changes = F.transform(moved, lambda c: F.struct(c.alias("column"), va[c].alias("before"), vb[c].alias("after")))
    none = F.array().cast("array<struct<column:string,before:string,after:string>>")
    out = both.select(*ROW, was.alias("was_live"), now.alias("is_live"), F.when(now, changes).otherwise(none).alias("changes"))
    return out.filter("was_live != is_live or size(changes) > 0")
