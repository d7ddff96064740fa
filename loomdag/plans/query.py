"""A single-table query: validate, filter, order, offset, limit, project."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdag.functions.canonical import decimal_key, sort_key
from loomdag.functions.predicates import QueryError, check, lower

IDENTITY = ["rowId", "uuid", "rowAuthor"]
#: From this offset on a stretch of an order is looked for first; a task orders about as many rows.
DEEP = 50_000
SAMPLE = 5_000


def validate(query: dict, types: dict[str, str], coerce: bool = False, identity: bool = False) -> None:
    """Refuse unknown columns, unfit comparisons and bad limits before any plan is made.

    Only schema columns and ``rowAuthor`` may be filtered on, unless ``identity``.
    """
    known = types | {"rowAuthor": "string"} | ({"rowId": "string", "uuid": "string"} if identity else {})
    unknown = set(query) - {"where", "orderBy", "limit", "offset", "columns"}
    if unknown:
        raise QueryError(f"unknown parts: {sorted(unknown)}")
    if query.get("where") is not None:
        check(query["where"], known, coerce=coerce)
    for item in query.get("orderBy") or []:
        if item["column"] not in known:
            raise QueryError(f"unknown column {item['column']}")
        if item.get("direction", "asc") not in ("asc", "desc"):
            raise QueryError("a direction is asc or desc")
    for c in query.get("columns") or []:
        if c not in known:
            raise QueryError(f"unknown column {c}")
    for part in ("limit", "offset"):
        n: Any = query.get(part)
        if n is not None and (isinstance(n, bool) or not isinstance(n, int) or n < 0):
            raise QueryError(f"{part} is a whole number from 0")


def _before(names: list[str], down: list[bool], row: Any) -> Column:
    """Whether a row comes before ``row`` in the order of the keys, missing values last."""
    out = F.lit(False)
    for name, desc, value in reversed(list(zip(names, down, row))):
        c, v = F.col(name), F.lit(value)
        first = c.isNotNull() if value is None else F.coalesce(c > v if desc else c < v, F.lit(False))
        out = first | (c.eqNullSafe(v) & out)
    return out


def _stretch(rows: DataFrame, names: list[str], down: list[bool], offset: int, limit: int) -> tuple[DataFrame, int]:
    """A part of ``rows`` that has the stretch of an order from ``offset`` on, and how many
    rows of the order come before that part.

    A plain offset makes every task send all rows before the stretch to one. Here two
    rows of a sample stand around the stretch; the rows before each are counted, so a bad sample
    costs another round and never a row. Nothing is shuffled but counts.
    """
    order = [F.desc_nulls_last(n) if d else F.asc_nulls_last(n) for n, d in zip(names, down)]
    part, size, skipped, idle = rows, rows.count(), 0, 0
    while size > DEEP and idle < 2:
        first = offset - skipped
        drawn = part.filter(F.rand() < SAMPLE / size).select(*names).orderBy(*order).collect()
        margin = 2 * math.sqrt(len(drawn)) + 1
        i, j = math.floor(first / size * len(drawn) - margin), math.ceil((first + limit) / size * len(drawn) + margin)
        low = _before(names, down, drawn[i]) if 0 <= i < len(drawn) else F.lit(False)
        high = _before(names, down, drawn[j]) if 0 <= j < len(drawn) else F.lit(True)
        below, upto = part.agg(F.count_if(low), F.count_if(high)).first()
        if below > first:
            low, below = F.lit(False), 0
        if upto < first + limit:
            high, upto = F.lit(True), size
        idle = 0 if upto - below < size / 2 else idle + 1
        part, size, skipped = part.filter(~low & high), upto - below, skipped + below
    return part, skipped


def run(rows: DataFrame, types: dict[str, str], query: dict, coerce: bool = False, identity: bool = False) -> DataFrame:
    """``rows`` has rowId, uuid, rowAuthor and the schema's columns.

    One lazy plan: Catalyst pushes the filter and the columns to the scan and makes a
    top-k of order and limit. Before a stretch deep in the order (``DEEP``) that is of bounded
    length, jobs look for it. Missing values come last in both directions; rowId breaks
    ties and is the order where none is given.
    """
    validate(query, types, coerce, identity)
    known = types | {"rowAuthor": "string", "rowId": "string", "uuid": "string"}
    if query.get("where") is not None:
        rows = rows.filter(lower(query["where"], known))
    keys, down = [], []
    for item in query.get("orderBy") or []:
        c, kind = F.col(f"`{item['column']}`"), known[item["column"]]
        keys.append(sort_key(c) if kind == "bigint" else decimal_key(c) if kind == "decimal" else c)
        down.append(item.get("direction") == "desc")
    keys, down = [*keys, F.col("rowId")], [*down, False]
    offset, limit = query.get("offset") or 0, query.get("limit")
    if offset >= DEEP and limit is not None and limit <= DEEP:
        names = [f"__key_{i}" for i in range(len(keys))]
        rows, skipped = _stretch(rows.select("*", *[k.alias(n) for k, n in zip(keys, names)]), names, down, offset, limit)
        keys, offset = [F.col(n) for n in names], offset - skipped
    rows = rows.orderBy(*[k.desc_nulls_last() if d else k.asc_nulls_last() for k, d in zip(keys, down)])
    if offset:
        rows = rows.offset(offset)
    if limit is not None:
        rows = rows.limit(limit)
    columns = [c for c in (query.get("columns") or list(types)) if c not in IDENTITY]
    return rows.select(*IDENTITY, *columns)


def find_row_ids(rows: DataFrame, where: dict[str, Any]) -> DataFrame:
    """rowIds whose columns equal all of ``where`` (one at least), sorted."""
    if not where:
        raise QueryError("a search names one column at least")
    for c, v in where.items():
        rows = rows.filter(F.col(f"`{c}`") == F.lit(v))
    return rows.select("rowId").orderBy("rowId")
