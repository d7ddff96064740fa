"""Row filters and rule predicates: type check, lowering to Columns, text form.

The tree is plain data:

    {"p": "true"} {"p": "false"} {"p": "not", "arg": x} {"p": "and"|"or", "args": [...]}
    {"p": "cmp", "op": "eq|ne|lt|le|gt|ge", "left": o, "right": o}
    {"p": "str", "op": "prefix|suffix|contains", "left": o, "right": o}
    {"p": "exists", "table": "name" | "group.name", "where": {column: term}}
    operands: {"lit": v} {"col": name} {"len": o} {"op": "add|sub|mul", "args": [o, o]}
    terms: {"lit": v} "$author" "$row.<column>"

Logic has two values: an atom with a missing operand is false, and its negation true.
"""

from __future__ import annotations

from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomdag.functions.canonical import SAFE, decimal_key, sort_key

NUMERIC = ("integer", "float", "bigint", "decimal")
SPARK_TYPES = {"string": "string", "integer": "bigint", "float": "double", "boolean": "boolean", "json": "string", "bigint": "string", "decimal": "string", "bytes": "string"}
MOST_DEPTH, MOST_ARGS, MOST_WHERE = 16, 64, 64


class QueryError(ValueError):
    """A query or rule that is refused before it is planned."""


def literal_type(v: Any) -> str:
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "integer" if float(v).is_integer() else "float"
    if isinstance(v, str):
        return "string"
    return "json"


def operand_type(o: dict, types: dict[str, str], hint: str | None = None) -> str:
    """The type of an operand; a literal takes the other side's type where it fits."""
    if isinstance(o, str):  # $author, $row.<column>
        return "string" if o == "$author" else operand_type({"col": o.removeprefix("$row.")}, types)
    if "col" in o:
        if o["col"] not in types:
            raise QueryError(f"unknown column {o['col']}")
        return types[o["col"]]
    if "lit" in o:
        own = literal_type(o["lit"])
        return hint if own == "string" and hint in ("bigint", "decimal", "bytes") else own
    if "len" in o:
        if operand_type(o["len"], types) != "string":
            raise QueryError("len takes a string")
        return "integer"
    if o.get("op") in ("add", "sub", "mul"):
        a, b = o["args"]
        hinted = operand_type(b, types) if "lit" in a else hint
        left = operand_type(a, types, hinted)
        right = operand_type(b, types, left)
        if left != right or left not in ("integer", "bigint", "decimal"):
            raise QueryError(f"{o['op']} takes two integers, bigints or decimals")
        return left
    raise QueryError(f"not an operand: {o}")


def check(p: dict, types: dict[str, str], rule: bool = False, coerce: bool = False, depth: int = 0) -> None:
    """Refuse what can't be evaluated; ``coerce`` lets numeric families mix."""
    if depth > MOST_DEPTH:
        raise QueryError(f"deeper than {MOST_DEPTH}")
    kind = p.get("p")
    if kind in ("true", "false"):
        return
    if kind == "not":
        if rule:
            raise QueryError("rules have no NOT")
        check(p["arg"], types, rule, coerce, depth + 1)
    elif kind in ("and", "or"):
        if not 1 <= len(p["args"]) <= MOST_ARGS:
            raise QueryError(f"{kind} takes 1 to {MOST_ARGS} arguments")
        for x in p["args"]:
            check(x, types, rule, coerce, depth + 1)
    elif kind in ("cmp", "str"):
        left, right = p["left"], p["right"]
        hint = operand_type(right, types) if isinstance(left, dict) and "lit" in left else None
        a = operand_type(left, types, hint)
        b = operand_type(right, types, a)
        if coerce and a in NUMERIC and b in NUMERIC:
            return
        if a != b:
            raise QueryError(f"{a} is compared with {b}")
        if kind == "str" and a != "string":
            raise QueryError(f"{p['op']} takes strings")
        if a == "json" or p["op"] in ("lt", "le", "gt", "ge") and a in ("boolean", "bytes"):
            raise QueryError(f"{a} has no {p['op']}")
    elif kind == "exists":
        if not rule:
            raise QueryError("EXISTS is for rules")
        if not 1 <= len(p["where"]) <= MOST_WHERE:
            raise QueryError(f"EXISTS takes 1 to {MOST_WHERE} conditions")
    else:
        raise QueryError(f"unknown predicate {kind}")


# -- lowering ------------------------------------------------------------------


def operand(o: dict | str, types: dict[str, str], exact_utf16: bool = False) -> Column:
    if isinstance(o, str):
        return F.col("author") if o == "$author" else F.col(f"`{o.removeprefix('$row.')}`")
    if "col" in o:
        return F.col(f"`{o['col']}`")
    if "lit" in o:
        return F.lit(o["lit"])
    if "len" in o:
        text = operand(o["len"], types)
        return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("bigint") if exact_utf16 else F.length(text).cast("bigint")
    kind = operand_type(o, types)
    a, b = (operand(x, types, exact_utf16) for x in o["args"])
    name = o["op"]
    if kind == "integer":
        out = {"add": F.try_add, "sub": F.try_subtract, "mul": F.try_multiply}[name](a.cast("bigint"), b.cast("bigint"))
        return F.when(F.abs(out) <= SAFE, out)
    scale = 0 if kind == "bigint" else 18
    wide = f"decimal(38,{scale})"
    x, y = a.try_cast(wide), b.try_cast(wide)
    out = {"add": F.try_add, "sub": F.try_subtract, "mul": F.try_multiply}[name](x, y)
    return out.cast("string") if kind == "bigint" else F.regexp_replace(out.cast("string"), r"(\.[0-9]*?)0+$", "$1")


def lower(p: dict, types: dict[str, str], exists: Any = None, exact_utf16: bool = False) -> Column:
    """A Column that is never null. ``exists`` lowers an EXISTS atom (rules only)."""
    kind = p["p"]
    if kind in ("true", "false"):
        return F.lit(kind == "true")
    if kind == "not":
        return ~lower(p["arg"], types, exists, exact_utf16)
    if kind in ("and", "or"):
        parts = [lower(x, types, exists, exact_utf16) for x in p["args"]]
        out = parts[0]
        for x in parts[1:]:
            out = out & x if kind == "and" else out | x
        return out
    if kind == "exists":
        return F.coalesce(exists(p), F.lit(False))
    a, b = operand(p["left"], types, exact_utf16), operand(p["right"], types, exact_utf16)
    op = p["op"]
    if kind == "str":
        atom = {"prefix": a.startswith, "suffix": a.endswith, "contains": a.contains}[op](b)
        return F.coalesce(atom, F.lit(False))
    family = operand_type(p["left"], types, operand_type(p["right"], types))
    if op in ("lt", "le", "gt", "ge"):
        if family in ("bigint", "decimal"):
            a, b = (sort_key(x) if family == "bigint" else decimal_key(x) for x in (a, b))
        elif family == "string" and exact_utf16:
            a, b = F.encode(a, "UTF-16BE"), F.encode(b, "UTF-16BE")
    atom = {"eq": a == b, "ne": a != b, "lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b}[op]
    return F.coalesce(atom, F.lit(False))


def like(column: str, pattern: str) -> dict:
    """LIKE knows a % at either end only; all else is literal, and no % means equality."""
    left, value = {"col": column}, pattern
    start, end = pattern.startswith("%"), pattern.endswith("%") and len(pattern) > 1
    if start and end:
        return {"p": "str", "op": "contains", "left": left, "right": {"lit": value[1:-1]}}
    if start:
        return {"p": "str", "op": "suffix", "left": left, "right": {"lit": value[1:]}}
    if end:
        return {"p": "str", "op": "prefix", "left": left, "right": {"lit": value[:-1]}}
    return {"p": "cmp", "op": "eq", "left": left, "right": {"lit": value}}


# -- text ----------------------------------------------------------------------

SIGNS = {"eq": "=", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}


def value_text(v: Any) -> str:
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if v is None:
        return "NULL"
    if isinstance(v, float):
        # the shortest text that reads back as the same number, without an exponent
        return format(Decimal(repr(v)), "f") if not v.is_integer() else f"{int(v)}.0"
    if isinstance(v, (dict, list)):
        return json_text(v)
    return str(v)


def json_text(v: Any) -> str:
    """A JSON literal of the statement language."""
    if isinstance(v, dict):
        return "{" + ", ".join(f"{value_text(k)}: {json_text(x)}" for k, x in v.items()) + "}"
    if isinstance(v, list):
        return "[" + ", ".join(map(json_text, v)) + "]"
    return value_text(v)


def _operand_text(o: Any) -> str:
    if isinstance(o, str):
        return o
    if "col" in o:
        return o["col"]
    if "lit" in o:
        return value_text(o["lit"])
    if "len" in o:
        return f"len({_operand_text(o['len'])})"
    return "(" + f" {dict(add='+', sub='-', mul='*')[o['op']]} ".join(_operand_text(x) for x in o["args"]) + ")"


def text(p: dict, outer: str = "") -> str:
    """The predicate in the statement language."""
    kind = p["p"]
    if kind in ("true", "false"):
        return kind.upper()
    if kind == "not":
        return f"NOT ({text(p['arg'])})"
    if kind in ("and", "or"):
        body = f" {kind.upper()} ".join(text(x, kind) for x in p["args"])
        return f"({body})" if outer and outer != kind else body
    if kind == "exists":
        where = " AND ".join(f"{c} = {_operand_text(t)}" for c, t in p["where"].items())
        return f"EXISTS {p['table']} WHERE {where}"
    if kind == "str":
        v = p["right"]["lit"]
        shown = {"prefix": v + "%", "suffix": "%" + v, "contains": "%" + v + "%"}[p["op"]]
        return f"{_operand_text(p['left'])} LIKE {value_text(shown)}"
    return f"{_operand_text(p['left'])} {SIGNS[p['op']]} {_operand_text(p['right'])}"
