"""Versioned schemas: slot resolution, validation, Spark types.

A schema is a log of rules. A version is resolved, never stored: every rule writes slots,
a slot's winner is the causal maximum, of concurrent ones the larger entry hash, within
one entry the later rule. A winning ``add-table`` resets its table: writes at or below it
don't count, nor do the base writes of an ``add-table`` that lost.

Rules: {"rule": "add-table", "table", "columns": {name: column}, "concurrentDeletes",
"fks", "restrictions", "idProvider"}, "drop-table", "add-column" (column, def),
"drop-column", "set-concurrent-deletes" (value), "set-fks" (fks), "set-restrictions"
(restrictions). A column: {"type", "nullable", "default", "pub", "readonly",
"maxLength", "min", "max", "scale", "precision"}.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from loomdag.functions import canonical as C
from loomdag.functions.localdag import LocalDag
from loomdag.functions.predicates import SPARK_TYPES, QueryError, check

#: Limits of names and counts, and the constraints each type takes.
LIMITS = {"name": 256, "tables": 1024, "columns": 1024, "fks": 256, "restrictions": 64, "rules": 1024, "uuid": 128, "bundle": 1024}
CONSTRAINTS = {
    "string": {"maxLength"}, "integer": {"min", "max"}, "float": set(), "boolean": set(), "json": set(),
    "bigint": {"min", "max"}, "decimal": {"scale", "precision", "min", "max"}, "bytes": {"maxLength"},
}


class SchemaError(QueryError):
    """A schema change that is refused."""


@dataclass
class Table:
    name: str
    columns: dict[str, dict] = field(default_factory=dict)
    incarnations: dict[str, str] = field(default_factory=dict)
    concurrent_deletes: bool = True
    fks: dict[str, str] = field(default_factory=dict)
    restrictions: list[dict] = field(default_factory=list)
    id_provider: dict | None = None

    def types(self) -> dict[str, str]:
        return {c: d["type"] for c, d in self.columns.items()}

    def pub(self) -> list[str]:
        return [c for c, d in self.columns.items() if d.get("pub")]

    def rules_for(self, action: str) -> list[dict]:
        """Matching rules AND together; without one, inserts are free and the rest is the author's."""
        found = [r["rule"] for r in self.restrictions if r["on"] in (action, "all")]
        if found:
            return found
        return [] if action == "insert" else [{"p": "own"}]

    def ddl(self) -> str:
        return ", ".join(f"`{c}` {SPARK_TYPES[d['type']]}" for c, d in self.columns.items())


Schema = dict[str, Table]


def _writes(h: str, i: int, rule: dict) -> list[tuple[tuple, Any, bool]]:
    """(slot, value, whether it belongs to an add-table's base)."""
    t, kind = rule["table"], rule["rule"]
    if kind == "add-table":
        out = [(("table", t), {"by": (h, i), "idProvider": rule.get("idProvider")}, False)]
        out += [(("col", t, c), d, True) for c, d in rule["columns"].items()]
        out += [(("cd", t), rule.get("concurrentDeletes", True), True), (("fks", t), rule.get("fks", {}), True)]
        return [*out, (("restrictions", t), rule.get("restrictions", []), True)]
    slot, value = {
        "drop-table": (("table", t), None),
        "add-column": (("col", t, rule.get("column")), rule.get("def")),
        "drop-column": (("col", t, rule.get("column")), None),
        "set-concurrent-deletes": (("cd", t), rule.get("value")),
        "set-fks": (("fks", t), rule.get("fks")),
        "set-restrictions": (("restrictions", t), rule.get("restrictions")),
    }[kind]
    return [(slot, value, False)]


def slots(rule: dict) -> list[tuple]:
    return [s for s, _, _ in _writes("", 0, rule)]


def resolve(dag: LocalDag, at: set[str] | list[str], rules: dict[str, list[dict]]) -> Schema:
    """The schema at version ``at``; ``rules`` by entry hash."""
    by: dict[tuple, list[tuple[str, int, Any, bool]]] = {}
    for h in dag.hist(at):
        for i, rule in enumerate(rules.get(h, [])):
            for slot, value, base in _writes(h, i, rule):
                by.setdefault(slot, []).append((h, i, value, base))

    def winner(writes: list[tuple[str, int, Any, bool]]) -> tuple[str, int, Any, bool] | None:
        top = dag.maxima({w[0] for w in writes})
        return max((w for w in writes if w[0] in top), key=lambda w: (w[0], w[1]), default=None)

    schema: Schema = {}
    for (kind, *key), writes in by.items():
        if kind != "table":
            continue
        won = winner(writes)
        if won is None or won[2] is None:
            continue
        name, (h, i) = key[0], won[2]["by"]

        def counts(w: tuple[str, int, Any, bool], h: str = h, i: int = i) -> bool:
            if w[3]:
                return (w[0], w[1]) == (h, i)
            return (w[0] == h and w[1] > i) or (w[0] != h and not dag.leq(w[0], h))

        table = Table(name, id_provider=won[2]["idProvider"])
        for slot, ws in by.items():
            if slot[0] == "table" or slot[1] != name:
                continue
            best = winner([w for w in ws if counts(w)])
            if best is None or best[2] is None:
                continue
            if slot[0] == "col":
                table.columns[slot[2]] = best[2]
                table.incarnations[slot[2]] = f"{best[0]}#{best[1]}"
            else:
                setattr(table, {"cd": "concurrent_deletes", "fks": "fks", "restrictions": "restrictions"}[slot[0]], best[2])
        schema[name] = table
    return schema


# -- validation ------------------------------------------------------------------


def check_value(column: dict, v: Any) -> str | None:
    """Why ``v`` is no value of the column; None where it is one."""
    kind = column["type"]
    if v is None:
        return "null is not stored"
    ok = {
        "string": lambda: isinstance(v, str),
        "integer": lambda: isinstance(v, int) and not isinstance(v, bool) and abs(v) <= C.SAFE,
        "float": lambda: isinstance(v, (int, float)) and not isinstance(v, bool) and v == v and abs(v) != float("inf"),
        "boolean": lambda: isinstance(v, bool),
        "json": lambda: True,
        "bigint": lambda: C.is_bigint(v),
        "decimal": lambda: C.is_decimal(v, column.get("scale", 0)),
        "bytes": lambda: C.is_base64(v),
    }[kind]()
    if not ok:
        return f"not a {kind}"
    if "maxLength" in column:
        size = len(v.encode("utf-16-le")) // 2 if kind == "string" else len(v) // 4 * 3 - v[-2:].count("=")
        if size > column["maxLength"]:
            return f"longer than {column['maxLength']}"
    from decimal import Decimal

    number = (lambda x: Decimal(str(x))) if kind in ("integer", "bigint", "decimal") else None
    if number and "min" in column and number(v) < number(column["min"]):
        return f"less than {column['min']}"
    if number and "max" in column and number(v) > number(column["max"]):
        return f"more than {column['max']}"
    return None


def check_column(name: str, column: dict) -> None:
    if not name or len(name) > LIMITS["name"] or name in ("rowId", "rowAuthor", "uuid"):
        raise SchemaError(f"{name!r} can't name a column")
    if column.get("type") not in CONSTRAINTS:
        raise SchemaError(f"{name}: unknown type {column.get('type')}")
    extra = set(column) - {"type", "nullable", "default", "pub", "readonly"} - CONSTRAINTS[column["type"]]
    if extra:
        raise SchemaError(f"{name}: {column['type']} doesn't take {sorted(extra)}")
    if column["type"] == "decimal" and not isinstance(column.get("scale"), int):
        raise SchemaError(f"{name}: a decimal needs a scale")
    if "default" in column and (why := check_value(column, column["default"])):
        raise SchemaError(f"{name}: default {why}")


def check_table(name: str, table: Table, schema: Schema) -> None:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name) or len(name) > LIMITS["name"]:
        raise SchemaError(f"{name!r} can't name a table")
    if not table.columns or len(table.columns) > LIMITS["columns"]:
        raise SchemaError(f"{name}: a table has 1 to {LIMITS['columns']} columns")
    if len(table.fks) > LIMITS["fks"] or len(table.restrictions) > LIMITS["restrictions"]:
        raise SchemaError(f"{name}: too many references or rules")
    for c, d in table.columns.items():
        check_column(c, d)
    for c, target in table.fks.items():
        if c not in table.columns:
            raise SchemaError(f"{name}: reference by unknown column {c}")
        if "." not in target and target not in schema:
            raise SchemaError(f"{name}.{c}: unknown table {target}")
    for r in table.restrictions:
        if r["on"] not in ("insert", "update", "delete", "all"):
            raise SchemaError(f"{name}: rule on {r['on']}")
        readonly = {c: d["type"] for c, d in table.columns.items() if d.get("readonly")} | {"rowAuthor": "string"}
        check(r["rule"], readonly, rule=True)
        for atom in exists_atoms(r["rule"]):
            target = schema.get(atom["table"])
            if "." in atom["table"]:
                continue
            if target is None:
                raise SchemaError(f"{name}: rule on unknown table {atom['table']}")
            for c, term in atom["where"].items():
                if c != "rowAuthor" and not target.columns.get(c, {}).get("pub"):
                    raise SchemaError(f"{name}: rule searches {atom['table']}.{c}, which is not PUB")
                if isinstance(term, str) and term.startswith("$row.") and not table.columns.get(term[5:], {}).get("readonly") and term[5:] != "rowAuthor":
                    raise SchemaError(f"{name}: {term} is not READONLY")


def exists_atoms(p: dict) -> list[dict]:
    if p["p"] == "exists":
        return [p]
    return [a for x in p.get("args", []) + ([p["arg"]] if "arg" in p else []) for a in exists_atoms(x)]


def columns_of(p: Any) -> set[str]:
    """The subject's columns that a rule names."""
    if isinstance(p, str):
        return {p[5:]} if p.startswith("$row.") else set()
    if isinstance(p, list):
        return set().union(*map(columns_of, p))
    if not isinstance(p, dict) or "lit" in p:
        return set()
    own = {p["col"]} if isinstance(p.get("col"), str) else set()
    return own.union(*(columns_of(v) for k, v in p.items() if k != "col" and not isinstance(v, str)), *(columns_of(v) for v in p.values() if isinstance(v, str) and v.startswith("$row.")))


def apply(schema: Schema, rules: list[dict]) -> Schema:
    """``schema`` after ``rules``, one after another; the first that can't be applied is refused."""
    if len(rules) > LIMITS["rules"]:
        raise SchemaError("too many rules")
    import copy

    now = copy.deepcopy(schema)
    for rule in rules:
        kind, t = rule["rule"], rule["table"]
        if kind == "add-table":
            if t in now:
                raise SchemaError(f"table {t} exists")
            if len(now) >= LIMITS["tables"]:
                raise SchemaError("too many tables")
            now[t] = Table(
                t, dict(rule["columns"]), {}, rule.get("concurrentDeletes", True), dict(rule.get("fks", {})), list(rule.get("restrictions", [])), rule.get("idProvider")
            )
            continue
        if t not in now:
            raise SchemaError(f"unknown table {t}")
        table = now[t]
        if kind == "drop-table":
            for other in now.values():
                if other.name != t and (t in other.fks.values() or any(a["table"] == t for r in other.restrictions for a in exists_atoms(r["rule"]))):
                    raise SchemaError(f"{other.name} refers to {t}")
            del now[t]
        elif kind == "add-column":
            if rule["column"] in table.columns:
                raise SchemaError(f"column {t}.{rule['column']} exists")
            table.columns[rule["column"]] = rule["def"]
        elif kind == "drop-column":
            c = rule["column"]
            if c not in table.columns:
                raise SchemaError(f"unknown column {t}.{c}")
            if len(table.columns) == 1:
                raise SchemaError(f"{t} keeps one column at least")
            used = c in table.fks or any(c in columns_of(r["rule"]) for r in table.restrictions)
            used |= any(a["table"] == t and c in a["where"] for o in now.values() for r in o.restrictions for a in exists_atoms(r["rule"]))
            if used:
                raise SchemaError(f"{t}.{c} is in use")
            del table.columns[c]
        elif kind == "set-concurrent-deletes":
            table.concurrent_deletes = bool(rule["value"])
        elif kind == "set-fks":
            table.fks = dict(rule["fks"])
        elif kind == "set-restrictions":
            table.restrictions = list(rule["restrictions"])
        else:
            raise SchemaError(f"unknown rule {kind}")
    for name, table in now.items():
        check_table(name, table, now)
    return now


def check_write(table: Table, action: str, values: dict[str, Any]) -> None:
    """Refuse values that the table doesn't take."""
    if action == "delete":
        return
    if action == "update" and not values:
        raise QueryError("an update writes one column at least")
    for c, v in values.items():
        if c not in table.columns:
            raise QueryError(f"unknown column {table.name}.{c}")
        if action == "update" and table.columns[c].get("readonly"):
            raise QueryError(f"{table.name}.{c} is READONLY")
        if why := check_value(table.columns[c], v):
            raise QueryError(f"{table.name}.{c}: {why}")
    if action == "insert":
        for c, d in table.columns.items():
            if c not in values and "default" not in d and not d.get("nullable"):
                raise QueryError(f"{table.name}.{c} needs a value")


def delta(start: Schema, end: Schema) -> list[dict]:
    """What changed, table by table."""
    out = []
    for name in sorted(start.keys() | end.keys()):
        a, b = start.get(name), end.get(name)
        change: dict[str, Any] = {"table": name}
        if a is None or b is None:
            change["change"] = "added" if a is None else "dropped"
            out.append(change)
            continue
        cols = {c: (a.columns.get(c), b.columns.get(c)) for c in a.columns.keys() | b.columns.keys()}
        moved = {c: v for c, v in cols.items() if v[0] != v[1] or a.incarnations.get(c) != b.incarnations.get(c)}
        if moved:
            change["columns"] = dict(sorted(moved.items()))
        for part in ("concurrent_deletes", "fks", "restrictions"):
            if getattr(a, part) != getattr(b, part):
                change[part] = (getattr(a, part), getattr(b, part))
        if len(change) > 1:
            out.append(change | {"change": "altered"})
    return out
