"""Which operations don't count, and why.

An operation is judged at its own entry, seen from ``later``: its table's rules, then its
references. It reads other operations only where they count themselves, so verdicts
depend on each other; an entry that is met while it is being judged counts as void. The
definition is by recursion and is evaluated as such, one log per task. A verdict is
remembered for other verdicts only if no such meeting happened anywhere below it, so
that none depends on who was asked first; a verdict inside a cycle is found anew for
everyone who asks.

Entries: dag_id, hash, prev, payload - JSON {"kind": "create"|"ops"|"deploy", "ops": [{table,
rowId, uuid, author, action, values}], "schema": n}. ``deploy`` moves the group to
schema ``n``; one that is concurrent counts from ``later``.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdag.functions.localdag import LocalDag
from loomdag.operators.causal import arrow_rows, clustered, lists, spans, whole_logs
from loomdag.plans.schema import Schema, Table


class Group:
    """One log's operations, for exact evaluation."""

    def __init__(self, entries: list[tuple[str, list[str], dict]], schemas: list[Schema], foreign: Any = None) -> None:
        self.dag = LocalDag((h, p) for h, p, _ in entries)
        self.load = {h: x for h, _, x in entries if h in self.dag.at}
        self.schemas = schemas
        self.foreign = foreign
        self.stack: list[str] = []
        self.meetings = 0
        self.known: dict[tuple[str, tuple[str, ...]], dict | None] = {}
        #: verdicts that were asked for from outside: those of a cycle serve no other verdict
        self.asked: dict[tuple[str, tuple[str, ...]], dict | None] = {}
        self.by_row: dict[str, list[tuple[str, int, dict]]] = {}
        #: what decides whether a row lives: its inserts and its deletes, in the log's order
        self.inserts: dict[tuple[str, str], list[tuple[str, dict]]] = {}
        self.deletes: dict[tuple[str, str], list[str]] = {}
        self.by_table: dict[str, set[str]] = {}
        self.by_value: dict[tuple[str, str, Any], set[str]] = {}
        self.deploys = [(h, x["schema"]) for h, x in self.load.items() if x["kind"] in ("create", "deploy")]
        for h in self.dag.ordered(self.load):
            for i, op in enumerate(self.load[h].get("ops", [])):
                self.by_row.setdefault(op["rowId"], []).append((h, i, op))
                if op["action"] == "insert":
                    self.inserts.setdefault((op["table"], op["rowId"]), []).append((h, op))
                elif op["action"] == "delete":
                    self.deletes.setdefault((op["table"], op["rowId"]), []).append(h)
                self.by_table.setdefault(op["table"], set()).add(op["rowId"])
                for c, v in op.get("values", {}).items():
                    if not isinstance(v, (dict, list)):
                        self.by_value.setdefault((op["table"], c, v), set()).add(op["rowId"])

    # -- versions

    def _sees(self, at: list[str], h: str) -> bool:
        """Whether ``h`` is in the history of ``at``. Asked entry by entry: a set for every
        position that is judged would be quadratic in the log."""
        _, chain, idx, _ = self.dag.at[h]
        for p in at:
            vc = self.dag.at[p][3]
            if chain < len(vc) and vc[chain] >= idx:
                return True
        return False

    def _beside(self, later: Sequence[str], at: list[str], h: str) -> bool:
        """Whether ``h`` is concurrent with ``at`` as seen from ``later``."""
        return not self._sees(at, h) and self._sees(later, h) and not any(self.dag.leq(p, h) for p in at)

    def schema(self, at: list[str], later: Sequence[str]) -> Schema:
        """The largest schema deployed at or before ``at``, or concurrently as seen from ``later``."""
        if len(self.schemas) == 1:
            return self.schemas[0]
        return self.schemas[max([n for h, n in self.deploys if self._sees(at, h) or self._beside(later, at, h)], default=0)]

    # -- verdicts

    def void(self, entry: str, later: Sequence[str]) -> dict | None:
        """The reason that ``entry`` is void, None where it counts."""
        key = (entry, later if isinstance(later, tuple) else tuple(sorted(later)))
        if key in self.known:
            return self.known[key]
        if not self.stack and key in self.asked:
            return self.asked[key]
        if entry in self.stack:
            # an entry that sees itself meets no one else: that is so whoever asks
            self.meetings += entry != self.stack[-1]
            return {"kind": "authorization-cycle"}
        before = self.meetings
        self.stack.append(entry)
        try:
            reason = self._diagnose(entry, later)
        finally:
            self.stack.pop()
        if self.meetings == before:
            self.known[key] = reason
        elif not self.stack:
            self.asked[key] = reason
        return reason

    def _diagnose(self, entry: str, later: Sequence[str]) -> dict | None:
        load = self.load[entry]
        if load["kind"] != "ops":
            return None
        ops = load["ops"]
        schema = self.schema([entry], later)
        for i, op in enumerate(ops):
            reason = self._rule(entry, op, schema, later) or self._reach(entry, op, ops, schema, later)
            if reason:
                return reason if len(ops) == 1 else {"kind": "bundle", "index": i, "of": reason}
        return None

    def _rule(self, entry: str, op: dict, schema: Schema, later: Sequence[str]) -> dict | None:
        table = schema.get(op["table"])
        if table is None:
            return {"kind": "restriction", "table": op["table"]}
        rules = table.rules_for(op["action"])
        subject = self._subject(entry, op, table, later, any(map(_asks_values, rules)))
        if all(self._holds(r, op, subject, [entry], later) for r in rules):
            return None
        if op["action"] != "insert" and not self.live(op["table"], op["rowId"], [entry], later, bypass=entry):
            return {"kind": "row-not-live", "table": op["table"], "rowId": op["rowId"]}
        return {"kind": "restriction", "table": op["table"], "action": op["action"]}

    def _subject(self, entry: str, op: dict, table: Table, later: Sequence[str], valued: bool) -> dict:
        """The row that an operation is judged by; its values only where a rule asks for them."""
        defaults = {c: d["default"] for c, d in table.columns.items() if "default" in d}
        if op["action"] == "insert":
            return defaults | op.get("values", {}) | {"rowAuthor": op.get("author")}
        found = self.insert(op["table"], op["rowId"], [entry], later)
        if not found:
            return {}
        held = self.values(op["table"], op["rowId"], [entry], later) if valued else {}
        return defaults | held | op.get("values", {}) | {"rowAuthor": found.get("author")}

    def _holds(self, p: dict, op: dict, subject: dict, at: list[str], later: Sequence[str]) -> bool:
        kind = p["p"]
        if kind == "own":
            return op.get("author") is not None and subject.get("rowAuthor") == op["author"]
        if kind in ("true", "false"):
            return kind == "true"
        if kind in ("and", "or"):
            return (all if kind == "and" else any)(self._holds(x, op, subject, at, later) for x in p["args"])
        term = lambda t: op.get("author") if t == "$author" else subject.get(t[5:]) if isinstance(t, str) else t["lit"] if "lit" in t else subject.get(t["col"])
        if kind == "exists":
            where = {c: term(t) for c, t in p["where"].items()}
            return None not in where.values() and self.exists(p["table"], where, at, later)
        side = lambda o: term(o) if isinstance(o, str) else _value(o, subject, op)
        a, b = side(p["left"]), side(p["right"])
        if a is None or b is None:
            return False
        if kind == "str":
            return {"prefix": a.startswith, "suffix": a.endswith, "contains": a.__contains__}[p["op"]](b)
        if p["op"] in ("eq", "ne"):
            return (a == b) == (p["op"] == "eq")
        try:
            return {"lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b}[p["op"]]
        except TypeError:
            return False

    def _reach(self, entry: str, op: dict, siblings: list[dict], schema: Schema, later: Sequence[str]) -> dict | None:
        if op["action"] == "delete":
            return None
        table = schema[op["table"]]
        written = dict(op.get("values", {}))
        if op["action"] == "insert":
            written = {c: d["default"] for c, d in table.columns.items() if "default" in d} | written
        for c, target in table.fks.items():
            v = written.get(c)
            if v is None:
                continue
            if not isinstance(v, str):
                return {"kind": "fk", "column": c, "target": target}
            own = [s["action"] for s in siblings if s["rowId"] == v and s["table"] == target]
            if "delete" in own or ("insert" not in own and not self.reaches(target, v, [entry], later)):
                return {"kind": "fk", "column": c, "target": target, "rowId": v}
        return None

    # -- rows, as far as verdicts need them

    def insert(self, table: str, row: str, at: list[str], later: Sequence[str], bypass: str | None = None) -> dict | None:
        """The winning insert of a live row. Only inserts and deletes decide, so no verdict on
        an update is asked for; and each delete only until one counts."""
        inserts, deletes = self.inserts.get((table, row), []), self.deletes.get((table, row), [])
        seen = [x for x in inserts if x[0] != bypass and self._sees(at, x[0])]
        if not seen:
            return None
        for h in deletes:
            if h != bypass and self._sees(at, h) and self.void(h, later) is None:
                return None
        won = {h: op for h, op in seen if self.void(h, later) is None}
        if not won:
            return None
        one = self.schemas[0].get(table) if len(self.schemas) == 1 else None
        for h in () if one and not one.concurrent_deletes else dict.fromkeys(deletes):
            holder = self.schema([h], later).get(table)
            if holder and holder.concurrent_deletes and self._beside(later, at, h) and self.void(h, later) is None:
                return None
        return won[max(won)]

    def live(self, table: str, row: str, at: list[str], later: Sequence[str], bypass: str | None = None) -> bool:
        return self.insert(table, row, at, later, bypass) is not None

    def values(self, table: str, row: str, at: list[str], later: Sequence[str]) -> dict:
        by: dict[str, dict[str, Any]] = {}
        now = self.schema(at, later).get(table)
        for h, _, op in self.by_row.get(row, []):
            if op["table"] != table or op["action"] == "delete" or not self._sees(at, h) or self.void(h, later) is not None:
                continue
            then = self.schema([h], [h]).get(table)
            for c, v in op.get("values", {}).items():
                # a column that was added anew since has none of its old writes
                if not (now and then) or now.incarnations.get(c) == then.incarnations.get(c):
                    by.setdefault(c, {})[h] = v
        return {c: ws[max(self.dag.maxima(ws))] for c, ws in by.items()}

    def reaches(self, table: str, row: str, at: list[str], later: Sequence[str]) -> bool:
        if "." in table:
            return bool(self.foreign and self.foreign(table, {"rowId": row}, at, later))
        return self.live(table, row, at, later)

    def exists(self, table: str, where: dict, at: list[str], later: Sequence[str]) -> bool:
        if "." in table:
            return bool(self.foreign and self.foreign(table, where, at, later))
        # candidates come from written values; a default alone doesn't make one
        if "rowAuthor" in where or any(isinstance(v, (dict, list)) for v in where.values()):
            candidates = self.by_table.get(table, set())
        else:
            candidates = set().union(*(self.by_value.get((table, c, v), set()) for c, v in where.items()))
        for row in sorted(candidates):
            found = self.insert(table, row, at, later)
            if found is None:
                continue
            held = self.values(table, row, at, later) | {"rowAuthor": found.get("author")}
            if all(held.get(c) == v for c, v in where.items()):
                return True
        return False

    def verdicts(self, later: Sequence[str] | None = None) -> dict[str, dict | None]:
        later = tuple(sorted(later or self.dag.frontier()))
        return {h: self.void(h, later) for h in self.dag.ordered(self.dag.hist(later))}


def _asks_values(p: dict) -> bool:
    """Whether a rule may read the subject's columns; ``own`` needs only its author."""
    if p["p"] in ("and", "or"):
        return any(map(_asks_values, p["args"]))
    return p["p"] not in ("own", "true", "false")


def _value(o: dict, subject: dict, op: dict) -> Any:
    if "lit" in o:
        return o["lit"]
    if "col" in o:
        return subject.get(o["col"])
    if "len" in o:
        v = _value(o["len"], subject, op)
        return len(v.encode("utf-16-le")) // 2 if isinstance(v, str) else None
    a, b = (_value(x, subject, op) for x in o["args"])
    if not all(isinstance(x, int) and not isinstance(x, bool) for x in (a, b)):
        return None
    out = {"add": a + b, "sub": a - b, "mul": a * b}[o["op"]]
    return out if abs(out) < 2**53 else None


def reason_text(reason: dict | None) -> str | None:
    """One line per kind of reason."""
    if reason is None:
        return None
    kind = reason["kind"]
    if kind == "bundle":
        return f"bundle: operation {reason['index']}: {reason_text(reason['of'])}"
    if kind == "fk":
        return f"fk: {reason['column']} reaches no live row of {reason['target']}"
    if kind == "row-not-live":
        return f"row-not-live: {reason['table']} {reason['rowId']}"
    if kind == "restriction":
        return f"restriction: {reason['table']} {reason.get('action', '')}".rstrip()
    return kind


def verdicts(entries: DataFrame, schemas: list[Schema]) -> DataFrame:
    """dag_id, hash, void, reason for every entry, seen from its log's frontier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(1_000_000)
        for table in whole_logs(batches):
            ids, hashes, loads = (table.column(c).to_pylist() for c in ("dag_id", "hash", "payload"))
            prevs = lists(table.column("prev"))
            out: list[tuple] = []
            for a, b in spans(ids):
                entries = [(h, p, json.loads(x)) for h, p, x in zip(hashes[a:b], prevs[a:b], loads[a:b])]
                out += [(ids[a], h, r is not None, reason_text(r)) for h, r in Group(entries, schemas).verdicts().items()]
            yield arrow_rows(out, {"dag_id": table.schema.field("dag_id").type, "hash": pa.string(), "void": pa.bool_(), "reason": pa.string()})

    kind = entries.schema["dag_id"].dataType.simpleString()
    whole = clustered(entries.select("dag_id", "hash", "prev", "payload"))
    return whole.mapInArrow(run, f"dag_id {kind}, hash string, void boolean, reason string")


def verdict_delta(start: DataFrame, end: DataFrame) -> DataFrame:
    """Entries whose verdict turned: dag_id, hash, was_void, is_void, reason."""
    a = start.select("dag_id", "hash", F.col("void").alias("was_void"))
    b = end.select("dag_id", "hash", F.col("void").alias("is_void"), "reason")
    return a.join(b, ["dag_id", "hash"], "full_outer").filter(~F.col("was_void").eqNullSafe(F.col("is_void")) & (F.col("was_void").isNotNull() | F.col("is_void")))
