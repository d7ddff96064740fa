"""Verdicts, schemas and canonical forms on small histories."""

import random

import pytest

from loomdag.functions import canonical as C
from loomdag.functions.localdag import LocalDag
from loomdag.functions.predicates import QueryError, check, like
from loomdag.operators.sets import Capabilities
from loomdag.operators.voiding import Group
from loomdag.plans import schema as S

OPEN = [{"on": "all", "rule": {"p": "true"}}]
HELD = {"p": "exists", "table": "caps", "where": {"label": {"lit": "admin"}, "grantee": "$author"}}


def tables(line_deletes=True, cap_deletes=True):
    text = {"type": "string", "pub": True, "readonly": True}
    return {
        "orders": S.Table("orders", {"customer": {"type": "string"}}, {}, True, {}, OPEN),
        "lines": S.Table("lines", {"order": {"type": "string", "nullable": True}}, {}, line_deletes, {"order": "orders"}, OPEN),
        "caps": S.Table("caps", {"label": text, "grantee": text}, {}, cap_deletes, {}, [{"on": "all", "rule": HELD}]),
        "docs": S.Table("docs", {"body": {"type": "string"}}, {}, True, {}, [{"on": "all", "rule": HELD}]),
    }


def op(table, action, row, author=None, **values):
    return {"table": table, "action": action, "rowId": row, "uuid": row, "author": author, "values": values}


def group(entries, **kw):
    made = [(h, p, {"kind": "create", "schema": 0, "ops": o} if h == "0" else {"kind": "ops", "ops": o}) for h, p, o in entries]
    return Group(made, [tables(**kw)])


GENESIS = ("0", [], [op("caps", "insert", "ca", None, label="admin", grantee="ann"), op("caps", "insert", "cb", None, label="admin", grantee="bob")])


def test_line_before_delete_stays_and_concurrent_falls():
    base = [GENESIS, ("1", ["0"], [op("orders", "insert", "o", customer="x")])]
    after = group([*base, ("2", ["1"], [op("lines", "insert", "l", order="o")]), ("3", ["2"], [op("orders", "delete", "o")])])
    assert after.verdicts()["2"] is None
    beside = group([*base, ("2", ["1"], [op("lines", "insert", "l", order="o")]), ("3", ["1"], [op("orders", "delete", "o")])])
    assert beside.verdicts()["2"]["kind"] == "fk"


def test_use_before_revoke_and_concurrent_revoke():
    used = ("1", ["0"], [op("docs", "insert", "d", "bob", body="x")])
    revoke = [op("caps", "delete", "cb", "ann")]
    assert group([GENESIS, used, ("2", ["1"], revoke)]).verdicts()["1"] is None
    assert group([GENESIS, used, ("2", ["0"], revoke)]).verdicts()["1"]["kind"] == "restriction"
    assert group([GENESIS, used, ("2", ["0"], revoke)], cap_deletes=False).verdicts()["1"] is None


def test_mutual_revocation_leaves_both():
    g = group([GENESIS, ("1", ["0"], [op("caps", "delete", "cb", "ann")]), ("2", ["0"], [op("caps", "delete", "ca", "bob")])])
    assert all(v is not None for h, v in g.verdicts().items() if h != "0")
    assert g.live("caps", "ca", ["1", "2"], ["1", "2"]) and g.live("caps", "cb", ["1", "2"], ["1", "2"])


class Forgetful(Group):
    """The definition by recursion, without any memory."""

    def void(self, entry, later):
        self.known.clear()
        self.asked.clear()
        return super().void(entry, later)


@pytest.mark.parametrize("order", [("1", "2"), ("2", "1")])
def test_mutual_revocation_whoever_is_asked_first(order):
    g = group([GENESIS, ("1", ["0"], [op("caps", "delete", "cb", "ann")]), ("2", ["0"], [op("caps", "delete", "ca", "bob")])])
    assert all(g.void(h, ["1", "2"]) for h in order)


@pytest.mark.parametrize("seed", range(25))
def test_verdicts_need_no_memory(seed):
    """Random logs in which admins grant to and revoke from each other concurrently."""
    rng = random.Random(seed)
    names = ["ann", "bob", "cat", "dan"]
    entries, heads, serial = [GENESIS], ["0"], 0
    for i in range(1, 9):
        prev = sorted(set(rng.sample(heads, min(len(heads), rng.choice([1, 1, 2])))))
        who = rng.choice(names)
        if rng.random() < 0.35:
            serial += 1
            ops = [op("caps", "insert", f"c{serial}", who, label="admin", grantee=rng.choice(names))]
        elif rng.random() < 0.8:
            ops = [op("caps", "delete", rng.choice(["ca", "cb", *[f"c{k}" for k in range(1, serial + 1)]]), who)]
        else:
            ops = [op("docs", "insert", f"d{i}", who, body="x")]
        entries.append((str(i), prev, ops))
        heads = [str(i), *rng.sample(heads, min(len(heads), 2))]
    made = [(h, p, {"kind": "create", "schema": 0, "ops": o} if h == "0" else {"kind": "ops", "ops": o}) for h, p, o in entries]
    plain, own = Forgetful(made, [tables()]), Group(made, [tables()])
    later = sorted(own.dag.frontier())
    want = {h: plain.void(h, later) is not None for h, _, _ in entries}
    asked = list(want)
    for _ in range(3):
        rng.shuffle(asked)
        fresh = Group(made, [tables()])
        assert {h: fresh.void(h, later) is not None for h in asked} == want
    assert {h: r is not None for h, r in own.verdicts().items()} == want


def test_bundle_is_all_or_nothing():
    g = group([GENESIS, ("1", ["0"], [op("orders", "insert", "o", customer="x"), op("lines", "insert", "l", order="o")]), ("2", ["1"], [op("lines", "insert", "m", order="o"), op("docs", "insert", "e", "eve", body="x")])])
    v = g.verdicts()
    assert v["1"] is None and v["2"]["kind"] == "bundle" and v["2"]["index"] == 1


def test_larger_hash_wins_concurrent_writes():
    g = group([GENESIS, ("1", ["0"], [op("orders", "insert", "o", customer="a")]), ("2", ["1"], [op("orders", "update", "o", customer="b")]), ("3", ["1"], [op("orders", "update", "o", customer="c")])])
    assert g.values("orders", "o", ["2", "3"], ["2", "3"]) == {"customer": "c"}
    assert g.values("orders", "o", ["2"], ["2", "3"]) == {"customer": "b"}


def test_readded_column_has_a_new_incarnation():
    col = lambda d: {"type": "string", "default": d}
    rules = {
        "a": [{"rule": "add-table", "table": "t", "columns": {"x": {"type": "string"}, "s": col("new")}}],
        "b": [{"rule": "drop-column", "table": "t", "column": "s"}],
        "c": [{"rule": "add-column", "table": "t", "column": "s", "def": col("fresh")}],
    }
    dag = LocalDag([("a", []), ("b", ["a"]), ("c", ["b"])])
    first, last = S.resolve(dag, ["a"], rules)["t"], S.resolve(dag, ["c"], rules)["t"]
    assert "s" not in S.resolve(dag, ["b"], rules)["t"].columns
    assert last.columns["s"]["default"] == "fresh" and last.incarnations["s"] != first.incarnations["s"]
    assert S.delta({"t": first}, {"t": last})[0]["columns"].keys() == {"s"}


def test_schema_changes_that_are_refused():
    now = tables()
    for rule in (
        {"rule": "drop-table", "table": "orders"}, {"rule": "drop-column", "table": "lines", "column": "order"}, {"rule": "add-column", "table": "orders", "column": "customer", "def": {"type": "string"}},
        {"rule": "set-fks", "table": "lines", "fks": {"order": "nowhere"}}, {"rule": "add-column", "table": "orders", "column": "p", "def": {"type": "decimal"}},
    ):
        with pytest.raises(S.SchemaError):
            S.apply(now, [rule])


def test_types_must_fit():
    types = {"f": "float", "i": "integer", "s": "string", "j": "json", "b": "boolean"}
    fits = lambda c, op_, v: check({"p": "cmp", "op": op_, "left": {"col": c}, "right": {"lit": v}}, types)
    fits("f", "gt", 2.5)
    fits("i", "gt", 2)
    for c, op_, v in (("f", "gt", 2), ("i", "gt", 1.5), ("j", "eq", "x"), ("b", "lt", True), ("s", "eq", 1)):
        with pytest.raises(QueryError):
            fits(c, op_, v)


@pytest.mark.parametrize("pattern,op_", [("%x%", "contains"), ("%x", "suffix"), ("x%", "prefix"), ("x", "eq"), ("%", "suffix"), ("a_b%c", "eq")])
def test_like(pattern, op_):
    assert like("c", pattern)["op"] == op_


def test_canonical_forms():
    assert C.canonical_json({"b": 1, "a": [True, "x\"\\", 1.5, 1e21, 1e-7]}) == '{"a":[true,"x\\"\\\\",1.5,1e+21,1e-7],"b":1}'
    assert C.bigint("-007") == "-7" and C.bigint("-0") == "0" and not C.is_bigint("07")
    assert C.decimal("-01.5", 2) == "-1.50" and C.decimal("-0.00", 2) == "0.00"
    with pytest.raises(ValueError):
        C.decimal("1.005", 2)
    assert C.is_base64("AA==") and not C.is_base64("AB==")


def test_sort_key_is_numeric(spark):
    from pyspark.sql import functions as F

    numbers = ["-100", "-20", "-3", "0", "5", "17", "123456789012345678901234567890"]
    df = spark.createDataFrame([(n,) for n in numbers], "n string")
    assert [r["n"] for r in df.orderBy(C.sort_key(F.col("n"))).collect()] == numbers


def test_capabilities():
    caps = Capabilities(
        [("0", [], {"kind": "create", "cap": "", "to": "", "by": "root"}), ("1", ["0"], {"kind": "grant", "cap": "admin", "to": "ann", "by": "root"}),
         ("2", ["1"], {"kind": "grant", "cap": "write", "to": "bob", "by": "ann"}), ("3", ["0"], {"kind": "grant", "cap": "write", "to": "eve", "by": "eve"})],
        ["root"], {"write": "admin"},
    )
    assert caps.has("bob", "write") and not caps.has("eve", "write") and caps.has("root", "anything")
