"""Rules and references over many subjects, and forks, against plain loops."""

import random

import pytest

from loomdag.functions.predicates import QueryError
from loomdag.operators import causal
from loomdag.plans import rules as R

HELD = {"p": "exists", "table": "caps", "where": {"label": {"lit": "w"}, "grantee": "$author"}}
OWNS = {"p": "exists", "table": "caps", "where": {"grantee": "$row.owner"}}
TYPES = {"name": "string", "owner": "string"}


def test_rules_in_bulk(spark):
    caps = spark.createDataFrame([("w", "ann"), ("w", "ann"), ("r", "bob"), ("w", None)], "label string, grantee string")
    subjects = [("a", "bob", "ann"), ("b", None, "bob"), ("c", "zed", None), ("d", "ann", "eve")]
    df = spark.createDataFrame(subjects, "name string, owner string, author string")
    named = {"p": "cmp", "op": "eq", "left": {"col": "name"}, "right": {"lit": "c"}}
    for rule, want in (
        (HELD, "a"), (OWNS, "ad"), ({"p": "and", "args": [HELD, OWNS]}, "a"), ({"p": "or", "args": [HELD, named, OWNS]}, "acd"),
        ({"p": "exists", "table": "caps", "where": {"label": {"lit": "r"}}}, "abcd"), ({"p": "exists", "table": "caps", "where": {"label": {"lit": "x"}}}, ""),
    ):
        got = R.judged(df, rule, TYPES, {"caps": caps}).collect()
        assert len(got) == 4 and "".join(sorted(r["name"] for r in got if r["allowed"])) == want
    with pytest.raises(QueryError):
        R.judged(df, {"p": "not", "arg": HELD}, TYPES, {"caps": caps})


def test_references_in_bulk(spark):
    live = spark.createDataFrame([("x",), ("x",), ("y",)], "rowId string")
    rows = spark.createDataFrame([(1, "x", "y"), (2, "z", "y"), (3, None, "z"), (4, None, None)], "k int, a string, b string")
    got = {r["k"]: r["failed"] for r in R.unreached(rows, {"a": "t", "b": "t"}, {"t": live}).collect()}
    assert got == {2: "a", 3: "b"}


def branching(rng, n):
    out, open_ = [], []
    while len(out) < n:
        after = list(open_) if rng.random() < 0.5 else [h for h in open_ if rng.random() < 0.7] or list(open_)
        open_ = [h for h in open_ if h not in after]
        for _ in range(min(rng.randint(1, 6), n - len(out))):
            out.append((f"{rng.random():.9f}", after))
            open_.append(out[-1][0])
    return out


def test_chains_are_about_as_many_as_entries_side_by_side():
    log = branching(random.Random(2), 2000)
    rows = causal.sweep([h for h, _ in log], [p for _, p in log])
    assert max(r[1] for r in rows) < 40
    below: dict[str, set[str]] = {}
    for h, ps in log:
        below[h] = {h}.union(*(below[p] for p in ps))
    at = {h: r for (h, _), r in zip(log, rows)}
    rng = random.Random(3)
    for _ in range(3000):
        a, b = rng.choice(log)[0], rng.choice(log)[0]
        _, chain, idx, _ = at[a]
        vc = at[b][3]
        assert (chain < len(vc) and vc[chain] >= idx) == (a in below[b])


def test_fork_position_by_definition(spark):
    rng = random.Random(9)
    log = branching(rng, 60)
    below: dict[str, set[str]] = {}
    for h, ps in log:
        below[h] = {h}.union(*(below[p] for p in ps))
    prev = dict(log)
    index = causal.chain_index(spark.createDataFrame([("d", h, p) for h, p in log], "dag_id string, hash string, prev array<string>"))
    pairs = [(str(i), [x[0] for x in rng.sample(log, 2)], [x[0] for x in rng.sample(log, 2)]) for i in range(12)]
    table = lambda k: spark.createDataFrame([("d", p[0], h) for p in pairs for h in p[k]], "dag_id string, pos_id string, hash string")
    want = set()
    for i, a, b in pairs:
        ha, hb = set().union(*(below[h] for h in a)), set().union(*(below[h] for h in b))
        both = ha & hb
        for side, own in (("left", ha - hb), ("right", hb - ha)):
            for h in own:
                for p in set(prev[h]) & both:
                    want |= {(i, side, h), (i, "common", p)}
        want |= {(i, "frontier", h) for h in both if not any(h in below[x] and x != h for x in both)}
    got = [(r["pos_id"], r["part"], r["hash"]) for r in causal.fork_position(index, table(1), table(2)).collect()]
    assert len(got) == len(want) and set(got) == want
