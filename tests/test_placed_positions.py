"""Positions that keep their places are not looked up, and give what looked-up ones give."""

import random

from pyspark.sql import functions as F

from loomdag import queries
from loomdag.operators import causal, rows
from loomdag.sources.tables import events_log
from tests.test_causal import random_log

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def got(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_placed_positions_give_the_same(spark):
    logs = {f"d{s}": random_log(s, 30) for s in range(3)}
    data = [(d, h, p, i) for d, (hs, ps) in logs.items() for i, (h, p) in enumerate(zip(hs, ps))]
    index = causal.chain_index(spark.createDataFrame(data, "dag_id string, hash string, prev array<string>, n int")).cache()
    rng = random.Random(4)
    sides = []
    for _ in range(2):
        drawn = [(d, str(k), h) for d, (hs, _) in logs.items() for k in range(3) for h in rng.sample(hs, 2)]
        plain = spark.createDataFrame(drawn, "dag_id string, pos_id string, hash string")
        sides.append((plain, plain.join(index.select("dag_id", *queries.PLACE), ["dag_id", "hash"]).cache()))
    (a, a_placed), (b, b_placed) = sides
    keys = ["dag_id", "pos_id", "hash"]
    for f in (causal.fork, causal.fork_position):
        assert got(f(index, a, b), *keys, "part") == got(f(index, a_placed, b_placed), *keys, "part")
    for f in (causal.walk_back, causal.concurrent):
        assert got(f(index, a, b), *keys) == got(f(index, a_placed, b_placed), *keys)
    assert got(causal.minimal_cover(index, a), *keys) == got(causal.minimal_cover(index, a_placed), *keys)
    assert got(causal.tips(index), "dag_id", "hash") == got(causal.frontier(index), "dag_id", "hash")
    own = index.filter("n % 7 = 0").withColumn("pos_id", F.lit("p"))
    assert "Join" not in plan(causal.at_positions(index, own)) and "Join" in plan(causal.at_positions(index, a))


def test_events_are_dealt_once(spark):
    assert plan(causal.chain_index(events_log(spark, SMALL))).count("Exchange hashpartitioning") == 1


def test_base_liveness_makes_no_verdicts(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("base liveness has no use for verdicts")

    monkeypatch.setattr(queries, "_verdicts", refuse)
    assert queries.base_live(spark, SMALL).count() > 0
    ops = queries._ops(spark, SMALL)
    at = queries._last(ops, 5)
    every = ops.select("dag_id", "hash")
    keys = ("dag_id", "row_id", "author")
    assert got(rows.live_rows(ops, at, void=every, base=True), *keys) == got(rows.live_rows(ops, at, base=True), *keys)
    assert rows.live_rows(ops, at, void=every).filter(F.lit(True)).count() == 0
