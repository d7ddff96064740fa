"""Causal operators against a plain evaluation of their definitions, on random logs."""

import random

import pytest
from pyspark.sql import functions as F

from loomdag.functions.localdag import LocalDag
from loomdag.operators import causal


def random_log(seed, n=40):
    rng = random.Random(seed)
    hashes, prevs = [], []
    for i in range(n):
        prev = rng.sample(hashes, min(len(hashes), rng.choice([0, 1, 1, 1, 2]) if i else 0))
        hashes.append(f"{rng.getrandbits(32):08x}")
        prevs.append(prev)
    return hashes, prevs


def closure(hashes, prevs):
    up = {}
    for h, ps in zip(hashes, prevs):
        up[h] = {h}.union(*(up[p] for p in ps))
    return up


@pytest.mark.parametrize("seed", range(8))
def test_index_is_the_closure(seed):
    hashes, prevs = random_log(seed, 60)
    up, dag = closure(hashes, prevs), LocalDag(zip(hashes, prevs))
    assert all(dag.leq(a, b) == (a in up[b]) for a in hashes for b in hashes)


def test_operators_match_definitions(spark):
    logs = {f"d{s}": random_log(s) for s in range(4)}
    rows = [(d, h, p, i) for d, (hs, ps) in logs.items() for i, (h, p) in enumerate(zip(hs, ps))]
    index = causal.chain_index(spark.createDataFrame(rows, "dag_id string, hash string, prev array<string>, n int")).cache()
    at = {d: set(random.Random(d).sample(hs, 2)) for d, (hs, _) in logs.items()}
    other = {d: set(random.Random(d + "x").sample(hs, 2)) for d, (hs, _) in logs.items()}
    frame = lambda pos: spark.createDataFrame([(d, "p", h) for d, hs in pos.items() for h in hs], "dag_id string, pos_id string, hash string")
    dags = {d: LocalDag(zip(*log)) for d, log in logs.items()}
    got = lambda df: {(r["dag_id"], r["hash"]) for r in df.collect()}
    want = lambda f: {(d, h) for d, g in dags.items() for h in f(d, g)}
    place = {d: {h: i for i, h in enumerate(hs)} for d, (hs, _) in logs.items()}
    assert got(causal.frontier(index)) == want(lambda d, g: g.frontier())
    assert got(causal.history(index, frame(at))) == want(lambda d, g: g.hist(at[d]))
    assert got(causal.minimal_cover(index, frame(at))) == want(lambda d, g: g.maxima(at[d]))
    odd = F.col("n") % 3 == 0
    assert got(causal.cover(index, frame(at), odd)) == want(lambda d, g: g.maxima(h for h in g.hist(at[d]) if place[d][h] % 3 == 0))
    tip = {d: g.frontier() for d, g in dags.items()}
    assert got(causal.concurrent_cover(index, frame(tip), frame(at), F.lit(True))) == want(lambda d, g: g.maxima(g.conc(tip[d], at[d])))
    parts = causal.fork(index, frame(at), frame(other)).collect()
    for part, f in {
        "common": lambda d, g: g.hist(at[d]) & g.hist(other[d]), "left": lambda d, g: g.hist(at[d]) - g.hist(other[d]),
        "right": lambda d, g: g.hist(other[d]) - g.hist(at[d]), "frontier": lambda d, g: g.meet([at[d], other[d]]),
    }.items():
        assert {(r["dag_id"], r["hash"]) for r in parts if r["part"] == part} == want(f)


def test_waits_for_predecessors(spark):
    log = spark.createDataFrame([("d", "b", ["a"]), ("d", "c", ["b"]), ("d", "r", [])], "dag_id string, hash string, prev array<string>")
    assert [r["hash"] for r in causal.chain_index(log).collect()] == ["r"]
