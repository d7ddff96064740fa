"""Logs by the batch: what a batch's end cuts is put together, and verdicts ask for no more than decides."""

import random

import pyarrow as pa

from loomdag.operators import causal
from loomdag.operators.voiding import Group, verdicts
from loomdag.plans.schema import Table
from tests.test_causal import random_log

ITEMS = [{"items": Table("items", {"c": {"type": "float", "nullable": True}}, {}, False)}]


def test_a_log_that_batches_cut_is_whole():
    ids = [3] * 4 + [1] + [2] * 9 + [5]
    for size in (1, 2, 4, 5, 20):
        batches = pa.table({"dag_id": ids, "at": list(range(len(ids)))}).to_batches(size)
        tables = [t.column("dag_id").to_pylist() for t in causal.whole_logs(iter([*batches[:1], batches[0].slice(0, 0), *batches[1:]]))]
        assert sum(tables, []) == ids
        assert all(a[-1] != b[0] for a, b in zip(tables, tables[1:]))


def test_index_and_verdicts_over_many_batches(spark):
    logs = {f"d{s}": random_log(s) for s in range(6)}
    row = '{"kind": "ops", "ops": [{"table": "items", "rowId": "r", "uuid": "r", "author": "%s", "action": "%s", "values": {}}]}'
    rows = [(d, h, p, row % ("ab"[i % 5 == 4], "insert" if i == 0 else "update"), i) for d, (hs, ps) in logs.items() for i, (h, p) in enumerate(zip(hs, ps))]
    entries = spark.createDataFrame([*rows, *rows[:7]], "dag_id string, hash string, prev array<string>, payload string, n int")
    entries = entries.unionByName(spark.createDataFrame([("d0", "late", ["nowhere"], row % ("a", "update"), 99)], entries.schema))
    def read(df):
        return sorted(map(tuple, df.collect()))

    places = ["dag_id", "hash", "n", "topo", "chain", "idx", "vc"]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        small = read(causal.chain_index(entries).select(places))
        wide = read(causal.chain_index(entries, wide=True).select(places))
        judged = read(verdicts(entries, ITEMS))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert small == wide and len(small) == 240
    want = {(d, h): r for d, (hs, ps) in logs.items() for h, r in zip(hs, causal.sweep(hs, ps))}
    assert {(r[0], r[1]): (*r[3:6], list(r[6])) for r in small} == {k: (*v[:3], v[3]) for k, v in want.items()}
    assert judged == read(verdicts(entries, ITEMS)) and len(judged) == 240


def test_liveness_asks_no_update_and_no_set_of_history():
    """A verdict's work is by the inserts and deletes of its row: before, every verdict walked
    over the log and over all writes to the row, which is quadratic in the log."""
    n = 400
    op = lambda action, author: {"table": "items", "rowId": "r", "uuid": "r", "author": author, "action": action, "values": {}}
    rng = random.Random(1)
    names = [f"{rng.random():.9f}" for _ in range(n)]
    group = Group([(names[i], names[i - 1 : i] if i else [], {"kind": "ops", "ops": [op("update" if i else "insert", "ab"[i % 2])]}) for i in range(n)], ITEMS)
    asked = []
    sees = group._sees
    group._sees = lambda at, h: asked.append(h) or sees(at, h)
    found = group.verdicts()
    assert [found[h] is None for h in names] == [i % 2 == 0 for i in range(n)]
    assert len(asked) < 6 * n
