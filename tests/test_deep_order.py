"""A stretch deep in an order is found by counting, and no task gets the rows before it."""

import random

from loomdag.plans import query as Q

TYPES = {"k": "string", "x": "float"}


def test_every_stretch_is_the_order_s_own(spark, monkeypatch):
    monkeypatch.setattr(Q, "DEEP", 60)
    monkeypatch.setattr(Q, "SAMPLE", 40)
    rng = random.Random(5)
    data = [(f"{rng.random():.8f}", rng.choice([None, "a", "b", "c"]), rng.choice([None, -1.5, 0.0, 2.5])) for _ in range(900)]
    rows = spark.createDataFrame([(i, i, None, k, x) for i, k, x in data], "rowId string, uuid string, rowAuthor string, k string, x double").cache()
    down = sorted(data, key=lambda r: (r[1] is None, -ord(r[1] or "a"), r[2] is None, r[2] or 0.0, r[0]))
    order = [{"column": "k", "direction": "desc"}, {"column": "x"}]
    for offset in (60, 435, 880, 899, 900, 2000):
        got = Q.run(rows, TYPES, {"orderBy": order, "limit": 30, "offset": offset}).collect()
        assert [r["rowId"] for r in got] == [r[0] for r in down[offset : offset + 30]]


def test_a_task_gets_a_bounded_part(spark, monkeypatch):
    monkeypatch.setattr(Q, "DEEP", 300)
    monkeypatch.setattr(Q, "SAMPLE", 400)
    rows = spark.range(20_000).selectExpr("lpad(id, 8, '0') AS rowId", "if(id % 3 = 0, null, id % 7) AS k")
    part, skipped = Q._stretch(rows, ["k", "rowId"], [True, False], 13_300, 50)
    assert part.count() <= 300 and 0 < skipped <= 13_300


def test_equal_rows_end_the_search(spark, monkeypatch):
    monkeypatch.setattr(Q, "DEEP", 10)
    rows = spark.range(200).selectExpr("'same' AS rowId", "'u' AS uuid", "'a' AS rowAuthor", "'k' AS k", "1.0D AS x")
    assert len(Q.run(rows, TYPES, {"orderBy": [{"column": "k"}], "limit": 7, "offset": 150}).collect()) == 7
