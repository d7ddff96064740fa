"""Scripts through the engine, the store, streams and projections."""

import pytest

from loomdag.functions.canonical import row_id
from loomdag.functions.predicates import QueryError
from loomdag.lang.engine import Engine
from loomdag.lang.parser import ParseError, parse
from loomdag.operators.projection import Snapshot, assign_ids, schema_actions, target_names
from loomdag.sources.store import LogStore
from loomdag.streaming.ingest import causal_apply

SCRIPT = """
CREATE DATABASE app CREATORS ($admin); -- a comment
CREATE SCHEMA shop AS (
  TABLE caps (label string PUB READONLY, grantee string PUB READONLY) CONCURRENT DELETES ALLOW all IF TRUE,
  TABLE orders (customer string PUB, total float DEFAULT 0.5, note string NULL) ALLOW all IF TRUE,
  TABLE lines (orderId string REFERENCES orders, qty integer MIN 0 MAX 100) CONCURRENT DELETES
    ALLOW insert IF EXISTS caps AS c WHERE c.label = 'writer' AND c.grantee = $author ALLOW update IF TRUE ALLOW delete IF TRUE,
);
CREATE TABLEGROUP sales USING SCHEMA shop AT LATEST WITH ROWS (caps (uuid='c1', label='writer', grantee='ann'));
ADD SCHEMA shop TO app BY $admin; ADD TABLEGROUP sales TO app BY $admin;
"""


@pytest.fixture
def engine(spark):
    e = Engine(spark)
    e.sql(SCRIPT)
    e.sql("INSERT INTO sales.orders (uuid, customer, total) VALUES ('o1', 'ann', 10.25); INSERT INTO orders (uuid, customer, note) VALUES ('o2', 'bob', 'x')")
    return e


def test_select(engine):
    rows = engine.sql("SELECT customer, total FROM orders WHERE NOT note = 'x' OR total > 1.5 ORDER BY total DESC LIMIT 5")[0].collect()
    assert [(r["customer"], r["total"]) for r in rows] == [("ann", 10.25)]
    missing_last = engine.sql("SELECT * FROM orders ORDER BY note DESC")[0].collect()
    assert [r["note"] for r in missing_last] == ["x", None]


@pytest.mark.parametrize("bad", [
    "INSERT INTO lines (uuid, orderId, qty) VALUES ('l', 'zzz', 3) BY 'ann'", "INSERT INTO caps (label) VALUES ('x')", "SELECT nope FROM orders",
    "SELECT * FROM orders WHERE total > 2", "INSERT INTO orders (uuid, customer) VALUES ('o1', 'again')", "SELECT * FROM orders FROM LATEST", "ADD SCHEMA shop TO app BY 'eve'",
])
def test_refused(engine, bad):
    with pytest.raises(QueryError):
        engine.sql(bad)


def test_concurrent_delete_cancels_and_explains(engine):
    before = engine.logs["sales"].frontier()
    o1 = row_id("o1")
    at = engine.sql(f"INSERT INTO lines (uuid, orderId, qty) VALUES ('l1', #{o1[:8]}, 3) BY 'ann'")[0]
    assert engine.sql("SELECT * FROM lines")[0].count() == 1
    engine.write("sales", [{"do": "delete", "table": "orders", "row": o1}], None, before)
    assert engine.sql("SELECT * FROM lines")[0].count() == 0
    assert engine.table("sales", "lines", [at], [at]).count() == 1
    log = {r["op"][:17]: r for r in engine.sql("EXPLAIN LOG sales")[0].collect()}
    assert log["INSERT INTO lines"]["status"] == "Cancelled" and log["INSERT INTO lines"]["reason"].startswith("fk")
    delta = engine.delta("sales", [at])
    assert {(r["table"], r["is_live"]) for r in delta["rows"].collect()} == {("lines", False), ("orders", False)}
    assert [r["is_void"] for r in delta["ops"].collect()] == [True]


def test_bundle_and_projection(engine, spark):
    new = row_id("o9", "ann")
    engine.sql(f"BUNDLE ON sales (INSERT INTO orders (uuid, customer) VALUES ('o9', 'cy'); INSERT INTO lines (uuid, orderId, qty) VALUES ('l9', '{new}', 1);) BY 'ann'")
    engine.project("sales")
    got = spark.sql("SELECT customer, count(*) n FROM sales_orders JOIN sales_lines l ON l.orderId = sales_orders.rowId GROUP BY 1").collect()
    assert [(r["customer"], r["n"]) for r in got] == [("cy", 1)]
    late = row_id("o10", "ann")
    with pytest.raises(QueryError):
        engine.sql(f"BUNDLE ON sales (INSERT INTO lines (uuid, orderId, qty) VALUES ('l10', '{late}', 1); INSERT INTO orders (uuid, customer) VALUES ('o10', 'cy');) BY 'ann'")


def test_schema_moves_and_dump_replays(engine, spark):
    engine.sql("ALTER SCHEMA shop AS (ADD COLUMN orders.status string DEFAULT 'new', DROP COLUMN orders.note); UPDATE SCHEMA shop TO LATEST ON sales")
    assert {r["status"] for r in engine.sql("SELECT status FROM orders")[0].collect()} == {"new"}
    other = Engine(spark)
    other.sql(engine.dump("sales"))
    assert other.sql("SELECT customer FROM orders ORDER BY customer")[0].count() == 2


def test_foreign_groups(spark):
    e = Engine(spark)
    e.sql("""CREATE SCHEMA u AS (TABLE caps (label string PUB READONLY, grantee string PUB READONLY) CONCURRENT DELETES ALLOW all IF TRUE);
        CREATE SCHEMA d AS (TABLE pages (title string) ALLOW all IF EXISTS user.caps WHERE user.caps.label = 'w' AND user.caps.grantee = $author);
        CREATE TABLEGROUP people USING SCHEMA u AT LATEST; CREATE TABLEGROUP doc USING SCHEMA d AT LATEST BIND user => people;
        INSERT INTO caps (uuid, label, grantee) VALUES ('c', 'w', 'ann')""")
    with pytest.raises(QueryError):
        e.sql("INSERT INTO pages (uuid, title) VALUES ('p', 't') BY 'ann'")
    e.sql("UPDATE REF user TO LATEST ON doc; INSERT INTO pages (uuid, title) VALUES ('p', 't') BY 'ann'")
    assert e.sql("SELECT * FROM pages")[0].count() == 1


@pytest.mark.parametrize("bad", ["SELECT FROM t", "CREATE TABLE x", "SELECT * FROM t WHERE a ~ 1", "UPDATE t SET a = 1"])
def test_parse_errors(bad):
    with pytest.raises(ParseError):
        parse(bad)


def test_clauses_in_any_order():
    s = parse("SELECT a FROM t LIMIT 3 ORDER BY a WHERE b <> 'it''s' LIMIT 5 ORDER BY c DESC /* x */ OFFSET 1")[0]
    assert s["limit"] == 5 and [o["column"] for o in s["orderBy"]] == ["a", "c"] and s["where"]["right"] == {"lit": "it's"}


def test_store_and_stream(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "log"))
    rows = lambda *r: spark.createDataFrame([(d, h, p, "{}", {}) for d, h, p in r], "dag_id string, hash string, prev array<string>, payload string, meta map<string,array<string>>")
    store.append(rows(("d", "a", []), ("d", "b", ["a"])))
    store.append(rows(("d", "b", ["a"]), ("d", "c", ["b"])))
    assert store.entries().count() == 3 and [r["hash"] for r in store.frontier().collect()] == ["c"]
    with pytest.raises(ValueError):
        store.append(rows(("d", "z", ["y"])))
    source = str(tmp_path / "in")
    out = str(tmp_path / "out")
    for batch in ([("d", "c", ["b"]), ("d", "a", [])], [("d", "b", ["a"]), ("d", "x", ["never"])]):
        spark.createDataFrame([(d, h, p, "{}") for d, h, p in batch], "dag_id string, hash string, prev array<string>, payload string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("dag_id string, hash string, prev array<string>, payload string").parquet(source)
        q = causal_apply(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(out)
        q.awaitTermination()
    got = sorted((r["place"], r["hash"], r["waiting"]) for r in spark.read.parquet(out).collect())
    assert got == [(0, "a", 1), (1, "b", 1), (2, "c", 1)]


def test_snapshot_and_ids(spark, tmp_path):
    snap = Snapshot(spark, str(tmp_path / "snap"))
    frame = lambda *r: spark.createDataFrame(list(r), "rowId string, v int")
    snap.upsert(frame(("a", 1), ("b", 2)), 0)
    snap.upsert(frame(("b", 3), ("c", 4)), 1, frame(("a", 0)))
    assert sorted((r["rowId"], r["v"]) for r in snap.read().collect()) == [("b", 3), ("c", 4)] and snap.batch() == 1
    ids = assign_ids(spark.createDataFrame([("a", 7)], "rowId string, id long"), frame(("a", 1), ("b", 1), ("c", 1)))
    got = {r["rowId"]: r["id"] for r in ids.collect()}
    assert got["a"] == 7 and sorted(got.values()) == [7, 8, 9]


def test_schema_actions():
    from loomdag.plans.schema import Table

    a = {"t": Table("t", {"x": {"type": "string"}, "y": {"type": "string"}})}
    b = {"t": Table("t", {"x": {"type": "integer"}}), "n": Table("n", {"z": {"type": "json"}})}
    assert schema_actions(a, b) == [("drop-column", "t", "x"), ("drop-column", "t", "y"), ("create-table", "n", {"z": "json"}), ("add-column", "t", "x", "integer")]
    with pytest.raises(ValueError):
        target_names(b, columns={"t": {"x": "id"}})


def test_readded_column_reads_its_default(spark):
    """A column that was dropped and added again has none of its old writes."""
    e = Engine(spark)
    e.sql("CREATE SCHEMA s AS (TABLE t (k string, n string DEFAULT 'first') ALLOW all IF TRUE); CREATE TABLEGROUP g USING SCHEMA s AT LATEST")
    before = e.sql("INSERT INTO t (uuid, k, n) VALUES ('a', 'x', 'old')")[0]
    e.sql("ALTER SCHEMA s AS (DROP COLUMN t.n); UPDATE SCHEMA s TO LATEST ON g")
    e.sql("ALTER SCHEMA s AS (ADD COLUMN t.n string DEFAULT 'fresh'); UPDATE SCHEMA s TO LATEST ON g")
    assert [r["n"] for r in e.table("g", "t").collect()] == ["fresh"]
    assert [r["n"] for r in e.table("g", "t", [before], [before]).collect()] == ["old"]
    e.sql("INSERT INTO t (uuid, k, n) VALUES ('b', 'x', 'new')")
    assert sorted(r["n"] for r in e.table("g", "t").collect()) == ["fresh", "new"]
    changes = {r["row_id"]: [(c["column"], c["before"], c["after"]) for c in r["changes"]] for r in e.delta("g", [before])["rows"].collect()}
    assert changes[row_id("a")] == [("n", "old", None)] and ("n", None, "new") in changes[row_id("b")]


def test_dump_replays_everything(spark):
    e = Engine(spark)
    e.sql("""CREATE SCHEMA u AS (TABLE caps (label string PUB READONLY, grantee string PUB READONLY) CONCURRENT DELETES ALLOW all IF TRUE);
        CREATE TABLEGROUP people USING SCHEMA u AT LATEST WITH ROWS (caps (uuid = 'c', label = 'w', grantee = 'ann'));
        CREATE SCHEMA d CREATORS ('ann') AS (
          TABLE pages (title string(80), size float DEFAULT 0.000012345678, extra json NULL, big bigint NULL) ALLOW insert IF EXISTS user.caps WHERE user.caps.label = 'w' AND user.caps.grantee = $author ALLOW update IF TRUE ALLOW delete IF TRUE);
        CREATE TABLEGROUP doc SEED 'it''s' USING SCHEMA d AT LATEST BIND user => people ALLOW UPDATE SCHEMA IF TRUE WITH ROWS (pages (uuid = 'p0', title = 'root', size = 1234567.125));
        INSERT INTO pages (uuid, title, size, extra) VALUES ('p1', 'a ''quoted'' one', 123456789.5, {'k': [1, 'x', TRUE], 'y''z': 0.1}) BY 'ann'""")
    first = e.logs["doc"].frontier()
    e.sql("ALTER SCHEMA d AS (ADD COLUMN pages.status string DEFAULT 'new', SET CONCURRENT DELETES pages FALSE) BY 'ann'; UPDATE SCHEMA d TO LATEST ON doc; UPDATE REF user TO LATEST ON doc")
    e.write("doc", [{"do": "update", "table": "pages", "row": row_id("p0"), "values": {"title": "beside"}}], "bob", first)
    e.sql(f"DELETE FROM pages WHERE rowId = #{row_id('p1', 'ann')}; INSERT INTO pages (uuid, title, size) VALUES ('p2', 'two', 100000000000000000000000.0) BY 'ann'")
    other = Engine(spark)
    other.sql(e.dump("people"))
    other.sql(e.dump("doc"))
    for name in ("people", "doc", "d", "u"):
        assert sorted(other.logs[name].entries, key=str) == sorted(e.logs[name].entries, key=str)
    same = lambda x: sorted(map(str, x.table("doc", "pages").collect()))
    assert same(other) == same(e) and len(same(e)) == 2


def test_drop_of_a_column_whose_name_is_part_of_a_rule(spark):
    e = Engine(spark)
    e.sql("CREATE SCHEMA s AS (TABLE t (a string NULL, name string READONLY PUB, b string NULL) ALLOW all IF name = 'abc' OR EXISTS t WHERE t.name = $author)")
    e.sql("ALTER SCHEMA s AS (DROP COLUMN t.a)")
    with pytest.raises(QueryError):
        e.sql("ALTER SCHEMA s AS (DROP COLUMN t.name)")


def test_crash_between_snapshot_steps_loses_nothing(spark, tmp_path):
    snap = Snapshot(spark, str(tmp_path / "snap"))
    frame = lambda *r: spark.createDataFrame(list(r), "rowId string, v int")
    snap.upsert(frame(("a", 1)), 0)
    frame(("x", 9)).write.parquet(str(tmp_path / "snap" / "v1"))  # written, but its pointer never was
    assert snap.batch() == 0 and [r["rowId"] for r in snap.read().collect()] == ["a"]
    snap.upsert(frame(("b", 2)), 1)
    snap.upsert(frame(("c", 3)), 1)
    assert sorted(r["rowId"] for r in snap.read().collect()) == ["a", "b"]


def test_another_session_reads_the_store(engine, spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "store"))
    engine.save(store)
    engine.sql("ALTER SCHEMA shop AS (ADD COLUMN orders.status string DEFAULT 'new'); UPDATE SCHEMA shop TO LATEST ON sales; INSERT INTO orders (uuid, customer, status) VALUES ('o5', 'eve', 'y')")
    engine.save(store)
    other = Engine.load(spark, LogStore(spark, str(tmp_path / "store")))
    same = lambda e: sorted(map(str, e.sql("SELECT * FROM orders")[0].collect()))
    assert same(other) == same(engine) and len(same(other)) == 3
    assert {n: (log.kind, sorted(h for h, _, _ in log.entries)) for n, log in other.logs.items()} == {n: (log.kind, sorted(h for h, _, _ in log.entries)) for n, log in engine.logs.items()}
    other.sql("INSERT INTO orders (uuid, customer) VALUES ('o6', 'dan')")
    other.save(store)
    assert len(same(Engine.load(spark, store))) == 4


def test_endpoints_are_replaced_and_withdrawn(spark):
    from loomdag.lang.users import Users

    users = Users(Engine(spark), "people", "founder")
    ann = users.register("ann-key")
    users.publish("wss://one", ann)
    users.publish("wss://two", ann)
    table = lambda: [r["address"] for r in users.engine.table("people", "endpoints").collect()]
    assert table() == ["wss://two"] and len(users.endpoints(ann)) == 1
    users.withdraw(ann)
    assert table() == [] and users.withdraw(ann) is None
