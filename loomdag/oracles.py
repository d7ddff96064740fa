"""DuckDB SQL for the queries: ancestry by recursive closure, maxima by NOT EXISTS."""

from loomdag.queries import PROJECTED

#: log, edges and anc (s: entry, a: an ancestor or itself), numbered inside each log.
LOG = """
WITH RECURSIVE log AS (
    SELECT user_id AS dag_id, sha256(CAST(event_id AS VARCHAR)) AS hash, event_type AS row_id, value,
           row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
           row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS nth,
           'u' || (event_id % 4) AS author, 'c' || (event_id % 3) AS col
    FROM events),
ops AS (SELECT *, CASE WHEN nth = 0 THEN 'insert' WHEN nth % 9 = 8 THEN 'delete' ELSE 'update' END AS action,
               max(seq) OVER (PARTITION BY dag_id) AS last FROM log),
edges AS (SELECT dag_id, seq AS s, seq - 3 AS p FROM log WHERE seq >= 3
          UNION SELECT dag_id, seq, seq - 1 FROM log WHERE seq % 5 = 0 AND seq > 0),
anc AS (SELECT dag_id, seq AS s, seq AS a FROM log UNION SELECT anc.dag_id, anc.s, edges.p FROM anc JOIN edges ON edges.dag_id = anc.dag_id AND edges.s = anc.a)
"""

#: The default rule: a row is its author's. The owner's deletes that see the row are own; of those, one that sees
#: no other counts, so that a row is dead wherever an own delete is seen.
JUDGED = """
ins AS (SELECT dag_id, row_id, seq AS first, author AS owner FROM ops WHERE action = 'insert'),
seeing AS (SELECT o.*, owner, anc.a IS NOT NULL AS has_row FROM ops o JOIN ins USING (dag_id, row_id)
           LEFT JOIN anc ON anc.dag_id = o.dag_id AND anc.s = o.seq AND anc.a = ins.first),
own AS (SELECT dag_id, row_id, seq FROM seeing WHERE action = 'delete' AND has_row AND author = owner),
dead AS (SELECT DISTINCT o.dag_id, o.seq FROM ops o JOIN anc ON anc.dag_id = o.dag_id AND anc.s = o.seq
         JOIN own d ON d.dag_id = o.dag_id AND d.row_id = o.row_id AND d.seq = anc.a WHERE d.seq <> o.seq),
judged AS (SELECT s.dag_id, s.seq, hash, CASE
               WHEN action = 'insert' OR (has_row AND d.seq IS NULL AND author = owner) THEN NULL
               WHEN has_row AND d.seq IS NULL THEN 'restriction: items ' || action ELSE 'row-not-live: items ' || row_id END AS reason
           FROM seeing s LEFT JOIN dead d ON d.dag_id = s.dag_id AND d.seq = s.seq),
void AS (SELECT dag_id, seq FROM judged WHERE reason IS NOT NULL)
"""


def _pos(back: int, name: str = "pos") -> str:
    return f"{name} AS (SELECT dag_id, seq FROM ops WHERE seq BETWEEN last - {back + 1} AND last - {back})"


def _hist(pos: str, name: str) -> str:
    return f"{name} AS (SELECT DISTINCT anc.dag_id, a AS seq FROM anc JOIN {pos} p ON p.dag_id = anc.dag_id AND anc.s = p.seq)"


END = "tip AS (SELECT dag_id, seq FROM log WHERE NOT EXISTS (SELECT 1 FROM edges WHERE edges.dag_id = log.dag_id AND edges.p = log.seq))"


def _conc(later: str, at: str, name: str) -> str:
    return f"""{name} AS (SELECT f.dag_id, f.seq FROM {later} f WHERE NOT EXISTS (
        SELECT 1 FROM {at} p JOIN anc ON anc.dag_id = p.dag_id WHERE p.dag_id = f.dag_id
          AND ((anc.s = p.seq AND anc.a = f.seq) OR (anc.s = f.seq AND anc.a = p.seq))))"""


def _maxima(of: str, same: str = "") -> str:
    return f"""SELECT x.* FROM {of} x WHERE NOT EXISTS (
        SELECT 1 FROM {of} y JOIN anc ON anc.dag_id = y.dag_id AND anc.s = y.seq
        WHERE y.dag_id = x.dag_id AND y.seq <> x.seq AND anc.a = x.seq {same})"""


def _hashes(body: str) -> str:
    return f"SELECT m.dag_id, hash FROM ({body}) m JOIN log USING (dag_id, seq)"


def _live(seen: str) -> str:
    return f"""SELECT dag_id, row_id, max_by(author, hash) FILTER (action = 'insert') AS author FROM {seen}
        GROUP BY dag_id, row_id HAVING count(*) FILTER (action = 'insert') > 0 AND count(*) FILTER (action = 'delete') = 0"""


SEEN = "seen AS (SELECT ops.* FROM ops JOIN hist USING (dag_id, seq))"
COUNTED = f"{JUDGED}, counted AS (SELECT * FROM seen WHERE (dag_id, seq) NOT IN (SELECT dag_id, seq FROM void))"
KILLED = "killed AS (SELECT DISTINCT dag_id, row_id FROM ops JOIN beside USING (dag_id, seq) WHERE action = 'delete')"
ORDERS = "(SELECT *, CAST(o_orderkey AS VARCHAR) AS uuid, nullif(o_orderpriority, '1-URGENT') AS note FROM orders)"


def _cells(writes: str) -> str:
    same = "AND y.row_id = x.row_id AND y.col = x.col"
    return f"SELECT dag_id, row_id, col, max_by(value, hash) AS value, max(hash) AS hash FROM ({_maxima(writes, same)}) GROUP BY dag_id, row_id, col"


def _view(seen: str) -> str:
    return f"""SELECT l.dag_id, l.row_id, l.author, max(value) FILTER (col = 'c0') AS c0, max(value) FILTER (col = 'c1') AS c1, max(value) FILTER (col = 'c2') AS c2
        FROM ({_live(seen)}) l LEFT JOIN ({_cells('(SELECT * FROM ' + seen + " WHERE action <> 'delete')")}) c USING (dag_id, row_id) GROUP BY ALL"""


def _set(seen: str, more: str = "") -> str:
    same = "AND y.row_id = x.row_id"
    return f"SELECT DISTINCT dag_id, row_id AS element FROM ({_maxima(seen, same)}) WHERE action <> 'delete' {more}"


CAP = "EXISTS (SELECT 1 FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey)"
TEXT = """CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN '0' || o_orderkey WHEN 2 THEN o_orderkey || '.50' ELSE '-' || o_orderkey END"""



def _values(columns: str, rows: str) -> str:
    return f"SELECT * FROM (VALUES {rows}) t({columns})"


#: What the scenarios have to give, by the rules of the language.
SCENARIOS = {
    "void_scenarios": _values("dag_id, hash, void, reason", """
        ('bundle', '0', false, NULL), ('bundle', '1', false, NULL), ('bundle', '2', true, 'bundle: operation 1: restriction: docs insert'),
        ('chain', '0', false, NULL), ('chain', '1', true, 'restriction: caps insert'), ('chain', '2', true, 'restriction: docs insert'), ('chain', '3', false, NULL),
        ('delete-after', '0', false, NULL), ('delete-after', '1', false, NULL), ('delete-after', '2', false, NULL), ('delete-after', '3', false, NULL),
        ('delete-beside', '0', false, NULL), ('delete-beside', '1', false, NULL), ('delete-beside', '2', true, 'fk: order reaches no live row of orders'), ('delete-beside', '3', false, NULL),
        ('delete-beside-off', '0', false, NULL), ('delete-beside-off', '1', false, NULL), ('delete-beside-off', '2', false, NULL), ('delete-beside-off', '3', false, NULL),
        ('deploy-after', '0', false, NULL), ('deploy-after', '1', false, NULL), ('deploy-after', '2', false, NULL),
        ('deploy-beside', '0', false, NULL), ('deploy-beside', '1', false, NULL), ('deploy-beside', '2', false, NULL),
        ('dead-row', '0', false, NULL), ('dead-row', '1', false, NULL), ('dead-row', '2', false, NULL), ('dead-row', '3', true, 'row-not-live: docs nowhere'),
        ('mutual', '0', false, NULL), ('mutual', '1', true, 'restriction: caps delete'), ('mutual', '2', true, 'restriction: caps delete'),
        ('revoke-after', '0', false, NULL), ('revoke-after', '1', false, NULL), ('revoke-after', '2', false, NULL),
        ('revoke-beside', '0', false, NULL), ('revoke-beside', '1', true, 'restriction: docs insert'), ('revoke-beside', '2', false, NULL),
        ('revoke-beside-off', '0', false, NULL), ('revoke-beside-off', '1', false, NULL), ('revoke-beside-off', '2', false, NULL),
        ('self-grant', '0', false, NULL), ('self-grant', '1', true, 'restriction: caps insert'), ('self-grant', '2', true, 'restriction: docs insert'),
        ('stranger', '0', false, NULL), ('stranger', '1', true, 'restriction: docs insert')"""),
    "op_delta": _values("dag_id, hash, was_void, is_void", """
        ('bundle', '2', NULL, true), ('deploy-beside', '1', true, false), ('mutual', '1', false, true), ('mutual', '2', NULL, true),
        ('revoke-beside', '1', false, true), ('self-grant', '2', NULL, true)"""),
    "schema_at": _values('version, "table", "column", type, preset, barrier', """
        ('1', 't', 'x', 'integer', NULL, true), ('1', 't', 's', 'string', 'new', true), ('1', 'u', 'y', 'string', NULL, true),
        ('2', 't', 'x', 'integer', NULL, true), ('2', 'u', 'y', 'string', NULL, true),
        ('3', 't', 'x', 'integer', NULL, true), ('3', 't', 's', 'string', 'fresh', true), ('3', 'u', 'y', 'string', NULL, true),
        ('4', 't', 'x', 'integer', NULL, true), ('4', 't', 's', 'string', 'beside', true), ('4', 'u', 'y', 'string', NULL, true),
        ('5', 't', 'x', 'integer', NULL, true), ('5', 't', 's', 'string', 'new', true),
        ('6', 't', 'x', 'integer', NULL, false), ('6', 't', 's', 'string', 'beside', false),
        ('7', 't', 'x', 'integer', NULL, false), ('7', 't', 's', 'string', 'beside', false), ('7', 'u', 'z', 'boolean', NULL, true)"""),
    "schema_delta": _values('version, "table", change, parts, columns', """
        ('2', 't', 'altered', 'columns', 's'), ('3', 't', 'altered', 'columns', 's'), ('4', 't', 'altered', 'columns', 's'), ('5', 'u', 'dropped', '', ''),
        ('6', 't', 'altered', 'columns,concurrent_deletes', 's'), ('6', 'u', 'dropped', '', ''),
        ('7', 't', 'altered', 'columns,concurrent_deletes', 's'), ('7', 'u', 'altered', 'columns', 'y,z')"""),
    "capability_holds": _values("version, who, cap, holds", """
        ('granted', 'ann', 'admin', true), ('granted', 'bob', 'write', true), ('granted', 'eve', 'write', false), ('granted', 'root', 'write', true),
        ('alone', 'ann', 'admin', false), ('alone', 'bob', 'write', false), ('alone', 'eve', 'write', false), ('alone', 'root', 'write', true),
        ('revoked', 'ann', 'admin', true), ('revoked', 'bob', 'write', false), ('revoked', 'eve', 'write', false), ('revoked', 'root', 'write', true),
        ('again', 'ann', 'admin', true), ('again', 'bob', 'write', true), ('again', 'eve', 'write', false), ('again', 'root', 'write', true),
        ('merged', 'ann', 'admin', false), ('merged', 'bob', 'write', false), ('merged', 'eve', 'write', false), ('merged', 'root', 'write', true)"""),
    "write_validation": _values("step, accepted", """
        ('insert', true), ('insert-again', false), ('insert-lacks', false), ('insert-unknown-column', false), ('insert-type', false), ('insert-range', false),
        ('insert-rule', false), ('insert-reference', false), ('insert-by-holder', true), ('update', true), ('update-readonly', false), ('delete', true),
        ('delete-dead', false), ('update-dead', false), ('bundle', true), ('bundle-order', false), ('syntax', false), ('drop-referenced', false),
        ('drop-column', true), ('deploy', true), ('insert-dropped-column', false)"""),
    "explain_log": _values("kind, op, status, reason", """
        ('create', 'CREATE', NULL, NULL), ('ops', 'INSERT INTO', 'OK', NULL), ('ops', 'INSERT INTO', 'OK', NULL),
        ('ops', 'INSERT INTO', 'Cancelled', 'fk: orderId reaches no live row of orders'), ('ops', 'DELETE FROM', 'OK', NULL)"""),
    "readded_column": _values("version, k, n", """
        ('first', 'x', 'old'), ('first', 'y', 'first'), ('second', 'x', 'fresh'), ('second', 'y', 'fresh'), ('third', 'x', 'new'), ('third', 'y', 'fresh')"""),
    "dump_replay": _values("uuid, customer, total, note, status", """
        ('o1', 'ann', CAST(0.000012345 AS DOUBLE), NULL, 'new'), ('o2', 'bob', CAST(0.5 AS DOUBLE), 'x', 'new'), ('o7', 'd''or', CAST(1234567.125 AS DOUBLE), NULL, 'new')"""),
    "foreign_rule": _values("step, accepted", """
        ('not yet seen', false), ('seen', true), ('revoked there, not seen here', true), ('revocation seen', false)"""),
    "users_directory": _values("name, address", "('ann', 'wss://ann')"),
}

ORACLES = {
    "filter_cmp": f"SELECT uuid, o_orderkey, o_totalprice FROM {ORDERS} WHERE o_totalprice > 100000.5",
    "filter_bool_not_missing": f"SELECT uuid, o_orderkey, note FROM {ORDERS} WHERE NOT coalesce(note = '2-HIGH', false)",
    "filter_and_or": f"SELECT uuid, o_orderkey FROM {ORDERS} WHERE o_orderstatus = 'F' OR (o_orderpriority <> '5-LOW' AND o_totalprice <= 50000.5)",
    "like_prefix": f"SELECT uuid, o_orderkey FROM {ORDERS} WHERE starts_with(o_orderpriority, '1')",
    "like_suffix": f"SELECT uuid, o_orderkey FROM {ORDERS} WHERE ends_with(o_orderpriority, 'LOW')",
    "like_contains": f"SELECT uuid, o_orderkey FROM {ORDERS} WHERE contains(o_orderpriority, 'IG')",
    "arith_int": f"SELECT uuid, o_orderkey, o_custkey FROM {ORDERS} WHERE o_custkey * 3 + 7 > 500",
    "len": f"SELECT uuid, o_orderkey, o_orderpriority FROM {ORDERS} WHERE length(o_orderpriority) >= 8",
    "project": f"SELECT uuid, o_orderkey, o_orderstatus FROM {ORDERS}",
    "order_missing_last": f"SELECT uuid, o_orderkey, note FROM {ORDERS} ORDER BY note DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET (SELECT greatest(0, count(note) - 25) FROM {ORDERS})",
    "verdicts": f"{LOG}, {JUDGED} SELECT dag_id, hash, reason IS NOT NULL AS void, reason FROM judged",
    "walk_to_bound": f"""{LOG}, {_pos(2, 'p1')}, {_pos(14, 'p2')}, {_hist('p1', 'h1')}, {_hist('p2', 'h2')}
        {_hashes('SELECT * FROM h1 EXCEPT SELECT * FROM h2')}""",
    "find_rows": f"""SELECT to_base64(unhex(sha256('{{"uuid":"' || uuid || '"}}'))) AS "rowId" FROM {ORDERS} WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'""",
    "fork_position": f"""{LOG}, l AS (SELECT dag_id, seq FROM ops WHERE seq = last - 3), r AS (SELECT dag_id, seq FROM ops WHERE seq = last - 7),
        {_hist('l', 'hl')}, {_hist('r', 'hr')}, common AS (SELECT * FROM hl INTERSECT SELECT * FROM hr),
        own AS (SELECT *, 'left' AS part FROM (SELECT * FROM hl EXCEPT SELECT * FROM hr) UNION ALL SELECT *, 'right' FROM (SELECT * FROM hr EXCEPT SELECT * FROM hl)),
        met AS (SELECT own.dag_id, own.seq, part, edges.p FROM own JOIN edges ON edges.dag_id = own.dag_id AND edges.s = own.seq JOIN common ON common.dag_id = own.dag_id AND common.seq = edges.p),
        parts AS (SELECT DISTINCT dag_id, seq, part FROM met UNION ALL SELECT DISTINCT dag_id, p, 'common' FROM met UNION ALL SELECT *, 'frontier' FROM ({_maxima('common')}))
        SELECT parts.dag_id, part, hash FROM parts JOIN log USING (dag_id, seq)""",
    "topk": f"SELECT uuid, o_orderkey, o_totalprice FROM {ORDERS} WHERE starts_with(o_orderpriority, '1') ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "limit_offset": f"SELECT uuid, o_orderkey FROM {ORDERS} ORDER BY o_orderkey LIMIT 20 OFFSET 40",
    "frontier": f"{LOG}, {END} {_hashes('SELECT * FROM tip')}",
    "history_at": f"{LOG}, {_pos(7)}, {_hist('pos', 'hist')} {_hashes('SELECT * FROM hist')}",
    "min_cover": f"{LOG}, own AS (SELECT dag_id, seq FROM log WHERE seq % 4 = 0) {_hashes(_maxima('own'))}",
    "cover_filtered": f"{LOG}, {_pos(5)}, {_hist('pos', 'hist')}, own AS (SELECT dag_id, seq FROM hist JOIN log USING (dag_id, seq) WHERE row_id = 'click') {_hashes(_maxima('own'))}",
    "concurrent_cover": f"{LOG}, {_pos(9)}, {END}, {_hist('tip', 'later')}, {_conc('later', 'pos', 'beside')} {_hashes(_maxima('beside'))}",
    "fork_parts": f"""{LOG}, l AS (SELECT dag_id, seq FROM ops WHERE seq = last - 3), r AS (SELECT dag_id, seq FROM ops WHERE seq = last - 7),
        {_hist('l', 'hl')}, {_hist('r', 'hr')}, common AS (SELECT * FROM hl INTERSECT SELECT * FROM hr),
        parts AS (SELECT *, 'common' AS part FROM common UNION ALL SELECT *, 'left' FROM (SELECT * FROM hl EXCEPT SELECT * FROM hr)
                  UNION ALL SELECT *, 'right' FROM (SELECT * FROM hr EXCEPT SELECT * FROM hl) UNION ALL SELECT *, 'frontier' FROM ({_maxima('common')}))
        SELECT parts.dag_id, part, hash FROM parts JOIN log USING (dag_id, seq)""",
    "meet": f"""{LOG}, pos AS (SELECT dag_id, seq FROM ops WHERE seq > last - 3), n AS (SELECT dag_id, count(*) AS n FROM pos GROUP BY dag_id),
        common AS (SELECT dag_id, a AS seq FROM (SELECT anc.dag_id, a, count(*) AS m FROM anc JOIN pos ON pos.dag_id = anc.dag_id AND anc.s = pos.seq GROUP BY anc.dag_id, a)
                   JOIN n USING (dag_id) WHERE m = n) {_hashes(_maxima('common'))}""",
    "base_live": f"{LOG}, {_pos(5)}, {_hist('pos', 'hist')}, {SEEN} {_live('seen')}",
    "enforced_live": f"{LOG}, {_pos(5)}, {_hist('pos', 'hist')}, {SEEN}, {COUNTED} {_live('counted')}",
    "concurrent_delete_kill": f"{LOG}, {_pos(11)}, {END}, {_hist('tip', 'later')}, {_conc('later', 'pos', 'beside')}, {KILLED} SELECT * FROM killed",
    "lww_values": f"{LOG}, writes AS (SELECT * FROM ops WHERE action <> 'delete') SELECT dag_id, row_id, col AS \"column\", value, hash FROM ({_cells('writes')})",
    "view_at_from": f"""{LOG}, {_pos(11)}, {_hist('pos', 'hist')}, {SEEN}, {COUNTED}, {END}, {_hist('tip', 'later')}, {_conc('later', 'pos', 'beside0')},
        beside AS (SELECT * FROM beside0 WHERE (dag_id, seq) NOT IN (SELECT dag_id, seq FROM void)), {KILLED}
        SELECT dag_id, row_id, author, coalesce(c0, -1.0) AS c0, c1, coalesce(c2, 0.5) AS c2 FROM ({_view('counted')})
        WHERE (dag_id, row_id) NOT IN (SELECT dag_id, row_id FROM killed)""",
    "delta_rows": f"""{LOG}, {_pos(12, 'p1')}, {_pos(0, 'p2')}, {_hist('p1', 'h1')}, {_hist('p2', 'h2')},
        s1 AS (SELECT ops.* FROM ops JOIN h1 USING (dag_id, seq)), s2 AS (SELECT ops.* FROM ops JOIN h2 USING (dag_id, seq)),
        v1 AS ({_view('s1')}), v2 AS ({_view('s2')}),
        met AS (SELECT dag_id, row_id, v1.author IS NOT NULL AS was_live, v2.author IS NOT NULL AS is_live,
            CASE WHEN v2.author IS NULL THEN '' ELSE array_to_string(list_filter([CASE WHEN v1.c0 IS DISTINCT FROM v2.c0 THEN 'c0' END,
                CASE WHEN v1.c1 IS DISTINCT FROM v2.c1 THEN 'c1' END, CASE WHEN v1.c2 IS DISTINCT FROM v2.c2 THEN 'c2' END], lambda x: x IS NOT NULL), ',') END AS columns
            FROM v1 FULL JOIN v2 USING (dag_id, row_id))
        SELECT * FROM met WHERE was_live <> is_live OR columns <> ''""",
    "exists_semi": f"SELECT o_orderkey FROM orders WHERE {CAP}",
    "exists_under_or": f"SELECT o_orderkey FROM orders WHERE {CAP} OR o_orderstatus = 'F'",
    "fk_reach_anti": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P')",
    "default_rule_owner": f"{LOG}, {JUDGED} SELECT dag_id, hash FROM judged WHERE starts_with(reason, 'restriction')",
    "canonical_checks": f"""SELECT o_orderkey, regexp_full_match({TEXT}, '0|-?[1-9][0-9]*') AS is_bigint,
        regexp_full_match({TEXT}, '-?(0|[1-9][0-9]*)\\.[0-9][0-9]') AND NOT regexp_full_match({TEXT}, '-[0.]*') AS is_decimal,
        to_base64(from_base64(rpad(CAST(o_orderkey AS VARCHAR), 8, 'A'))) = rpad(CAST(o_orderkey AS VARCHAR), 8, 'A') AS is_base64 FROM orders""",
    "row_identity": """SELECT c_custkey, to_base64(unhex(sha256(CASE WHEN c_custkey % 2 = 0
        THEN '{"author":"' || c_mktsegment || '","uuid":"' || c_name || '"}' ELSE '{"uuid":"' || c_name || '"}' END))) AS row_id FROM customer""",
    "upsert_replay": "SELECT user_id, event_type, max_by(value, (ts, event_id)) AS value, max_by(event_id, (ts, event_id)) AS last_event FROM events GROUP BY ALL",
    "set_membership": f"{LOG}, {_pos(4)}, {_hist('pos', 'hist')}, {SEEN} {_set('seen')}",
    "set_barrier": f"""{LOG}, {_pos(11)}, {_hist('pos', 'hist')}, {SEEN}, {END}, {_hist('tip', 'later')}, {_conc('later', 'pos', 'beside')}, {KILLED}
        {_set('seen', 'AND (dag_id, row_id) NOT IN (SELECT dag_id, row_id FROM killed)')}""",
    "causal_apply": f"""{LOG}, late AS (SELECT dag_id, seq FROM log WHERE seq % 31 = 30)
        SELECT dag_id, hash FROM log WHERE NOT EXISTS (SELECT 1 FROM anc JOIN late ON late.dag_id = anc.dag_id AND late.seq = anc.a WHERE anc.dag_id = log.dag_id AND anc.s = log.seq)""",
} | PROJECTED | SCENARIOS
