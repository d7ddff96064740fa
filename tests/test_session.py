"""Meta commands, renderers and the users group."""

import pytest

from loomdag.functions.predicates import QueryError
from loomdag.lang.cli import Session
from loomdag.lang.engine import Engine
from loomdag.lang.users import Users


def test_script(spark):
    out = Session(spark).run(
        "CREATE SCHEMA s AS (TABLE t (name string PUB, n integer NULL) ALLOW all IF TRUE);\nCREATE TABLEGROUP g USING SCHEMA s AT LATEST;\n"
        "INSERT INTO t (uuid, name, n) VALUES ('1', 'x', 3);\n\\dt g\n\\output json\nSELECT name FROM t\n  WHERE n = 3;\n\\d g.t\n\\groups\n"
    )
    assert out[3] == "t" and '"name": "x"' in out[5] and out[6].startswith("name ") and out[7] == "g"


def test_users(spark):
    u = Users(Engine(spark), "people", "root-key")
    ann, bob = u.register("ann-key", "Ann"), u.register("bob-key")
    assert u.grant("writer", ann, u.founder) and u.grant("writer", ann, u.founder) is None
    with pytest.raises(QueryError):
        u.grant("writer", bob, ann)
    u.publish("tcp://a", ann)
    u.publish("tcp://b", bob)
    assert [r["address"] for r in u.directory("writer").collect()] == ["tcp://a"]
    u.revoke("writer", ann, u.founder)
    assert u.grants("writer", ann) == [] and u.revoke("writer", ann, u.founder) is None
