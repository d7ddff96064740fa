"""Scripts and meta commands: ``python -m loomdag.lang.cli [script.sql]``, else stdin."""

from __future__ import annotations

import json
import sys
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from loomdag.functions.predicates import QueryError
from loomdag.lang.engine import Engine
from loomdag.lang.parser import ParseError

HELP = """\\dbs \\schemas \\groups   names          \\dt group          its tables
\\d group.table           its columns    \\members db        its members
\\frontier name           its frontier   \\key name value    what $name stands for
\\view                    the view set   \\output table|vertical|json
\\dump group              as a script    \\delta group start [end]
\\q                       leave          statements end with ;"""


def show(result: Any, output: str = "table") -> str:
    """A whole result as text: a table, one value a line, or a JSON line a row. A script that
    wants fewer rows says LIMIT."""
    if result is None:
        return "ok"
    if not isinstance(result, DataFrame):
        return str(result)
    data = [r.asDict(recursive=True) for r in result.toLocalIterator()]
    if output == "json":
        return "\n".join(json.dumps(r, ensure_ascii=False) for r in data)
    if output == "vertical":
        return "\n\n".join("\n".join(f"{c}: {'' if v is None else v}" for c, v in r.items()) for r in data)
    names = result.columns
    cells = [names] + [["" if r[c] is None else str(r[c]) for c in names] for r in data]
    width = [max(len(row[i]) for row in cells) for i in range(len(names))]
    return "\n".join(" | ".join(x.ljust(w) for x, w in zip(row, width)).rstrip() for row in cells)


class Session:
    def __init__(self, spark: SparkSession) -> None:
        self.engine, self.output = Engine(spark), "table"

    def meta(self, line: str) -> str:
        word, *args = line[1:].split()
        e = self.engine
        kinds = {"dbs": "database", "schemas": "schema", "groups": "group"}
        if word in kinds:
            return "\n".join(n for n, log in e.logs.items() if log.kind == kinds[word])
        if word == "dt":
            at = e.logs[args[0]].frontier()
            return "\n".join(e.group(args[0]).schema(at, at))
        if word == "d":
            group, table = args[0].rsplit(".", 1)
            at = e.logs[group].frontier()
            return "\n".join(f"{c} {json.dumps(d, sort_keys=True)}" for c, d in e.group(group).schema(at, at)[table].columns.items())
        if word == "members":
            return "\n".join(e.members(args[0]))
        if word == "frontier":
            return "\n".join("#" + h for h in e.logs[args[0]].frontier())
        if word == "key":
            e.keys[args[0]] = args[1].lstrip("#")
            return "ok"
        if word == "view":
            return json.dumps(e.view)
        if word == "output":
            self.output = args[0]
            return "ok"
        if word == "dump":
            return e.dump(args[0])
        if word == "delta":
            found = e.delta(args[0], [args[1].lstrip("#")], [args[2].lstrip("#")] if len(args) > 2 else None)
            return "\n".join([json.dumps(found["schema"], default=str), show(found["rows"], self.output), show(found["ops"], self.output)])
        return HELP

    def run(self, text: str) -> list[str]:
        """The output of a script: a line that begins with a backslash is a meta command."""
        out, rest = [], ""
        for line in [*text.splitlines(), ""]:
            if line.startswith("\\") and not rest.strip():
                out.append(self.meta(line))
            else:
                rest += line + "\n"
                if line.rstrip().endswith(";") or not line:
                    if rest.count("(") <= rest.count(")") and rest.strip():
                        out += [show(r, self.output) for r in self.engine.sql(rest)]
                        rest = ""
        if rest.strip():
            out += [show(r, self.output) for r in self.engine.sql(rest)]
        return out


def main(args: list[str]) -> int:
    spark = SparkSession.builder.appName("loomdag").getOrCreate()
    text = open(args[0]).read() if args else sys.stdin.read()
    try:
        print("\n".join(Session(spark).run(text)))
    except (QueryError, ParseError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
