"""Rules and references over many subjects at once, as joins.

``operators.voiding`` judges operations one by one, inside their log. Where the tables that
a rule searches are at hand as rows at one version, all subjects can be judged in one plan:
every EXISTS atom becomes a left join with the distinct searched values, and the rule's
tree combines the flags.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdag.functions.predicates import check, lower
from loomdag.plans.schema import exists_atoms


def judged(subjects: DataFrame, rule: dict, types: dict[str, str], tables: dict[str, DataFrame]) -> DataFrame:
    """``subjects`` (the subject's columns, and ``author`` where the rule asks for it) with
    ``allowed``. ``tables`` has the live rows of every searched table. A missing value on
    either side is never equal."""
    check(rule, types, rule=True)
    out, flags = subjects, {}
    for i, atom in enumerate(exists_atoms(rule)):
        found, keys = tables[atom["table"]], []
        for column, term in atom["where"].items():
            if isinstance(term, str):
                keys.append((column, "author" if term == "$author" else term.removeprefix("$row.")))
            else:
                found = found.filter(F.col(column) == F.lit(term["lit"]))
        flag = f"__exists_{i}"
        if keys:
            values = found.select(*[F.col(c).alias(f"{flag}_{k}") for k, (c, _) in enumerate(keys)]).dropna().distinct()
            on = [F.col(own) == F.col(f"{flag}_{k}") for k, (_, own) in enumerate(keys)]
            out = out.join(values.withColumn(flag, F.lit(True)), on, "left").drop(*values.columns)
            flags[id(atom)] = F.col(flag)
        else:
            flags[id(atom)] = F.lit(not found.isEmpty())

    def exists(atom: dict) -> Column:
        return flags[id(atom)]

    return out.select(*subjects.columns, lower(rule, types, exists).alias("allowed"))


def unreached(rows: DataFrame, fks: dict[str, str], live: dict[str, DataFrame]) -> DataFrame:
    """The rows of which a reference that is set reaches no live row (``rowId``), with
    ``failed``, the first such column."""
    out: DataFrame = rows
    failed: Any = F.lit(None).cast("string")
    for i, (column, target) in reversed(list(enumerate(fks.items()))):
        found = live[target].select(F.col("rowId").alias(f"__to_{i}")).distinct()
        out = out.join(found, F.col(column) == F.col(f"__to_{i}"), "left")
        failed = F.when(F.col(column).isNotNull() & F.col(f"__to_{i}").isNull(), F.lit(column)).otherwise(failed)
    return out.select(*rows.columns, failed.alias("failed")).filter("failed is not null")
