"""Replicated sets and capabilities.

``log``: dag_id, hash, chain, idx, vc, element, action (add, delete), barrier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdag.functions.localdag import LocalDag
from loomdag.operators.causal import concurrent, history, maxima


def members(log: DataFrame, at: DataFrame, later: DataFrame | None = None) -> DataFrame:
    """dag_id, pos_id, element: elements of the set.

    An element is in when one of its maximal operations is an add that no concurrent
    barrier of the element, as seen from ``later``, overrules; or when such a barrier
    is itself an add.
    """
    keys = ["dag_id", "pos_id", "element"]
    tops = maxima(history(log, at), keys, ["action"])
    adds = tops.filter(F.exists("tops", lambda t: t["action"] == "add")).select(*keys)
    if later is None:
        return adds
    barriers = concurrent(log, later, at).filter("barrier")
    overruled = barriers.filter("action = 'delete'").select(*keys).distinct()
    restored = barriers.filter("action = 'add'").select(*keys).distinct()
    return adds.join(overruled, keys, "left_anti").unionByName(restored).distinct()


class Capabilities:
    """Grants and revocations in one log, by recursion over who may grant what.

    Entries: (hash, prev, {"kind": "create"|"grant"|"revoke", "cap", "to", "by"}).
    ``creators`` always hold everything; ``managed_by`` names the capability that may
    grant and revoke another. A grant that is met while it is being judged doesn't hold.
    """

    def __init__(self, entries: list[tuple[str, list[str], dict]], creators: list[str], managed_by: dict[str, str]) -> None:
        self.dag = LocalDag((h, p) for h, p, _ in entries)
        self.load = {h: x for h, _, x in entries if h in self.dag.at}
        self.creators, self.managed_by = creators, managed_by

    def _allowed(self, h: str, later: list[str], stack: frozenset[str]) -> bool:
        if h in stack:
            return False
        by = self.load[h]["by"]
        manager = self.managed_by.get(self.load[h]["cap"])
        return by in self.creators or (manager is not None and self._holds(by, manager, [h], later, stack | {h}))

    def _holds(self, who: str, cap: str, at: list[str], later: list[str], stack: frozenset[str]) -> bool:
        if who in self.creators:
            return True
        own = lambda kind, scope: [h for h in scope if self.load[h]["kind"] == kind and self.load[h]["cap"] == cap and self.load[h]["to"] == who]
        seen, beside = self.dag.hist(at), self.dag.conc(later, at)
        grants = [h for h in own("grant", seen) if self._allowed(h, later, stack)]
        revokes = [h for h in own("revoke", seen | beside) if self._allowed(h, later, stack)]
        # a revocation ends the grants it doesn't precede: later ones stay
        return any(not any(not self.dag.leq(r, g) for r in revokes) for g in grants)

    def has(self, who: str, cap: str, at: list[str] | None = None, later: list[str] | None = None) -> bool:
        later = list(later or self.dag.frontier())
        return self._holds(who, cap, list(at or later), later, frozenset())
