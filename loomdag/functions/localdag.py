"""A small log in memory: for schemas, references and per-log evaluation."""

from __future__ import annotations

from collections.abc import Iterable

from loomdag.operators.causal import sweep


class LocalDag:
    """Partial order of one log's entries, by the chain index."""

    def __init__(self, entries: Iterable[tuple[str, Iterable[str]]]) -> None:
        pairs = list({h: list(p) for h, p in entries}.items())
        rows = sweep([h for h, _ in pairs], [p for _, p in pairs])
        self.at = {h: r for (h, _), r in zip(pairs, rows) if r is not None}
        self.prev = {h: p for h, p in pairs if h in self.at}

    def leq(self, a: str, b: str) -> bool:
        _, chain, idx, _ = self.at[a]
        vc = self.at[b][3]
        return chain < len(vc) and vc[chain] >= idx

    def ordered(self, hashes: Iterable[str]) -> list[str]:
        return sorted(hashes, key=lambda h: self.at[h][0])

    def hist(self, position: Iterable[str]) -> set[str]:
        position = list(position)
        return {e for e in self.at if any(self.leq(e, p) for p in position)}

    def conc(self, later: Iterable[str], at: Iterable[str]) -> set[str]:
        at = list(at)
        return {e for e in self.hist(later) if not any(self.leq(e, p) or self.leq(p, e) for p in at)}

    def maxima(self, hashes: Iterable[str]) -> set[str]:
        own = set(hashes)
        return {x for x in own if not any(x != y and self.leq(x, y) for y in own)}

    def frontier(self) -> set[str]:
        return set(self.at) - {p for ps in self.prev.values() for p in ps}

    def meet(self, positions: list[Iterable[str]]) -> set[str]:
        if not positions:
            return set()
        return self.maxima(set.intersection(*(self.hist(p) for p in positions)))

    def extends(self, end: Iterable[str], start: Iterable[str]) -> bool:
        return set(start) <= self.hist(end)
