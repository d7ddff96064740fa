"""Causal-order ingest and streamed projection.

Entries arrive in any order. An entry is passed on once all its predecessors have been;
until then it waits in its log's state, however late they come. Nothing is dropped for
lateness: a late entry is simply concurrent with what came before it.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "dag_id string, hash string, prev array<string>, payload string, place long, waiting long"
STATE = "applied array<string>, pending string"


def release_ready(applied: set[str], pending: dict[str, tuple[list[str], str]]) -> list[str]:
    """Hashes of ``pending`` that can be applied now, in causal order; they move to ``applied``."""
    after: dict[str, list[str]] = {}
    lacking = {}
    for h, (prev, _) in pending.items():
        need = {p for p in prev if p not in applied}
        lacking[h] = len(need)
        for p in need:
            after.setdefault(p, []).append(h)
    ready, out = deque(sorted(h for h, n in lacking.items() if n == 0)), []
    while ready:
        h = ready.popleft()
        out.append(h)
        applied.add(h)
        for s in sorted(after.get(h, [])):
            lacking[s] -= 1
            if lacking[s] == 0:
                ready.append(s)
    return out


def causal_apply(entries: DataFrame, accept: Callable[[str], bool] | None = None) -> DataFrame:
    """A stream of applied entries with their place in the log and how many still wait.

    ``accept`` judges a payload; a refused entry is not applied, so that its successors
    wait for ever, as they would for one that never came.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            old = state.get
            applied, order = set(old[0]), list(old[0])
            pending = {h: (p, x) for h, p, x in json.loads(old[1])}
        else:
            applied, order, pending = set(), [], {}
        for pdf in batches:
            for h, prev, payload in zip(pdf["hash"], pdf["prev"], pdf["payload"]):
                if h not in applied and h not in pending and (accept is None or accept(payload)):
                    pending[h] = (list(prev) if prev is not None else [], payload)
        rows: list[Any] = []
        for h in release_ready(applied, pending):
            prev, payload = pending.pop(h)
            rows.append((key[0], h, prev, payload, len(order)))
            order.append(h)
        state.update((order, json.dumps([(h, p, x) for h, (p, x) in pending.items()])))
        if rows:
            yield pd.DataFrame([(*r, len(pending)) for r in rows], columns=["dag_id", "hash", "prev", "payload", "place", "waiting"])

    keyed = entries.select(F.col("dag_id").cast("string").alias("dag_id"), "hash", "prev", "payload")
    return keyed.groupBy("dag_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def project_stream(applied: DataFrame, resolve: Callable[[DataFrame], DataFrame], target: Any, checkpoint: str) -> Any:
    """Write a stream's projection: each micro-batch's rows are upserted by ``target``
    (``operators.projection.Snapshot``), once per batch even when it is repeated."""

    def each(batch: DataFrame, number: int) -> None:
        if target.batch() < number:
            target.upsert(resolve(batch), number)

    return applied.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
