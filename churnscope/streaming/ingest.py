"""Micro-batches of change rows merged into additive tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from churnscope.operators.snapshots import upsert_accumulate
from churnscope.sources.store import Store

CHURN_SUMS = ("commits", "total_added", "total_deleted", "recent_added", "recent_deleted", "total_churn", "recent_churn")


def merge_into(store: Store, name: str, key: list[str], sums=(), lows=(), highs=()) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: merges a batch's aggregate into a table once per epoch.

    The epoch is kept with the version, so a batch that is run again after a failure
    changes nothing.
    """
    def run(batch: DataFrame, epoch: int) -> None:
        if store.epoch(name) >= epoch:
            return
        old = store.read(name) if store.exists(name) else batch.limit(0)
        store.write(name, upsert_accumulate(old, batch, key, sums, lows, highs), epoch)

    return run
