"""The view counter as a stream: the same gate as feed.view_counts, with its state kept by Spark [T5]."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "slug string, client string, at timestamp"


def counted_views(events: DataFrame, slug: str, client: str, at: str, hours: int = 12, late: str = "1 hour") -> DataFrame:
    """Views that count, each once its time is certain: a view waits until no earlier one can come (`late` behind the newest), so late views are judged in
    their order and the outcome is that of the batch. State of a client who stays away twice the gate is dropped."""
    gap = int(pd.Timedelta(hours=hours).total_seconds() * 1_000_000)
    stream = events.select(F.col(slug).cast("string").alias("slug"), F.col(client).cast("string").alias("client"), F.col(at).cast("timestamp").alias("at")).dropna().withWatermark("at", late)

    def gate(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = state.get if state.exists else (None, [])
        sure = state.getCurrentWatermarkMs() * 1000
        waiting = sorted([*waiting, *[int(t.value // 1000) for f in frames for t in f["at"]]])
        taken = []
        while waiting and waiting[0] <= sure:
            t = waiting.pop(0)
            if last is None or t - last > gap:
                taken.append(t)
                last = t
        if waiting:
            state.update((last, waiting))
            state.setTimeoutTimestamp(max(waiting[0], sure) // 1000 + 1)
        elif last is None or last + 2 * gap <= sure:
            state.remove() if state.exists else None
        else:
            state.update((last, []))
            state.setTimeoutTimestamp(max(last + 2 * gap, sure) // 1000 + 1)
        if taken:
            yield pd.DataFrame({"slug": key[0], "client": key[1], "at": pd.to_datetime(taken, unit="us")})

    return stream.groupBy("slug", "client").applyInPandasWithState(gate, OUT, "last long, waiting array<long>", "append", GroupStateTimeout.EventTimeTimeout)
