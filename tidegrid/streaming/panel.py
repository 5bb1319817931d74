"""Dense panels with lags on a stream: each key's last bins are kept as state (an extension)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegrid.functions.timebins import epoch, from_epoch

_STATE = "bins array<bigint>, counts array<bigint>, next bigint, history array<bigint>"


def stream_panel(events: DataFrame, key: str, ts: str, seconds: int = 3600, late: str = "1 hour", lags: Sequence[int] = (1, 2, 3, 24)) -> DataFrame:
    """(key, bin, demand, lag_k...): every bin of each key from its first one on, once the watermark has passed its end.

    A key's state is its open bins and the counts of its last ``max(lags)`` closed ones, so it doesn't grow with the stream.
    Rows are counted in the bin they belong to however they are shuffled, as long as they are at most ``late`` behind the
    latest; later ones are left out. A bin without rows has demand 0, a lag before a key's first bin is null. Rows without key or
    time are left out. Closed bins never change, so the output appends.
    """
    keep = max(lags, default=0)
    names = [f"lag_{k}" for k in lags]

    def run(of: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bins, counts, following, history = state.get if state.exists else ([], [], None, [])
        open_ = dict(zip(bins, counts, strict=True))
        history = list(history)
        if not state.hasTimedOut:
            for part in parts:
                for b, n in part["s"].value_counts().items():
                    if following is None or b >= following:
                        open_[int(b)] = open_.get(int(b), 0) + int(n)
        closed = state.getCurrentWatermarkMs() // 1000  # bins that end here or before
        out = []
        at = following if following is not None else min(open_, default=None)
        while at is not None and at + seconds <= closed:
            demand = open_.pop(at, 0)
            out.append((of[0], at, float(demand), *[float(history[-k]) if k <= len(history) else None for k in lags]))
            history = [*history, demand][-keep:] if keep else []
            at += seconds
            following = at
        state.update((list(open_), list(open_.values()), following, history))
        if at is not None:
            state.setTimeoutTimestamp(max((at + seconds) * 1000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=[key, "s", "demand", *names]).astype({n: "float64" for n in ["demand", *names]})

    kind = dict(events.dtypes)[key]
    rows = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    rows = rows.select(key, "_at", (F.floor(epoch(ts) / F.lit(seconds)) * seconds).alias("s"))
    schema = f"`{key}` {kind}, s bigint, demand double" + "".join(f", {n} double" for n in names)
    found = rows.groupBy(key).applyInPandasWithState(run, schema, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(key, from_epoch(F.col("s")).alias("bin"), "demand", *names)
