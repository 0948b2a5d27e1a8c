"""Demand and reallocation events as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def hourly_demand(trips: DataFrame, late: str = "30 minutes") -> DataFrame:
    """(begin, end, o, d, w) by the hour of trips (ts, o, d); trips later than ``late`` behind the newest are dropped."""
    hour = F.window("ts", "1 hour")
    own = trips.withWatermark("ts", late).groupBy(hour.alias("hour"), "o", "d").agg(F.count(F.lit(1)).cast("double").alias("w"))
    return own.select(F.col("hour.start").alias("begin"), F.col("hour.end").alias("end"), "o", "d", "w")


def replay(events: DataFrame) -> DataFrame:
    """(u, v, k, lanes_remaining) after each batch of events (u, v, k, lanes_total, event_type): a lane taken is one
    less, never below none, and a mark as not reallocatable leaves none. The state is one number for each segment."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        left = state.get[0] if state.exists else None
        for f in frames:
            for total, kind in zip(f["lanes_total"], f["event_type"]):
                left = int(total) if left is None else left
                left = 0 if kind == "marked_segment_not_reallocatable" else max(0, left - 1)
        if left is not None:
            state.update((left,))
            yield pd.DataFrame({"u": [key[0]], "v": [key[1]], "k": [key[2]], "lanes_remaining": [left]})

    out = "u long, v long, k long, lanes_remaining int"
    return events.groupBy("u", "v", "k").applyInPandasWithState(step, out, "lanes_remaining int", "update", GroupStateTimeout.NoTimeout)
