"""Series of observations as a stream: counts by event-time window, and persistence of requirements kept up to date."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkyard.operators.detections import MIN_OBSERVATIONS, PERSISTENCE


def windowed_counts(stream: DataFrame, ts: str, keys: list[str], width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Rows per key and event-time window; rows later than ``late`` behind the newest are left out."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def distinct_observations(stream: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once, however often it is delivered within ``late``."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def running_persistence(stream: DataFrame, seconds: float | None = None, least: int = MIN_OBSERVATIONS, ratio: float = PERSISTENCE) -> DataFrame:
    """After each batch the persistence of each requirement of the series it touched; the same rule as the batch operator's.

    ``stream``: series (string), obs_no (bigint), ts (timestamp), id, bucket. State of a series: its observations of the last ``seconds``
    (null: all) with their missing and uncertain requirements, so it is as large as one window.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {(n, t): (set(m), set(u)) for n, t, m, u in zip(*state.get)} if state.exists else {}
        for f in frames:
            for n, t, i, b in zip(f["obs_no"], f["ts"].astype("int64") // 1000, f["id"], f["bucket"]):
                missing, unsure = held.setdefault((int(n), int(t)), (set(), set()))
                if b == "missing":
                    missing.add(i)
                elif b == "uncertain":
                    unsure.add(i)
        if seconds is not None and held:
            last = max(t for _, t in held)
            held = {k: v for k, v in held.items() if last - k[1] <= seconds * 1e6}
        order = sorted(held)
        state.update(([k[0] for k in order], [k[1] for k in order], [sorted(held[k][0]) for k in order], [sorted(held[k][1]) for k in order]))
        n, rows = len(held), []
        for i in sorted({x for m, u in held.values() for x in m | u}):
            m, u = (sum(i in v[k] for v in held.values()) for k in (0, 1))
            kind = "insufficient_data" if n < least else "persistent_missing" if m / n >= ratio else "persistent_uncertain" if u and (m + u) / n >= ratio else "transient"
            rows.append((key[0], i, n, m, u, kind))
        yield pd.DataFrame(rows, columns=["series", "id", "n", "missing_n", "uncertain_n", "state"])

    return stream.groupBy("series").applyInPandasWithState(
        update,
        "series string, id string, n long, missing_n long, uncertain_n long, state string",
        "obs array<long>, ts array<long>, missing array<array<string>>, uncertain array<array<string>>",
        "update",
        GroupStateTimeout.NoTimeout,
    )
