"""Cadence buckets over streams: the same aggregates as in batch, and stateful accumulators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def bucketed(events: DataFrame, cadence: str, key: str = "event_type", ts: str = "ts", value: str = "value", late: str | None = None) -> DataFrame:
    """key, start, n, total, low and high of tumbling buckets, for batch or stream; late: the watermark's delay."""
    if late:
        events = events.withWatermark(ts, late)
    x = F.col(value)
    out = events.groupBy(F.window(ts, cadence).alias("w"), key).agg(F.count("*").alias("n"), F.sum(x).alias("total"), F.min(x).alias("low"), F.max(x).alias("high"))
    return out.select(key, F.col("w.start").alias("start"), "n", "total", "low", "high")


def running_moments(events: DataFrame, key: str = "event_type", value: str = "value") -> DataFrame:
    """n, mean and m2 of each key after every batch, by the pairwise merge of the batch's own moments."""

    def update(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
        for pdf in parts:
            x = pdf[value].dropna()
            if len(x):
                k_, m_ = len(x), float(x.mean())
                d = m_ - mean
                m2 += float(((x - m_) ** 2).sum()) + d * d * n * k_ / (n + k_)
                mean += d * k_ / (n + k_)
                n += k_
        state.update((n, mean, m2))
        yield pd.DataFrame({key: [k[0]], "n": [n], "mean": [mean], "m2": [m2]})

    return events.groupBy(key).applyInPandasWithState(update, f"{key} string, n long, mean double, m2 double", "n long, mean double, m2 double", "update", GroupStateTimeout.NoTimeout)
