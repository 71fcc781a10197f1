"""Grades as a stream: term weights kept as state, one clamped fold for each term."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.feedback import BASE_TERM, DECAY, MAX_TERM, REWARD


def stream_term_weights(events: DataFrame) -> DataFrame:
    """(term, w) updates of a stream of events (ts, q, label); within a micro-batch events fold in the order of ts."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    change = F.when(F.col("label") == "good", F.lit(REWARD)).otherwise(F.lit(-DECAY))
    rows = events.select("ts", change.alias("d"), F.explode(F.array_distinct(T.terms(F.coalesce("q", F.lit(""))))).alias("term"))

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        w = state.get[0] if state.exists else BASE_TERM
        for d in pd.concat(list(batches)).sort_values(["ts", "d"])["d"]:
            w = max(BASE_TERM, min(MAX_TERM, w + d))
        state.update((w,))
        yield pd.DataFrame({"term": [key[0]], "w": [w]})

    return rows.groupBy("term").applyInPandasWithState(fold, "term string, w double", "w double", "update", GroupStateTimeout.NoTimeout)


def stream_event_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Grades a window, with a watermark; events: time, label."""
    return events.withWatermark("time", late).groupBy(F.window("time", width), "label").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "label", "n")
