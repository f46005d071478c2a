"""Event streams: windowed counts with late data, duplicates within the watermark, and keyed last-seen state.

These are Spark conveniences beside the nightly state, not operators of their own. ``ts`` without a zone is cast once, since a
watermark needs a timestamp.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events by window and type; works on a table and on a stream."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("at", late) if timed.isStreaming else timed
    return timed.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def first_of_each(events: DataFrame, keys: list[str], late: str = "2 days") -> DataFrame:
    """Duplicates of a key dropped, within the watermark on a stream."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    return timed.withWatermark("at", late).dropDuplicatesWithinWatermark(keys) if timed.isStreaming else timed.dropDuplicates(keys)


def last_seen(events: DataFrame) -> DataFrame:
    """ST1 as keyed state: each user's number of events and last time, updated with every micro-batch."""

    def update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, 0)
        for pdf in batches:
            n, last = n + len(pdf), max(last, int(pdf["at"].max().timestamp()))
        state.update((n, last))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last": [last]})

    timed = events.select("user_id", F.col("ts").cast("timestamp").alias("at"))
    return timed.groupBy("user_id").applyInPandasWithState(update, "user_id bigint, n bigint, last bigint", "n bigint, last bigint", "update", "NoTimeout")
