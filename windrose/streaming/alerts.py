"""Incremental jobs: deduplicated flashes, rolling counts and session alerts, all on event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState


def exactly_once(flashes: DataFrame, keys: list[str], time: str, late: str = "30 minutes") -> DataFrame:
    """One row for each natural key; state is dropped when the watermark passes."""
    return flashes.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def rolling_counts(flashes: DataFrame, key: str, time: str, width: str = "30 minutes", step: str = "5 minutes", late: str = "30 minutes") -> DataFrame:
    windowed = flashes.withWatermark(time, late).groupBy(F.window(time, width, step), key).agg(F.count("*").alias("n"), F.max(time).alias("last"))
    return windowed.select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "last")


def alert_sessions(flashes: DataFrame, key: str, time: str, gap: str = "15 minutes", late: str = "30 minutes") -> DataFrame:
    """An alert at a session's first flash and its all-clear ``gap`` after the last."""
    sessions = flashes.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return sessions.select(key, F.col("session_window.start").alias("alert_at"), F.col("session_window.end").alias("clear_at"), "n")


SENT = "key string, type string, sent timestamp"


def cooldown(alerts: DataFrame, minutes: int = 15, late: str = "30 minutes") -> DataFrame:
    """Alerts (key, type, at) that go out: none within ``minutes`` of the last of its key and type, across batches and restarts.

    The state is the last time sent; it is dropped when the watermark has passed its wait. An alert older than the last
    sent is too late and goes nowhere.
    """
    wait = pd.Timedelta(minutes=minutes)

    def send(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        out = []
        for at in sorted(t for batch in batches for t in batch["at"]):
            if last is None or at >= last + wait:
                last = at
                out.append((*name, at))
        if last is not None:
            state.update((int(last.value // 1000),))
            state.setTimeoutTimestamp(max(int((last + wait).value // 1_000_000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "type", "sent"])

    rows = alerts.select("key", "type", "at").withWatermark("at", late)
    return rows.groupBy("key", "type").applyInPandasWithState(send, SENT, "last long", "append", "EventTimeTimeout")


def all_clears(alerts: DataFrame, clears: DataFrame, as_of: Column, quiet: str = "15 minutes", back: str = "30 minutes") -> DataFrame:
    """Keys to clear at a time: alerted within ``back`` and not within ``quiet``, and not cleared since. Tables of (key, at)."""
    last = alerts.where(F.col("at") <= as_of).groupBy("key").agg(F.max("at").alias("last"))
    done = clears.groupBy("key").agg(F.max("at").alias("cleared"))
    due = last.where((F.col("last") >= as_of - F.expr(f"interval {back}")) & (F.col("last") <= as_of - F.expr(f"interval {quiet}")))
    return due.join(done, "key", "left").where("cleared is null or cleared < last").select("key", "last")


def live_or_proxy(flashes: DataFrame, sites: DataFrame, as_of: Column, proxy: str, within: str = "10 minutes") -> DataFrame:
    """Sites with ``source``: the feed if it has any flash lately, else the column ``proxy`` from warnings."""
    live = flashes.where((F.col("at") > as_of - F.expr(f"interval {within}")) & (F.col("at") <= as_of)).agg((F.count("*") > 0).alias("live"))
    return sites.crossJoin(F.broadcast(live)).withColumn("source", F.when(F.col("live"), "feed").otherwise(F.col(proxy)))
