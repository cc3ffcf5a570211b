"""The life of events as a stream: state by event, corrections that come late, expiry by timers; and the feed's live periods.

A report may arrive at any time within the watermark's delay and in any order. What an event's state keeps of its reports (the
newest action, the newest end that was named, all zones) doesn't depend on the order of arrival, so the stream's last row of an event equals
``merge.event_states`` over all its reports, whatever the batches and across restarts.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.merge import ENDING

#: Times are microseconds: a worker's times have a zone in state and none in rows.
_OUT = "key string, active boolean, ends long, zones array<string>, last_action string, version long, expired boolean"
_STATE = "issued long, number long, action string, ends_issued long, ends_number long, ends long, version long, expired boolean"


class Life(StatefulProcessor):
    """One row out for each batch that touches an event, and one when its end passes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", _STATE)
        self.zones = handle.getMapState("zones", "zone string", "seen boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        old = self.state.get() if self.state.exists() else (None, None, None, None, None, None, 0, False)
        newest, action, named, ends, version = (old[0], old[1]), old[2], (old[3], old[4]), old[5], old[6]
        for row in rows:
            place = (row.at, row.number)
            if newest[0] is None or place > newest:
                newest, action = place, row.action
            if row.until is not None and (named[0] is None or place > named):
                named, ends = place, row.until
            for zone in row.zones or ():
                if zone is not None and not self.zones.containsKey((zone,)):
                    self.zones.updateValue((zone,), (True,))
        yield self.keep(key, newest, action, named, ends, version + 1, self.past(ends, timerValues))

    def past(self, ends, timerValues) -> bool:
        return ends is not None and ends // 1000 <= timerValues.getCurrentWatermarkInMs()

    def keep(self, key: tuple, newest, action, named, ends, version: int, expired: bool) -> Row:
        self.state.update((*newest, action, *named, ends, version, expired))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        over = action in ENDING and action != "UPG"
        if ends is not None and not over and not expired:
            self.handle.registerTimer(ends // 1000)
        zones = sorted(k[0] for k in self.zones.keys())
        return Row(key=key[0], active=not over and not expired, ends=ends, zones=zones, last_action=action, version=version, expired=expired)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        issued, number, action, ends_issued, ends_number, ends, version, _ = self.state.get()
        yield self.keep(key, (issued, number), action, (ends_issued, ends_number), ends, version + 1, True)

    def close(self) -> None:
        pass


def event_lives(reports: DataFrame, late: str = "6 hours") -> DataFrame:
    """A row of (key, active, ends, zones, last_action, version, expired) whenever an event changes; the highest version of a key is its state.

    reports: a stream of (key, issued, number, action, ends, zones); number settles reports of one time. An event is active until a cancellation or
    expiry is its newest report or the watermark passes its end; a later extension, or a correction that arrives late, makes it active again.
    The state store must be RocksDB. Reports older than the watermark are dropped; null zones are none; a null key is a key.
    """
    rows = reports.select("key", "issued", F.unix_micros("issued").alias("at"), "number", "action", F.unix_micros("ends").alias("until"), "zones").withWatermark("issued", late)
    lives = rows.groupBy("key").transformWithState(Life(), outputStructType=_OUT, outputMode="Update", timeMode="EventTime")
    return lives.withColumn("ends", F.timestamp_micros("ends"))


def live_periods(flashes: DataFrame, feed: str, time: str, quiet: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(feed, live_from, live_until, n): when each feed had a flash within ``quiet``. Sessions are merged in each partition before the shuffle, so a feed's flashes don't meet as rows."""
    flashes.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    periods = flashes.withWatermark(time, late).groupBy(F.session_window(time, quiet), feed).agg(F.count("*").alias("n"))
    return periods.select(feed, F.col("session_window.start").alias("live_from"), F.col("session_window.end").alias("live_until"), "n")
