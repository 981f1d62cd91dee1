"""Watching the sources' weeks with state that outlives restarts: stale deliveries, one alert a missing week."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from datetime import date, datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

VERDICTS = "source string, d date, n long, verdict string"
ALERTS = "source string, week date, due timestamp"
WEEK = timedelta(days=7)
#: How long a source's weeks are remembered, by their own dates: only the week before and the week
#: itself matter, the others leave room for deliveries that come late.
REMEMBERED = 8 * WEEK
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """State by key needs the RocksDB store; the session's own choice comes back afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


class Deliveries(StatefulProcessor):
    """Judges each delivered week of a source by what it delivered before.

    stale: the same rows as the stored week before; shrunk: fewer rows than the stored delivery of
    this week; unchanged: the same as it; else stored, and remembered until weeks that much later
    come.  (Spark's own expiry goes by processing time, which would tie verdicts to when a stream
    runs, and keeps a stream with an end from ending.)
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.weeks = handle.getMapState("weeks", "d date", "n long, hash string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows))  # a source's deliveries of one batch: a short row a week
        out = []
        for d, n, digest in table.sort_values(["d", "n", "hash"])[["d", "n", "hash"]].itertuples(index=False):
            own = self.weeks.getValue((d,)) if self.weeks.containsKey((d,)) else None
            before = self.weeks.getValue((d - WEEK,)) if self.weeks.containsKey((d - WEEK,)) else None
            if before is not None and before[1] == digest:
                verdict = "stale"
            elif own is not None and n < own[0]:
                verdict = "shrunk"
            elif own is not None and digest == own[1]:
                verdict = "unchanged"
            else:
                verdict = "stored"
                self.weeks.updateValue((d,), (int(n), digest))
            out.append((key[0], d, int(n), verdict))
        known = [week for (week,) in self.weeks.keys()]
        for week in known:
            if week < max(known) - REMEMBERED:
                self.weeks.removeKey((week,))
        yield pd.DataFrame(out, columns=["source", "d", "n", "verdict"])

    def close(self) -> None:
        pass


class Alarms(StatefulProcessor):
    """One alert a source and week that has not been delivered when its Tuesday begins.

    Each row (at, d) says that time has come to ``at`` and, if d is not null, that week d was
    delivered then; later than its Tuesday is too late, in whatever batch it comes.  A timer stands at the Tuesday of every week that time has come to; what a week has
    had, a delivery or an alert, is remembered, so that no restart tells it again.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getMapState("settled", "week date", "how string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        for table in rows:
            for d, at in table[["d", "at"]].dropna().itertuples(index=False):
                if _tuesday_ms(d + REMEMBERED) > now and at.timestamp() * 1000 < _tuesday_ms(d):
                    self.settled.updateValue((d,), ("delivered",))
            for monday in {at.date() - timedelta(days=at.weekday()) for at in table["at"]}:
                due = _tuesday_ms(monday)
                if not self.settled.containsKey((monday,)):
                    self.handle.registerTimer(max(due, now + 1))
                    self.settled.updateValue((monday,), ("awaited",))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        for (week,), (how,) in list(self.settled.iterator()):
            if how == "awaited" and _tuesday_ms(week) <= now:
                self.settled.updateValue((week,), ("alerted",))
                out.append((key[0], week, datetime.fromtimestamp(_tuesday_ms(week) / 1000, timezone.utc).replace(tzinfo=None)))
            elif _tuesday_ms(week + REMEMBERED) <= now:
                self.settled.removeKey((week,))  # rows of that time are behind the watermark and come no more
        if out:
            yield pd.DataFrame(out, columns=["source", "week", "due"])

    def close(self) -> None:
        pass


def _tuesday_ms(monday: date) -> int:
    return int(datetime(monday.year, monday.month, monday.day, tzinfo=timezone.utc).timestamp() * 1000) + 24 * 3600 * 1000


def judged(deliveries: DataFrame) -> DataFrame:
    """Streamed deliveries (source, d, n, hash; d a Monday) with their verdicts; state by source, without what is long past."""
    rows = deliveries.select("source", "d", F.col("n").cast("long").alias("n"), "hash")
    return rows.groupBy("source").transformWithStateInPandas(Deliveries(), VERDICTS, "Update", "None")


def alerts(seen: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Streamed rows (source, at, d) as alerts (source, week, due), one a missing week; ``late`` is the watermark's delay."""
    rows = seen.select("source", F.col("at").cast("timestamp").alias("at"), "d").withWatermark("at", late)
    return rows.groupBy("source").transformWithStateInPandas(Alarms(), ALERTS, "Append", "EventTime")


def stale_weeks(hashes: DataFrame) -> DataFrame:
    """The same question about a whole archive (source, d, hash): weeks whose rows are those of the Monday before.

    An equi-join of short rows, a week a source, instead of one ordered window over all.
    """
    before = hashes.select("source", F.date_add("d", 7).alias("d"), F.col("hash").alias("before"))
    return hashes.join(before, ["source", "d"]).where("hash = before").select("source", "d")
