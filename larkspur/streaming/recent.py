"""The last value of each key on a stream, for as long as it lives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import TimestampNTZType

#: State of many keys lies in RocksDB, which ``transformWithState`` needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Milliseconds of the first and last event time: a watermark starts at 1970 and drops rows up to there, and workers hold no time after 2262. Other times count as these, for lateness alone.
FIRST, LAST = 1, 9_223_372_036_000


class Recent(StatefulProcessor):
    """Answers each row with the one before it of its key, unless that is older than ``lives`` milliseconds; a timer drops what has outlived it.

    Rows without a time come last and meet nothing; of one time those without an id come last.
    """

    def __init__(self, lives: int) -> None:
        self.lives = lives

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, id long, anonymous boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = list(rows)
        timeless, at, anonymous, ids = (np.concatenate([p[c].to_numpy() for p in parts]) for c in ("timeless", "at", "anonymous", "id"))
        order = np.lexsort((ids, anonymous, at, timeless))
        at, anonymous, ids = at[order], anonymous[order].astype(bool), ids[order]
        timed = len(order) - int(timeless.sum())
        hit, served, unnamed = np.zeros(len(order), dtype=bool), np.roll(ids, 1), np.roll(anonymous, 1)
        hit[1:timed] = np.diff(at[:timed]) <= self.lives
        if timed:
            if self.last.exists():
                before, served[0], unnamed[0] = self.last.get()
                hit[0] = at[0] - before <= self.lives
                self.handle.deleteTimer(max(before, FIRST) + self.lives + 1)
            newest = int(at[timed - 1])
            self.last.update((newest, int(ids[timed - 1]), bool(anonymous[timed - 1])))
            self.handle.registerTimer(max(newest, FIRST) + self.lives + 1)
        named = pd.arrays.IntegerArray  # not doubles, which lose digits of large ids
        keys = named(np.full(len(order), key[1]), np.full(len(order), key[0], dtype=bool))
        yield pd.DataFrame({"key": keys, "id": named(ids, anonymous), "hit": hit, "served": named(served, unnamed | ~hit)})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def millis(events: DataFrame, time: str) -> Column:
    """Milliseconds from 1970; a time without a zone is one of UTC, whatever the zone of the session."""
    if not isinstance(events.schema[time].dataType, TimestampNTZType):
        return F.unix_millis(F.col(time).cast("timestamp"))
    since = F.col(time) - F.expr("timestamp_ntz '1970-01-01 00:00:00'")
    part = lambda unit: F.extract(F.lit(unit), since).cast("decimal(18,6)")
    return F.floor(((part("DAYS") * 24 + part("HOURS")) * 60 + part("MINUTES")) * 60_000 + part("SECONDS") * 1000).cast("long")


def recent(events: DataFrame, time: str, key: str, id_col: str, lives_ms: int, late: str = "1 hour") -> DataFrame:
    """(key, id, hit, served): whether the row before each row of a key is ``lives_ms`` old at most, and its id.

    Rows later than ``late`` behind the newest are dropped, for which rows without a time count as of 1970; rows of a key come in order of time, then id, within a batch.
    Rows without a key are a key of their own. Nulls travel as marks, as workers would turn numbers beside nulls into doubles.
    """
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    at = F.coalesce(millis(events, time), F.lit(0))
    own = events.select(
        F.col(key).isNull().alias("keyless"), number(key).alias("key"), F.col(time).isNull().alias("timeless"), at.alias("at"),
        F.col(id_col).isNull().alias("anonymous"), number(id_col).alias("id"), F.timestamp_millis(F.greatest(F.lit(FIRST), F.least(F.lit(LAST), at))).alias("_t"),
    ).withWatermark("_t", late)
    return own.groupBy("keyless", "key").transformWithStateInPandas(Recent(lives_ms), "key long, id long, hit boolean, served long", "append", "eventTime")
