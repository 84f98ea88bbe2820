"""Streams with keyed state and event-time timers: settlement of predictions, snapshots hidden until their session ends.

State is kept per key, so a batch's work follows the keys it brings and those
whose timers are due.  What is on or before the watermark is final: Spark drops
rows that come later than that, and results wait for it.  State is kept by
RocksDB under the checkpoint, where a restart finds it.
"""

from __future__ import annotations

import contextlib
import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
EPOCH = dt.date(1970, 1, 1)


@contextlib.contextmanager
def _keyed_state(spark: SparkSession):
    """RocksDB as the state store of the streams that start meanwhile."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def append(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run ``stream`` over all that is available now and append its rows to a Parquet table; the table so far is returned.

    Run again with the same checkpoint, it goes on where it stopped; the table's
    log of files keeps rows of a batch that failed half-way out of it.
    """
    spark = stream.sparkSession
    with _keyed_state(spark):
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _days(x: pd.Series) -> np.ndarray:
    return x.to_numpy().astype("datetime64[D]").astype(np.int64)


def _dates(days: np.ndarray) -> list[dt.date]:
    return days.astype("datetime64[D]").tolist()


def _date(day: int) -> dt.date:
    return EPOCH + dt.timedelta(days=int(day))


class Settlement(StatefulProcessor):
    """One symbol's closes that may still matter and its open predictions.

    A prediction is settled at the ``h``-th bar after its date once that bar's
    date is final; only bars with a positive close count.  It needs a bar on its
    own date: one whose date is final without a bar is dropped.  Of two bars of
    one date the later batch's counts, within a batch the one with the larger
    close.  Kept are bars that are not final, and those since the oldest open
    prediction: about ``h`` and the delay, however long the series is.
    """

    def __init__(self, h: int):
        self.h = h

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "days array<long>, closes array<double>, waiting array<long>")

    def _settled(self, key, days: np.ndarray, closes: np.ndarray, waiting: np.ndarray, final: int) -> Iterator[pd.DataFrame]:
        """Settle what is final, keep the rest, and come back at the next settlement that is known."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        good = closes > 0
        at, value = days[good], closes[good]
        place = np.searchsorted(at, waiting)
        found = (place < len(at)) & (at[np.minimum(place, len(at) - 1)] == waiting) if len(at) else np.zeros(len(waiting), bool)
        known = found & (place + self.h < len(at))
        end = np.where(known, at[np.minimum(place + self.h, len(at) - 1)], np.iinfo(np.int64).max) if len(at) else np.full(len(waiting), np.iinfo(np.int64).max)
        done, lost = end <= final, ~found & (waiting <= final)
        if done.any():
            realized = np.log(value[place[done] + self.h] / value[place[done]])
            yield pd.DataFrame({"symbol": key[0], "as_of": _dates(waiting[done]), "realized": realized, "settled_at": _dates(end[done])})
        left = ~done & ~lost
        waiting, end = waiting[left], end[left]
        need = (days > final) | (days >= (waiting.min() if len(waiting) else final + 1))
        if need.any() or len(waiting):
            self.held.update((days[need].tolist(), closes[need].tolist(), waiting.tolist()))
            due = np.minimum(end, np.where(np.isin(waiting, at), np.iinfo(np.int64).max, waiting)).min(initial=np.iinfo(np.int64).max)
            if due < np.iinfo(np.int64).max:
                self.handle.registerTimer(int(due) * DAY_MS - 1)
        else:
            self.held.clear()

    def _load(self):
        days, closes, waiting = self.held.get() if self.held.exists() else ((), (), ())
        return np.array(days, np.int64), np.array(closes, float), np.array(waiting, np.int64)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        days, closes, waiting = self._load()
        new = pd.concat(list(rows))
        asked = new["asked"].to_numpy(bool)
        bars = new[~asked].sort_values("close")
        held = dict(zip(days.tolist(), closes.tolist(), strict=True)) | dict(zip(_days(bars["at"]).tolist(), bars["close"].tolist(), strict=True))
        days = np.array(sorted(held), np.int64)
        closes = np.array([held[d] for d in days.tolist()], float)
        waiting = np.union1d(waiting, _days(new["at"][asked])).astype(np.int64)
        yield from self._settled(key, days, np.nan_to_num(closes), waiting, timerValues.getCurrentWatermarkInMs() // DAY_MS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settled(key, *self._load(), timerValues.getCurrentWatermarkInMs() // DAY_MS)

    def close(self) -> None:
        pass


SETTLED = "symbol string, as_of date, realized double, settled_at date"


def stream_settle(bars: DataFrame, predictions: DataFrame, path: str, checkpoint: str, *, h: int = 5, delay: str = "7 days") -> DataFrame:
    """(symbol, as_of, realized, settled_at) of the predictions settled so far, from streams of bars and of predictions.

    ``bars`` has symbol, bar_date and close, ``predictions`` symbol and as_of.
    Rows may come up to ``delay`` behind the newest of their stream, in any
    order; the watermark is that of the slower stream.  What is settled stays.
    Rows without symbol or date are left out.
    """
    one = bars.select("symbol", F.col("bar_date").cast("timestamp").alias("at"), F.col("close").cast("double").alias("close"), F.lit(False).alias("asked")).withWatermark("at", delay)
    two = predictions.select("symbol", F.col("as_of").cast("timestamp").alias("at"), F.lit(None).cast("double").alias("close"), F.lit(True).alias("asked")).withWatermark("at", delay)
    both = one.unionByName(two).filter("symbol is not null and at is not null")
    return append(both.groupBy("symbol").transformWithStateInPandas(Settlement(h), SETTLED, "Append", "EventTime"), path, checkpoint)


class Snapshots(StatefulProcessor):
    """The newest write of each key and date of a group of keys, not shown before the session is over.

    At the session's end the newest write so far is shown; a newer one that
    comes later is shown as it comes.  Once the watermark is past what was
    shown, all that can still come is newer, and nothing has to be kept.  A
    group has one state and one timer, so what a batch costs beside its rows
    follows the groups: keys and dates may have a write or two each.
    """

    def __init__(self, cut_off: str, kind: str):
        h, m, s = map(int, cut_off.split(":"))
        self.end, self.kind = ((h * 60 + m) * 60 + s) * 1000, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", f"keys array<{self.kind}>, days array<long>, created array<long>, written array<double>, shown array<boolean>")

    def _held(self) -> pd.DataFrame:
        keys, days, created, values, shown = self.newest.get() if self.newest.exists() else ([], [], [], [], [])
        return pd.DataFrame({"key": pd.Series(list(keys), dtype=object), "day": np.array(days, np.int64), "created_us": np.array(created, np.int64), "value": np.array(values, float), "shown": np.array(shown, bool)})

    def _shown(self, rows: pd.DataFrame, watermark: int) -> Iterator[pd.DataFrame]:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        end = rows["day"].to_numpy() * DAY_MS + self.end
        due = ~rows["shown"].to_numpy() & (end <= watermark)
        if due.any():
            out = rows[due]
            yield pd.DataFrame(
                {
                    "key": out["key"], "as_of": [_date(x) for x in out["day"]], "value": out["value"].astype(object).where(out["value"].notna(), None),
                    "created_at": pd.to_datetime(out["created_us"], unit="us", utc=True), "is_final": out["created_us"].to_numpy() >= end[due] * 1000,
                }
            )
        rows = rows.assign(shown=rows["shown"] | due)
        left = ~(rows["shown"] & (rows["created_us"] <= watermark * 1000)).to_numpy()
        rows, end = rows[left], end[left]
        if not len(rows):
            self.newest.clear()
            return
        values = [None if np.isnan(x) else x for x in rows["value"].tolist()]
        self.newest.update((rows["key"].tolist(), rows["day"].tolist(), rows["created_us"].tolist(), values, rows["shown"].tolist()))
        next_ms = np.where(rows["shown"], np.maximum(end, -(-rows["created_us"].to_numpy() // 1000)), end - 1)
        self.handle.registerTimer(int(next_ms.min()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["created_us", "value"]).drop_duplicates(["key", "day"], keep="last")
        new = new[["key", "day", "created_us", "value"]].assign(key=new["key"].astype(object), value=new["value"].astype(float), shown=False)
        both = pd.concat([new, self._held()])  # of one time what is held comes last, and stays
        both = both.sort_values("created_us", kind="stable").drop_duplicates(["key", "day"], keep="last")
        yield from self._shown(both, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._shown(self._held(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def stream_snapshots(writes: DataFrame, path: str, checkpoint: str, *, cut_off: str = "20:00:00", delay: str = "1 hour", groups: int = 256) -> DataFrame:
    """(key, as_of, value, created_at, is_final): every write shown so far, in a stream of writes (key, as_of, value, created_at).

    Nothing of a date is shown before its session's end (UTC); ``is_final``
    tells writes after the end from preliminary ones.  Of one time's writes the
    largest value counts.  Writes may come up to ``delay`` late; rows without
    key, date or time are left out.  State is kept by ``groups`` hashed groups of
    keys; a checkpoint goes on with the number it began with.
    """
    rows = writes.filter("key is not null and as_of is not null and created_at is not null").select("key", F.unix_date(F.col("as_of").cast("date")).cast("long").alias("day"), F.col("value").cast("double").alias("value"), F.col("created_at").cast("timestamp").alias("at"))
    rows = rows.withColumns({"created_us": F.unix_micros("at"), "of": F.pmod(F.xxhash64("key", "day"), F.lit(groups))}).withWatermark("at", delay)
    kind = dict(writes.dtypes)["key"]
    out = f"key {kind}, as_of date, value double, created_at timestamp, is_final boolean"
    return append(rows.groupBy("of").transformWithStateInPandas(Snapshots(cut_off, kind), out, "Append", "EventTime"), path, checkpoint)


def newest_shown(shown: DataFrame) -> DataFrame:
    """Per key and date what was shown last."""
    last = shown.groupBy("key", "as_of").agg(F.max_by(F.struct("value", "created_at", "is_final"), "created_at").alias("x"))
    return last.select("key", "as_of", "x.*")
