"""Structured Streaming: the user profile kept up to date, enrichment of a stream, windowed counts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..tables import own_folder

OUTPUT = "user_id string, event_id long, ts timestamp, review_cnt long, price_mean double, price_std double, cat_hist string, history string, late boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROWS_OUT = 10_000
"""So many rows at most are held before they are handed on."""
LOT = 1000
"""Milliseconds of event time whose rows of a user leave together."""
BATCH_BYTES = 256 << 20
STATE = "n long, n_price long, s_price long, q_price string, cats string, last string, newest_ts long, newest_id long"


def _cents(value: float | None) -> int | None:
    return None if value is None or pd.isna(value) else round(value * 100)


class Past:
    """One user's running sums: ``row`` is the profile before an event, ``add`` takes the event in."""

    def __init__(self, kept: tuple | None):
        n, n_price, s_price, q_price, cats, last, newest, newest_id = kept or (0, 0, 0, "0", "{}", "[]", -1, -1)
        self.n, self.n_price, self.s_price, self.q_price = n, n_price, s_price, int(q_price)
        self.cats, self.last, self.newest = json.loads(cats), json.loads(last), (newest, newest_id)

    def row(self) -> tuple:
        n, s = self.n_price, self.s_price
        spread = max(0, n * self.q_price - s * s) / (n * (n - 1)) if n > 1 else 0.0
        shares = ";".join(f"{c}:{k}" for c, k in self.cats.items())
        return self.n, s / n / 100 if n else None, spread**0.5 / 100, shares, ";".join(self.last)

    def add(self, micros: int, event_id: int, category: str | None, price: float | None) -> None:
        cents = _cents(price)
        if cents is not None:
            self.n_price, self.s_price, self.q_price = self.n_price + 1, self.s_price + cents, self.q_price + cents * cents
        self.n, self.newest = self.n + 1, max(self.newest, (micros, int(event_id)))
        name = category or "UNK"
        self.cats[name] = self.cats.get(name, 0) + 1
        self.last = [*self.last, f"{name}/{event_id}"][-3:]

    def kept(self) -> tuple:
        return self.n, self.n_price, self.s_price, str(self.q_price), json.dumps(self.cats), json.dumps(self.last), *self.newest


class PastProfile(StatefulProcessor):
    """Each event gets the profile of the events before it, at once.

    Within a micro-batch events are taken in the order of time and id. An event older than what the state
    has seen cannot change profiles already given out: it is counted from now on and flagged ``late``.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("profile", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame = pd.concat([f[["event_id", "ts", "category", "price"]] for f in rows]).sort_values(["ts", "event_id"], kind="stable")
        names = [part.split()[0] for part in OUTPUT.split(", ")]
        past, out = Past(self.state.get() if self.state.exists() else None), []
        for event_id, ts, category, value in zip(frame["event_id"], frame["ts"], frame["category"], frame["price"]):
            micros = ts.value // 1000
            out.append((key[0], event_id, ts, *past.row(), (micros, event_id) < past.newest))
            past.add(micros, event_id, category, value)
            if len(out) == ROWS_OUT:
                yield pd.DataFrame(out, columns=names)
                out = []
        self.state.update(past.kept())
        if out:
            yield pd.DataFrame(out, columns=names)

    def close(self) -> None:
        pass


class OrderedProfile(StatefulProcessor):
    """Each event waits until the watermark has passed its lot, and then leaves in the order of time and id with its profile.

    A user's waiting events are a list state of packs, one for each frame that came in, and the user has one timer of event time, at the end of the earliest lot
    of ``LOT`` milliseconds that waits: when it fires, all lots that the watermark has passed leave together, so calls to the state follow users
    and micro-batches, not events. With ``idle``, a user's profile is forgotten so many milliseconds of event time after the last event.
    """

    def __init__(self, idle: int | None = None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("profile", STATE)
        self.waiting = handle.getListState("waiting", "events binary")
        self.timer = handle.getValueState("timer", "at long")

    def _forgotten(self, newest: int) -> int:
        """When a profile whose newest event has these microseconds is forgotten, in milliseconds."""
        return (newest // 1000 + self.idle) // LOT * LOT + LOT

    def _wake(self, at: int) -> None:
        """Have the user's one timer stand at ``at`` at the latest."""
        now = self.timer.get()[0] if self.timer.exists() else None
        if now is None or at < now:
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        packs, first = [], None
        for frame in rows:
            micros = frame["ts"].astype("int64") // {"ns": 1000, "us": 1}[frame["ts"].dt.unit]
            packs.append((_packed(pd.DataFrame({"micros": micros, "event_id": frame["event_id"], "category": frame["category"], "price": frame["price"]})),))
            first = int(micros.min()) if first is None else min(first, int(micros.min()))
        if packs:
            self.waiting.appendList(packs)
            self._wake(_lot_end(first))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.timer.clear()  # the timer that fired is gone
        mark, names = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()), [part.split()[0] for part in OUTPUT.split(", ")]
        packs = [_unpacked(p[0]) for p in self.waiting.get()] if self.waiting.exists() else []
        past, out = Past(self.state.get() if self.state.exists() else None), []
        if packs:
            events = pd.concat(packs, ignore_index=True).sort_values(["micros", "event_id"], kind="stable")
            passed = (_lot_end(events["micros"]) <= mark).to_numpy()
            due, rest = events[passed], events[~passed]
            for micros, event_id, category, price in zip(due["micros"].tolist(), due["event_id"].tolist(), due["category"].tolist(), due["price"].tolist()):
                if self.idle and past.n and self._forgotten(past.newest[0]) < _lot_end(micros):
                    past = Past(None)
                out.append((key[0], event_id, pd.Timestamp(micros, unit="us"), *past.row(), False))
                past.add(micros, event_id, category, price)
                if len(out) == ROWS_OUT:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            self.waiting.clear()
            if len(rest):
                self.waiting.put([(_packed(rest),)])
                self._wake(_lot_end(int(rest["micros"].iloc[0])))
        if self.idle and past.n and self._forgotten(past.newest[0]) <= mark:
            self.state.clear()
        else:
            if past.n:
                self.state.update(past.kept())
            if self.idle and past.n:
                self._wake(self._forgotten(past.newest[0]))
        if out:
            yield pd.DataFrame(out, columns=names)

    def close(self) -> None:
        pass


def _lot_end(micros):
    """The end of the lot of these microseconds, in milliseconds."""
    return (micros // (1000 * LOT) + 1) * LOT


def _packed(events: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(events, schema=_EVENTS, preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, _EVENTS) as made:
        made.write_batch(batch)
    return out.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(data)).read_all().to_pandas()


_EVENTS = pa.schema([("micros", pa.int64()), ("event_id", pa.int64()), ("category", pa.string()), ("price", pa.float64())])


def running_profiles(events: DataFrame) -> DataFrame:
    """Profiles of a stream of ``user_id, event_id, ts, category, price``, one row for each event.

    State of this kind needs the RocksDB store, which is set for the session's streams.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return events.groupBy("user_id").transformWithStateInPandas(PastProfile(), OUTPUT, "Append", "None")


def ordered_profiles(events: DataFrame, delay: str = "1 hour", idle_ms: int | None = None) -> DataFrame:
    """Profiles in event time: rows may come in any order within ``delay``, and the outcome is that of a batch in order.

    Rows later than ``delay`` are dropped; those the watermark has not passed are not given out yet. ``late`` is always false. A user's
    waiting rows are those of ``delay``, however many a micro-batch brings. ``idle_ms`` lets profiles of absent users go.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return events.withWatermark("ts", delay).groupBy("user_id").transformWithStateInPandas(OrderedProfile(idle_ms), OUTPUT, "Append", "EventTime")


def enriched(stream: DataFrame, meta: DataFrame) -> DataFrame:
    """A review stream joined with the static metadata, one row an item."""
    return stream.join(meta, "parent_asin")


def window_counts(stream: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts in tumbling windows of event time; rows later than ``delay`` are dropped, open windows are not given out."""
    return (
        stream.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def read_table(spark: SparkSession, folder: str, name: str, bytes_per_batch: int = BATCH_BYTES) -> DataFrame:
    """One table of a folder, ``<name>.parquet`` (a file, or a folder of files), as a stream.

    A micro-batch takes files up to so many bytes, oldest first: this bounds what one user has in it.
    """
    path = f"{folder}/{name}.parquet"
    batch = spark.read.parquet(path)
    stream = spark.readStream.schema(batch.schema).option("maxBytesPerTrigger", bytes_per_batch)
    if all(f.endswith(f"/{name}.parquet") for f in batch.inputFiles()):  # a stream reads folders only
        return stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return stream.parquet(path)


def drained(stream: DataFrame, folder: str | None = None, mode: str = "append") -> DataFrame:
    """Run a stream until its present input is used up, into Parquet under the shared folder; returns the table."""
    spark = stream.sparkSession
    out = f"{folder or own_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = stream.schema
    query = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/rows")
