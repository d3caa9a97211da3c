"""Streams that keep their own state per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 256   # state keys of a job; more for state of many millions of rows
PART = 100_000  # rows of one element of a state


def use_state_store(spark: SparkSession) -> None:
    """Keep state in RocksDB, which these jobs need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def _bucket(column: str, buckets: int) -> Column:
    """Deals keys into ``buckets`` state keys: Python is then called once for every bucket
    of a batch, not once for every connection or message."""
    return F.pmod(F.xxhash64(column), F.lit(buckets)).alias("bucket")


class _Timed(StatefulProcessor):
    """Tables in list states, and one timer for a bucket.

    An element of a state is a stretch of a table as an Arrow stream: rows that go to the
    state store and back one by one take most of the time of a job.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._timer = handle.getValueState("timer", "at long")

    def _packed(self, rows: pd.DataFrame, schema: pa.Schema) -> tuple[bytes]:
        table = pa.Table.from_pandas(rows, schema, preserve_index=False).replace_schema_metadata()
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, schema) as stream:
            stream.write_table(table)
        return (out.getvalue().to_pybytes(),)

    def _read(self, state, schema: pa.Schema) -> pd.DataFrame:
        parts = [pa.ipc.open_stream(part).read_all() for part, in state.get()] if state.exists() else []
        return pa.concat_tables([schema.empty_table(), *parts]).to_pandas()

    def _append(self, state, rows: pd.DataFrame, schema: pa.Schema) -> None:
        state.appendValue(self._packed(rows, schema))

    def _write(self, state, rows: pd.DataFrame, schema: pa.Schema) -> None:
        parts = [self._packed(rows[k:k + PART], schema) for k in range(0, len(rows), PART)]
        state.put(parts) if parts else state.clear()

    def _wake_at(self, ms: int | None) -> None:
        if self._timer.exists():
            now = self._timer.get()[0]
            if now == ms:
                return
            self._handle.deleteTimer(now)
            self._timer.clear()
        if ms is not None:
            self._handle.registerTimer(ms)
            self._timer.update((ms,))

    def close(self) -> None:
        pass


WAITING = pa.schema({"conn_id": pa.string(), "ts_us": pa.int64(), "seq": pa.int64(), "type": pa.string(),
                     "username": pa.string()})
KNOWN = pa.schema({"conn_id": pa.string(), "username": pa.string(), "last_us": pa.int64()})


class Presence(_Timed):
    """Remembers under which name a connection is joined, for the connections of a bucket.

    A message counts only if its connection is joined under the same name. Rows wait
    until the watermark has passed them and are then taken in time order, whatever the
    batches they came in. A connection that is silent for longer than ``ttl`` is gone:
    its name is forgotten, in the results and in the state.
    """

    def __init__(self, ttl_ms: int) -> None:
        self._ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self._known = handle.getListState("known", "rows binary")
        self._waiting = handle.getListState("waiting", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues
                        ) -> Iterator[pd.DataFrame]:
        first = self._timer.get()[0] if self._timer.exists() else None
        for chunk in rows:
            self._append(self._waiting, chunk[WAITING.names], WAITING)
            earliest = int(chunk["ts_us"].min()) // 1000 + 1
            first = earliest if first is None else min(first, earliest)
        self._wake_at(first)
        yield pd.DataFrame([], columns=OUT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self._timer.clear()
        waiting, known = self._read(self._waiting, WAITING), self._read(self._known, KNOWN)
        ready = waiting[waiting["ts_us"] < passed]
        rest = waiting[waiting["ts_us"] >= passed]
        if len(ready):
            self._write(self._waiting, rest, WAITING)
            out, newest = self._taken(ready, known)
            yield out
            known = pd.concat([known, newest]).drop_duplicates("conn_id", keep="last")
        known = known[(known["username"] != "") & (known["last_us"] + self._ttl * 1000 >= passed)]
        self._write(self._known, known, KNOWN)
        due = [*([int(rest["ts_us"].min()) // 1000 + 1] if len(rest) else []),
               *([int(known["last_us"].min()) // 1000 + self._ttl + 1] if len(known) else [])]
        self._wake_at(min(due, default=None))

    def _taken(self, rows: pd.DataFrame, known: pd.DataFrame):
        """Accepted rows, and the names and times that are known after them."""
        conn, ids = pd.factorize(rows["conn_id"], use_na_sentinel=False)
        rows = rows.assign(conn=conn).sort_values(["conn", "ts_us", "seq"], kind="stable").reset_index(drop=True)
        by = known.drop_duplicates("conn_id").set_index("conn_id").reindex(ids)
        conn, ts, user = rows["conn"], rows["ts_us"], rows["username"].fillna("")
        name = pd.Series(by["username"].to_numpy()[conn], index=rows.index)
        last = pd.Series(by["last_us"].to_numpy(dtype=float)[conn], index=rows.index)
        before_it = ts.groupby(conn).shift().fillna(last)
        stretch = (ts - before_it > self._ttl * 1000).groupby(conn).cumsum()
        groups = [conn, stretch]
        moves = user.where(rows["type"] == "join").mask(rows["type"] == "leave", "")
        after = moves.groupby(groups).ffill()
        before = after.groupby(groups).shift()
        after, before = (x.mask(x.isna() & (stretch == 0), name).fillna("") for x in (after, before))
        kind = pd.Series(None, index=rows.index, dtype=object)
        kind[rows["type"] == "join"] = "user-joined"
        kind[(rows["type"] == "leave") & (before != "")] = "user-left"
        kind[(rows["type"] == "message") & (before != "") & (before == user)] = "message"
        out = pd.DataFrame({"conn_id": rows["conn_id"], "seq": rows["seq"], "kind": kind,
                            "username": user.mask(rows["type"] == "leave", before)})
        newest = pd.DataFrame({"conn_id": rows["conn_id"], "username": after, "last_us": ts})[
            ~conn.duplicated(keep="last")]
        return out[kind.notna()], newest


OUT = ["conn_id", "seq", "kind", "username"]


def presence(events: DataFrame, delay: str = "1 minute", ttl_seconds: int = 86_400,
             buckets: int = BUCKETS) -> DataFrame:
    """Joins, leaves and accepted messages of (conn_id, username, type, ts, seq), once the
    watermark (``delay`` behind the newest row) has passed them. Rows that come later than
    that are dropped. State is bounded by the rows of the last ``delay`` and by the
    connections with a row in the last ``ttl_seconds``; it is kept in ``buckets`` keys, whose
    number holds for the life of a checkpoint."""
    use_state_store(events.sparkSession)
    timed = events.withWatermark("ts", delay).select(
        _bucket("conn_id", buckets), "conn_id", "username", "type", "seq", "ts", F.unix_micros("ts").alias("ts_us"))
    return timed.groupBy("bucket").transformWithStateInPandas(
        Presence(ttl_seconds * 1000), "conn_id string, seq long, kind string, username string",
        outputMode="append", timeMode="EventTime")


def online(events: DataFrame) -> DataFrame:
    """Connections by their newest join or leave; built-in state, update mode."""
    moves = events.filter(F.col("type").isin("join", "leave"))
    newest = F.max_by(F.struct("type", "username"), F.struct("ts", "seq")).alias("m")
    return moves.groupBy("conn_id").agg(newest).select(
        "conn_id", F.col("m.username").alias("username"),
        (F.col("m.type") == "join").alias("is_online"))


SNOOZES = pa.schema({"id": pa.string(), "at_us": pa.int64(), "until_ms": pa.int64()})


class SnoozeTimer(_Timed):
    """Holds the ends of the snoozes of a bucket of messages and reports those that event
    time passes.

    A later snooze replaces an earlier one; a NULL time cancels it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self._pending = handle.getListState("pending", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues
                        ) -> Iterator[pd.DataFrame]:
        new = None
        for chunk in rows:
            new = self._newest([new, chunk[SNOOZES.names]])
        pending = self._read(self._pending, SNOOZES)
        if len(pending) or new["until_ms"].notna().any():
            self._keep(self._newest([pending, new]).dropna(subset=["until_ms"]).astype({"until_ms": "int64"}))
        yield pd.DataFrame({"id": pd.Series(dtype=str), "until_ms": pd.Series(dtype="int64")})

    def _newest(self, parts: list[pd.DataFrame | None]) -> pd.DataFrame:
        """The newest row of every message; of rows of one moment the last."""
        rows = pd.concat([p for p in parts if p is not None and len(p)])
        return rows.sort_values("at_us", kind="stable").drop_duplicates("id", keep="last")

    def _keep(self, pending: pd.DataFrame) -> None:
        self._write(self._pending, pending, SNOOZES)
        self._wake_at(int(pending["until_ms"].min()) if len(pending) else None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo
                           ) -> Iterator[pd.DataFrame]:
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        self._timer.clear()
        pending = self._read(self._pending, SNOOZES)
        due = pending["until_ms"] <= passed
        self._keep(pending[~due])
        yield pending.loc[due, ["id", "until_ms"]]


def snooze_timer(snoozes: DataFrame, delay: str = "1 minute", buckets: int = BUCKETS) -> DataFrame:
    """(id, snoozed_until) when event time passes the end of a snooze.

    ``snoozes`` has (id, ts, snoozed_until); the watermark on ``ts`` is the clock. State
    has the open snoozes only, in ``buckets`` keys, whose number holds for the life of a
    checkpoint.
    """
    use_state_store(snoozes.sparkSession)
    timed = snoozes.withWatermark("ts", delay).select(
        _bucket("id", buckets), "id", "ts", F.unix_micros("ts").alias("at_us"),
        F.unix_millis(F.col("snoozed_until").cast("timestamp")).alias("until_ms"))
    fired = timed.groupBy("bucket").transformWithStateInPandas(
        SnoozeTimer(), "id string, until_ms long", outputMode="append", timeMode="EventTime")
    return fired.select("id", F.timestamp_millis("until_ms").cast("timestamp_ntz")
                        .alias("snoozed_until"))
