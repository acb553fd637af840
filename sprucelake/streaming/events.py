"""Structured Streaming over event files: windows, sessions, duplicates, joins and state.

Each query is a terminating run (availableNow) into a parquet sink in the shared folder, so a
test or a batch can read what the stream wrote.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sprucelake.operators.groups import latest
from sprucelake.session import SCHEMAS, delete_folder, folders, shared_folder, written

SCHEMA = SCHEMAS["events"]


def event_stream(spark: SparkSession, sf_dir: str, delay: str = "30 minutes") -> DataFrame:
    """The events as a stream with a watermark (which wants a timestamp with zone; the session's is UTC)."""
    raw = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*.parquet")
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def run(stream: DataFrame, name: str, mode: str = "append", single_batch: bool = False) -> DataFrame:
    """Run a stream over all that is there and return what it wrote.

    State that depends on the time of processing asks for batch after batch, so such a stream never
    ends by availableNow: single_batch takes all that is there in one and stops.
    """
    spark = stream.sparkSession
    out = shared_folder(spark, f"stream-{name}")
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint").trigger(**({"once": True} if single_batch else {"availableNow": True})).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def run_in_memory(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream into a table in the driver's memory: for small results only."""
    out = shared_folder(stream.sparkSession, f"stream-{name}")
    stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


def run_batches(stream: DataFrame, name: str, mode: str, key: list[str] | None = None) -> DataFrame:
    """Run a stream with foreachBatch.

    What is returned: of a complete stream the rows of its last batch, of an update stream the last
    row of each key over all batches, of an append stream all rows.
    """
    if (mode == "update") != bool(key):
        raise ValueError("an update stream has a key, and no other has")
    spark = stream.sparkSession
    out = shared_folder(spark, f"stream-{name}")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    written = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{out}/data")
    if mode == "update":
        return latest(written, key, [F.desc("batch")]).drop("batch")
    if mode == "complete":
        written = written.where(F.col("batch") == written.agg(F.max("batch")).first()[0])
    return written.drop("batch")


def tumbling(events: DataFrame, size: str = "6 hours") -> DataFrame:
    grouped = events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 hours", slide: str = "1 hour") -> DataFrame:
    return events.groupBy(F.window("ts", size, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def user_sessions(events: DataFrame, gap: str = "2 hours") -> DataFrame:
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def distinct_events(events: DataFrame) -> DataFrame:
    return events.dropDuplicatesWithinWatermark(["event_id"])


def clicks_with_purchases(events: DataFrame, within: str = "1 day") -> DataFrame:
    """A stream joined with itself: purchases of a user up to `within` after a click."""
    clicks = events.where("event_type = 'click'").select(F.col("user_id").alias("cu"), F.col("ts").alias("ct"), F.col("event_id").alias("click_id"))
    buys = events.where("event_type = 'purchase'").select(F.col("user_id").alias("bu"), F.col("ts").alias("bt"), F.col("event_id").alias("purchase_id"))
    return clicks.join(buys, F.expr(f"cu = bu AND bt >= ct AND bt <= ct + interval {within}")).select("click_id", "purchase_id")


class RunningCount(StatefulProcessor):
    """Events and value so far of each user, given out after each batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("so_far", "n long, total double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, total = self.state.get() if self.state.exists() else (0, 0.0)
        for pdf in rows:
            n, total = n + len(pdf), total + float(pdf["value"].sum())
        self.state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [round(total, 4)]})

    def close(self) -> None:
        pass


def running_counts(events: DataFrame) -> DataFrame:
    """Arbitrary state by transformWithState (needs the RocksDB state store)."""
    return events.groupBy("user_id").transformWithStateInPandas(RunningCount(), "user_id long, n long, total double", "Update", "None")


#: Parts that users are dealt to where a part's state is kept by one key: each call from Python for a key's state and timers costs, whatever is in it.
SHARDS = 2048


def by_shard(events: DataFrame, *columns: str, shards: int = SHARDS) -> GroupedData:
    """(user, known, columns) of the events by shards of users; user is 0 where user_id is null, which known tells."""
    user = F.coalesce(F.col("user_id"), F.lit(0)).alias("user")
    return events.select(F.pmod(F.xxhash64("user_id"), F.lit(shards)).alias("shard"), user, F.col("user_id").isNotNull().alias("known"), *columns).groupBy("shard")


def with_users(out: DataFrame, *columns: str) -> DataFrame:
    return out.select(F.when(F.col("known"), F.col("user")).alias("user_id"), *columns)


def _micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy("datetime64[us]").astype("int64")


def _times(micros: np.ndarray) -> np.ndarray:
    return micros.astype("datetime64[us]")


class Rows:
    """Rows of whole numbers in a shard's state: one value, each column an array of int64 as bytes."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, columns: list[str]) -> None:
        self.state, self.columns = handle.getValueState(name, ", ".join(f"{c} binary" for c in columns)), columns

    def get(self) -> pd.DataFrame:
        found = self.state.get() if self.state.exists() else [b""] * len(self.columns)
        return pd.DataFrame({c: np.frombuffer(bytes(x), np.int64) for c, x in zip(self.columns, found, strict=True)})

    def put(self, rows: pd.DataFrame) -> None:
        if len(rows):
            self.state.update(tuple(rows[c].to_numpy(np.int64).tobytes() for c in self.columns))
        else:
            self.state.clear()


class Waking(StatefulProcessor):
    """A processor of shards with one timer for each."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def wake(self, millis: int | None) -> None:
        """One timer at that time, or none."""
        timers = list(self.handle.listTimers())
        for t in timers:
            if t != millis:
                self.handle.deleteTimer(t)
        if millis is not None and millis not in timers:
            self.handle.registerTimer(millis)

    def close(self) -> None:
        pass


class IdleSessions(Waking):
    """Users' sessions: events less than `gap` apart, in whatever order they come, given out when the watermark is `gap` behind the last."""

    def __init__(self, gap: str) -> None:
        self.gap = pd.Timedelta(gap) // pd.Timedelta("1us")

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = Rows(handle, "open", ["user", "known", "start", "last", "n"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows), ignore_index=True)
        at = _micros(new["ts"])
        spans = pd.concat([self.open.get(), pd.DataFrame({"user": new["user"], "known": new["known"].astype("int64"), "start": at, "last": at, "n": 1})], ignore_index=True)
        spans = spans.sort_values(["user", "known", "start"], ignore_index=True)
        # A session begins where a user does, or `gap` behind all that the user has before.
        own = spans.groupby(["user", "known"], sort=False)
        before = own["last"].cummax().shift(fill_value=0)
        session = ((own.cumcount() == 0) | (spans["start"] - before >= self.gap)).cumsum()
        self._keep(spans.groupby(session).agg({"user": "first", "known": "first", "start": "first", "last": "max", "n": "sum"}))
        yield self._rows(spans[:0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        spans = self.open.get()
        closed = (spans["last"] + self.gap) // 1000 <= timerValues.getCurrentWatermarkInMs()
        self._keep(spans[~closed])
        yield self._rows(spans[closed])

    def _keep(self, spans: pd.DataFrame) -> None:
        self.open.put(spans)
        self.wake(int((spans["last"].min() + self.gap) // 1000) if len(spans) else None)

    def _rows(self, closed: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"user": closed["user"], "known": closed["known"].astype(bool), "start": _times(closed["start"].to_numpy()), "n": closed["n"]})


def idle_sessions(events: DataFrame, gap: str = "2 hours", shards: int = SHARDS) -> DataFrame:
    """Sessions by state and event-time timers (needs the RocksDB state store). Events may come in any order within the watermark."""
    out = by_shard(events, "ts", shards=shards).transformWithStateInPandas(IdleSessions(gap), "user long, known boolean, start timestamp, n long", "Append", "EventTime")
    return with_users(out, "start", "n")


class InOrder(Waking):
    """Users' events, kept until the watermark has passed them and then given out in order of time, each user's numbered from 1."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = Rows(handle, "waiting", ["user", "known", "ts", "event_id"])
        self.given = Rows(handle, "given", ["user", "known", "n"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows), ignore_index=True)
        new = pd.DataFrame({"user": new["user"], "known": new["known"].astype("int64"), "ts": _micros(new["ts"]), "event_id": new["event_id"].astype("int64")})
        self._keep(pd.concat([self.waiting.get(), new], ignore_index=True))
        yield self._rows(new[:0].assign(place=0))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        rows = self.waiting.get()
        ripe = rows["ts"] // 1000 < timerValues.getCurrentWatermarkInMs()
        done, given = rows[ripe].sort_values(["user", "known", "ts", "event_id"]), self.given.get()
        self._keep(rows[~ripe])
        done = done.merge(given, on=["user", "known"], how="left")
        own = done.groupby(["user", "known"], sort=False)
        done["place"] = done["n"].fillna(0).astype("int64") + own.cumcount() + 1
        self.given.put(pd.concat([given, done.rename(columns={"n": "_", "place": "n"})[["user", "known", "n"]]]).groupby(["user", "known"], as_index=False)["n"].max())
        yield self._rows(done)

    def _keep(self, rows: pd.DataFrame) -> None:
        self.waiting.put(rows)
        self.wake(int(rows["ts"].min() // 1000) + 1 if len(rows) else None)

    def _rows(self, done: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"user": done["user"], "known": done["known"].astype(bool), "event_id": done["event_id"], "ts": _times(done["ts"].to_numpy()), "place": done["place"]})


def in_order(events: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(user_id, event_id, ts, place): a disordered stream's events in order (needs the RocksDB state store); late ones are dropped by the watermark."""
    out = by_shard(events, "event_id", "ts", shards=shards).transformWithStateInPandas(InOrder(), "user long, known boolean, event_id long, ts timestamp, place long", "Append", "EventTime")
    return with_users(out, "event_id", "ts", "place")


def replayed(events: DataFrame, batch: Column, batches: int, delay: str) -> DataFrame:
    """events (SCHEMA) as a stream of `batches` batches, row by row in the batch that the column `batch` says (from 0), with a watermark."""
    spark, path = events.sparkSession, shared_folder(events.sparkSession, "replay")
    numbered = written(events.withColumn("_batch", batch), "replay-rows")
    for b in range(batches):  # a file for each batch, written one after another
        numbered.where(F.col("_batch") == b).drop("_batch").coalesce(1).write.parquet(f"{path}/batch-{b:04d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/batch-*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


class Upserts:
    """A table of one row for each key, kept up to date batch by batch; a batch that comes again changes nothing.

    Each batch that is done is a version of the table in a folder of its own, whole when Spark's marker is there. A batch makes its
    version from the one before, so what a failed attempt has left is written over. Of versions, the last two are kept: storage grows with the keys
    and not with the batches. Of a key's rows the one that comes first in `order` stays.
    """

    def __init__(self, path: str, key: list[str], order: list[Column]) -> None:
        self.path, self.key, self.order = path, key, order

    def versions(self, spark: SparkSession) -> list[int]:
        """The batches whose versions are whole and kept, ascending."""
        return sorted(int(n.rsplit("-", 1)[1]) for n in folders(spark, self.path, "_SUCCESS"))

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = self.versions(spark)
        if done and number <= done[-1]:
            return
        before = [spark.read.schema(batch.schema).parquet(f"{self.path}/version-{done[-1]}")] if done else []
        rows = batch.unionByName(before[0]) if before else batch
        latest(rows, self.key, self.order).write.mode("overwrite").parquet(f"{self.path}/version-{number}")
        for old in done[:-1]:
            delete_folder(spark, f"{self.path}/version-{old}")

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/version-{self.versions(spark)[-1]}")


def run_upserts(stream: DataFrame, name: str, key: list[str], order: list[Column]) -> DataFrame:
    """Run a stream into a table of the first row of each key in `order`."""
    spark = stream.sparkSession
    out = shared_folder(spark, f"stream-{name}")
    target = Upserts(f"{out}/data", key, order)
    stream.writeStream.foreachBatch(target).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return target.table(spark)


class FirstSeen(StatefulProcessor):
    """A user's first event; a user who isn't seen for the time to live is new again."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "yes boolean", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = min(pdf["event_id"].min() for pdf in rows)
        new = not self.seen.exists()
        self.seen.update((True,))
        yield pd.DataFrame({"user_id": [key[0]] * new, "event_id": [first] * new})

    def close(self) -> None:
        pass


def first_seen(events: DataFrame, keep_ms: int = 3_600_000) -> DataFrame:
    """Users when they are first seen, by state that is forgotten after a time (needs the RocksDB state store)."""
    return events.groupBy("user_id").transformWithStateInPandas(FirstSeen(keep_ms), "user_id long, event_id long", "Append", "ProcessingTime")
