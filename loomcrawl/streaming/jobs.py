"""Structured Streaming forms: deduplication, loads per window, keyed upserts, per-domain politeness state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomcrawl.operators.crawl import AFTER, LEAST, MOST, START
from loomcrawl.sources.shared import shared_path


def json_source(spark, schema, servers: str, topic: str, most: int = 10_000) -> DataFrame:
    """Messages of a Kafka topic (the connector must be on the class path), parsed; a list or a single object each."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("maxOffsetsPerTrigger", most).load()
    text = F.trim(F.col("value").cast("string"))
    listed = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    return raw.select("timestamp", F.explode(F.from_json(listed, f"array<{schema}>")).alias("m")).select("timestamp", "m.*")


def json_sink(df: DataFrame, key: str, servers: str, topic: str, checkpoint: str):
    keyed = df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))
    return keyed.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint)


def first_seen(stream: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark; state older than it goes."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def loads(stream: DataFrame, key: str, ts: str, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(key, F.window(ts, width)).agg(F.count("*").alias("n"))


def upsert_into(path: str, key: str, order: str):
    """foreachBatch function: the last row of each key by order, as a new version below path. Repeating a batch is harmless."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if number:
            try:
                rows = spark.read.schema(batch.schema).parquet(f"{path}/v{number - 1}").unionByName(batch)
            except Exception as e:  # the first version of a restarted sink
                if "PATH_NOT_FOUND" not in str(e):
                    raise
        place = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
        rows.withColumn("_n", place).where("_n = 1").drop("_n").write.mode("overwrite").parquet(f"{path}/v{number}")

    return write


def politeness(stream: DataFrame, delay: float = 1.0, ttl: str | None = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Verdicts of requests (domain, ts, id) by crawl delay; a domain's state is its last admitted start.

    With a TTL the state goes when the watermark (ts less `late`) passes the domain's last request by it; requests
    later than the watermark are dropped by Spark then. Without one it is kept.
    """
    span = int(pd.Timedelta(ttl).total_seconds() * 1000) if ttl else None

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, newest = state.get if state.exists else (None, 0.0)
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        out = []
        for ts, i in zip(rows["ts"], rows["id"], strict=True):
            now = ts.timestamp()
            wait = 0.0 if last is None else max(0.0, last + delay - now)
            if not wait:
                last = now
            newest = max(newest, now)
            out.append((key[0], i, wait == 0, wait))
        state.update((last, newest))
        if span:
            state.setTimeoutTimestamp(max(int(newest * 1000) + span, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["domain", "id", "ok", "wait"])

    timed = stream.withWatermark("ts", late) if ttl else stream
    return timed.groupBy("domain").applyInPandasWithState(decide, "domain string, id long, ok boolean, wait double", "last double, newest double", "append", GroupStateTimeout.EventTimeTimeout if ttl else GroupStateTimeout.NoTimeout)


def domain_stats(stream: DataFrame) -> DataFrame:
    """Requests, mean response and adaptive delay of each domain after every micro-batch, kept in state.

    stream has domain, ts, id, ok, seconds; within a batch a domain's events count in order of (ts, id).
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, good, mean, delay = state.get if state.exists else (0, 0, 0.0, START)
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        for ok, seconds in zip(rows["ok"], rows["seconds"], strict=True):
            n, good = n + 1, good + bool(ok)
            if seconds > 0:
                mean = (mean * (n - 1) + seconds) / n
            if n >= AFTER:
                share = good / n
                if share < 0.8 or mean > 5:
                    delay = min(delay * 1.5, MOST)
                elif share > 0.95 and mean < 1:
                    delay = max(delay * 0.8, LEAST)
        state.update((n, good, mean, delay))
        yield pd.DataFrame([(key[0], n, mean, delay)], columns=["domain", "requests", "avg_response", "delay"])

    return stream.groupBy("domain").applyInPandasWithState(fold, "domain string, requests int, avg_response double, delay double", "n int, good int, mean double, delay double", "append", GroupStateTimeout.NoTimeout)


class _Delayed(StatefulProcessor):
    """Items of one key wait in a list until their time; a timer for each of them wakes the key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "id long", "ready_at long, attempts int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark, due = timerValues.getCurrentWatermarkInMs(), []
        for batch in rows:
            for i, at, attempts in zip(batch["id"], batch["ready_at"], batch["attempts"], strict=True):
                ms = int(at.timestamp() * 1000)
                if ms <= mark:
                    due.append((int(i), ms, int(attempts)))
                else:
                    self.waiting.updateValue((int(i),), (ms, int(attempts)))
                    self.handle.registerTimer(ms)
        yield self._rows(key, due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = [(i[0], v[0], v[1]) for i, v in self.waiting.iterator() if v[0] <= now]
        for i, _, _ in due:
            self.waiting.removeKey((i,))
        yield self._rows(key, due)

    @staticmethod
    def _rows(key, due: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], i, ms, n) for i, ms, n in due], columns=["bucket", "id", "ready_ms", "attempts"]).astype({"bucket": "int64", "id": "int64", "ready_ms": "int64", "attempts": "int32"})

    def close(self) -> None:
        pass


def delay_queue(stream: DataFrame, seconds: int = 30, attempts: int = 5, late: str = "0 seconds") -> DataFrame:
    """Delayed items (id, ready_at, attempts, ts) as soon as event time has passed their ready_at.

    State is keyed by the bucket of ready_at, so it is spread over time and no key outlives its bucket; items tried
    more often than `attempts` are given up. Needs the RocksDB state store.
    """
    keyed = stream.where(F.col("attempts") <= attempts).withWatermark("ts", late).withColumn("bucket", F.floor(F.unix_timestamp("ready_at") / seconds))
    return keyed.groupBy("bucket").transformWithStateInPandas(statefulProcessor=_Delayed(), outputStructType="bucket long, id long, ready_ms long, attempts int", outputMode="append", timeMode="eventTime")


def drained(stream: DataFrame, label: str) -> DataFrame:
    """Everything a stream has now, as a table: rows go to Parquet in the shared folder until the source is exhausted."""
    spark = stream.sparkSession
    path = shared_path(spark, f"stream-{label}")
    stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
