"""Streaming jobs over the same functions as the batch queries, and the three stateful folds.

Each job reads a file stream, runs over what is there (availableNow) unless told otherwise, and writes Parquet with a
checkpoint, in the folder that driver and executors share. A micro-batch takes at most BATCH_BYTES of files, so that a
key's rows in one batch are bounded whatever the log's length.

Folds that depend on the order of events (streaming.ordered) wait until the watermark, DELAY behind the latest event, has
passed an event, so that files may come in any order within the delay; what comes later is marked, not lost.

Results that wait for a watermark are complete once the stream is closed: after the data, an end marker (a row dated
END) is sent through the same query, so that the watermark passes everything that waits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tanpura.operators.analyze import analyze
from tanpura.operators.compose import compose, rejected
from tanpura.operators.notifications import REMOVE_DELAY
from tanpura.session import settings, shared_path, ship
from tanpura.sources import tables
from tanpura.streaming.guard import each_once
from tanpura.streaming.ordered import Expiry, InFlight, InOrder, Pending, in_order

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Bytes of files that a micro-batch takes, and when an end marker is dated.
BATCH_BYTES, END = 1 << 30, "timestamp'9000-01-01 00:00:00'"
#: How far behind the latest event one may come: the tables are logs of a month, whose files may come in any order.
DELAY = "31 days"
#: How long the duplicate guard keeps a key in its state; older ones are looked up in what it has written.
LIVE_MS = 3_600_000


def stream(spark: SparkSession, folder: str, derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A derived table as a stream over the files of its base table."""
    return derive(base_stream(spark, folder, tables.BASES[derive]))


def base_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream. The pattern stands for one file or one folder of files; a stream source takes no bare file."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", str(BATCH_BYTES)).parquet(f"{folder}/{name}[.]parquet")


def run(rows: DataFrame, name: str, out: str | None = None) -> DataFrame:
    """Run a stream over what is there and read what it wrote; with the same out again, over what is new."""
    spark = rows.sparkSession
    ship(spark)
    out = out or shared_path(spark, name)
    with settings(spark, spark__sql__streaming__stateStore__providerClass=ROCKSDB):
        query = rows.writeStream.format("parquet").outputMode("append").option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/data")


def run_to_end(spark: SparkSession, name: str, marker: dict[str, str], made: Callable[[Callable[[DataFrame], DataFrame]], DataFrame]) -> DataFrame:
    """Run the stream that made builds, send an end marker (columns as SQL), and run it on from its checkpoint.

    made gets a function that adds the markers to a stream with some of those columns. A marker that takes part in a join
    needs a key: conditions that aren't on the event time, such as that keys aren't null, reach rows before the watermark.
    """
    out = shared_path(spark, name)
    row = spark.range(1).select(*(F.expr(v).alias(k) for k, v in marker.items()))
    row.limit(0).write.parquet(f"{out}/ends")
    rows = made(lambda stream: stream.unionByName(spark.readStream.schema(row.schema).parquet(f"{out}/ends"), allowMissingColumns=True).select(*stream.columns))
    run(rows, name, out)
    row.write.mode("append").parquet(f"{out}/ends")
    return run(rows, name, out)


def stream_analyze(spark: SparkSession, folder: str) -> DataFrame:
    """Analysis of recordings as they arrive."""
    found = analyze(stream(spark, folder, tables.recordings))
    return run(found.select("recording_id", F.col("raga.id").alias("raga_id"), F.col("tala.id").alias("tala_id"), "tempo", "confidence"), "stream-analyze")


def compose_to_sinks(requests: DataFrame, out: str) -> None:
    """Compositions and rejected requests of a stream to two sinks. A batch's folders are named by its number, so that a repeated batch replaces itself."""

    def both(batch: DataFrame, number: int) -> None:
        batch.persist()
        compose(batch).select("request_id", "id", F.col("raga.id").alias("raga_id"), "audio_url").write.mode("overwrite").parquet(f"{out}/compositions/batch={number}")
        rejected(batch).select("request_id", F.array_join("missing", ",").alias("missing")).write.mode("overwrite").parquet(f"{out}/rejected/batch={number}")
        batch.unpersist()

    requests.writeStream.foreachBatch(both).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def stream_compose(spark: SparkSession, folder: str) -> DataFrame:
    """request_id, accepted and detail (the composition's URL, or the missing keys), from the two sinks."""
    out = shared_path(spark, "stream-compose")
    compose_to_sinks(stream(spark, folder, tables.composition_requests), out)
    good = spark.read.parquet(f"{out}/compositions").select("request_id", F.lit(True).alias("accepted"), F.col("audio_url").alias("detail"))
    return good.union(spark.read.parquet(f"{out}/rejected").select("request_id", F.lit(False).alias("accepted"), F.col("missing").alias("detail")))


class SessionState(StatefulProcessor):
    """The events that set a session's file, analysis and composition; after each batch the state as it then is.

    What is kept is the latest event of each kind, so that rows may come in any order and in parts.
    """

    KINDS = {"file": ("SELECT_FILE",), "found": ("ANALYZE_OK",), "cleared": ("SELECT_FILE", "RESET_ANALYSIS"), "composition": ("GENERATE_OK",)}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cells = handle.getValueState("cells", ", ".join(["seen long", *(f"{k}_us long, {k}_event long" for k in self.KINDS)]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen, *known = self.cells.get() if self.cells.exists() else (0, *(None,) * (2 * len(self.KINDS)))
        latest = [tuple(known[i : i + 2]) if known[i] is not None else None for i in range(0, len(known), 2)]
        for part in rows:
            seen += len(part)
            for i, actions in enumerate(self.KINDS.values()):
                own = part[part["action"].isin(actions)]
                if len(own):
                    newest = own[own["us"] == own["us"].max()]
                    latest[i] = max(filter(None, (latest[i], (int(newest["us"].iloc[0]), int(newest["event_id"].max())))))
        self.cells.update((seen, *(x for pair in latest for x in (pair or (None, None)))))
        file, found, cleared, composition = latest
        analysis = found if found and (not cleared or found > cleared) else None
        cells = {"file_event": file, "analysis_event": analysis, "composition_event": composition}
        session = pd.array([None if key[1] else key[0]], "Int64")
        yield pd.DataFrame({"session_id": session, "seen": [seen]} | {k: pd.array([v and v[1]], "Int64") for k, v in cells.items()})

    def close(self) -> None:
        pass


def stream_session_state(spark: SparkSession, folder: str) -> DataFrame:
    """Each session's state after the last batch that had events of it."""
    events = stream(spark, folder, tables.session_events).select("event_id", "session_id", F.unix_micros("ts").alias("us"), "action")
    # Never null: a null among the grouping keys loses other keys' rows on the way to Python.
    keyed = events.withColumn("none", F.col("session_id").isNull()).withColumn("session_id", F.coalesce("session_id", F.lit(0).cast("long")))
    states = keyed.groupBy("session_id", "none").transformWithStateInPandas(SessionState(), "session_id long, seen long, file_event long, analysis_event long, composition_event long", "Append", "None")
    rows = run(states, "stream-session-state")
    return rows.groupBy("session_id").agg(F.max_by(F.struct("file_event", "analysis_event", "composition_event"), "seen").alias("s")).select("session_id", "s.*")


def folded(spark: SparkSession, name: str, rows: DataFrame, key: str, at: str, what: Column, order: str, processor: InOrder, delay: str) -> DataFrame:
    """The stream rows folded in order of time, to its end: the processor's rows with late, which marks those that no decision could be made for."""

    def made(closed) -> DataFrame:
        return in_order(closed(rows), key, at, what, order, processor, delay, F.expr(END))

    return run_to_end(spark, name, {at: END}, made)


def stream_in_flight(spark: SparkSession, folder: str, seconds: float = 6 * 3600, delay: str = DELAY) -> DataFrame:
    """Each call and whether a running call suppresses it; accepted is null for a call that came later than the delay."""
    calls = stream(spark, folder, tables.analysis_calls).select("session_id", F.col("requested_at").alias("at"), "recording_id")
    return folded(spark, "stream-in-flight", calls, "session_id", "at", F.lit("CALL"), "recording_id", InFlight(seconds), delay).drop("late")


def stream_expiry(spark: SparkSession, folder: str, delay: str = DELAY) -> DataFrame:
    """Notifications that were dismissed and expired before the session's next one came, or by the stream's end; expires_ms is null for an event that came later than the delay."""
    base = base_stream(spark, folder, "events")
    # An event names the session's latest notification or all, which is the same here: the state holds one.
    action = F.expr("case event_type when 'view' then 'ADD' when 'click' then 'ADD' when 'signup' then 'DISMISS' end")
    events = base.select("event_id", F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("at"), action.alias("action")).where("action is not null")
    return folded(spark, "stream-expiry", events, "session_id", "at", F.col("action"), "event_id", Expiry(REMOVE_DELAY), delay).drop("late")


def stream_pending(spark: SparkSession, folder: str, hours: int = 14, delay: str = DELAY) -> DataFrame:
    """Calls without a result within so many hours, to the stream's end. Rows that came later than the delay are not among them: pending_late() has those."""
    return _pending(spark, folder, hours, delay).where("not late").select("recording_id", "session_id")


def pending_late(spark: SparkSession, folder: str, hours: int = 14, delay: str = DELAY) -> DataFrame:
    """Calls, and results (session_id null), that came later than the delay."""
    return _pending(spark, folder, hours, delay).where("late").select("recording_id", "session_id")


def _pending(spark: SparkSession, folder: str, hours: int, delay: str) -> DataFrame:
    calls = stream(spark, folder, tables.analysis_calls)
    asked = F.struct(F.col("requested_at").alias("at"), F.lit(0).cast("long").alias("order"), F.concat(F.lit("="), F.coalesce(F.col("session_id").cast("string"), F.lit(""))).alias("what"))
    done = F.struct(F.col("completed_at").alias("at"), F.lit(1).cast("long").alias("order"), F.lit(Pending.DONE).alias("what"))
    events = calls.select("recording_id", F.explode(F.array(asked, done)).alias("e")).select("recording_id", "e.at", "e.order", "e.what").where("at is not null")
    return folded(spark, "stream-pending", events, "recording_id", "at", F.col("what"), "order", Pending(hours * 3_600_000_000), delay)


def stream_distinct_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Each request once, however often and late it is sent again: here every request is sent twice."""
    requests = stream(spark, folder, tables.composition_requests)
    twice = requests.select("request_id", "session_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("sent")).select("request_id", "session_id")
    return each_once(twice, "request_id", shared_path(spark, "stream-distinct-requests"), LIVE_MS)
