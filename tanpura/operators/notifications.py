"""Folds of notification logs. A session shows one notification at a time: a new one takes the old one's place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tanpura.operators import ranges

# Fixed value: how long a dismissed notification stays, in milliseconds.
REMOVE_DELAY = 1_000_000


def latest(events: DataFrame, k: int = 1) -> DataFrame:
    """Each session's k newest notifications, by rank. For k = 1 an aggregation, beyond that a window."""
    adds = events.where("action = 'ADD'")
    if k == 1:
        return adds.groupBy("session_id").agg(F.max(F.struct("ts", "event_id", "payload")).alias("m")).select("session_id", F.col("m.event_id").alias("toast_id"), F.col("m.payload").alias("payload"), F.col("m.ts").alias("ts"), F.lit(1).alias("rank"))
    newest = W.partitionBy("session_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return adds.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= k).select("session_id", F.col("event_id").alias("toast_id"), "payload", "ts", "rank")


def touching(events: DataFrame) -> DataFrame:
    """Later events beside the session's shown notification: toast (its id), shown_at, first_payload, and the event's columns.

    An event names a notification or, with a null toast_id and for DISMISS and REMOVE only, all.
    """
    shown = latest(events).select("session_id", F.col("toast_id").alias("toast"), F.col("ts").alias("shown_at"), F.col("payload").alias("first_payload"))
    meant = (F.col("toast_id") == F.col("toast")) | (F.col("toast_id").isNull() & F.col("action").isin("DISMISS", "REMOVE"))
    return shown.join(events.where("action <> 'ADD'"), "session_id", "left").withColumn("meant", F.coalesce(meant & (F.col("ts") > F.col("shown_at")), F.lit(False)))


def _any(action: str) -> Column:
    return F.coalesce(F.bool_or(F.col("meant") & (F.col("action") == action)), F.lit(False))


def state(events: DataFrame) -> DataFrame:
    """The notification that each session shows after its log: session_id, toast_id, payload, open. Removed ones give no row."""
    update = F.when(F.col("meant") & (F.col("action") == "UPDATE"), F.struct("ts", "event_id"))
    sums = touching(events).groupBy("session_id", "toast", "first_payload").agg(F.max_by("payload", update).alias("patch"), (~_any("DISMISS")).alias("open"), _any("REMOVE").alias("gone"))
    return sums.where("not gone").select("session_id", F.col("toast").alias("toast_id"), F.coalesce("patch", "first_payload").alias("payload"), "open")


def expiry(events: DataFrame) -> DataFrame:
    """Dismissed notifications: when they expire (the first DISMISS starts the clock), and whether they are alive at the log's end."""
    first = F.min(F.when(F.col("meant") & (F.col("action") == "DISMISS"), F.unix_millis("ts")))
    sums = touching(events).groupBy("session_id", F.col("toast").alias("toast_id")).agg((first + REMOVE_DELAY).alias("expires_ms")).where("expires_ms is not null")
    as_of = events.agg(F.max(F.unix_millis("ts")).alias("as_of"))
    return sums.crossJoin(F.broadcast(as_of)).select("session_id", "toast_id", "expires_ms", (F.col("expires_ms") > F.col("as_of")).alias("alive"))  # with one row


def sequence(events: DataFrame, most: int | None = None) -> DataFrame:
    """Each session's notifications numbered from 1, as text; a session of more than most goes range by range."""
    adds = events.where("action = 'ADD'").select("event_id", "session_id", F.unix_micros("ts").alias("us"))
    numbered = ranges.running(adds, "session_id", "us", ["us", "event_id"], {"number": ranges.numbering()}, most)
    return numbered.select("event_id", "session_id", F.col("number").cast("string").alias("toast_number"))
