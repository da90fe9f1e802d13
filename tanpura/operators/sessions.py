"""Folds of session event logs: state after each event, final state, stale results, prefilled settings, pending and accepted calls."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tanpura.operators import ranges
from tanpura.session import written
from tanpura.sources import catalog

SETTINGS = ("raga", "tala", "style", "tempo", "duration", "creativity")


def state_after_each(events: DataFrame, most: int | None = None) -> DataFrame:
    """For each event the events that set the session's file, analysis and composition (null: none), and the two gates.

    Choosing a file clears the analysis; a failed analysis keeps the old one. The latest event of each kind is a running
    aggregate, which a session of more than most rows takes range by range.
    """
    at = F.struct("us", "event_id")
    of = lambda *actions: ranges.last_of(F.when(F.col("action").isin(*actions), F.struct("event_id", "action")), at)
    kinds = {"__f": of("SELECT_FILE"), "__a": of("ANALYZE_OK", "SELECT_FILE", "RESET_ANALYSIS"), "__c": of("GENERATE_OK")}
    state = ranges.running(events.withColumn("us", F.unix_micros("ts")), "session_id", "us", ["us", "event_id"], kinds, most)
    analysis = F.when(F.col("__a.action") == "ANALYZE_OK", F.col("__a.event_id"))
    file, composition = F.col("__f.event_id"), F.col("__c.event_id")
    return state.select("event_id", "session_id", "ts", file.alias("file_event"), analysis.alias("analysis_event"), composition.alias("composition_event"), file.isNotNull().alias("can_analyze"), composition.isNotNull().alias("can_play"))


def final_state(events: DataFrame) -> DataFrame:
    """The state after each session's last event, by aggregation alone."""
    at = F.struct("ts", "event_id")
    last = lambda *actions: F.max(F.when(F.col("action").isin(*actions), at))
    sums = events.groupBy("session_id").agg(last("SELECT_FILE").alias("file"), last("ANALYZE_OK").alias("set"), last("SELECT_FILE", "RESET_ANALYSIS").alias("clear"), last("GENERATE_OK").alias("composition"))
    analysis = F.when(F.col("clear").isNull() | (F.col("set") > F.col("clear")), F.col("set.event_id"))
    return sums.select("session_id", F.col("file.event_id").alias("file_event"), analysis.alias("analysis_event"), F.col("composition.event_id").alias("composition_event"))


def stale_results(calls: DataFrame, events: DataFrame, most: int | None = None) -> DataFrame:
    """Calls during which the session chose another file: the first choice after the request isn't after the result.

    Each call looks up the next choice after it in one sort of calls and choices, so that neither side is multiplied; a
    session of more than most rows goes range by range. Calls that never end and null times give no row.
    """
    chosen = events.where("action = 'SELECT_FILE'").select("session_id", F.unix_micros("ts").alias("at")).withColumn("chosen", F.col("at"))
    asked = calls.select("session_id", F.unix_micros("requested_at").alias("at"), "recording_id", F.unix_micros("completed_at").alias("until"))
    return ranges.next_points(asked, chosen, "session_id", "chosen", True, most).where("next <= until").select("recording_id", "session_id")


def prefilled(finals: DataFrame, analyses: DataFrame) -> DataFrame:
    """Settings that a session starts with: those of its analysis, else the catalogues' first and the defaults.

    finals has session_id and analysis_event; analyses has recording_id (the event), raga, tala and tempo. A tempo of 0 counts as missing.
    """
    spark = finals.sparkSession
    first = lambda dim, name: dim.agg(F.coalesce(F.min_by("id", "ordinal"), F.lit("")).alias(name))
    defaults = catalog.dim_defaults(spark).withColumnsRenamed({"tempo": "d_tempo"})
    for dim, name in ((catalog.dim_raga(spark), "d_raga"), (catalog.dim_tala(spark), "d_tala"), (catalog.dim_style(spark), "style")):
        defaults = defaults.crossJoin(F.broadcast(first(dim, name)))  # one row with one row
    known = analyses.select(F.col("recording_id").alias("analysis_event"), F.col("raga.id").alias("a_raga"), F.col("tala.id").alias("a_tala"), F.col("tempo").alias("a_tempo"))
    rows = finals.select("session_id", "analysis_event").join(known, "analysis_event", "left").crossJoin(F.broadcast(defaults))  # with one row
    given = lambda column, default: F.coalesce(F.nullif(F.col(column), F.lit("")), F.col(default))
    return rows.select("session_id", given("a_raga", "d_raga").alias("raga"), given("a_tala", "d_tala").alias("tala"), "style", F.coalesce(F.nullif("a_tempo", F.lit(0)), F.col("d_tempo")).alias("tempo"), "duration", "creativity")


def settings_of(edits: DataFrame) -> DataFrame:
    """Each session's last value of each setting."""
    last = lambda k: F.max_by(F.when(F.col("setting") == k, F.col("value")), F.when(F.col("setting") == k, F.struct("ts", "event_id"))).alias(k)
    return edits.groupBy("session_id").agg(*map(last, SETTINGS))


def pending(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls without a result."""
    return calls.join(results, "recording_id", "left_anti").select("recording_id", "session_id", "requested_at")


def accepted(calls: DataFrame, seconds: float, most: int | None = None) -> DataFrame:
    """Calls that a session's running call doesn't suppress: accepted iff seconds have passed since the last accepted one.

    A greedy fold over each session in order. Sessions of up to most calls are dealt to tasks, sorted there and folded as
    batches come. The fold of longer ones is a path: each call points to the first one that could be accepted after it, and
    what is accepted can be reached from the session's first call. It is followed by pointer doubling over all tasks.
    Calls at the same time count in the order of recording_id; a call without a time comes first in its session.
    """
    most = most or ranges.RANGE_ROWS
    if seconds <= 0:
        return calls.select("recording_id", "session_id", F.lit(True).alias("accepted"))
    rows = calls.select("recording_id", "session_id", F.unix_micros("requested_at").alias("us"))
    long = rows.groupBy("session_id").agg(F.count("*").alias("n")).where(F.col("n") > most).select("session_id")
    if long.isEmpty():
        return _folded(rows, seconds)
    long = F.broadcast(long) if long.count() <= LONG_SESSIONS else long
    short = _folded(rows.join(long, "session_id", "left_anti"), seconds)
    return short.union(_followed(rows.join(long, "session_id", "left_semi"), seconds, most))


#: Sessions of more than RANGE_ROWS calls that are broadcast as a list of ids.
LONG_SESSIONS = 100_000


def _folded(rows: DataFrame, seconds: float) -> DataFrame:
    gap = round(seconds * 1_000_000)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, last = None, None
        for rows in batches:
            keep = []
            for s, at in zip(rows["session_id"], rows["us"], strict=True):
                if session is None or s != session or last != last or at >= last + gap:  # a time that is null isn't equal to itself
                    session, last = s, at
                    keep.append(True)
                else:
                    keep.append(False)
            yield rows.assign(accepted=keep)[["recording_id", "session_id", "accepted"]]

    dealt = rows.repartition("session_id").sortWithinPartitions("session_id", "us", "recording_id")
    return dealt.mapInPandas(fold, "recording_id long, session_id long, accepted boolean")


def _followed(rows: DataFrame, seconds: float, most: int) -> DataFrame:
    """accepted() by pointers. A call is named by (us, recording_id), its place in the session."""
    place = F.struct("us", "recording_id")
    calls = written(rows.where("us is not null"), "calls")
    apart = written(calls.distinct(), "call-places")  # repeated rows would double with each step
    points = apart.select("session_id", F.col("us").alias("at"), place.alias("place"))
    probes = apart.select("session_id", (F.col("us") + round(seconds * 1_000_000)).alias("at"), place.alias("own"))
    steps = written(ranges.next_points(probes, points, "session_id", "place", False, most).select("session_id", "own", F.col("next").alias("to")), "call-steps")
    reached = written(calls.groupBy("session_id").agg(F.min(place).alias("own")), "call-reached")
    while True:
        # Those that are reached by up to 2^k steps, and from each of them 2^k steps on.
        new = reached.join(steps, ["session_id", "own"]).where("to is not null").select("session_id", F.col("to").alias("own"))
        more = written(new.join(reached, ["session_id", "own"], "left_anti").distinct(), "call-reached")
        if more.isEmpty():
            break
        reached = written(reached.union(more), "call-reached")
        on = steps.select("session_id", F.col("own").alias("to"), F.col("to").alias("next"))
        steps = written(steps.where("to is not null").join(on, ["session_id", "to"]).select("session_id", "own", F.col("next").alias("to")), "call-steps")
    taken = reached.select("session_id", "own.us", "own.recording_id").withColumn("taken", F.lit(True))
    # Of rows that are equal in everything the first is accepted.
    timed = calls.groupBy("session_id", "us", "recording_id").agg(F.count("*").alias("n")).join(taken, ["session_id", "us", "recording_id"], "left")
    timed = timed.select("recording_id", "session_id", "taken", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i"))
    timed = timed.select("recording_id", "session_id", (F.coalesce("taken", F.lit(False)) & (F.col("i") == 1)).alias("accepted"))
    return timed.union(rows.where("us is null").select("recording_id", "session_id", F.lit(True).alias("accepted")))
