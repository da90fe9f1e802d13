"""The engine's input tables, derived from the given Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tanpura.session import table


def recordings(events: DataFrame) -> DataFrame:
    """Uploads: names that meet one rule, none, both or in the wrong case; one in four isn't audio."""
    start = F.expr("case event_id % 5 when 0 then 'bhairavi_' when 1 then 'yaman_' when 2 then 'Bhairavi_' when 3 then 'yaman_bhairavi_' else 'take_' end")
    ending = F.expr("case event_id % 4 when 0 then '.mp3' when 1 then '.wav' when 2 then '.flac' else '.txt' end")
    return events.select(F.col("event_id").alias("recording_id"), F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("uploaded_at"), F.concat(start, F.col("event_id").cast("string"), ending).alias("file_name"))


def composition_requests(orders: DataFrame) -> DataFrame:
    """Requests with unknown ragas, blank talas, null styles and numbers outside their domains."""
    return orders.selectExpr(
        "o_orderkey as request_id",
        "o_custkey as session_id",
        "cast(o_orderdate as timestamp) as requested_at",
        "array('bhairavi','yaman','desh','malkauns','bageshri','durga','todi','kafi','unknown')[cast(o_orderkey % 9 as int)] as raga",
        "array('teental','jhaptaal','ektaal','rupak','dadra','keherwa','')[cast(o_custkey % 7 as int)] as tala",
        "array('dhrupad','khayal','thumri','ghazal','tarana','instrumental',null)[cast((o_orderkey div 9) % 7 as int)] as style",
        "cast(30 + o_custkey % 181 as int) as tempo",
        "cast(15 * (1 + o_orderkey % 22) as int) as duration",
        "cast(o_orderkey % 111 - 5 as int) as creativity",
    )


def session_events(events: DataFrame) -> DataFrame:
    action = F.expr("case event_type when 'view' then 'SELECT_FILE' when 'click' then 'ANALYZE_OK' when 'purchase' then 'GENERATE_OK' when 'signup' then 'RESET_ANALYSIS' else 'ANALYZE_ERR' end")
    return events.select("event_id", F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), action.alias("action"))


def notification_events(events: DataFrame) -> DataFrame:
    """toast_id null means all; else the session's latest ADD."""
    action = F.expr("case event_type when 'view' then 'ADD' when 'click' then 'ADD' when 'purchase' then 'UPDATE' when 'signup' then 'DISMISS' else 'REMOVE' end")
    named = events.select("event_id", F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), action.alias("action"), F.col("props").alias("payload"))
    toast = F.expr("case when action = 'ADD' then event_id when event_id % 10 = 0 then null else max(case when action = 'ADD' then event_id end) over (partition by session_id order by ts rows between unbounded preceding and current row) end")
    return named.select("event_id", "session_id", "ts", "action", toast.alias("toast_id"), "payload")


def note_observations(lineitem: DataFrame) -> DataFrame:
    """Notes in both spellings; (recording_id, position) isn't unique."""
    note = "array('Sa','Sa','Komal Re','Re Komal','Re','Re','Komal Ga','Ga Komal','Ga','Ga','Ma','Ma','Tivra Ma','Ma Tivra','Pa','Pa','Komal Dha','Dha Komal','Dha','Dha','Komal Ni','Ni Komal','Ni','Ni')[cast(2 * (l_partkey % 12) + l_linenumber % 2 as int)]"
    return lineitem.selectExpr("l_orderkey as recording_id", "l_linenumber as position", f"{note} as note")


def onsets(part: DataFrame) -> DataFrame:
    """32 onsets for each recording at 40 to 200 beats a minute, with a little jitter."""
    return part.select("p_partkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(31).cast("long"))).alias("k")).selectExpr("p_partkey as recording_id", "k", "k * (60000 div (40 + p_partkey % 161)) + (p_partkey * 31 + k * 17) % 11 as onset_ms")


def analysis_calls(events: DataFrame) -> DataFrame:
    """Requests for an analysis; one in ten never completes."""
    done = F.expr("case when event_id % 10 = 9 then null else cast(ts as timestamp) + make_dt_interval(0, cast(1 + event_id % 13 as int)) end")
    return events.where("event_type = 'click'").select(F.col("event_id").alias("recording_id"), F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("requested_at"), done.alias("completed_at"))


def settings_edits(events: DataFrame) -> DataFrame:
    setting = F.expr("case event_id % 6 when 0 then 'raga' when 1 then 'tala' when 2 then 'style' when 3 then 'tempo' when 4 then 'duration' else 'creativity' end")
    return events.select("event_id", F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), setting.alias("setting"), F.concat(F.lit("v"), (F.col("event_id") % 97).cast("string")).alias("value"))


def playback_positions(events: DataFrame) -> DataFrame:
    return events.selectExpr("event_id", "value as position_s", "case when event_id % 10 = 0 then cast(0 as double) when event_id % 10 = 1 then null else value * 2 end as duration_s")


BASES = {
    recordings: "events", composition_requests: "orders", session_events: "events", notification_events: "events", note_observations: "lineitem",
    onsets: "part", analysis_calls: "events", settings_edits: "events", playback_positions: "events",
}


def load(spark: SparkSession, folder: str, derive) -> DataFrame:
    """A derived table over the tables in folder."""
    return derive(table(spark, folder, BASES[derive]))
