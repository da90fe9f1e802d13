"""The registered queries: each operator over the given tables, so that its work grows with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tanpura.functions import labels as L
from tanpura.operators import analyze as A
from tanpura.operators import catalogue as K
from tanpura.operators import compose as C
from tanpura.operators import content as D
from tanpura.operators import notifications as N
from tanpura.operators import sessions as S
from tanpura.session import shared_path
from tanpura.sources import audio, catalog, tables
from tanpura.streaming import jobs

#: How long a call suppresses others in the checked query.
IN_FLIGHT_SECONDS = 6 * 3600


def recordings(spark: SparkSession, d: str) -> DataFrame:
    return tables.load(spark, d, tables.recordings)


def requests(spark: SparkSession, d: str) -> DataFrame:
    return tables.load(spark, d, tables.composition_requests)


def named(rows: DataFrame, key: str) -> DataFrame:
    """How many rows name each id."""
    return rows.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n"))


def catalog_with_requests(spark: SparkSession, d: str, dim: DataFrame, key: str) -> DataFrame:
    found = dim.join(named(requests(spark, d), key), "id", "left").withColumn("n_requests", F.coalesce("n", F.lit(0)))
    return found.orderBy("ordinal").select("ordinal", *(c for c in dim.columns if c not in ("ordinal", "notes", "scale")), *([F.array_join("notes", ",").alias("notes")] if "notes" in dim.columns else []), "n_requests")


def catalog_ragas(spark, d):
    return catalog_with_requests(spark, d, catalog.dim_raga(spark), "raga")


def catalog_talas(spark, d):
    return catalog_with_requests(spark, d, catalog.dim_tala(spark), "tala")


def catalog_styles(spark, d):
    return catalog_with_requests(spark, d, catalog.dim_style(spark), "style")


def known_analyses(spark, d):
    """The rules with what they stand for, and how many recordings each one takes."""
    met = A.classify(recordings(spark, d)).groupBy("rule").agg(F.count("*").alias("n"))
    rules = A.known_analyses(spark)
    return rules.join(met, F.col("rule") == F.col("priority"), "left").select("priority", "pattern", F.col("raga.name").alias("raga_name"), F.col("tala.name").alias("tala_name"), rules["tempo"], "confidence", F.array_join(rules["notes"], ",").alias("notes"), F.coalesce("n", F.lit(0)).alias("n_recordings"))


def audio_recordings(spark, d):
    return recordings(spark, d).where(audio.is_audio()).select("recording_id", "session_id", "file_name")


def composition_export(spark, d):
    """Compositions after a round trip through files partitioned by raga."""
    back = audio.export_compositions(C.flat(C.compose(requests(spark, d))), shared_path(spark, "compositions"))
    return back.select("request_id", "id", F.col("raga_id").cast("string").alias("raga_id"), "tala_id", "style_id", "audio_url")


def raga_labels(spark, d):
    found = K.attach(requests(spark, d), "raga", catalog.dim_raga(spark), "r")
    return found.select("request_id", L.raga_label(F.col("r.name"), F.col("r.mood")).alias("label"))


def tala_labels(spark, d):
    found = K.attach(K.attach(requests(spark, d), "tala", catalog.dim_tala(spark), "t"), "style", catalog.dim_style(spark), "s")
    return found.select("request_id", L.tala_label(F.col("t.name"), F.col("t.beats")).alias("tala_label"), F.col("s.name").alias("style_label"))


def looked_up(spark, d, dim, key):
    found = K.attach(requests(spark, d), key, K.unique_ids(dim), "row")
    return found.select("request_id", F.col(key).alias("id"), F.col("row.name").alias("name"), F.col("row.description").alias("description"))


def raga_by_id(spark, d):
    return looked_up(spark, d, catalog.dim_raga(spark), "raga")


def tala_by_id(spark, d):
    return looked_up(spark, d, catalog.dim_tala(spark), "tala")


def style_by_id(spark, d):
    return looked_up(spark, d, catalog.dim_style(spark), "style")


def catalog_defaults(spark, d):
    """Requests with the catalogues' first ids for blank keys."""
    rows = requests(spark, d)
    for dim, key in ((catalog.dim_raga(spark), "raga"), (catalog.dim_tala(spark), "tala"), (catalog.dim_style(spark), "style")):
        first = F.broadcast(K.first_id(dim).withColumnRenamed("id", f"first_{key}"))
        rows = rows.crossJoin(first).withColumn(key, F.coalesce(F.nullif(key, F.lit("")), F.col(f"first_{key}")))  # with one row
    return rows.select("request_id", "raga", "tala", "style")


def mood_tokens(spark, d):
    """The moods of each request's raga."""
    return requests(spark, d).join(F.broadcast(K.mood_tokens(catalog.dim_raga(spark))), F.col("raga") == F.col("id")).select("request_id", "place", "mood")


def tala_beats(spark, d):
    """The beats of each tala, and how many requests play them."""
    beats = K.tala_beats(catalog.dim_tala(spark))
    return beats.join(named(requests(spark, d), "tala"), "id", "left").select("id", "section", "beat", "syllable", F.coalesce("n", F.lit(0)).alias("n_requests"))


def raga_categories(spark, d):
    """The ragas of each time and mood, and how many requests ask for them."""
    members = K.categories(catalog.dim_raga(spark)).select("kind", "category", "members", F.explode("members.id").alias("id"))
    found = members.join(named(requests(spark, d), "raga"), "id", "left")
    return found.groupBy("kind", "category").agg(F.first(F.array_join(F.transform("members", lambda m: m["id"]), ",")).alias("members"), F.sum(F.coalesce("n", F.lit(0))).alias("n_requests"))


def confidence_levels(spark, d):
    found = A.analyze(recordings(spark, d))
    return found.select("recording_id", L.percent(F.col("confidence")).alias("pct"), L.level(F.col("confidence")).alias("level"))


def creativity_bands(spark, d):
    return requests(spark, d).select("request_id", "creativity", L.creativity_band(F.col("creativity")).alias("band"))


def duration_format(spark, d):
    return requests(spark, d).select("request_id", L.minutes(F.col("duration")).alias("text"))


def position_format(spark, d):
    rows = tables.load(spark, d, tables.playback_positions)
    return rows.select("event_id", L.minutes(F.col("position_s")).alias("position"), L.minutes(F.col("duration_s")).alias("duration"))


def playback_progress(spark, d):
    return tables.load(spark, d, tables.playback_positions).select("event_id", L.progress(F.col("position_s"), F.col("duration_s")).alias("progress"))


def analysis_messages(spark, d):
    return A.messages(A.analyze(recordings(spark, d)))


def composition_messages(spark, d):
    return C.messages(C.compose(requests(spark, d)))


def notification_texts(spark, d):
    """Title, text and severity of the events that show a message; names and numbers are filled in elsewhere."""
    kind = F.expr("case action when 'ANALYZE_OK' then 'analysis_ok' when 'ANALYZE_ERR' then 'analysis_failed' when 'GENERATE_OK' then 'generation_ok' end")
    rows = tables.load(spark, d, tables.session_events).withColumn("kind", kind)
    return rows.join(F.broadcast(catalog.dim_message(spark)), "kind").select("event_id", "kind", "title", "text_template", "severity")


def message_catalogue(spark, d):
    """All kinds of message, and how many rows show each: events of a session, rejected requests, uploads that aren't audio."""
    shown = notification_texts(spark, d).select("kind")
    shown = shown.unionByName(C.rejected(requests(spark, d)).select(F.lit("generation_failed").alias("kind")))
    shown = shown.unionByName(recordings(spark, d).where(~audio.is_audio()).select(F.lit("no_file").alias("kind")))
    counts = shown.groupBy("kind").agg(F.count("*").alias("n"))
    return catalog.dim_message(spark).join(counts, "kind", "left").select("kind", "title", "text_template", "severity", F.coalesce("n", F.lit(0)).alias("n_shown"))


def analysis_cards(spark, d):
    return A.cards(A.analyze(recordings(spark, d)))


def composition_cards(spark, d):
    return C.cards(C.compose(requests(spark, d)))


def analysis_notes(spark, d):
    return A.notes(A.analyze(recordings(spark, d)))


def settings_from_edits(spark, d):
    return S.settings_of(tables.load(spark, d, tables.settings_edits))


def canonical_notes(spark, d):
    rows = tables.load(spark, d, tables.note_observations)
    return rows.groupBy(L.canonical_note(F.col("note")).alias("note")).agg(F.count("*").alias("n"), F.countDistinct("recording_id").alias("n_recordings"))


def submit_gate(spark, d):
    return C.submit_gate(requests(spark, d)).select("request_id", "can_submit")


def rejected_requests(spark, d):
    return C.rejected(requests(spark, d)).select("request_id", F.array_join("missing", ",").alias("missing"))


def domain_violations(spark, d):
    return C.domain_violations(requests(spark, d)).select("request_id", F.array_join("violations", ",").alias("violations"))


def undetected_recordings(spark, d):
    return A.detected(D.with_ragas(content(spark, d)))[1].select("recording_id", "confidence")


def resolved_requests(spark, d):
    found = C.resolve(requests(spark, d))
    return found.select("request_id", F.col("raga_row.name").alias("raga_name"), F.col("tala_row.name").alias("tala_name"), F.col("style_row.name").alias("style_name"))


def classify_recordings(spark, d):
    return A.classify_by_rules(recordings(spark, d), catalog.dim_file_rule(spark)).select("recording_id", "rule")


def compose(spark, d):
    return C.flat(C.compose(requests(spark, d)))


def analyze(spark, d):
    found = A.analyze(recordings(spark, d))
    return found.select("recording_id", "session_id", "file_name", "rule", F.col("raga.id").alias("raga_id"), F.col("raga.name").alias("raga_name"), F.col("tala.id").alias("tala_id"), "tempo", "confidence", F.array_join("notes", ",").alias("notes"))


def default_assignment(spark, d):
    rows = recordings(spark, d).where(A.rule_of(F.col("file_name")).isNull())
    return rows.select("recording_id", *(c.alias(k) for k, c in A.defaults_of(F.col("file_name")).items()))


def prefilled_settings(spark, d):
    return S.prefilled(S.final_state(tables.load(spark, d, tables.session_events)), A.analyze(recordings(spark, d)))


def latest_notifications(spark, d):
    return N.latest(tables.load(spark, d, tables.notification_events), 3).select("session_id", "rank", "toast_id", "payload")


def session_state(spark, d):
    return S.state_after_each(tables.load(spark, d, tables.session_events)).drop("ts")


def session_final_state(spark, d):
    return S.final_state(tables.load(spark, d, tables.session_events))


def stale_results(spark, d):
    return S.stale_results(tables.load(spark, d, tables.analysis_calls), tables.load(spark, d, tables.session_events))


def notification_state(spark, d):
    return N.state(tables.load(spark, d, tables.notification_events))


def notification_expiry(spark, d):
    return N.expiry(tables.load(spark, d, tables.notification_events))


def notification_sequence(spark, d):
    return N.sequence(tables.load(spark, d, tables.notification_events))


def raga_match(spark, d):
    return D.raga_match(tables.load(spark, d, tables.note_observations), catalog.dim_raga(spark))


def raga_candidates(spark, d):
    return D.raga_candidates(tables.load(spark, d, tables.note_observations), catalog.dim_raga(spark))


def tempo_estimate(spark, d):
    return D.tempo_estimate(tables.load(spark, d, tables.onsets))


def beats(spark, d, cycles=None):
    return D.timeline(C.flat(C.compose(requests(spark, d))), cycles)


def tala_match(spark, d):
    return D.tala_match(beats(spark, d, cycles=1))


def content(spark, d, talas_found=None):
    return D.content_analysis(tables.load(spark, d, tables.note_observations), tables.load(spark, d, tables.onsets), catalog.dim_raga(spark), talas_found)


def content_analysis(spark, d):
    return content(spark, d, tala_match(spark, d))


def composition_timeline(spark, d):
    """Every composition's beats, summed up by their place in the cycle."""
    sums = beats(spark, d).groupBy("request_id", "beat", "syllable")
    return sums.agg(F.count("*").alias("n"), F.min("offset_ms").alias("first_ms"), F.max("offset_ms").alias("last_ms"), F.sum("offset_ms").alias("sum_ms"), F.max("cycle").alias("last_cycle"))


def pending_calls(spark, d):
    calls = tables.load(spark, d, tables.analysis_calls)
    return S.pending(calls, calls.where("completed_at is not null").select("recording_id")).drop("requested_at")


def accepted_calls(spark, d):
    return S.accepted(tables.load(spark, d, tables.analysis_calls), IN_FLIGHT_SECONDS)


BATCH = [
    catalog_ragas, catalog_talas, catalog_styles, known_analyses, audio_recordings, composition_export, raga_labels, tala_labels, raga_by_id, tala_by_id, style_by_id,
    catalog_defaults, mood_tokens, tala_beats, raga_categories, confidence_levels, creativity_bands, duration_format, position_format, playback_progress, analysis_messages,
    composition_messages, notification_texts, message_catalogue, analysis_cards, composition_cards, analysis_notes, settings_from_edits, canonical_notes, submit_gate, rejected_requests,
    domain_violations, undetected_recordings, resolved_requests, classify_recordings, compose, analyze, default_assignment, prefilled_settings, latest_notifications,
    session_state, session_final_state, stale_results, notification_state, notification_expiry, notification_sequence, raga_match, raga_candidates, tempo_estimate,
    tala_match, content_analysis, composition_timeline, pending_calls, accepted_calls,
]
STREAMS = [jobs.stream_analyze, jobs.stream_compose, jobs.stream_session_state, jobs.stream_pending, jobs.stream_in_flight, jobs.stream_expiry, jobs.stream_distinct_requests]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in BATCH + STREAMS}
