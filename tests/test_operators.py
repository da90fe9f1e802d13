"""Golden rows, boundaries and invariants of the operators."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tanpura.functions import labels as L
from tanpura.operators import analyze as A
from tanpura.operators import catalogue as K
from tanpura.operators import compose as C
from tanpura.operators import content as D
from tanpura.operators import notifications as N
from tanpura.operators import sessions as S
from tanpura.plans import queries as Q
from tanpura.sources import audio, catalog, tables


def column(spark, value, expression, kind="double"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v"))).first()[0]


def test_catalogues_in_order(spark):
    assert [r["id"] for r in catalog.dim_raga(spark).orderBy("ordinal").collect()] == ["bhairavi", "yaman", "desh", "malkauns", "bageshri", "durga", "todi", "kafi"]
    assert [(r["id"], r["beats"]) for r in catalog.dim_tala(spark).orderBy("ordinal").collect()] == [("teental", 16), ("jhaptaal", 10), ("ektaal", 12), ("rupak", 7), ("dadra", 6), ("keherwa", 8)]
    assert [r["id"] for r in catalog.dim_style(spark).orderBy("ordinal").collect()] == ["dhrupad", "khayal", "thumri", "ghazal", "tarana", "instrumental"]


def test_lookup_takes_the_first_and_minds_case(spark):
    dim = catalog.dim_style(spark)
    twice = dim.union(spark.createDataFrame([(9, "khayal", "Other", "x")], dim.schema))
    assert [r["name"] for r in K.by_id(twice, "khayal").collect()] == ["Khayal"]
    assert K.by_id(dim, "Khayal").count() == 0
    assert K.unique_ids(twice).where("id = 'khayal'").first()["name"] == "Khayal"
    assert K.first_id(dim.limit(0)).first()["id"] == ""


def test_tala_beats_agree_with_their_number(spark):
    rows = K.tala_beats(catalog.dim_tala(spark)).groupBy("id", "beats").agg(F.count("*").alias("n"), F.countDistinct("section").alias("sections")).collect()
    assert all(r["n"] == r["beats"] for r in rows) and sum(r["n"] for r in rows) == 59
    assert {r["id"]: r["sections"] for r in rows}["rupak"] == 3


@pytest.mark.parametrize("value,pct,level", [(None, None, "low"), (0.594, 59, "low"), (0.595, 60, "medium"), (0.6, 60, "medium"), (0.794, 79, "medium"), (0.795, 80, "high"), (0.8, 80, "high"), (0.0, 0, "low"), (1.0, 100, "high")])
def test_confidence(spark, value, pct, level):
    assert column(spark, value, L.percent) == pct
    assert column(spark, value, L.level) == level


@pytest.mark.parametrize("value,band", [(None, "Experimental"), (0, "Conservative"), (32, "Conservative"), (33, "Balanced"), (65, "Balanced"), (66, "Experimental"), (100, "Experimental")])
def test_creativity(spark, value, band):
    assert column(spark, value, L.creativity_band, "int") == band


@pytest.mark.parametrize("value,text", [(0.0, "0:00"), (5.0, "0:05"), (59.999, "0:59"), (60.0, "1:00"), (61.0, "1:01"), (300.0, "5:00"), (3600.0, "60:00"), (float("nan"), None), (float("inf"), None), (None, None)])
def test_minutes(spark, value, text):
    assert column(spark, value, L.minutes) == text


@pytest.mark.parametrize("value,want", [(0.0, 0.0), (None, 0.0), (float("nan"), 0.0), (8.0, 25.0)])
def test_progress(spark, value, want):
    assert column(spark, value, lambda d: L.progress(F.lit(2.0), d)) == want


def test_rules_by_chain_and_by_join(spark):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(["bhairavi_1.mp3", "yaman_2", "yaman_bhairavi_3", "Bhairavi_4", "x"])], "recording_id long, file_name string")
    want = [0, 1, 0, None, None]
    assert [r["rule"] for r in A.classify(rows).orderBy("recording_id").collect()] == want
    assert [r["rule"] for r in A.classify_by_rules(rows, catalog.dim_file_rule(spark)).orderBy("recording_id").collect()] == want


def test_defaults_stay_in_range(spark, small):
    rows = Q.default_assignment(spark, small).toPandas()
    assert rows["raga_ordinal"].between(0, 7).all() and rows["tala_ordinal"].between(0, 5).all()
    assert rows["tempo"].between(60, 99).all() and (rows["confidence"] >= 0.4).all() and (rows["confidence"] < 0.9).all()
    assert len(set(rows["raga_ordinal"])) == 8


def requests(spark, *rows):
    at = datetime(2024, 1, 1)
    return spark.createDataFrame([(i, 1, at, *r) for i, r in enumerate(rows)], "request_id long, session_id long, requested_at timestamp, raga string, tala string, style string, tempo int, duration int, creativity int")


def test_gate_and_rejection(spark):
    keys = [("yaman", "rupak", "khayal"), (None, "rupak", "khayal"), ("yaman", "", "khayal"), ("Yaman", "rupak", "khayal"), ("yaman ", "rupak", "khayal"), ("none", None, "")]
    rows = requests(spark, *((*k, 80, 60, 50) for k in keys))
    assert [r["can_submit"] for r in C.submit_gate(rows).orderBy("request_id").collect()] == [True, False, False, True, True, False]
    assert [r["request_id"] for r in C.compose(rows).collect()] == [0]
    assert {r["request_id"]: r["missing"] for r in C.rejected(rows).collect()} == {1: ["raga"], 2: ["tala"], 3: ["raga"], 4: ["raga"], 5: ["raga", "tala", "style"]}


@pytest.mark.parametrize("tempo,duration,creativity,want", [(40, 30, 0, []), (200, 300, 100, []), (39, 0, -1, ["tempo", "duration", "creativity"]), (201, 330, 101, ["tempo", "duration", "creativity"]), (80, 45, 50, ["duration"])])
def test_domains(spark, tempo, duration, creativity, want):
    assert C.domain_violations(requests(spark, ("a", "b", "c", tempo, duration, creativity))).first()["violations"] == want


def test_compositions_and_rejects_make_all_requests(spark, small):
    assert Q.compose(spark, small).count() + Q.rejected_requests(spark, small).count() == Q.requests(spark, small).count()
    assert Q.analyze(spark, small).count() == Q.analyze(spark, small).select("recording_id").distinct().count() == Q.recordings(spark, small).count()


def test_dimensions_are_broadcast(spark, small):
    plan = C.compose(Q.requests(spark, small))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 3 and "SortMergeJoin" not in plan


def notifications(spark, *rows):
    at = datetime(2024, 1, 1)
    return spark.createDataFrame([(i, 1, at + timedelta(seconds=i), *r) for i, r in enumerate(rows)], "event_id long, session_id long, ts timestamp, action string, toast_id long, payload string")


@pytest.mark.parametrize(
    "rows,want",
    [
        ([("ADD", 0, "a")], [(0, "a", True)]),
        ([("ADD", 0, "a"), ("ADD", 1, "b"), ("UPDATE", 0, "c")], [(1, "b", True)]),
        ([("ADD", 0, "a"), ("UPDATE", 0, "c"), ("DISMISS", None, None)], [(0, "c", False)]),
        ([("ADD", 0, "a"), ("DISMISS", 0, None), ("DISMISS", 0, None)], [(0, "a", False)]),
        ([("ADD", 0, "a"), ("REMOVE", 0, None), ("UPDATE", 0, "x")], []),
        ([("ADD", 0, "a"), ("UPDATE", None, "x")], [(0, "a", True)]),
        ([("ADD", 0, "a"), ("REMOVE", None, None)], []),
        ([("REMOVE", None, None)], []),
    ],
)
def test_notification_fold(spark, rows, want):
    got = N.state(notifications(spark, *rows)).collect()
    assert [(r["toast_id"], r["payload"], r["open"]) for r in got] == want


def test_first_dismiss_starts_the_clock(spark):
    rows = notifications(spark, ("ADD", 0, "a"), ("DISMISS", 0, None), ("DISMISS", 0, None))
    got = N.expiry(rows).first()
    dismissed = rows.where("action = 'DISMISS'").agg(F.min(F.unix_millis("ts"))).first()[0]
    assert got["expires_ms"] == dismissed + 1_000_000
    assert got["alive"]


def test_prefill_counts_a_tempo_of_0_as_missing(spark):
    finals = spark.createDataFrame([(1, 10), (2, 11), (3, None)], "session_id long, analysis_event long")
    analyses = spark.createDataFrame([(10, ("desh",), ("rupak",), 0), (11, None, ("dadra",), 70)], "recording_id long, raga struct<id: string>, tala struct<id: string>, tempo int")
    got = {r["session_id"]: (r["raga"], r["tala"], r["style"], r["tempo"], r["duration"], r["creativity"]) for r in S.prefilled(finals, analyses).collect()}
    assert got == {1: ("desh", "rupak", "dhrupad", 80, 60, 50), 2: ("bhairavi", "dadra", "dhrupad", 70, 60, 50), 3: ("bhairavi", "teental", "dhrupad", 80, 60, 50)}


def test_timeline_round_trips(spark):
    rows = requests(spark, ("yaman", "rupak", "khayal", 60, 60, 50), ("yaman", "teental", "khayal", 120, 90, 50), ("yaman", "dadra", "khayal", 200, 300, 50))
    made = D.timeline(C.flat(C.compose(rows))).cache()
    assert {r["request_id"]: r["count"] for r in made.groupBy("request_id").count().collect()} == {0: 60, 1: 180, 2: 1000}
    assert {r["request_id"]: r["tala_id"] for r in D.tala_match(made).collect()} == {0: "rupak", 1: "teental", 2: "dadra"}
    tempos = D.tempo_estimate(made.select(F.col("request_id").alias("recording_id"), F.col("b").alias("k"), F.col("offset_ms").alias("onset_ms")))
    assert {r["recording_id"]: r["tempo"] for r in tempos.collect()} == {0: 60, 1: 120, 2: 200}


def test_first_cycles_of_a_timeline(spark):
    rows = C.flat(C.compose(requests(spark, ("yaman", "rupak", "khayal", 60, 60, 50), ("yaman", "teental", "khayal", 40, 15, 50))))
    whole = sorted(map(tuple, D.timeline(rows).where("cycle < 2").collect()))
    assert sorted(map(tuple, D.timeline(rows, cycles=2).collect())) == whole and len(whole) == 14 + 10


def test_stale_results_of_a_long_session(spark):
    """Against a plain search; the session is long enough to show a cost that grows with its square."""
    n, at = 20_000, datetime(2024, 1, 1)
    calls = spark.range(n).selectExpr("id as recording_id", "1L as session_id", "timestamp_micros(1704067200000000 + id * 1000000) as requested_at", "timestamp_micros(1704067200000000 + (id + id % 7) * 1000000) as completed_at")
    chosen = spark.range(n).where("id % 5 = 0").selectExpr("id as event_id", "1L as session_id", "timestamp_micros(1704067200000000 + id * 1000000) as ts", "'SELECT_FILE' as action")
    odd = spark.createDataFrame([(n, 1, at, None), (n + 1, 1, None, at), (n + 2, None, at, at)], "recording_id long, session_id long, requested_at timestamp, completed_at timestamp")
    got = sorted(r["recording_id"] for r in S.stale_results(calls.union(odd), chosen).collect())
    assert got == [i for i in range(n) if any(j % 5 == 0 and j < n - n % 5 for j in range(i + 1, i + i % 7 + 1))]


def test_timeline_of_no_beats_is_empty(spark):
    assert D.timeline(C.flat(C.compose(requests(spark, ("yaman", "rupak", "khayal", 40, 0, 50))))).count() == 0


def test_raga_match_of_its_own_notes(spark):
    ragas = catalog.dim_raga(spark)
    observed = ragas.select(F.col("ordinal").cast("long").alias("recording_id"), F.posexplode("notes").alias("position", "note"))
    got = {r["recording_id"]: (r["raga_id"], r["confidence"]) for r in D.raga_match(observed, ragas).collect()}
    assert got == {i: (r[0], 1.0) for i, r in enumerate(catalog.RAGAS)}


def test_export_and_read_back(spark, small, tmp_path):
    made = C.flat(C.compose(Q.requests(spark, small)))
    back = audio.export_compositions(made, f"file://{tmp_path}/out")
    assert back.count() == made.count()
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {f"raga_id={r[0]}" for r in catalog.RAGAS}


def test_audio_files_by_ending(spark, tmp_path):
    for name in ("a.mp3", "b.wav", "c.flac", "d.txt"):
        (tmp_path / name).write_bytes(b"x" * 5)
    got = audio.audio_files(spark, f"file://{tmp_path}")
    assert {(r["file_name"], r["length"]) for r in got.collect()} == {("a.mp3", 5), ("b.wav", 5), ("c.flac", 5)}


def test_accepted_calls_equal_a_fold(spark, small):
    calls = tables.load(spark, small, tables.analysis_calls)
    want, last = {}, {}
    for r in sorted(calls.collect(), key=lambda r: (r["session_id"], r["requested_at"], r["recording_id"])):
        ok = r["session_id"] not in last or r["requested_at"] >= last[r["session_id"]] + timedelta(hours=6)
        want[r["recording_id"]] = ok
        if ok:
            last[r["session_id"]] = r["requested_at"]
    assert {r["recording_id"]: r["accepted"] for r in S.accepted(calls, 6 * 3600).collect()} == want
