"""The streams against their batch forms."""

import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tanpura import session
from tanpura.operators import notifications as N
from tanpura.operators import sessions as S
from tanpura.sources import tables
from tanpura.streaming import guard, jobs, ordered


def test_expired_notifications(spark, small):
    ended = {(r["session_id"], r["toast_id"], r["expires_ms"]) for r in jobs.stream_expiry(spark, small).collect()}
    log = tables.load(spark, small, tables.notification_events)
    latest = {(r["session_id"], r["toast_id"]) for r in N.latest(log).collect()}
    assert {x for x in ended if x[:2] in latest} == {(r["session_id"], r["toast_id"], r["expires_ms"]) for r in N.expiry(log).collect()}


def test_pending_calls_are_those_without_a_result(spark, small):
    calls = tables.load(spark, small, tables.analysis_calls)
    batch = sorted(r["recording_id"] for r in S.pending(calls, calls.where("completed_at is not null")).collect())
    assert sorted(r["recording_id"] for r in jobs.stream_pending(spark, small).collect()) == batch


def shuffled(spark, small, tmp_path, monkeypatch, n=3):
    """The events in files out of time order, one to a batch."""
    monkeypatch.setattr(jobs, "BATCH_BYTES", 1)
    session.table(spark, small, "events").withColumn("user_id", F.nullif("user_id", F.lit(3))).repartition(n).write.parquet(f"file://{tmp_path}/events.parquet")
    return f"file://{tmp_path}"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("job", [jobs.stream_in_flight, jobs.stream_pending, jobs.stream_expiry], ids=lambda f: f.__name__)
def test_files_out_of_order_change_nothing(spark, small, tmp_path, monkeypatch, job):
    session.table(spark, small, "events").withColumn("user_id", F.nullif("user_id", F.lit(3))).coalesce(1).write.parquet(f"file://{tmp_path}/whole/events.parquet")
    want = rows(job(spark, f"file://{tmp_path}/whole"))
    assert rows(job(spark, shuffled(spark, small, tmp_path, monkeypatch))) == want and want


def test_calls_later_than_the_delay_are_marked(spark, small, tmp_path, monkeypatch):
    calls = tables.load(spark, small, tables.analysis_calls)
    got = jobs.stream_in_flight(spark, shuffled(spark, small, tmp_path, monkeypatch), delay="1 hour").collect()
    late = [r for r in got if r["accepted"] is None]
    assert late and sorted(r["recording_id"] for r in got) == sorted(r["recording_id"] for r in calls.collect())


def test_late_calls_and_results_are_given_apart(spark, small, tmp_path, monkeypatch):
    calls = tables.load(spark, small, tables.analysis_calls)
    folder = shuffled(spark, small, tmp_path, monkeypatch)
    found, late = jobs.stream_pending(spark, folder, delay="1 hour").collect(), jobs.pending_late(spark, folder, delay="1 hour").collect()
    unfinished = {r["recording_id"] for r in calls.where("completed_at is null").collect()}
    assert unfinished <= {r["recording_id"] for r in found + late}


def test_state_over_many_batches_of_mixed_order(spark, small, tmp_path, monkeypatch):
    """Files of a shuffled log, one to a batch."""
    monkeypatch.setattr(jobs, "BATCH_BYTES", 1)
    events = session.table(spark, small, "events").withColumn("user_id", F.nullif("user_id", F.lit(3)))
    events.repartition(5).write.parquet(f"file://{tmp_path}/events.parquet")
    want = S.final_state(tables.session_events(events)).collect()
    assert rows(jobs.stream_session_state(spark, f"file://{tmp_path}")) == sorted(map(tuple, want), key=str)


def test_keys_come_once_with_state_that_ends(spark, tmp_path):
    """Five runs of one stream, each with new keys, keys of the run before and of the first one; the time to live ends between runs."""
    out, at, sizes = f"file://{tmp_path}/out", f"file://{tmp_path}/in", []
    for i in range(5):
        keys = [*range(100 * i, 100 * i + 100), *range(max(0, 100 * i - 30), 100 * i), *range(20), None]
        spark.createDataFrame([(k, i) for k in keys], "id long, run int").coalesce(1).write.mode("append").parquet(at)
        watch = []
        got = guard.each_once(spark.readStream.schema("id long, run int").parquet(at), "id", out, 1, watch).collect()
        assert sorted((r["id"] is not None, r["id"] or 0) for r in got) == [(False, 0), *((True, k) for k in range(100 * i + 100))]
        sizes.append(max(p["stateOperators"][0]["numRowsTotal"] for p in watch if p["stateOperators"]))
    assert all(r["run"] == (r["id"] or 0) // 100 for r in got)
    assert max(sizes[1:]) <= 2 * sizes[0]  # five times the keys, the same state


def test_guard_state_goes_by_groups_of_keys_and_ends(spark, tmp_path, monkeypatch):
    """Keys that are sent again get past the state only once the time to live has ended; the state has rows for groups, and longs beside nulls stay exact."""
    monkeypatch.setattr(guard, "GROUPS", 8)
    big, whole, passed, watch = (1 << 60) + 1, guard.once, [], []
    monkeypatch.setattr(guard, "once", lambda batch, number, *more: (passed.append(batch.count()), whole(batch, number, *more)))
    for live in (3_600_000, 1):
        out, at = f"file://{tmp_path}/out{live}", f"file://{tmp_path}/in{live}"
        for _ in range(2):
            spark.range(1, 2001).selectExpr("nullif(id, 7) as id", f"if(id % 2 = 0, {big} + id, null) as n").coalesce(1).write.mode("append").parquet(at)
            got = guard.each_once(spark.readStream.schema("id long, n long").parquet(at), "id", out, live, watch).collect()
            assert sorted((r["id"] or 7, r["n"] or 0) for r in got) == [(i, big + i if i % 2 == 0 else 0) for i in range(1, 2001)]
    assert passed == [2000, 0, 2000, 2000]
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in watch if p["stateOperators"]) < 200  # before, one row or more for each of 2,000 keys


def test_a_repeated_batch_gives_the_same(spark, tmp_path):
    batch = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    out = f"file://{tmp_path}"
    of = lambda n: sorted(r["id"] for r in spark.read.parquet(f"{out}/rows/batch={n}").collect())
    for number, rows in ((0, batch(1, 2, 2)), (1, batch(2, 3)), (1, batch(2, 3)), (0, batch(1, 2, 2))):
        guard.once(rows, number, "id", out)
    assert of(0) == [1, 2] and of(1) == [3]


def test_filters_hold_what_was_put_in():
    rng = np.random.default_rng(1)
    known, others = (rng.integers(-(1 << 62), 1 << 62, 5000) for _ in range(2))
    table = lambda h: pa.table({"bucket": pa.array([3] * len(h), pa.int32()), "hash": pa.array(h)})
    filters = guard.filter_of(table(known))
    assert guard.maybe_known(table(known), filters).num_rows == 5000
    assert guard.maybe_known(table(others), filters).num_rows < 100


def test_settings_are_put_back(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    with pytest.raises(ZeroDivisionError), session.settings(spark, spark__sql__streaming__stateStore__providerClass=jobs.ROCKSDB, spark__made__up="x"):
        assert (spark.conf.get(key), spark.conf.get("spark.made.up")) == (jobs.ROCKSDB, "x")
        1 / 0
    assert spark.conf.get(key) == before and spark.conf.get("spark.made.up", None) is None


class Held:
    """A value or list of a state, in memory."""

    def __init__(self, empty):
        self.clear = lambda: setattr(self, "held", empty)
        self.clear()

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    put = update

    def appendList(self, values):
        self.held = [*self.held, *values]

    def appendValue(self, value):
        self.appendList([value])


def by_group(processor, batches):
    """What a group's processor gives for batches of rows, each with the watermark that follows it."""
    timers, got = set(), []
    processor.init(SimpleNamespace(getListState=lambda *_: Held([]), getValueState=lambda *_: Held(None), registerTimer=timers.add, deleteTimer=timers.discard))
    take = lambda parts: got.extend(r for part in parts for r in part.itertuples(index=False, name=None))
    for rows, watermark in batches:
        part = pd.DataFrame([(k or 0, k is None, us, i, False, what) for k, us, i, what in rows], columns=["key", "no_key", "us", "id", "no_id", "what"])
        take(processor.handleInputRows((0,), iter([part[:5], part[5:]]), None))
        for ms in sorted(t for t in timers if t <= watermark):
            timers.discard(ms)
            take(processor.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda w=watermark: w), None))
    return got


def by_key(processor, batches):
    """The same with all that was ever known of a key."""
    passed, kept, waiting, got = {}, {}, [], []
    for rows, watermark in batches:
        for k, *row in rows:
            if k in passed and tuple(row[:2]) < passed[k]:
                got.append((*processor.late_row(k, row), True))
            else:
                waiting.append((k, *row))
        until = 1000 * watermark
        for k in {r[0] for r in waiting} | set(kept):
            ready = sorted(r[1:] for r in waiting if r[0] == k and r[1] < until)
            made, kept[k] = processor.fold(k, kept.get(k), ready, until)
            got += [(*r, False) for r in made]
            if ready:
                passed[k] = ready[-1][:2]
        waiting = [r for r in waiting if r[1] >= until]
    return got


FOLDS = {"pending": (ordered.Pending(30_000), ["=1", "=", ""]), "expiry": (ordered.Expiry(15), ["ADD", "ADD", "DISMISS"]), "in_flight": (ordered.InFlight(0.03), ["CALL"])}


@pytest.mark.parametrize("name", FOLDS)
def test_groups_of_keys_give_what_keys_give(monkeypatch, name):
    """Random rows, some far too late, with what is put away written anew often."""
    monkeypatch.setattr(ordered, "ADDITIONS", 2)
    monkeypatch.setattr(ordered, "PIECE", 3)
    processor, whats = FOLDS[name]
    late = set()
    for seed in range(40):
        draw, batches = random.Random(seed), []
        for n in range(12):
            behind = lambda: draw.choice((5, 20, 20, 20, 120))
            rows = [(draw.choice((None, *range(6))), 1000 * max(1, 20 * n + 20 - draw.randrange(behind())) + draw.randrange(3), draw.randrange(50), draw.choice(whats)) for _ in range(draw.randrange(1, 15))]
            batches.append((rows, max(0, 20 * n - 10)))
        batches.append(([(9, 9_000_000, 1, whats[0])], 8_000))
        want = sorted(by_key(processor, batches), key=str)
        assert sorted(by_group(processor, batches), key=str) == want
        late |= {r[-1] for r in want}
    assert late == {False, True}


@pytest.mark.parametrize("name", FOLDS)
def test_fold_state_goes_by_groups_of_keys(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(ordered, "GROUPS", 8, raising=False)
    processor, whats = FOLDS[name]
    spark.range(2000).selectExpr("id", "timestamp_seconds(id) as at").write.parquet(f"file://{tmp_path}/in")
    log = spark.readStream.schema("id long, at timestamp").parquet(f"file://{tmp_path}/in")
    with session.settings(spark, spark__sql__streaming__stateStore__providerClass=jobs.ROCKSDB):
        made = ordered.in_order(log, "id", "at", F.lit(whats[0]), "id", processor, "1 day", F.expr(jobs.END))
        query = made.writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) < 200  # before, one row or more for each of 2,000 keys
