"""Hot sessions range by range give what they give whole, and are spread over tasks."""

import pytest
from pyspark.sql import functions as F

from tanpura import session
from tanpura.operators import notifications as N
from tanpura.operators import ranges
from tanpura.operators import sessions as S
from tanpura.sources import tables


@pytest.fixture(scope="module")
def events(spark, small):
    """A log of which one session has nearly all rows; some events share their time, and one has none."""
    log = session.table(spark, small, "events")
    user = F.when(F.col("event_id") % 20 == 0, F.col("user_id")).otherwise(F.lit(7)).cast("long")
    ts = F.when(F.col("event_id") == 50, None).when(F.col("event_id") % 9 == 0, F.date_trunc("day", "ts")).otherwise(F.col("ts"))
    return log.withColumns({"user_id": user, "ts": ts}).persist()


def made(events):
    calls, log = tables.analysis_calls(events), tables.session_events(events)
    return {
        "state": lambda most: S.state_after_each(log, most),
        "sequence": lambda most: N.sequence(tables.notification_events(events), most),
        "stale": lambda most: S.stale_results(calls, log, most),
        "accepted": lambda most: S.accepted(calls, 6 * 3600, most),
        "accepted twice": lambda most: S.accepted(calls.union(calls), 600, most),
    }


@pytest.mark.parametrize("most", [40])
@pytest.mark.parametrize("name", ["state", "sequence", "stale", "accepted", "accepted twice"])
def test_ranges_change_nothing(events, name, most):
    query = made(events)[name]
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    want = rows(query(10**6))
    assert rows(query(most)) == want and want


def test_a_session_is_spread_over_tasks(spark, events):
    # Else the small side of the join with what comes in from before, which is this test's log, would be broadcast.
    with session.settings(spark, spark__sql__adaptive__coalescePartitions__enabled="false", spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1"):
        found = S.state_after_each(tables.session_events(events), 50).where("session_id = 7").groupBy(F.spark_partition_id()).count().collect()
    assert len(found) > 2 and max(r["count"] for r in found) < 900 * 0.6


def test_ranges_follow_the_order(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("key"), F.when(F.col("id") > 20, F.col("id") % 300).alias("at")).union(spark.createDataFrame([(5, 1), (6, None)], "key long, at long"))
    split, several = ranges.ranged(rows, "key", "at", 40)
    assert several and split.count() == 1002
    ends = split.where("key < 2").groupBy("key", ranges.RANGE).agg(F.min(F.coalesce("at", F.lit(-1))).alias("low"), F.max(F.coalesce("at", F.lit(-1))).alias("high"), F.count("*").alias("n")).orderBy("key", ranges.RANGE).collect()
    assert len(ends) >= 20 and max(r["n"] for r in ends) <= 80
    assert all(a["high"] < b["low"] for a, b in zip(ends, ends[1:], strict=False) if a["key"] == b["key"])
    assert [r[ranges.RANGE] for r in split.where("key > 4").collect()] == [0, 0]
    assert not ranges.ranged(rows, "key", "at", 10**6)[1]
