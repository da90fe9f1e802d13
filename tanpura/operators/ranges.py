"""Running aggregates over keys of any size: a key with many rows is split into ranges of its order.

Within ranges the aggregates are windows; what comes in from the ranges before is a scan over one row for each range. No
task holds more than a range, and keys that are small are one range, so that nothing changes for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a key beyond which it is split, and rows of a range, about.
RANGE_ROWS = 2_000_000
#: The column that has a row's range.
RANGE = "__range"


def ranged(rows: DataFrame, key: str, at: str, most: int | None = None) -> tuple[DataFrame, bool]:
    """rows with RANGE, which doesn't fall as at (a long; null is lowest) rises, and whether any key has several ranges.

    Ranges are cut at quantiles of at, so rows that are equal in it stay together. Only the largest key's number of rows
    is brought to the driver.
    """
    most = most or RANGE_ROWS
    sizes = rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > most)
    largest = sizes.agg(F.max("__n")).first()[0]
    if largest is None:
        return rows.withColumn(RANGE, F.lit(0)), False
    pieces = -(-largest // most)
    cuts = F.percentile_approx(at, [i / pieces for i in range(1, pieces)], max(10_000, 10 * pieces))
    # A key has as many cuts as its own rows ask for.
    own = F.ceil(F.col("__n") / most).cast("int")
    thinned = F.array_distinct(F.transform(F.sequence(F.lit(1), own - 1), lambda i: F.get("__cuts", F.greatest(F.lit(0), F.ceil(i * pieces / own).cast("int") - 1))))
    hot = rows.join(sizes, key).groupBy(key).agg(cuts.alias("__cuts"), F.first("__n").alias("__n")).select(key, thinned.alias("__cuts"))
    number = F.size(F.filter("__cuts", lambda c: c < F.col(at)))
    return rows.join(hot, key, "left").withColumn(RANGE, F.when(F.col("__cuts").isNull(), 0).otherwise(number)).drop("__cuts"), True


def running(rows: DataFrame, key: str, at: str, order: list[Column | str], made: dict[str, tuple], most: int | None = None) -> DataFrame:
    """rows with running aggregates by key in the given order, whose first column is at.

    made has for each new column (window, total, scan, combine): window(w) is the aggregate up to a row, over the window w
    without a frame; total is the aggregate of a whole range; scan(total, w) brings the totals of the ranges before; and
    combine(before, here) puts what comes from them (null: nothing) to what is here.
    """
    split, several = ranged(rows, key, at, most)
    local = W.partitionBy(key, RANGE).orderBy(*order)
    if not several:
        alone = W.partitionBy(key).orderBy(*order)
        return rows.withColumns({name: combine(F.lit(None), window(alone)) for name, (window, _, _, combine) in made.items()})
    before = W.partitionBy(key).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    totals = split.groupBy(key, RANGE).agg(*(total.alias(f"__t_{name}") for name, (_, total, _, _) in made.items()))
    carried = totals.select(key, RANGE, *(scan(F.col(f"__t_{name}"), before).alias(f"__c_{name}") for name, (_, _, scan, _) in made.items()))
    whole = split.withColumns({f"__h_{name}": window(local) for name, (window, *_) in made.items()}).join(carried, [key, RANGE])
    return whole.select(*(F.col(c) for c in rows.columns), *(combine(F.col(f"__c_{name}"), F.col(f"__h_{name}")).alias(name) for name, (*_, combine) in made.items()))


def numbering() -> tuple:
    """For running(): a row's number within its key, from 1."""
    return lambda w: F.row_number().over(w).cast("long"), F.count("*"), lambda t, w: F.sum(t).over(w), lambda before, here: here + F.coalesce(before, F.lit(0).cast("long"))


def last_of(value: Column, at: Column) -> tuple:
    """For running(): the last value that isn't null; at orders a range's rows."""
    last = lambda v, w: F.last(v, ignorenulls=True).over(w)
    return lambda w: last(value, w.rowsBetween(W.unboundedPreceding, 0)), F.max_by(value, F.when(value.isNotNull(), at)), last, lambda before, here: F.coalesce(here, before)


def last_before(value: str, at: Column) -> tuple:
    """For running(): the row before's value; at orders a range's rows, whose first column is value (null comes first)."""
    return lambda w: F.lag(value).over(w), F.max_by(F.col(value), at), lambda t, w: F.last(t, ignorenulls=True).over(w), lambda before, here: F.coalesce(here, before)


def next_points(probes: DataFrame, points: DataFrame, key: str, value: str, strictly: bool, most: int | None = None) -> DataFrame:
    """probes (key, at, more columns) with next: the least value among the key's points (key, at, value) at or after at (strictly: after).

    A probe or point whose at is null has no place in time: such a probe gets null. Both sides are sorted together, latest
    first, and the minimum runs; ranges bring in the minimum of the ranges after them.
    """
    later = W.unboundedPreceding, -1 if strictly else 0
    lone = [c for c in probes.columns if c not in (key, "at")]
    kind = points.schema[value].dataType
    marked = points.select(key, "at", F.col(value).alias("__value"), *(F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in lone), F.lit(False).alias("__probe"))
    both = marked.union(probes.select(key, "at", F.lit(None).cast(kind).alias("__value"), *lone, F.lit(True).alias("__probe"))).where("at is not null")
    split, several = ranged(both, key, "at", most)
    here = F.min("__value").over(W.partitionBy(key, RANGE).orderBy(-F.col("at")).rangeBetween(*later))
    if several:
        totals = split.groupBy(key, RANGE).agg(F.min("__value").alias("__total"))
        after = totals.select(key, RANGE, F.min("__total").over(W.partitionBy(key).orderBy(RANGE).rowsBetween(1, W.unboundedFollowing)).alias("__after"))
        made = split.withColumn("next", here).join(after, [key, RANGE]).withColumn("next", F.least("next", "__after"))
    else:
        made = both.withColumn("next", F.min("__value").over(W.partitionBy(key).orderBy(-F.col("at")).rangeBetween(*later)))
    return made.where("__probe").select(key, "at", *lone, "next").unionByName(probes.where("at is null").withColumn("next", F.lit(None).cast(kind)))
