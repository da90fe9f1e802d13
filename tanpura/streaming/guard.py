"""Each key once, however long ago it came before, with state that ends.

The near past is state with a time to live: a key that is seen again within it goes at once. What gets through is looked up
in the keys written by earlier micro-batches. In front of them stand Bloom filters, one for each micro-batch and bucket of
keys: only keys that a filter may hold are looked up, so that the written keys aren't read for keys that are new. The
lookup is exact, so a filter's errors change nothing. A micro-batch's folders bear its number and it looks at lower numbers
only, so a micro-batch that is repeated after a failure gives what it gave before.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import NumericType

from tanpura.session import settings, ship

#: Buckets that keys are dealt to, bits of a filter for each key, and how many of them a key sets: one key in about 120 is looked up in vain.
BUCKETS, BITS, PROBES = 64, 10, 7
#: Groups of keys in the state.
GROUPS = 1024
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstSeen(StatefulProcessor):
    """Passes on a key's first row, and again the first one after the time to live has passed since.

    The state goes by groups of keys, and each micro-batch adds one list of keys to a group, so that calls of the state
    aren't made for each key. The column key must never be null.
    """

    def __init__(self, columns: list[str], live_ms: int):
        self.columns, self.live = columns, live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getListState("seen", "keys string", ttlDurationMs=self.live)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known, new = {k for (keys,) in self.seen.get() for k in json.loads(keys)}, []
        for part in rows:
            first = []
            for k in part["key"]:
                first.append(k not in known)
                if first[-1]:
                    known.add(k)
                    new.append(k)
            if any(first):
                yield part.loc[first, self.columns]
        if new:
            self.seen.appendValue((json.dumps(new),))

    def close(self) -> None:
        pass


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits that each hash sets, a row for each hash: two halves of it combined."""
    h = hashes.astype(np.int64).view(np.uint64)
    a, b = h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return ((a[:, None] + np.arange(PROBES, dtype=np.uint64) * b[:, None]) % np.uint64(bits)).astype(np.int64)


def filter_of(table: pa.Table) -> pa.Table:
    """(bucket, hash) of one bucket to (bucket, bits)."""
    hashes = table.column("hash").to_numpy()
    size = -(-max(1, len(hashes)) * BITS // 8) * 8
    set_ = np.zeros(size, np.uint8)
    set_[places(hashes, size).ravel()] = 1
    return pa.table({"bucket": table.column("bucket").slice(0, 1), "bits": pa.array([np.packbits(set_).tobytes()], pa.binary())})


def maybe_known(keys: pa.Table, filters: pa.Table) -> pa.Table:
    """(bucket, hash) that any of the bucket's filters may hold."""
    hashes, held = keys.column("hash").to_numpy(), np.zeros(keys.num_rows, bool)
    for bits in filters.column("bits").to_pylist():
        set_ = np.unpackbits(np.frombuffer(bits, np.uint8))
        held |= set_[places(hashes, len(set_))].all(axis=1)
    return keys.filter(pa.array(held))


def written_before(spark: SparkSession, path: str, number: int) -> DataFrame | None:
    """The tables of micro-batches below number, or None if there are none."""
    try:
        return spark.read.parquet(path).where(F.col("batch") < number)
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def once(batch: DataFrame, number: int, key: str, out: str) -> None:
    """Write those rows of a micro-batch whose key is in none before, and the keys and their filters."""
    spark, bucket = batch.sparkSession, F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
    rows = batch.dropDuplicates([key]).withColumns({"bucket": bucket, "hash": F.xxhash64(F.lit("once"), key)})
    filters = written_before(spark, f"{out}/filters", number)
    held = rows.persist()
    if filters is not None:
        mine, theirs = rows.select("bucket", "hash"), filters.select("bucket", "bits")
        maybe = mine.groupBy("bucket").cogroup(theirs.groupBy("bucket")).applyInArrow(lambda a, b: maybe_known(a, b), "bucket int, hash long").distinct().persist()
        if not maybe.isEmpty():
            known = written_before(spark, f"{out}/keys", number).join(maybe, ["bucket", "hash"], "left_semi").select(key)
            rows = rows.join(known, rows[key].eqNullSafe(known[key]), "left_anti")
        maybe.unpersist()
    rows.drop("bucket", "hash").write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
    # The rows are read back, so that what is noted as known is what was written.
    new = spark.read.schema(batch.schema).parquet(f"{out}/rows/batch={number}").select(key, bucket.alias("bucket"), F.xxhash64(F.lit("once"), key).alias("hash"))
    new.sortWithinPartitions("bucket").write.mode("overwrite").parquet(f"{out}/keys/batch={number}")
    made = new.select("bucket", "hash").groupBy("bucket").applyInArrow(filter_of, "bucket int, bits binary")
    made.write.mode("overwrite").parquet(f"{out}/filters/batch={number}")
    held.unpersist()


def each_once(rows: DataFrame, key: str, out: str, live_ms: int, watch: list | None = None) -> DataFrame:
    """Run the stream rows over what is there and give the rows of all runs with the same out, one for each key (null is a key). watch gets the progress of the micro-batches."""
    spark = rows.sparkSession
    ship(spark)
    # Without data the time to live gives no reason for a micro-batch; else there would always be another one.
    with settings(spark, spark__sql__streaming__stateStore__providerClass=ROCKSDB, spark__sql__streaming__noDataMicroBatches__enabled="false"):
        # Numbers go to Python as text: pandas makes doubles of longs among which one is null.
        types = {f"c{i}": (f.name, f.dataType, "string" if isinstance(f.dataType, NumericType) else f.dataType.simpleString()) for i, f in enumerate(rows.schema)}
        sent = rows.toDF(*types).select(*(F.col(c).cast(t) for c, (_, _, t) in types.items()), F.coalesce(F.concat(F.lit("="), F.col(f"c{rows.columns.index(key)}").cast("string")), F.lit("")).alias("key"))
        # Never null: a null among the grouping keys loses other keys' rows on the way to Python.
        grouped = sent.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(GROUPS)).cast("int")).groupBy("group")
        passed = grouped.transformWithStateInPandas(FirstSeen(list(types), live_ms), ", ".join(f"{c} {t}" for c, (_, _, t) in types.items()), "Append", "ProcessingTime")
        first = passed.select(*(F.col(c).cast(of).alias(name) for c, (name, of, _) in types.items()))
        query = first.writeStream.foreachBatch(lambda batch, number: once(batch, number, key, out)).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if watch is not None:
        watch += query.recentProgress
    return spark.read.schema(rows.schema).parquet(f"{out}/rows").select(*rows.columns)
