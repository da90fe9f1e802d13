"""Order MinHash fingerprints.

A text's k-mers of code points are numbered by occurrence, so that a repeated k-mer counts each time. For each of
SKETCHES hash functions the TUPLE k-mers of smallest hash are kept in the order in which the text has them, and that
tuple is hashed to 32 bits. Two fingerprints' likeness is the share of equal tuples; it falls with the texts' edit
distance, as moving text changes the order within tuples.

The successor of each document (by descending doc_id, around the end) is needed beside it. Documents are dealt into
ranges of doc_id and sorted within them; each range also gets the first document of the range that follows. So each
text is shuffled once, and no task reads more than its ranges. A doc_id that many rows repeat, or null, gets several
ranges, by a hash of the text; only rows that are equal in both stay together.

Defined cases: null and empty texts share the fingerprint of zeros; a text shorter than K is one k-mer; null doc_id
comes last; rows of equal doc_id are ordered by a hash of their text; a single row is its own successor; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tanpura.llm.common import Rows, mapped, small_batches, text_bytes

K, SKETCHES, TUPLE = 12, 64, 2
#: Elements of the matrix of hashes that is held at once.
MATRIX = 1 << 17
POSITION_BITS = 24
_random = np.random.default_rng(20240229)
_XOR = _random.integers(0, 1 << 32, SKETCHES, np.uint32)[:, None]
_ODD = (_random.integers(0, 1 << 32, SKETCHES, np.uint32) | np.uint32(1))[:, None]
_FACTORS = _random.integers(0, 1 << 63, 8, np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = h ^ (h >> np.uint64(32))
    h *= _FACTORS[0]
    h ^= h >> np.uint64(29)
    h *= _FACTORS[1]
    return h ^ (h >> np.uint64(32))


def kmer_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each K code points, in text order."""
    if len(text) < K:
        return np.array([xxhash.xxh64_intdigest(text.encode())] if text else [], np.uint64)
    two = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    two = two[:-1] * _FACTORS[2] + two[1:]
    four = mixed(two[:-2] * _FACTORS[3] + two[2:])
    eight = four[:-4] * _FACTORS[4] + four[4:]
    return mixed(eight[:-4] * _FACTORS[5] + four[8:])


def numbered(h: np.ndarray) -> np.ndarray:
    """The hashes with each one's occurrence number worked in."""
    n = len(h)
    if n < 1 << POSITION_BITS:
        low = np.uint64((1 << POSITION_BITS) - 1)
        packed = np.sort((h & ~low) | np.arange(n, dtype=np.uint64))
        place, key = (packed & low).astype(np.int64), packed >> np.uint64(POSITION_BITS)
    else:
        place = np.argsort(h, kind="stable")
        key = h[place]
    again = np.flatnonzero(key[1:] == key[:-1]) + 1
    if not len(again):
        return h
    first = np.arange(n)
    first[again] = 0
    count = np.arange(n) - np.maximum.accumulate(first)
    out = h.copy()
    out[place[again]] = mixed(h[place[again]] + count[again].astype(np.uint64) * _FACTORS[6])
    return out


def sketch(text: str) -> np.ndarray:
    """The text's SKETCHES tuple hashes."""
    h = numbered(kmer_hashes(text))
    n = len(h)
    if not n:
        return np.zeros(SKETCHES, np.uint32)
    top, out = (h >> np.uint64(32)).astype(np.uint32), np.empty(SKETCHES, np.uint32)
    step = max(1, min(SKETCHES, MATRIX // n))
    for at in range(0, SKETCHES, step):
        matrix = (top ^ _XOR[at : at + step]) * _ODD[at : at + step]
        rows, least = np.arange(len(matrix)), []
        for _ in range(min(TUPLE, n)):
            least.append(matrix.argmin(axis=1))
            matrix[rows, least[-1]] = np.uint32(0xFFFFFFFF)
        tuples = np.zeros(len(matrix), np.uint64)
        for place in np.sort(np.array(least), axis=0):
            tuples = mixed(tuples * _FACTORS[7] + h[place])
        out[at : at + step] = (tuples >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def written(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' columns but the text, with fingerprint."""
    return mapped(docs, text, "fingerprint string", lambda values: [pa.array([written(sketch(t.decode("utf-8", "replace"))) for t in values], pa.string())])


def with_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """Adds range, which falls in the order of documents: by descending doc_id, null last, then by the text's hash."""
    from pyspark.ml.feature import Bucketizer  # on the driver only; workers needn't load it

    quantiles = F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [0.5], 100 * ranges)
    row = docs.agg(quantiles.alias("cuts"), F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    cuts, width = row["cuts"] or [], ranges + 2
    many = {c: n + 1 for c, n in Counter(cuts).items() if n > 1}  # how many ranges an id gets that is several quantiles
    splits = [-float("inf"), *sorted({float(c) for c in cuts} or {0.0}), float("inf")]
    known = F.coalesce(F.col("doc_id"), F.lit(0)).cast("double")
    dealt = Bucketizer(splits=splits, inputCol="__known", outputCol="__range").transform(docs.withColumn("__known", known))
    share = F.xxhash64("text") / float(1 << 64) + 0.5
    part = lambda n: F.least(F.floor(share * n), n - 1)
    times = F.try_element_at(F.create_map(*(F.lit(x).cast("long") for pair in many.items() for x in pair)), F.col("doc_id")) if many else F.lit(None).cast("long")
    # An id that is a cut is the last of its bucket.
    within = F.when(times.isNotNull(), width - 2 - part(times)).otherwise(width - 1)
    nulls = F.lit(max(1, -(-ranges * row["nulls"] // max(1, row["n"])))).cast("long")
    return dealt.withColumn("range", F.when(F.col("doc_id").isNull(), -1 - part(nulls)).otherwise(F.col("__range").cast("long") * width + within)).drop("__known", "__range")


EDITED = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
EDITED_SQL = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range, ghosts last: each row but a ghost with the one after it."""
    out, held = Rows(EDITED), None
    for batch in batches:
        for part, ghost, doc_id, raw in zip(*(batch.column(c).to_pylist() for c in ("range", "ghost", "doc_id", "text")), strict=True):
            if ghost and held is None:
                continue
            text = raw.decode("utf-8", "replace")
            own = sketch(text)
            if held is not None:
                _, before, known, was = held
                n = len(known)
                edited = known[: n - n // 3] + text[: n // 3]
                other = was if edited == known else sketch(edited)
                digest = hashlib.sha256(edited.encode()).hexdigest()
                yield from out.add((before, n, digest, written(was), written(other), likeness(was, other), likeness(was, own)), 1200)
            held = None if ghost else (part, doc_id, text, own)
    yield from out.flush()


def edited_fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Each text's fingerprint beside those of its edited text and of the next document.

    The edited text has its last third (rounded down) replaced by the first as many code points of the next document.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    ranged = with_ranges(rows, ranges)
    heads = sorted(ranged.groupBy("range").agg(F.max("doc_id").alias("head")).collect(), key=lambda r: -r["range"])  # as many rows as ranges
    if not heads:
        return rows.mapInArrow(lambda batches: iter(()), EDITED_SQL)
    # The first document of each range is a ghost at the end of the range before it; that of the first, of the last.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    follows = [(h["range"], h["head"], heads[i - 1]["range"], i % tasks) for i, h in enumerate(heads)]
    small = F.broadcast(spark.createDataFrame(follows, "range long, head bigint, target long, task int"))
    tied = F.xxhash64("text")
    ghosts = ranged.join(small, "range").where(F.col("doc_id").eqNullSafe(F.col("head"))).groupBy("target", "doc_id").agg(F.min(F.struct(tied.alias("tie"), "text")).alias("first"))
    ghosts = ghosts.select(F.col("target").alias("range"), F.lit(True).alias("ghost"), "doc_id", F.col("first.tie").alias("tie"), F.col("first.text").alias("text"))
    dealt = ranged.select("range", F.lit(False).alias("ghost"), "doc_id", tied.alias("tie"), "text").unionByName(ghosts)
    # Every task gets as many ranges, which a hash of the range wouldn't give.
    dealt = dealt.join(small.select("range", "task"), "range").repartitionById(tasks, F.col("task"))
    ordered = dealt.sortWithinPartitions("range", "ghost", F.col("doc_id").desc_nulls_last(), "tie")
    return ordered.select("range", "ghost", "doc_id", "text").mapInArrow(compare, EDITED_SQL)
