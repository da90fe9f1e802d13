"""Exact deduplication by Grace hashing.

Each task first folds the copies it sees itself, so a group of copies reaches its bucket as one record for a task,
whatever its size; lists of more than FOLD of its rows go elsewhere, and take the class of the record. Records are
partitioned by a hash of their normalised text: into tasks by the texts' counted bytes, and where a task's bucket would
fill more than 1 / FILL of a table, it is partitioned again into buckets of its own by a further hash, which Spark's
sort brings together in its spill files. Each of these is read through an open-addressing table that compares complete
contents. A bucket that doesn't fit nevertheless spills what matches nothing in its full table to the shared folder;
the spilled records' bytes are counted and they are partitioned anew in the same way by other hashes, until nothing is
spilled. So levels don't grow with the data, and a level writes what overflowed only.

Texts are equal when identical after deleting white space (`[\\x20\\x09-\\x0D]`). Of equal texts the row with the most
code points stays, then the smallest doc_id (null last), then the row read first.

Defined cases: null text counts as empty, and all empty texts are one group; null doc_id stays null; of repeated rows
one is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tanpura.llm.common import Rows, one_of_each, small_batches, stored, text_bytes

WHITE = b" \t\n\x0b\x0c\r"
#: Bytes of content that a table holds, and rows that one record stands for at most.
TABLE_BYTES, FOLD = 48 << 20, 2000
#: Tables that records are dealt to for each one that they would fill, bytes of a task and tasks of a level at most, and bytes of a table's entry beside its content.
FILL, TASK_BYTES, BUCKETS, ENTRY_BYTES = 2, TABLE_BYTES // 2, 20_000, 100

MEMBER = pa.struct([("doc_id", pa.int64()), ("n_chars", pa.int64())])
#: of: the record whose class these further rows take; they have no content.
RECORD = pa.schema([("digest", pa.binary()), ("content", pa.binary()), ("record", pa.string()), ("of", pa.string()), ("members", pa.list_(MEMBER))])
RECORD_SQL = "digest binary, content binary, record string, of string, members array<struct<doc_id: bigint, n_chars: bigint>>"
RESOLVED = pa.schema([("class", pa.string()), *RECORD])
RESOLVED_SQL = f"class string, {RECORD_SQL}"


class ContentTable:
    """Open addressing with linear probing; a slot holds an entry's number, and complete contents are compared."""

    def __init__(self, slots: int = 1 << 12):
        self.slots = np.full(slots, -1, np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.held = 0

    def _slot(self, h: int, content: bytes) -> tuple[int, int]:
        mask = len(self.slots) - 1
        at = h & mask
        while (entry := int(self.slots[at])) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                return at, entry
            at = (at + 1) & mask
        return at, -1

    def find(self, h: int, content: bytes) -> int:
        return self._slot(h, content)[1]

    def add(self, h: int, content: bytes) -> int:
        """Number of the new entry; the content must not be there."""
        if 3 * len(self.contents) >= 2 * len(self.slots):
            self.slots = np.full(2 * len(self.slots), -1, np.int64)
            for entry, known in enumerate(self.hashes):
                self.slots[self._slot(known, self.contents[entry])[0]] = entry
        self.slots[self._slot(h, content)[0]] = entry = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.held += len(content) + ENTRY_BYTES
        return entry


def hashed(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little")


def fold(table_bytes: int = TABLE_BYTES):
    """For mapInArrow: rows (doc_id, text) to records; equal texts of one task share a record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, members, digests, names, made = ContentTable(), [], [], [], 0
        out, task = Rows(RECORD), TaskContext.get().partitionId()

        def emit(entry: int) -> Iterator[pa.RecordBatch]:
            nonlocal made
            made += 1
            content, of = (table.contents[entry], None) if names[entry] is None else (None, names[entry])
            names[entry] = names[entry] or f"{task}-{made}"
            yield from out.add((digests[entry], content, f"{task}-{made}", of, members[entry]), len(content or b"") + 16 * len(members[entry]))
            members[entry] = []

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                content = text.translate(None, WHITE)
                digest = hashlib.sha256(content).digest()
                entry = table.find(h := hashed(digest), content)
                if entry < 0:
                    if table.held > table_bytes:
                        for e, m in enumerate(members):
                            if m:
                                yield from emit(e)
                        table, members, digests, names = ContentTable(), [], [], []
                    entry = table.add(h, content)
                    members.append([])
                    digests.append(digest)
                    names.append(None)
                members[entry].append({"doc_id": doc_id, "n_chars": len(text) - count_tails(text)})
                if len(members[entry]) >= FOLD:
                    yield from emit(entry)
        for e, m in enumerate(members):
            if m:
                yield from emit(e)
        yield from out.flush()

    return run


TAILS = bytes(range(0x80, 0xC0))


def count_tails(text: bytes) -> int:
    """UTF-8 bytes that don't begin a code point."""
    return 0 if text.isascii() else len(text) - len(text.translate(None, TAILS))


def resolve(table_bytes: int = TABLE_BYTES):
    """For mapInArrow over a task's buckets, one after the other: records with their class; content stays only in records that are spilled (class null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, first, out, now = ContentTable(), [], Rows(RESOLVED), None
        for batch in batches:
            for bucket, digest, content, record, of, members in zip(*(batch.column(c).to_pylist() for c in ("bucket", *RECORD.names)), strict=True):
                if bucket != now:
                    table, first, now = ContentTable(), [], bucket
                if of is not None:
                    yield from out.add(("", digest, None, record, of, members), 16 * len(members) + 100)
                    continue
                entry = table.find(h := hashed(digest), content)
                if entry < 0 and (table.held <= table_bytes or not first):
                    entry = table.add(h, content)
                    first.append(record)
                if entry < 0:
                    yield from out.add((None, digest, content, record, None, members), len(content) + 16 * len(members))
                else:
                    yield from out.add((first[entry], digest, None, record, None, members), 16 * len(members) + 100)
        yield from out.flush()

    return run


def dealing(size: int, table_bytes: int, tasks: int) -> tuple[int, int]:
    """Tasks, and buckets of each, for records of so many bytes."""
    many = max(tasks, min(-(-size // TASK_BYTES), BUCKETS))
    return many, max(1, -(-FILL * size // (table_bytes * many)))


def classes(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """class, digest, record, members: what each record of folded rows belongs to."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    measure = lambda column: F.coalesce(F.sum(F.octet_length(column) + ENTRY_BYTES), F.lit(0).cast("long"))
    spilled, level, found = rows.mapInArrow(fold(table_bytes), RECORD_SQL), 0, None
    size = rows.agg(measure("text")).first()[0]
    while True:
        many, buckets = dealing(size, table_bytes, tasks)
        by = F.when(F.col("of").isNull(), F.hex("digest")).otherwise(F.col("record"))
        dealt = spilled.repartition(many, F.xxhash64(by, F.lit(level)))
        bucket = F.pmod(F.xxhash64(F.lit("bucket"), by, F.lit(level)), F.lit(buckets)) if buckets > 1 else F.lit(0).cast("long")
        dealt = dealt.withColumn("bucket", bucket)
        dealt = dealt.sortWithinPartitions("bucket") if buckets > 1 else dealt
        done = stored(dealt.mapInArrow(resolve(table_bytes), RESOLVED_SQL), f"grace-{level}")
        kept = done.where("class is not null").drop("content")
        found = kept if found is None else found.unionByName(kept)
        spilled, level = done.where("class is null").drop("class"), level + 1
        size = spilled.agg(measure("content")).first()[0]
        if not size:
            break
    more = found.where("of is not null").drop("class")
    own = found.where("of is null")
    if more.isEmpty():
        return own
    return own.unionByName(more.join(own.select(F.col("record").alias("of"), "class"), "of"))


def exact_duplicates(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_chars."""
    found = classes(docs, table_bytes)
    # The order within a group: most code points, smallest doc_id with null last, then the place in the folded records.
    ranked = F.transform("members", lambda m, i: F.struct((-m["n_chars"]).alias("less"), m["doc_id"].isNull().alias("none"), m["doc_id"].alias("doc_id"), F.col("record").alias("record"), i.alias("at")))
    found = found.select("class", "digest", "record", ranked.alias("members"))
    best = found.groupBy("class").agg(F.min(F.array_min("members")).alias("best"), F.sum(F.size("members").cast("long")).alias("group_size"))
    # Written, so that Spark can split a very large group in the join.
    rows = found.join(stored(best, "grace-groups"), "class").select("best", "group_size", "digest", F.explode("members").alias("m"))
    return rows.select(
        F.col("m.doc_id").alias("doc_id"),
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        ((F.col("m.record") == F.col("best.record")) & (F.col("m.at") == F.col("best.at"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        (-F.col("m.less")).alias("n_chars"),
    )


def identity(doc_id: int | None, text: bytes) -> bytes:
    """What rows that may stand for each other share: id, content and code points."""
    known = b"" if doc_id is None else b"%d" % doc_id
    return hashlib.sha256(b"%s|%d|" % (known, len(text) - count_tails(text)) + hashlib.sha256(text.translate(None, WHITE)).digest()).digest()


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns and their bytes; of rows that repeat a doc_id and text one stays.

    Texts are compared as bytes throughout, so that those that aren't UTF-8 are kept like any other.
    """
    parts = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.col("n_chars").cast("string"), F.lit("|"))
    kept = exact_duplicates(docs).where("kept").select(F.unhex(F.sha2(F.concat(parts.cast("binary"), F.unhex("text_sha256")), 256)))
    return one_of_each(docs, kept, identity)
