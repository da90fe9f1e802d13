"""Helpers that the training-data operators share: scratch tables, Arrow batch sizes, and passing a table's columns through."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tanpura.session import shared_dir, shared_path

#: Rows and bytes of one Arrow batch. Texts may be long, so a batch is bounded by bytes as well.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20


#: Rows for each file of a table whose size is known beforehand.
FILE_ROWS = 200_000


#: Paths of the tables that this process has stored and not dropped.
_stored: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Drops the tables that are stored within the block when it ends; what is made of them must be written by then."""
    before = len(_stored)
    yield
    for path in _stored[before:]:
        drop(spark, path)
    del _stored[before:]


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    file.getFileSystem(spark._jsc.hadoopConfiguration()).delete(file, True)


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df to a table in the shared folder and read it back. This cuts the lineage and survives lost executors.

    rows, where known, is a bound of df's rows, by which small tables get few files. Tables stay until scratch() drops
    them, as results that aren't written yet may read them.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(1 + rows // FILE_ROWS)
    path = shared_path(spark, name)
    _stored.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Spark hands to Python, and send this package to the workers.

    Spark reads the bounds when a plan runs, after the operator has returned it, so they stay set; smaller ones are kept.
    """
    ship(spark)
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


#: Rows of a few numbers up to which a written table is broadcast in a join; beyond that it is shuffled.
BROADCAST_ROWS = 100_000


def small_side(table: DataFrame) -> DataFrame:
    """A written, narrow table for a join: broadcast if it is counted to be small."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the executors once, so that jobs don't depend on the workers' own paths."""
    context = spark.sparkContext
    if getattr(context, "_tanpura_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="spark-")) / f"{package.name}.zip"
    with zipfile.ZipFile(to, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(str(to))
    context._tanpura_shipped = True


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def fresh(name: str, taken: Iterable[str]) -> str:
    """A name that no other column has, whatever the case."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name += "_"
    return name


def text_bytes(column: str = "text"):
    """The column as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(quoted(column)).cast("binary"), F.lit(b""))


#: Bytes of text that are worked on before their results are handed on.
GROUP_BYTES = 2 << 20


def groups(values: Sequence[bytes]) -> Iterator[tuple[int, int]]:
    """Starts and stops of runs of values that have GROUP_BYTES or little more."""
    start = held = 0
    for i, v in enumerate(values):
        held += len(v)
        if held >= GROUP_BYTES or i == len(values) - 1:
            yield start, i + 1
            start, held = i + 1, 0


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """df.mapInArrow for columns of any name; Spark's own takes what stands behind a dot for a field."""
    names = df.columns
    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(lambda batches: run(b.rename_columns(names) for b in batches), schema)


def mapped(df: DataFrame, text: str, made: str, make: Callable[[list[bytes]], Sequence[pa.Array]], keep_text: bool = False) -> DataFrame:
    """df with the columns of made (as DDL), which make gives for some texts as bytes (null: empty), without a shuffle.

    Other columns pass through as they are, whatever their names and types; those named as one of made are replaced.
    The text goes unless it is to be kept, in which case its bytes stay as they are, UTF-8 or not.
    """
    small_batches(df.sparkSession)
    outs = StructType.fromDDL(made)
    replaced = {n.lower() for n in outs.names} | (set() if keep_text else {text.lower()})
    names = [c for c in df.columns if c.lower() not in replaced]
    hidden = text if keep_text else fresh("text", names)
    schema = StructType([df.schema[c] for c in names] + outs.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [v or b"" for v in batch.column(hidden).cast(pa.binary()).to_pylist()]
            for start, stop in groups(values):
                part = batch.slice(start, stop - start)
                yield pa.record_batch([*(part.column(c) for c in names), *make(values[start:stop])], names=schema.names)

    own = [F.col(quoted(c)) for c in names]
    return in_arrow(df.select(*own, *([] if keep_text else [text_bytes(text).alias(hidden)])), run, schema)


#: Identities that a task remembers, to send on one of the rows that repeat it.
SEEN = 200_000


def one_of_each(docs: DataFrame, kept: DataFrame, identify: Callable[[int | None, bytes], bytes]) -> DataFrame:
    """One row of docs for each identity in kept (its only column), with all columns; identify has doc_id and text.

    A task sends on one row of those that it sees repeated, so that no identity brings more rows together than there
    are tasks.
    """
    small_batches(docs.sparkSession)
    row = fresh("row", docs.columns)
    schema = StructType([*docs.schema.fields, StructField(row, BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            made = [identify(i, t or b"") for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True)]
            first = []
            for r in made:
                first.append(r not in seen)
                seen.add(r)
            yield pa.record_batch([*batch.columns, pa.array(made, pa.binary())], names=schema.names).filter(pa.array(first))
            if len(seen) > SEEN:
                seen.clear()

    own = in_arrow(docs, run, schema)
    return own.join(kept.toDF(row), row, "left_semi").dropDuplicates([row]).select(*(F.col(quoted(c)) for c in docs.columns))


class Rows:
    """Collects rows and gives them out as Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema, rows: int = 5000, size: int = BATCH_BYTES):
        self.schema, self.rows, self.size = schema, rows, size
        self.clear()

    def clear(self) -> None:
        self.columns: list[list] = [[] for _ in self.schema]
        self.held = 0

    def add(self, row: Iterable, size: int = 0) -> Iterator[pa.RecordBatch]:
        for column, value in zip(self.columns, row, strict=True):
            column.append(value)
        self.held += size
        if len(self.columns[0]) >= self.rows or self.held >= self.size:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.columns[0]:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(self.columns, self.schema, strict=True)], schema=self.schema)
        self.clear()
