"""Token counts by separator scan.

A flat token file is ids of 16 bits (little endian), documents one after the other, each ended by a separator, with no
index. Spark's text sink writes such files: a row is a document's ids as bytes, and the line separator is the
separator's two bytes. A task writes several files, of FILE_DOCUMENTS documents each, so that none is large.

Files are cut into blocks at any place. In each block a vectorised search finds the separators; a prefix scan over the
blocks of a file, in two levels so that no task takes all blocks of a long file, gives the tokens and documents before
each block and where the document that its first tokens continue began.

A file doesn't hold doc_ids. They are written beside it, in the same order, by a pass over doc_ids alone, and meet the
counts by file and ordinal; where either has no partner the query fails. That needs rows that come in the same order
again: a table that isn't just read and filtered (shuffled, cached, sampled, coalesced) is written first.

Defined cases: an empty document has 0 tokens; tokens after a file's last separator are a last document that isn't
complete; an empty file has none; a file of an odd number of bytes and a vocabulary with ids that 16 bits can't hold, or
whose texts could have the separator, are refused; null text counts as empty; texts that aren't UTF-8 are encoded with
U+FFFD; a null doc_id stays null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tanpura.llm import bpe
from tanpura.llm.common import Rows, groups, shared_path, small_batches, stored, text_bytes

SEPARATOR, BLOCK_TOKENS, SUPER = 50256, 1 << 16, 1024
#: Documents of one flat file.
FILE_DOCUMENTS = 5_000

FOUND = pa.schema([("file", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("ends", pa.list_(pa.int32()))])
FOUND_SQL = "file string, block bigint, n bigint, ends array<int>"


def ids_of_16_bits(coder: bpe.ByteBPE, separator: int) -> None:
    """Raise where ids or the separator can't be told from each other in 16 bits."""
    if coder.bytes.n > 1 << 16 or not 0 <= separator < 1 << 16 or separator in coder.ordinary:
        raise ValueError(f"ids up to {coder.bytes.n - 1} with the separator {separator} don't make a file of 16-bit ids")


#: Steps of a plan that hand rows on in the order of the files they are read from, each time.
STEADY = re.compile(r"(?:AdaptiveSparkPlan|WholeStageCodegen|InputAdapter|ColumnarToRow|Project|Filter|FileScan|Scan parquet|LocalTableScan)\b")


def settled(docs: DataFrame) -> DataFrame:
    """docs whose rows come in the same order whenever they are read: as they are, if they are but read and filtered; else written first."""
    plan = docs._jdf.queryExecution().executedPlan().treeString()
    steps = [re.sub(r"^[\s:+\-*]*(?:\(\d+\) )?", "", line) for line in plan.splitlines()]
    return docs if all(STEADY.match(s) or not s or s.startswith("==") for s in steps) else stored(docs, "token-documents")


def flat_files(docs: DataFrame, path: str, vocabulary: tuple[str, str] | None = None, separator: int = SEPARATOR, file_documents: int = FILE_DOCUMENTS) -> None:
    """Write docs as flat token files to path/tokens, and their doc_ids in the same order, a line each, to path/labels."""
    small_batches(docs.sparkSession)
    name, pattern = vocabulary or bpe.default_vocabulary()
    ids_of_16_bits(bpe.loaded(name, pattern), separator)
    rows = settled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.loaded(name, pattern)
        for batch in batches:
            values = batch.column("text").to_pylist()
            for start, stop in groups(values):
                ids, ends = coder.encode([v.decode("utf-8", "replace") for v in values[start:stop]])
                yield pa.record_batch([bpe.as_binary(ids.astype("<u2").view(np.uint8), 2 * ends)], names=["tokens"])

    tokens = rows.select("text").mapInArrow(run, "tokens binary").select(F.col("tokens").cast("string"))
    ended = np.array([separator], "<u2").tobytes().decode("latin-1")
    tokens.write.option("maxRecordsPerFile", file_documents).option("encoding", "ISO-8859-1").option("lineSep", ended).text(f"{path}/tokens")
    rows.select(F.col("doc_id").cast("string")).write.option("maxRecordsPerFile", file_documents).text(f"{path}/labels")


def searched(spark: SparkSession, path: str, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, n, ends): the places of the separators in each block of the flat token files of path (each under 2 GB, the limit of Spark's binaryFile source)."""
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(FOUND)
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                raw = content.as_buffer()
                if raw.size % 2:
                    raise ValueError(f"{file} isn't a file of 16-bit ids")
                ids = np.frombuffer(raw, "<u2")
                for block, at in enumerate(range(0, len(ids), block_tokens)):
                    part = ids[at : at + block_tokens]
                    ends = np.flatnonzero(part == separator).astype(np.int32)
                    yield from out.add((file, block, len(part), ends), 4 * len(ends))
        yield from out.flush()

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, FOUND_SQL)


def token_counts(spark: SparkSession, path: str, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row for each document of the flat token files of path: file, ordinal in the file, start (its first token's place), n_tokens, complete."""
    # Written, as both levels of the scan read it: blocks are searched once.
    found = stored(searched(spark, path, separator, block_tokens), "separators").withColumn("super", F.floor(F.col("block") / SUPER))
    last = F.try_element_at("ends", F.lit(-1)).cast("long")
    inner = W.partitionBy("file", "super").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    near = found.withColumns({"at": F.coalesce(F.sum("n").over(inner), F.lit(0)), "before": F.coalesce(F.sum(F.size("ends")).over(inner), F.lit(0))})
    near = near.withColumn("end_before", F.max(F.col("at") + last).over(inner))
    outer = W.partitionBy("file").orderBy("super").rowsBetween(W.unboundedPreceding, -1)
    sums = near.groupBy("file", "super").agg(F.sum("n").alias("n"), F.sum(F.size("ends")).alias("docs"), F.max(F.col("at") + last).alias("end"))
    sums = sums.withColumn("super_at", F.coalesce(F.sum("n").over(outer), F.lit(0)))
    sums = sums.select("file", "super", "super_at", F.coalesce(F.sum("docs").over(outer), F.lit(0)).alias("super_before"), F.max(F.col("super_at") + F.col("end")).over(outer).alias("super_end"), (F.lead("super").over(W.partitionBy("file").orderBy("super")).isNull()).alias("super_last"))
    placed = near.join(sums, ["file", "super"])
    placed = placed.withColumn("base", F.col("super_at") + F.col("at"))
    begun = F.coalesce(F.col("super_at") + F.col("end_before"), F.col("super_end"), F.lit(-1)) + 1
    final = F.col("super_last") & (F.lead("block").over(W.partitionBy("file", "super").orderBy("block")).isNull())
    placed = placed.withColumn("begun", begun).withColumn("final", final)
    ends = F.transform("ends", lambda e: F.col("base") + e)
    tail = F.when(F.col("final") & (F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(-1)) < F.col("n") - 1), F.array(F.col("base") + F.col("n"))).otherwise(F.array().cast("array<bigint>"))
    placed = placed.withColumn("stops", F.concat(ends, tail))
    rows = placed.select("file", "before", "super_before", "begun", "stops", F.size("ends").alias("ended"), F.posexplode("stops").alias("i", "stop"))
    start = F.when(F.col("i") == 0, F.col("begun")).otherwise(F.get("stops", F.col("i") - 1) + 1)
    return rows.select("file", (F.col("super_before") + F.col("before") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("stop") - start).alias("n_tokens"), (F.col("i") < F.col("ended")).alias("complete"))


def document_counts(docs: DataFrame, vocabulary: tuple[str, str] | None = None, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS, file_documents: int = FILE_DOCUMENTS) -> DataFrame:
    """docs' tokens counted from flat files: doc_id, file (its number), ordinal, start, n_tokens, complete."""
    spark, path = docs.sparkSession, shared_path(docs.sparkSession, "flat-tokens")
    flat_files(docs, path, vocabulary, separator, file_documents)
    number = lambda file: F.regexp_replace(file, r"^.*/part-(\d+).*-c(\d+)[^/]*$", "$1-$2")
    lines = spark.read.format("binaryFile").load(f"{path}/labels").where("length > 0").select(number(F.col("path")).alias("file"), F.split(F.col("content").cast("string"), "\n").alias("lines"))
    labels = lines.select("file", F.posexplode(F.slice("lines", F.lit(1), F.size("lines") - 1)).alias("ordinal", "line"))
    labels = labels.select("file", F.col("ordinal").cast("long").alias("ordinal"), F.nullif("line", F.lit("")).cast("long").alias("doc_id"))
    counts = token_counts(spark, f"{path}/tokens", separator, block_tokens).withColumn("file", number(F.col("file")))
    apart = F.raise_error(F.concat(F.lit("tokens and doc_ids differ in file "), F.col("file")))
    both = labels.withColumn("labelled", F.lit(True)).join(counts, ["file", "ordinal"], "full")
    met = F.col("labelled").isNotNull() & F.col("n_tokens").isNotNull()
    return both.select("doc_id", "file", "ordinal", "start", F.when(met, F.col("n_tokens")).otherwise(apart.cast("long")).alias("n_tokens"), "complete")
