"""Audio intake and composition export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("mp3", "wav", "flac")


def is_audio(file_name: str = "file_name") -> Column:
    return F.col(file_name).rlike(rf"\.({'|'.join(EXTENSIONS)})$")


def audio_files(spark: SparkSession, folder: str) -> DataFrame:
    """Audio files of a folder by their metadata; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{','.join(EXTENSIONS)}}}").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "length", "modificationTime")


def export_compositions(compositions: DataFrame, path: str) -> DataFrame:
    """Write compositions as Parquet, a folder for each raga, and read them back. Rows of a raga are spread over tasks by Spark's rebalancing."""
    compositions.hint("rebalance", "raga_id").write.partitionBy("raga_id").parquet(path)
    return compositions.sparkSession.read.parquet(path)
