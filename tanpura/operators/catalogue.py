"""Lookups, defaults and expansions of the catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_id(dim: DataFrame, value: str) -> DataFrame:
    """The first row with this id, or none; case matters."""
    return dim.where(F.col("id") == value).orderBy("ordinal").limit(1)


def unique_ids(dim: DataFrame) -> DataFrame:
    """Of rows with equal ids the first, so that a join finds what a search in order would."""
    rest = [c for c in dim.columns if c != "id"]
    return dim.groupBy("id").agg(F.min_by(F.struct(*rest), "ordinal").alias("row")).select("id", "row.*")


def attach(rows: DataFrame, key: str, dim: DataFrame, name: str) -> DataFrame:
    """rows with a struct column name: the catalogue row whose id is in key, or null. The catalogue is broadcast: it has a fixed number of rows."""
    return rows.join(F.broadcast(dim.select(F.col("id").alias("__id"), F.struct(*dim.columns).alias(name))), F.col(key) == F.col("__id"), "left").drop("__id")


def first_id(dim: DataFrame) -> DataFrame:
    """One row: the first id in order, or an empty text."""
    return dim.agg(F.coalesce(F.min_by("id", "ordinal"), F.lit("")).alias("id"))


def mood_tokens(ragas: DataFrame) -> DataFrame:
    """id, place and mood: one row for each mood of a raga."""
    return ragas.select("id", F.posexplode(F.split("mood", ", ")).alias("place", "mood"))


def tala_beats(talas: DataFrame) -> DataFrame:
    """id, beats, section, beat (in the cycle, from 0) and syllable: one row for each beat."""
    sections = F.transform(F.split("pattern", " [|] "), lambda section, i: F.transform(F.split(section, " "), lambda syllable: F.struct(i.alias("section"), syllable.alias("syllable"))))
    return talas.select("id", "beats", F.posexplode(F.flatten(sections)).alias("beat", "x")).select("id", "beats", F.col("x.section").alias("section"), "beat", F.col("x.syllable").alias("syllable"))


def categories(ragas: DataFrame) -> DataFrame:
    """kind (time or mood), category and members: the ragas of each time and of each mood, in order."""
    member = F.struct("ordinal", "id")
    times = ragas.select(F.lit("time").alias("kind"), F.col("time").alias("category"), member.alias("m"))
    moods = ragas.select(F.lit("mood").alias("kind"), F.explode(F.split("mood", ", ")).alias("category"), member.alias("m"))
    return times.union(moods).groupBy("kind", "category").agg(F.sort_array(F.collect_list("m")).alias("members"))
