"""Composition requests: gates, validation, enrichment and what is shown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tanpura.functions import labels as L
from tanpura.operators.catalogue import attach
from tanpura.sources import catalog

# Least, most and step of each slider.
DOMAINS = {"tempo": (40, 200, 1), "duration": (30, 300, 30), "creativity": (0, 100, 1)}


def submit_gate(requests: DataFrame) -> DataFrame:
    """requests with can_submit: whether no key is null or empty."""
    return requests.withColumn("can_submit", ~(L.blank(F.col("raga")) | L.blank(F.col("tala")) | L.blank(F.col("style"))))


def resolve(requests: DataFrame) -> DataFrame:
    """requests with raga_row, tala_row and style_row: catalogue rows or null, by three broadcast joins."""
    spark = requests.sparkSession
    found = attach(requests, "raga", catalog.dim_raga(spark), "raga_row")
    found = attach(found, "tala", catalog.dim_tala(spark), "tala_row")
    return attach(found, "style", catalog.dim_style(spark), "style_row")


def is_valid():
    return F.col("raga_row").isNotNull() & F.col("tala_row").isNotNull() & F.col("style_row").isNotNull()


def compose(requests: DataFrame) -> DataFrame:
    """A composition for each valid request."""
    return resolve(requests).where(is_valid()).select(
        "request_id", "session_id", L.composition_id(F.col("requested_at")).alias("id"), F.col("raga_row").alias("raga"), F.col("tala_row").alias("tala"), F.col("style_row").alias("style"),
        "tempo", "duration", "creativity", L.audio_url(F.col("raga"), F.col("tala"), F.col("tempo")).alias("audio_url"), F.col("requested_at").alias("generated_at"),
    )


def rejected(requests: DataFrame) -> DataFrame:
    """Requests that don't resolve, with missing: the keys that don't."""
    missing = F.array_compact(F.array(*(F.when(F.col(f"{k}_row").isNull(), F.lit(k)) for k in ("raga", "tala", "style"))))
    return resolve(requests).where(~is_valid()).select(*requests.columns, missing.alias("missing"))


def domain_violations(requests: DataFrame) -> DataFrame:
    """requests with violations: names of the settings outside their slider's domain."""
    bad = lambda k, low, high, step: ~F.col(k).between(low, high) | ((F.col(k) - low) % step != 0)
    return requests.withColumn("violations", F.array_compact(F.array(*(F.when(bad(k, *d), F.lit(k)) for k, d in DOMAINS.items()))))


def messages(compositions: DataFrame) -> DataFrame:
    return compositions.select("request_id", L.composition_message(F.col("duration"), F.col("raga.name")).alias("message"))


def cards(compositions: DataFrame) -> DataFrame:
    return compositions.select("request_id", F.col("raga.name").alias("raga_name"), L.tala_label(F.col("tala.name"), F.col("tala.beats")).alias("tala_label"), F.col("style.name").alias("style_name"), F.concat(F.col("tempo").cast("string"), F.lit(" BPM")).alias("tempo_text"))


def flat(compositions: DataFrame) -> DataFrame:
    """Compositions with ids and names in place of structs."""
    return compositions.select(
        "request_id", "session_id", "id", F.col("raga.id").alias("raga_id"), F.col("raga.name").alias("raga_name"), F.col("tala.id").alias("tala_id"), F.col("tala.beats").alias("beats"), F.col("style.id").alias("style_id"),
        "tempo", "duration", "creativity", "audio_url", F.unix_millis("generated_at").alias("generated_ms"),
    )
