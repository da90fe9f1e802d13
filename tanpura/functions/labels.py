"""Labels, formats and levels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tanpura.sources.catalog import AUDIO_BASE, UNDETECTED_MESSAGE


def raga_label(name: Column, mood: Column) -> Column:
    return F.concat(name, F.lit(" - "), mood)


def tala_label(name: Column, beats: Column) -> Column:
    return F.concat(name, F.lit(" ("), beats.cast("string"), F.lit(" beats)"))


def percent(confidence: Column) -> Column:
    """A fraction as a whole percentage; halves go up."""
    return F.floor(confidence * 100 + 0.5).cast("bigint")


def level(confidence: Column) -> Column:
    """high, medium or low by the rounded percentage; null counts as low."""
    p = percent(confidence)
    return F.when(p >= 80, "high").when(p >= 60, "medium").otherwise("low")


def creativity_band(creativity: Column) -> Column:
    """Three bands with cuts at 33 and 66; null counts as the last one."""
    return F.when(creativity < 33, "Conservative").when(creativity < 66, "Balanced").otherwise("Experimental")


def minutes(seconds: Column) -> Column:
    """m:ss; null for null, NaN and infinite seconds."""
    s = F.floor(seconds)
    text = F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))
    number = seconds.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), text)


def progress(position: Column, duration: Column) -> Column:
    """Percent played; 0 for durations of 0, null and NaN."""
    missing = duration.isNull() | F.isnan(duration) | (duration == 0)
    return F.when(missing, F.lit(0.0)).otherwise(F.try_divide(position, duration) * 100)


def audio_url(raga: Column, tala: Column, tempo: Column, base: str = AUDIO_BASE) -> Column:
    return F.concat(F.lit(base), raga, F.lit("_"), tala, F.lit("_"), tempo.cast("string"), F.lit("bpm.mp3"))


def composition_id(requested_at: Column) -> Column:
    """comp_ and the epoch's milliseconds. It isn't unique; request_id is the key."""
    return F.concat(F.lit("comp_"), F.unix_millis(requested_at).cast("string"))


def analysis_message(raga_name: Column, confidence: Column) -> Column:
    found = F.concat(F.lit("Detected Raga: "), raga_name, F.lit(" ("), percent(confidence).cast("string"), F.lit("% confidence)"))
    return F.when(raga_name.isNotNull(), found).otherwise(F.lit(UNDETECTED_MESSAGE))


def composition_message(duration: Column, raga_name: Column) -> Column:
    return F.concat(F.lit("Successfully created a "), duration.cast("string"), F.lit(" second composition in "), raga_name, F.lit(" raga."))


def canonical_note(note: Column) -> Column:
    """One spelling for altered notes: Komal Re becomes Re Komal."""
    return F.regexp_replace(note, "^(Komal|Tivra) (Sa|Re|Ga|Ma|Pa|Dha|Ni)$", "$2 $1")


def blank(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) == ""
