"""Content analysis from notes and onsets, and beat-level timelines of compositions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tanpura.functions.labels import canonical_note
from tanpura.operators import ranges
from tanpura.operators.catalogue import attach, tala_beats
from tanpura.sources import catalog

#: A raga below this score counts as undetected.
LEAST_SCORE = 0.5


#: Each note has a bit: the seven natural notes, and each of them lowered and raised.
NOTES = [f"{note}{change}" for note in catalog.NATURAL_NOTES for change in ("", " Komal", " Tivra")]


def note_bit(note: Column) -> Column:
    """The canonical note's bit, or null for any other name."""
    bits = F.create_map(*(x for i, n in enumerate(NOTES) for x in (F.lit(n), F.lit(1 << i))))
    return F.try_element_at(bits, note)


def note_sets(observations: DataFrame) -> DataFrame:
    """recording_id, bits (of its notes) and others (distinct names that have no bit): one aggregation with partial sums."""
    rows = observations.select("recording_id", canonical_note(F.col("note")).alias("note")).where("note is not null").withColumn("bit", note_bit(F.col("note")))
    return rows.groupBy("recording_id").agg(F.coalesce(F.bit_or("bit"), F.lit(0)).alias("bits"), F.collect_set(F.when(F.col("bit").isNull(), F.col("note"))).alias("others"))


def raga_sets(ragas: DataFrame) -> DataFrame:
    """One row: known, an array of id, ordinal, bits and others of the ragas that have notes."""
    notes = F.array_distinct(F.transform("notes", canonical_note))
    bits = F.aggregate(notes, F.lit(0), lambda sum_, n: sum_.bitwiseOR(F.coalesce(note_bit(n), F.lit(0))))
    others = F.filter(notes, lambda n: note_bit(n).isNull())
    return ragas.agg(F.collect_list(F.struct("id", "ordinal", bits.alias("bits"), others.alias("others"))).alias("known"))


def scored(observations: DataFrame, ragas: DataFrame) -> DataFrame:
    """recording_id and scores: id, ordinal and the Jaccard similarity of note sets, for ragas that share a note, the best first.

    Sets are compared as bits, so a recording's notes are one row and no row is made for a note and a raga.
    """

    def score(r: Column) -> Column:
        shared = F.bit_count(F.col("bits").bitwiseAND(r["bits"])) + F.size(F.array_intersect("others", r["others"]))
        both = F.bit_count(F.col("bits").bitwiseOR(r["bits"])) + F.size(F.array_union("others", r["others"]))
        return F.struct((-shared / both).alias("order"), r["ordinal"].alias("ordinal"), r["id"].alias("id"), (shared / both).alias("score"))

    rows = note_sets(observations).crossJoin(F.broadcast(raga_sets(ragas)))  # with one row
    made = F.array_sort(F.filter(F.transform("known", score), lambda s: s["score"] > 0))
    return rows.select("recording_id", made.alias("scores"))


def raga_scores(observations: DataFrame, ragas: DataFrame) -> DataFrame:
    """recording_id, raga_id, ordinal and score, for ragas that share a note."""
    return scored(observations, ragas).select("recording_id", F.explode("scores").alias("s")).select("recording_id", F.col("s.id").alias("raga_id"), "s.ordinal", "s.score")


def raga_candidates(observations: DataFrame, ragas: DataFrame, k: int = 3) -> DataFrame:
    """The k best ragas of each recording; of equal scores the one declared first."""
    best = scored(observations, ragas).select("recording_id", F.posexplode(F.slice("scores", 1, k)).alias("place", "s"))
    return best.select("recording_id", (F.col("place") + 1).alias("rank"), F.col("s.id").alias("raga_id"), "s.score")


def raga_match(observations: DataFrame, ragas: DataFrame) -> DataFrame:
    return raga_candidates(observations, ragas, 1).select("recording_id", "raga_id", F.col("score").alias("confidence"))


def tempo_estimate(onsets: DataFrame, most: int | None = None) -> DataFrame:
    """Beats a minute by the median time between onsets, rounded with halves up; null for less than two onsets or a median of 0.

    Gaps are counted, with partial sums, and the median is where a running sum over a recording's different gaps passes
    the middle; nobody holds all gaps. A recording of more than most onsets takes its gaps range by range.
    """
    previous = ranges.last_before("onset_ms", F.struct("onset_ms", "k"))
    rows = ranges.running(onsets, "recording_id", "onset_ms", ["onset_ms", "k"], {"__before": previous}, most)
    counts = rows.groupBy("recording_id", (F.col("onset_ms") - F.col("__before")).alias("gap")).agg(F.count("*").alias("n"))
    counts = counts.withColumn("n", F.when(F.col("gap").isNull(), 0).otherwise(F.col("n")))
    own = W.partitionBy("recording_id")
    placed = counts.withColumns({"upto": F.sum("n").over(own.orderBy("gap")), "all": F.sum("n").over(own)})
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("gap")))
    middle = placed.groupBy("recording_id").agg(at(F.floor((F.col("all") - 1) / 2)).alias("low"), at(F.floor(F.col("all") / 2)).alias("high"))
    median = (F.col("low") + F.col("high")) / F.lit(2.0)
    return middle.select("recording_id", F.floor(F.try_divide(F.lit(60000.0), F.nullif(median, F.lit(0.0))) + 0.5).cast("int").alias("tempo"))


def timeline(compositions: DataFrame, cycles: int | None = None) -> DataFrame:
    """One row for each beat of a composition, or of its first cycles: request_id, b, cycle, beat, syllable, offset_ms.

    compositions has request_id, tala_id, tempo, duration. Columns are pruned before the rows are multiplied, and cycles
    bounds how often.
    """
    beats = F.broadcast(tala_beats(catalog.dim_tala(compositions.sparkSession)).groupBy("id").agg(F.max("beats").alias("beats"), F.transform(F.sort_array(F.collect_list(F.struct("beat", "syllable"))), lambda x: x["syllable"]).alias("syllables")))
    n = F.floor(F.col("duration") * F.col("tempo") / 60).cast("int")
    rows = compositions.select("request_id", "tala_id", "tempo", n.alias("n")).where("n >= 1").join(beats, F.col("tala_id") == F.col("id"))
    last = F.col("n") if cycles is None else F.least("n", F.col("beats") * cycles)
    rows = rows.select("request_id", "tempo", "beats", "syllables", F.explode(F.sequence(F.lit(0), last - 1)).alias("b"))
    beat = (F.col("b") % F.col("beats")).cast("int")
    return rows.select("request_id", "b", F.floor(F.col("b") / F.col("beats")).cast("int").alias("cycle"), beat.alias("beat"), F.get("syllables", beat).alias("syllable"), F.floor(F.col("b") * 60000 / F.col("tempo")).cast("long").alias("offset_ms"))


def tala_match(beats: DataFrame) -> DataFrame:
    """request_id and tala_id: the tala whose syllables a recording's first cycle equals, in order. beats is a timeline or its first cycle."""
    cycle = beats.where("cycle = 0").groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("beat", "syllable"))).alias("x"))
    known = tala_beats(catalog.dim_tala(beats.sparkSession)).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("beat", "syllable"))).alias("y"))
    syllables = lambda c: F.transform(c, lambda x: x["syllable"])
    keyed = known.select(F.col("id").alias("tala_id"), F.array_join(syllables("y"), " ").alias("key"))
    return cycle.select("request_id", F.array_join(syllables("x"), " ").alias("key")).join(F.broadcast(keyed), "key").select("request_id", "tala_id")


def content_analysis(observations: DataFrame, onsets: DataFrame, ragas: DataFrame, talas_found: DataFrame | None = None, least: float = LEAST_SCORE) -> DataFrame:
    """recording_id, raga_id (null below the least score), confidence, tempo, tala_id (null where no beats are known)."""
    match = raga_match(observations, ragas)
    both = match.join(tempo_estimate(onsets), "recording_id", "full")
    found = both.join(talas_found.withColumnRenamed("request_id", "recording_id"), "recording_id", "left") if talas_found is not None else both.withColumn("tala_id", F.lit(None).cast("string"))
    return found.select("recording_id", F.when(F.col("confidence") >= least, F.col("raga_id")).alias("raga_id"), "confidence", "tempo", "tala_id")


def with_ragas(analysis: DataFrame) -> DataFrame:
    return attach(analysis, "raga_id", catalog.dim_raga(analysis.sparkSession), "raga")
