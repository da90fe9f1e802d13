"""Analysis of recordings by file name, and what is shown of it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tanpura.functions import labels as L
from tanpura.operators.catalogue import attach
from tanpura.session import ship
from tanpura.sources import catalog
from tanpura.sources.catalog import FILE_RULES, NATURAL_NOTES, RAGAS, TALAS


def rule_of(file_name: Column) -> Column:
    """Priority of the first rule whose pattern the name contains, or null: the rules as one chain, without a join."""
    chain = F.when(F.lit(False), F.lit(0))
    for i, (pattern, *_) in enumerate(FILE_RULES):
        chain = chain.when(file_name.contains(pattern), F.lit(i))
    return chain


def drawn(file_name: Column, salt: str, n: int) -> Column:
    """A number from 0 to n - 1 that depends on salt and name only."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), file_name).cast("binary")), 1, 8), 16, 10).cast("bigint") % n


def defaults_of(file_name: Column) -> dict[str, Column]:
    """For names that meet no rule: raga and tala evenly, tempo 60 to 99, confidence 0.4 to under 0.9, the natural notes."""
    return {
        "raga_ordinal": drawn(file_name, "raga", len(RAGAS)).cast("int"),
        "tala_ordinal": drawn(file_name, "tala", len(TALAS)).cast("int"),
        "tempo": (60 + drawn(file_name, "tempo", 40)).cast("int"),
        "confidence": F.lit(0.4) + drawn(file_name, "confidence", 1000) / F.lit(2000.0),
    }


def pick(values: list, place: Column) -> Column:
    return F.get(F.array(*[F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v) for v in values]), place)


def classify(recordings: DataFrame) -> DataFrame:
    """recordings with rule: the first rule that the name meets, or null."""
    return recordings.withColumn("rule", rule_of(F.col("file_name")))


def classify_by_rules(recordings: DataFrame, rules: DataFrame) -> DataFrame:
    """As classify, for rules in a table (priority, pattern) that are many or change: by an automaton, or by a join where they are too many for one."""
    known = rules.select("priority", "pattern").where("pattern is not null and priority is not null").limit(AUTOMATON_RULES + 1).collect()
    return classify_by_join(recordings, rules) if len(known) > AUTOMATON_RULES else classify_by_automaton(recordings, known)


#: Rules that go to every task as one automaton.
AUTOMATON_RULES = 200_000


def classify_by_automaton(recordings: DataFrame, rules: list) -> DataFrame:
    """One pass over each name finds all the patterns in it, however many there are (Aho-Corasick); the least priority stays."""
    spark = recordings.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast([(int(p), x) for p, x in rules])

    @F.pandas_udf("int")
    def first_rule(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        least: dict[str, int] = {}
        for priority, pattern in sent.value:
            least[pattern] = min(priority, least.get(pattern, priority))
        always = least.pop("", None)  # every name has the empty pattern
        automaton = ahocorasick.Automaton()
        for pattern, priority in least.items():
            automaton.add_word(pattern, priority)
        if least:
            automaton.make_automaton()

        def of(name: str | None) -> int | None:
            if name is None:
                return None
            found = [p for _, p in automaton.iter(name)] if least else []
            return min(found if always is None else [*found, always], default=None)

        for series in names:
            yield pd.Series([of(n) for n in series], dtype="Int32")

    return recordings.withColumn("rule", first_rule("file_name"))


def classify_by_join(recordings: DataFrame, rules: DataFrame) -> DataFrame:
    """As classify_by_rules, for any number of rules: each different name's substrings, of the lengths that patterns have, meet the patterns by equality."""
    lengths = [r[0] for r in rules.where("pattern is not null").select(F.length("pattern")).distinct().collect()]  # as many as a name is long
    names = recordings.select("file_name").where("file_name is not null").distinct()
    parts = lambda n: F.transform(F.sequence(F.lit(1), F.length("file_name") - n + 1), lambda i: F.substring(F.col("file_name"), i, F.lit(n)))
    pieces = [F.when(F.length("file_name") >= n, parts(n)).otherwise(F.array().cast("array<string>")) if n else F.array(F.lit("")) for n in lengths]
    each = names.select("file_name", F.explode(F.array_distinct(F.flatten(F.array(*pieces)))).alias("pattern"))
    least = rules.where("pattern is not null").groupBy("pattern").agg(F.min("priority").alias("priority"))
    met = each.join(least, "pattern").groupBy("file_name").agg(F.min("priority").alias("rule"))
    return recordings.join(met, "file_name", "left").select(*recordings.columns, "rule")


def analyze(recordings: DataFrame) -> DataFrame:
    """recordings with raga and tala (structs), tempo, confidence and notes."""
    spark = recordings.sparkSession
    name, rule = F.col("file_name"), F.col("rule")
    default = defaults_of(name)
    ids = lambda table: [row[0] for row in table]
    column = lambda i: pick([r[i] for r in FILE_RULES], rule)
    keyed = classify(recordings).withColumns({
        "raga_id": F.coalesce(column(1), pick(ids(RAGAS), default["raga_ordinal"])),
        "tala_id": F.coalesce(column(2), pick(ids(TALAS), default["tala_ordinal"])),
        "tempo": F.coalesce(column(3), default["tempo"]),
        "confidence": F.coalesce(column(4), default["confidence"]),
        "notes": F.coalesce(column(5), F.array(*map(F.lit, NATURAL_NOTES))),
    })
    found = attach(attach(keyed, "raga_id", catalog.dim_raga(spark), "raga"), "tala_id", catalog.dim_tala(spark), "tala")
    return found.select(*recordings.columns, "rule", "raga", "tala", "tempo", "confidence", "notes")


def known_analyses(spark) -> DataFrame:
    """The rules with their ragas and talas."""
    rules = catalog.dim_file_rule(spark)
    return attach(attach(rules, "raga_id", catalog.dim_raga(spark), "raga"), "tala_id", catalog.dim_tala(spark), "tala")


def messages(analyses: DataFrame) -> DataFrame:
    return analyses.select("recording_id", L.analysis_message(F.col("raga.name"), F.col("confidence")).alias("message"))


def cards(analyses: DataFrame) -> DataFrame:
    """What a card shows: raga fields, tala and tempo where present (a tempo of 0 counts as missing), else the undetected text."""
    return analyses.select(
        "recording_id",
        L.percent(F.col("confidence")).alias("pct"),
        L.level(F.col("confidence")).alias("level"),
        F.col("raga.name").alias("raga_name"),
        F.col("raga.time").alias("raga_time"),
        F.col("raga.mood").alias("raga_mood"),
        F.when(F.col("raga").isNotNull(), L.tala_label(F.col("tala.name"), F.col("tala.beats"))).alias("tala_label"),
        F.when(F.col("raga").isNotNull(), F.col("tala.pattern")).alias("tala_pattern"),
        F.when(F.col("raga").isNotNull(), F.concat(F.nullif(F.col("tempo"), F.lit(0)).cast("string"), F.lit(" BPM"))).alias("tempo_text"),
        F.when(F.col("raga").isNull(), F.lit(catalog.UNDETECTED_CARD)).alias("undetected_text"),
    )


def notes(analyses: DataFrame) -> DataFrame:
    return analyses.select("recording_id", F.posexplode("notes").alias("place", "note"))


def detected(analyses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Analyses with a raga, and those without."""
    return analyses.where(F.col("raga").isNotNull()), analyses.where(F.col("raga").isNull())
