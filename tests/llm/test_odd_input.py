"""Nulls, empty, long and non-UTF-8 texts, repeated rows, empty tables, clashing and odd columns, for each operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tanpura.llm import bpe, grace, lineblocks, mixing, omh, probminhash, quality, repeats, tokenscan, toxicity

CLASHES = ["row", "__row", "score", "__score", "__size", "size", "key", "block", "stats", "class", "members", "bands", "label", "mix_size", "MIX_DRAW", "__text", "text_", "__html", "taken_", "file", "at"]
LONG = "a calm sentence of many words about rain " * 20_000


@pytest.fixture(scope="module")
def odd(spark):
    texts = [(1, "X'ff61'"), (2, "X'ff62'"), (3, "X'c3'"), (4, "null"), (5, "X''"), (None, "X'61'"), (None, "X'61'"), (6, "X'61'"), (7, "X'61'"), (7, "X'61'")]
    rows = [spark.range(1).select(F.lit(i).cast("long").alias("doc_id"), F.expr(f"cast({t} as string)").alias("text")) for i, t in texts]
    rows += [spark.createDataFrame([(8, LONG), (9, LONG + "!")], "doc_id long, text string")]
    made = rows[0]
    for r in rows[1:]:
        made = made.union(r)
    more = [F.lit("kept").alias(c) for c in CLASHES]
    source = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("s"), F.col("doc_id") % 2))
    return made.select("doc_id", "text", source.alias("source"), F.length("text").alias("n_chars"), F.named_struct(F.lit("a-b"), F.lit(1), F.lit("c d"), F.array(F.lit(2))).alias("odd-struct"), F.lit(3).alias("dot.ted"), *more).repartition(3)


def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(1, 10)], "doc_id long, quality int, rude boolean").withColumn("rude", F.col("rude").cast("int"))


def kept_columns(rows, but=()):
    """The extra columns are there with their contents."""
    for r in rows:
        assert all(r[c] == "kept" for c in CLASHES if c not in but) and r["odd-struct"]["a-b"] == 1 and r["dot.ted"] == 3


STAGES = {
    "quality": lambda docs: quality.keep_good(docs, labels(docs.sparkSession).limit(0)),  # without labels all stay
    "exact": grace.drop_exact_duplicates,
    "near": probminhash.drop_near_duplicates,
    "mixing": mixing.mixed_rows,
}


@pytest.mark.parametrize("name", STAGES)
def test_stages(spark, odd, name):
    made = STAGES[name](odd)
    rows = made.collect()
    assert made.columns == odd.columns and made.dtypes == odd.dtypes
    kept_columns(rows)
    raw = {r["x"] for r in made.select(F.hex(F.col("text").cast("binary")).alias("x")).collect()}
    if name in ("quality", "exact"):
        assert {"FF61", "FF62", "C3", "61"} <= raw
    wanted = {"quality": 12, "exact": 7}
    assert len(rows) == wanted.get(name, len(rows)) and rows
    assert STAGES[name](odd.limit(0)).count() == 0


def test_near_stage_keeps_one_of_each_class(odd):
    near = probminhash.near_duplicates(odd)
    assert near.count() == odd.count()
    assert probminhash.drop_near_duplicates(odd).count() == near.where("kept").select("class_id").distinct().count() == 6


PASSING = {
    "bpe": (lambda d: bpe.decode(bpe.encode(d, offsets=True)), ()),
    "fingerprints": (omh.fingerprints, ()),
    "statistics": (quality.with_statistics, ("stats",)),
    "score": (lambda d: quality.scored(quality.with_statistics(d), quality.fit(quality.labelled(quality.with_statistics(d), labels(d.sparkSession)))), ("stats", "score")),
    "toxicity": (lambda d: toxicity.toxicity(d, toxicity.fit_chain(d, labels(d.sparkSession), ["rude"])), ()),
    "html": (lambda d: lineblocks.extract(d, "text"), ()),
    "mix": (mixing.mix, ("size",)),
}


@pytest.mark.parametrize("name", PASSING)
def test_operators_pass_columns_through(odd, name):
    make, but = PASSING[name]
    rows = make(odd).collect()
    assert len(rows) == odd.count()
    kept_columns(rows, but)
    assert make(odd.limit(0)).count() == 0


def test_operators_with_their_own_rows(odd):
    n = odd.count()
    assert omh.edited_fingerprints(odd).count() == grace.exact_duplicates(odd).count() == repeats.remove_repeats(odd).count() == n
    counts = tokenscan.document_counts(odd, file_documents=2).collect()
    encoded = bpe.digests(bpe.encode(odd, decoded=True)).collect()
    per = lambda rows: sorted((r["doc_id"] or -1, r["n_tokens"]) for r in rows)
    assert per(counts) == per(encoded) and all(r["complete"] for r in counts)


def test_last_stage(spark, odd):
    docs = odd.withColumn("lang", F.lit("en"))
    made = P.byte_level_bpe(spark, docs, "")
    assert made.count() == odd.count() and made.where("n_tokens is null").count() == 0
