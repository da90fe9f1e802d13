"""The corpus pipeline, stage by stage, against the operators' own decisions and brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tanpura.llm import bpe, common, mixing, probminhash, quality, queries
from tests.llm.test_duplicates import bare, brute_classes
from tests.llm.test_encoding import reference  # noqa: F401


def test_stages_take_effect(spark, small):
    docs = queries.table(spark, small, "documents")
    columns, counts = docs.columns, [docs.count()]
    state = docs
    outs = []
    for _, stage in P.STAGES:
        state = stage(spark, state, small).cache()
        outs.append(state)
        counts.append(state.count())
    good, exact, near, mixed, tokens = outs
    assert all(x.columns == columns for x in outs[:4])
    predicted = {r["doc_id"] for r in queries.op10_quality(spark, small).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in good.collect()} == predicted
    texts = {bare(r["text"]) for r in good.collect()}
    assert counts[2] == len(texts) and {bare(r["text"]) for r in exact.collect()} == texts
    assert counts[3] == probminhash.near_duplicates(exact).where("kept").count()
    taken = mixing.mix(near).select(F.sum("taken")).first()[0]
    assert mixed.select(F.sum(mixing.size_of())).first()[0] == pytest.approx(taken, rel=mixing.MISS)
    assert counts[5] == counts[4]
    assert {r["ids_sha256"] for r in tokens.collect()} == {r["ids_sha256"] for r in bpe.digests(bpe.decode(bpe.encode(mixed))).collect()}
    # run() is the stages one after the other, and leaves nothing but their results behind.
    before = set(common._stored)
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in P.run(spark, small).collect()) == sorted((r["doc_id"], r["ids_sha256"]) for r in tokens.collect())
    assert set(common._stored) == before


def words(text):
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]


def brute_mix(rows):
    """Targets by filling up the least filled sources word share by word share, then documents in hash order, in one place."""
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    size = {s: sum(len(words(r["text"])) for r in by[s]) for s in names}
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    low, high = 0.0, 3.0 * sum(size.values())
    for _ in range(200):  # the level at which shares, capped, add up
        level = (low + high) / 2
        low, high = (low, level) if sum(min(3 * size[s], weight[s] * level) for s in names) > sum(size.values()) else (level, high)
    taken = Counter()
    for s in names:
        goal = int(np.floor(min(3 * size[s], weight[s] * level) + 0.5))
        times, rest = divmod(goal, size[s]) if size[s] else (0, 0)
        for r in sorted(by[s], key=lambda r: hashlib.md5(f"{'null' if r['doc_id'] is None else r['doc_id']}:0".encode()).hexdigest()):
            n = len(words(r["text"]))
            part = max(0, min(n, rest))
            rest -= part
            whole = n if 2 * part >= n else 0
            if abs(whole - part) > mixing.MISS * goal:
                whole = part
            for x in [n] * times + [whole]:
                if x:
                    taken[r["doc_id"], x] += 1
    return taken


def test_stages_equal_brute_force(spark, small, reference):  # noqa: F811
    """Each stage after the classifier over a part of the table that its predecessor gave, in one place; the classifier is held in test_models."""
    docs = queries.table(spark, small, "documents")
    good = [r.asDict() for r in P.quality_classifier(spark, docs, small).collect()]
    scores = {r["doc_id"]: r["score"] for r in queries.op10_quality(spark, small).collect()}
    assert Counter(r["doc_id"] for r in good) == Counter(r["doc_id"] for r in docs.collect() if scores[r["doc_id"]] >= 0.5)
    best = {}
    for r in good:
        k = bare(r["text"])
        if k not in best or (-len(r["text"] or ""), r["doc_id"]) < (-len(best[k]["text"] or ""), best[k]["doc_id"]):
            best[k] = r
    exact = P.exact_dedup(spark, spark.createDataFrame(good, docs.schema), small)
    assert {r["doc_id"] for r in exact.collect()} == {r["doc_id"] for r in best.values()}
    unique = sorted((r.asDict() for r in exact.collect()), key=lambda r: r["doc_id"])
    label = brute_classes([(r["doc_id"], r["text"]) for r in unique])
    least = [r for i, r in enumerate(unique) if label.index(label[i]) == i]
    near = P.minhash_near_dedup(spark, spark.createDataFrame(unique, docs.schema), small)
    assert {r["doc_id"] for r in near.collect()} == {r["doc_id"] for r in least}
    mixed = P.mixing_to_weights(spark, spark.createDataFrame(least, docs.schema), small).collect()
    assert Counter((r["doc_id"], len(words(r["text"]))) for r in mixed) == brute_mix(least)
    tokens = P.byte_level_bpe(spark, spark.createDataFrame(mixed, docs.schema), small).collect()
    want = Counter((r["doc_id"], hashlib.sha256(" ".join(map(str, reference.encode_ordinary(r["text"]))).encode()).hexdigest()) for r in mixed)
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in tokens) == want


def test_no_labels_for_held_out_rows(spark, small):
    labels = queries.table(spark, small, "labels")
    used = quality.labelled(quality.with_statistics(queries.table(spark, small, "documents")), labels)
    assert used.where(quality.held_out()).count() == 0 and used.count() > 0
