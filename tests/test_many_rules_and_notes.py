"""Rule automata, note sets and counted medians against plain Python."""

import random
import statistics
from math import floor

import pytest
from pyspark.sql import functions as F

from tanpura.operators import analyze as A
from tanpura.operators import content as D

CHANGES = {"Komal Re": "Re Komal", "Komal Ga": "Ga Komal", "Tivra Ma": "Ma Tivra"}


def rules_and_names(spark, n):
    rng = random.Random(n)
    word = lambda k: "".join(rng.choice("abcé\U0001f3b5") for _ in range(k))
    rules = [(i, word(rng.randint(2, 7))) for i in range(n)] + [(n + 1, None), (None, "ab")]
    names = [(i, None if i % 17 == 0 else word(rng.randint(0, 12))) for i in range(200)] + [(500, "aaaa"), (500, "aaaa")]
    want = {i: min((p for p, x in rules if p is not None and x is not None and name is not None and x in name), default=None) for i, name in names}
    return spark.createDataFrame(rules, "priority int, pattern string"), spark.createDataFrame(names, "recording_id long, file_name string"), want


@pytest.mark.parametrize("most", [200_000, 10])
def test_many_rules(spark, monkeypatch, most):
    monkeypatch.setattr(A, "AUTOMATON_RULES", most)
    rules, names, want = rules_and_names(spark, 10_000)
    got = A.classify_by_rules(names, rules).collect()
    assert len(got) == 202 and {r["recording_id"]: r["rule"] for r in got} == want and any(v is not None for v in want.values())


@pytest.mark.parametrize("most", [200_000, 0])
def test_empty_patterns_and_no_rules(spark, monkeypatch, most):
    monkeypatch.setattr(A, "AUTOMATON_RULES", most)
    names = spark.createDataFrame([(1, "ab"), (2, ""), (3, None)], "recording_id long, file_name string")
    of = lambda rules: [r["rule"] for r in A.classify_by_rules(names, spark.createDataFrame(rules, "priority int, pattern string")).orderBy("recording_id").collect()]
    assert of([(4, ""), (2, "b")]) == [2, 4, None]
    assert of([]) == [None, None, None]


def test_note_sets(spark):
    rng = random.Random(2)
    names = ["Sa", "Re", "Komal Re", "Re Komal", "Ga", "Komal Ga", "Ma", "Tivra Ma", "Ma Tivra", "Pa", "x", "y", None]
    rows = [(r, i, rng.choice(names[: 3 + r % 11])) for r in range(60) for i in range(rng.randint(1, 9))] + [(99, 0, None)]
    ragas = [(0, "a", ["Sa", "Re", "Sa"]), (1, "b", ["Komal Re", "Re Komal", "x"]), (2, "c", ["z"]), (3, "d", []), (4, "e", ["Ma Tivra", "Ga"]), (5, "f", ["Re", "Sa"])]
    own = {}
    for r, _, note in rows:
        if note is not None:
            own.setdefault(r, set()).add(CHANGES.get(note, note))
    known = [(o, i, {CHANGES.get(n, n) for n in notes}) for o, i, notes in ragas]
    want = []
    for r, notes in own.items():
        scores = sorted((-len(notes & k) / len(notes | k), o, i) for o, i, k in known if notes & k)
        want += [(r, rank + 1, i, -s) for rank, (s, _, i) in enumerate(scores[:3])]
    table = spark.createDataFrame(rows, "recording_id long, position int, note string").repartition(3)
    dim = spark.createDataFrame(ragas, "ordinal int, id string, notes array<string>")
    assert sorted(map(tuple, D.raga_candidates(table, dim).collect())) == sorted(want)
    assert D.raga_candidates(table, dim.limit(0)).count() == D.raga_candidates(table.limit(0), dim).count() == 0


def test_scores_take_one_exchange(spark, small):
    from tanpura.plans import queries as Q

    plan = Q.raga_match(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan


@pytest.mark.parametrize("most", [None, 7])
def test_counted_medians(spark, most):
    rng = random.Random(4)
    rows = [(r, k, rng.randint(0, 50) * (1 + r % 3)) for r in range(40) for k in range(rng.choice([1, 2, 3, 40]))] + [(90, 0, 5), (90, 1, None), (91, 0, 3), (91, 1, 3)]
    want = {}
    for r in {r for r, _, _ in rows}:
        at = sorted(ms for q, _, ms in rows if q == r and ms is not None)
        gaps = [b - a for a, b in zip(at, at[1:], strict=False)]
        middle = statistics.median(gaps) if gaps else 0
        want[r] = floor(60000.0 / middle + 0.5) if middle else None
    table = spark.createDataFrame(rows, "recording_id long, k long, onset_ms long").withColumn("more", F.lit(1)).repartition(3)
    assert {r["recording_id"]: r["tempo"] for r in D.tempo_estimate(table, most).collect()} == want
