"""SimHash (11), the prefix trie (12) and whitening (13) against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tanpura.llm import queries, simhash, trie, whitening


def simhash_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(prints, radius):
    """Number of the component of each fingerprint, all pairs compared."""
    least = np.arange(len(prints))
    for k in range(len(prints)):
        near = np.flatnonzero(np.bitwise_count(prints ^ prints[k]) <= radius)
        labels = np.unique(least[near])
        least[np.isin(least, labels)] = labels[0]
    return least


def test_simhash_query_equals_brute_force(spark, small):
    """These tables link equal fingerprints only; others are linked in the tests below."""
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op11_simhash(spark, small).collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    prints = np.array([simhash_of(t) for _, t in rows], np.uint64)
    labels = linked(prints, 3)
    assert got == {i: (f"{int(p):016x}", rows[k][0]) for (i, _), p, k in zip(rows, prints, labels, strict=True)}
    assert len(set(labels)) < len(rows)


def family(rng, n, far):
    """Fingerprints of which each is up to so many bits from an earlier one, or new."""
    made = []
    for _ in range(n):
        p = rng.getrandbits(64)
        if made and rng.random() < 0.7:
            p = rng.choice(made)
            for b in rng.sample(range(64), rng.randint(0, far)):
                p ^= 1 << b
        made.append(p)
    return made


@pytest.mark.parametrize("radius, tile, agreed", [(3, 1 << 20, None), (3, 40, None), (3, 3, None), (1, 5, None), (0, 5, None), (3, 1, (6, 3, 4)), (2, 2, (4, 2, 9))])
def test_every_pair_within_the_radius_meets(spark, monkeypatch, radius, tile, agreed):
    if agreed:
        monkeypatch.setattr(simhash, "plan", lambda *_: agreed)
    prints = sorted(set(family(random.Random(radius * 100 + tile), 600, radius + 1)))
    nodes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)], "fingerprint long, least long").repartition(3).persist()
    want = linked(np.array(prints, np.uint64), radius)
    place = {p - (1 << 64) if p >> 63 else p: i for i, p in enumerate(prints)}
    group = list(range(len(prints)))
    for a, b in simhash.links(nodes, radius, tile).collect():
        a, b = group[place[a]], group[place[b]]
        group = [min(a, b) if g in (a, b) else g for g in group]
    assert group == want.tolist()
    assert radius == 0 or len(set(group)) < len(group)


def test_plans_bring_tiles_near_their_size():
    for n in (0, 1, 2048, 255_000, 10**8, 5 * 10**10):
        blocks, agree, bits = simhash.plan(n, 3, 2048)
        assert blocks == 3 + agree and bits <= 64 // blocks and n / 2 ** (agree * bits) <= 2 * 2048 * 2**agree


def test_simhash_of_odd_rows(spark):
    made = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (None, "one"), (5, "one"), (6, "a b"), (7, "A\x0bB"), (8, "word " * 200_000), (9, "Ä b c d"), (10, "ä b c d")]
    docs = spark.createDataFrame(made, "doc_id long, text string").withColumn("fingerprint", F.lit("x")).withColumn("key", F.lit(1))
    got = sorted(((r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()))
    assert [g[1] for g in got] == [f"{simhash_of(t):016x}" for _, t in sorted(made, key=lambda m: m[0] or 0)]
    ids = {i: c for i, _, c in got}
    assert ids[1] == ids[2] == ids[3] == 1 and ids[0] == ids[5] == ids[4] == 4 and ids[7] == 6 and ids[9] != ids[10]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    bad = spark.range(1).select(F.lit(1).alias("doc_id"), F.expr("cast(X'ff61' as string)").alias("text"))
    assert simhash.near_duplicates(bad).first()["fingerprint"] == f"{xxhash.xxh64_intdigest(b'\xffa', 42):016x}"


def nodes_by_hand(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [v[2:] for v in sorted(t, key=lambda v: v[:2])] for c, t in turns.items()}
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(list)
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole = own.get(c - c % 5, [])[:h] + said[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append(c)
        ends[tuple(whole)].append(c)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = sum(saved[x] for x in children[k]) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    digest = lambda k: hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
    return [(min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(children[k]), leaves[k], saved[k], digest(k)) for k in members]


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple(-1 if v is None else v for v in r))


def made_conversations(spark):
    """Common first turns, nulls, one conversation of many turns and one that leaves it late; ids that are far apart."""
    rng = random.Random(1)
    rows = [(c, None if t == 0 and c % 3 else t, rng.choice(["u", "a", None]), rng.choice(["x", "yy", "é", None])) for c in range(50) for t in range(rng.randint(1, 6))]
    rows += [(c, t, "u", "x") for c, n in ((500, 250), (501, 240), (502, 9)) for t in range(n)] + [(10**12 + 3, 0, "u", "x"), (None, 0, "u", "nobody's")]
    return rows, spark.createDataFrame([(*r, "kept") for r in rows], "conv_id long, turn long, role string, text string, node string").repartition(3)


@pytest.mark.parametrize("piece, most", [(10**6, None), (6, 30)])
def test_trie(spark, piece, most):
    rows, table = made_conversations(spark)
    assert ordered(trie.prefix_trie(table, piece, most).collect()) == ordered(nodes_by_hand(rows))


def test_trie_over_the_table(spark, small):
    table = spark.read.parquet(f"{small}/conversations.parquet")
    want = ordered(nodes_by_hand(table.select("conv_id", "turn", "role", "text").collect()))
    assert ordered(queries.op12_trie(spark, small).collect()) == want
    assert ordered(trie.prefix_trie(table, piece=4).collect()) == want


def test_trie_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(trie, "JOINED_BYTES", 10)
    same = [(c, t, "u", "again") for c in range(0, 400, 5) for t in (0, 0, None)]  # ties and repeated rows; all end in one node
    table = spark.createDataFrame(same, "conv_id long, turn long, role string, text string")
    assert ordered(trie.prefix_trie(table).collect()) == ordered(nodes_by_hand(same))
    assert trie.prefix_trie(table.limit(0)).count() == 0
    ties = spark.createDataFrame([(5, 1, "u", x) for x in ("c", "a", "b", "a")], table.schema)
    assert ordered(trie.prefix_trie(ties).collect()) == ordered(trie.prefix_trie(ties.orderBy("text").coalesce(1)).collect())


def test_decomposition_of_random_forests():
    rng = np.random.default_rng(3)
    for n in (1, 2, 50, 300):
        parent = np.array([-1 if i == 0 or rng.random() < 0.1 else rng.integers(max(0, i - 5), i) for i in range(n)])
        depth, values = np.zeros(n, int), rng.integers(0, 9, (n, 2))
        want = values.copy()
        for i in range(n):
            depth[i] = 0 if parent[i] < 0 else depth[parent[i]] + 1
        for i in range(n - 1, 0, -1):
            if parent[i] >= 0:
                want[parent[i]] += want[i]
        mixed = rng.permutation(n)  # row i is node mixed[i]
        back = np.argsort(mixed)
        up = np.where(parent[mixed] < 0, -1, back[parent[mixed]])
        assert (trie.decomposed(up, depth[mixed], values[mixed]) == want[mixed]).all()


def whitened_by_hand(vectors, k=32):
    x = np.floor(64 * vectors.astype(float)).astype(np.int64) + 1000000
    n, sums = len(x), x.sum(axis=0)
    centred = (x - 1000000) - (sums - 1000000 * n) / n
    _, s, v = np.linalg.svd(centred, full_matrices=False)
    k = min(k, int((s > s[0] * 1e-11).sum()))
    return ((n * x - sums) ** 2).sum(axis=1), centred @ v[:k].T / (s[:k] / np.sqrt(n)), s[:k] ** 2 / (s**2).sum()


def against_hand(rows, vectors, tolerance):
    deviation, white, explained = whitened_by_hand(vectors)
    table = rows.toPandas()
    got = table.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert got.shape == white.shape
    sign = np.sign((got * white).sum(axis=0))
    assert np.abs(got - white * sign).max() < tolerance
    one = table[table["component"] == 1].sort_values("vec_id")
    assert one["deviation"].tolist() == deviation.tolist() and set(table["n"]) == {len(vectors)}
    assert np.allclose(table[table["vec_id"] == one["vec_id"].iloc[0]].sort_values("component")["explained"], explained, rtol=1e-6)
    assert table["identity_error"].nunique() == 1 and table["identity_error"].iloc[0] < 1e-6


def test_whitening_query_equals_svd(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet").orderBy("vec_id").toPandas()
    against_hand(queries.op13_whitening(spark, small), np.array(table["embedding"].tolist()), 1e-9)


def test_whitening_of_dependent_and_uneven_columns(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((120, 5))
    x = np.hstack([x, x[:, :2], np.ones((120, 1)), x[:, :1] * 1e4])
    odd = [(900, None), (901, [1.0]), (902, [float("nan")] * 9), (903, [None] + [1.0] * 8), (904, []), (905, [float("inf")] * 9)]
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + odd, "vec_id long, embedding array<double>").withColumn("x", F.lit("kept"))
    against_hand(whitening.whitened_rows(table.repartition(3)), x, 1e-4)


def test_whitening_of_few_rows(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [2.0, 5.0, 1.0]), (2, [2.0, 5.0, 1.0])], "vec_id long, embedding array<float>")
    assert whitening.whitened_rows(table.limit(0)).count() == whitening.whitened_rows(table.where("vec_id = 2")).count() == 0
    rows = whitening.whitened_rows(table).collect()
    assert [r["component"] for r in rows] == [1, 1, 1] and abs(sum(r["whitened"] ** 2 for r in rows) / 3 - 1) < 1e-9


def test_deviations_beyond_a_long_are_exact():
    n, sums = 10**11, (5, -(10**12))
    model = whitening.Whitening(n, list(sums))
    rows = [(3, -7), (2**20, 1), (2**50, 1)]
    want = [sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in rows]
    assert [v if v is None else int(v) for v in model.deviations(np.array(rows)).to_pylist()] == [*want[:2], None]  # beyond 38 digits: null
