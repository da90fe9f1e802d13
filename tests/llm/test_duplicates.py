"""Exact deduplication (3), repeated passages (4) and near-duplicates (5) against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tanpura.llm import grace, induced, probminhash, queries, repeats

SCHEMA = "doc_id long, text string, lang string, source string, class string, members string, key string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "x", "y", "z") for i, t in rows], SCHEMA)


def bare(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def exact(rows):
    groups = defaultdict(list)
    for n, (i, t) in enumerate(rows):
        groups[bare(t)].append((-len(t or ""), i is None, i or 0, n))
    want = []
    for text, members in groups.items():
        best = min(members)
        keep = rows[best[3]][0]
        want += [(rows[m[3]][0], keep, len(members), hashlib.sha256(text.encode()).hexdigest()) for m in members]
    return want, len(groups)


ROWS = [(1, "a b"), (2, "ab"), (3, "a  b "), (4, None), (5, ""), (6, " \n\t"), (7, "é"), (8, "é "), (None, "ab"), (9, "ab"), (9, "ab"), (10, "x" * 50_000), (11, "x" * 50_000 + " ")]


@pytest.mark.parametrize("table_bytes", [1, 200, 1 << 20])
def test_grace_hashing(spark, table_bytes):
    got = grace.exact_duplicates(docs(spark, ROWS).repartition(3), table_bytes).collect()
    want, groups = exact(ROWS)
    order = lambda x: (x[0] is None, x[0] or 0, x[1] or 0, x[2], x[3])
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=order) == sorted(want, key=order)
    assert sum(r["kept"] for r in got) == groups
    assert all(r["keep_id"] == r["doc_id"] for r in got if r["kept"])


@pytest.mark.parametrize("most", [20, 5])
def test_levels_and_spilled_bytes_dont_grow_as_tables_shrink(spark, small, monkeypatch, most):
    """With one task for each bucket, and with five tasks that have several each."""
    monkeypatch.setattr(grace, "BUCKETS", most)
    monkeypatch.setattr(grace, "TASK_BYTES", 20_000)
    table, levels, spilled = spark.read.parquet(f"{small}/documents.parquet"), [], []
    text = table.agg(F.sum(F.octet_length("text"))).first()[0]

    def kept(df, name, write=grace.stored):
        made = write(df, name)
        if name.startswith("grace-") and name != "grace-groups":
            levels[-1] += 1
            spilled[-1] += made.where("class is null").agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0))).first()[0]
        return made

    monkeypatch.setattr(grace, "stored", kept)
    want = None
    for table_bytes in (200_000, 100_000, 50_000, 25_000):
        levels.append(0), spilled.append(0)
        got = sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in grace.exact_duplicates(table, table_bytes).collect())
        assert want is None or got == want
        want = got
    assert all(b <= a + 1 for a, b in zip(levels, levels[1:], strict=False)) and max(levels) <= 4 and max(spilled) < text


def test_large_groups_are_folded(spark, monkeypatch):
    rows = [(i, "same text" if i % 3 else f"other {i}") for i in range(3000)]
    monkeypatch.setattr(grace, "FOLD", 7)
    got = grace.exact_duplicates(docs(spark, rows)).collect()
    assert sum(r["kept"] for r in got) == 1001 and {r["group_size"] for r in got} == {1, 2000}
    assert next(r["keep_id"] for r in got if r["group_size"] == 2000) == 1


def test_exact_dedup_keeps_columns_and_one_of_repeated_rows(spark):
    kept = grace.drop_exact_duplicates(docs(spark, ROWS))
    assert kept.columns == docs(spark, ROWS).columns
    assert kept.count() == exact(ROWS)[1]
    assert grace.drop_exact_duplicates(docs(spark, ROWS).limit(0)).count() == 0


def test_content_table_compares_contents():
    table = grace.ContentTable(4)
    entries = [table.add(5, bytes([i])) for i in range(20)]
    assert [table.find(5, bytes([i])) for i in range(20)] == entries and table.find(5, b"zz") == -1


def suffixes(s):
    return sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(500):
        size = rng.choice([1, 2, 4, 30])
        s = [rng.randint(1, size) for _ in range(rng.randint(0, 60))] + [0]
        want = suffixes(s)
        assert induced.suffix_array(np.array(s), size + 1).tolist() == want
        assert induced.sorted_suffixes(s, size + 1) == want
        shared = induced.permuted_prefixes(np.array(s), np.array(want), 9)
        for a, b in zip(want[1:], want, strict=False):
            n = 0
            while n < 9 and max(a, b) + n < len(s) and s[a + n] == s[b + n]:
                n += 1
            assert shared[a] == n


def cut_out(rows, length):
    seen = Counter()
    for _, t in rows:
        raw = (t or "").encode()
        seen.update(raw[i : i + length] for i in range(len(raw) - length + 1))
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for at in range(len(raw) - length + 1):
            if seen[raw[at : at + length]] > 1:
                gone[at : at + length] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        spans = int(np.sum(gone[:-1] & ~np.concatenate([[False], gone[:-1]])[: len(raw)])) if len(raw) else 0
        want.append((i, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return want


def shared_passages(rows, least):
    """For each row how many maximal runs of at least so many words also stand in a row of another doc_id."""
    where, found = defaultdict(set), []
    known = lambda i, t: ("null", t) if i is None else i
    for i, t in rows:
        w = [x for x in re.split(r"[ \t-\r]+", t or "") if x]
        for at in range(len(w) - least + 1):
            where[tuple(w[at : at + least])].add(known(i, t))
    for i, t in rows:
        w = [x for x in re.split(r"[ \t-\r]+", t or "") if x]
        held = np.zeros(len(w) + 1, int)
        for at in range(len(w) - least + 1):
            if len(where[tuple(w[at : at + least])]) > 1:
                held[at : at + least] = 1
        # Runs that touch without a common word are one.
        found.append(int(np.sum(np.diff(held, prepend=0) == 1)))
    return found


def passages(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    shared = [text(n) for n in (399, 400, 401, 500, 700, 1500)]
    rows = []
    for i in range(60):
        parts = [text(rng.randint(0, 600)) for _ in range(3)]
        for s in rng.sample(shared, rng.randint(0, 3)):
            at = rng.randint(0, max(0, len(s) - 450))
            parts.insert(rng.randint(0, 3), s[at:] if rng.random() < 0.5 else s)
        rows.append((i, "".join(parts)))
    near = list(rows[0][1])
    near[len(near) // 2] = "#"
    rows += [(60, rows[0][1]), (61, "".join(near)), (62, "ab" * 700), (63, "x" * 1200), (64, None), (65, ""), (66, "ab" * 300), (67, "y" * 400), (None, rows[1][1]), (67, "y" * 400)]
    return rows


def key(row):
    return (row[0] is None, row[0] or 0, *row[1:])


@pytest.mark.parametrize("hot", [1, 5, 1000])
def test_repeats_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = passages(hot)
    got = [tuple(r)[:6] for r in repeats.remove_repeats(docs(spark, rows).repartition(3)).collect()]
    want = [(*r, n) for r, n in zip(cut_out(rows, repeats.LENGTH), shared_passages(rows, repeats.PASSAGE), strict=True)]
    assert sorted(got, key=key) == sorted(want, key=key) and sum(r[5] for r in want) > 30


def test_short_passages_in_other_documents_are_counted(spark):
    """Passages of over 50 words and under 400 bytes, whatever the white space; not those of 50 words, nor those within one document."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, short, own = text(51), text(50), text(60)
    rows = [(1, f"{text(30)} {shared} {text(40)}"), (2, f"{text(9)}\n{shared.replace(' ', chr(10), 5)} {text(80)}"), (3, f"{text(9)} {short} {text(9)}"), (4, f"{short} {text(70)}"), (5, f"{own} {text(3)} {own}"), (6, text(300)), (7, None)]
    got = {r["doc_id"]: r for r in repeats.remove_repeats(docs(spark, rows)).collect()}
    assert {i: r["n_passages"] for i, r in got.items()} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0}
    assert not any(r["n_removed"] for r in got.values())
    low, high = got[1]["passages"]
    assert rows[0][1].encode()[low:high].decode() == shared


def test_a_key_under_thousands_of_contexts_is_split(spark, monkeypatch):
    """One passage in many documents with different surroundings, so that no two contexts fold."""
    monkeypatch.setattr(repeats, "HOT", 20)
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(430)
    rows = [(i, text(300) + passage[rng.randint(0, 20) : rng.randint(405, 430)] + text(200)) for i in range(150)]
    seen = []
    split = repeats.longer_anchors
    monkeypatch.setattr(repeats, "longer_anchors", lambda b: split(b))
    differing = repeats.differing
    monkeypatch.setattr(repeats, "differing", lambda read: seen.append(1) or differing(read))
    got = [tuple(r)[:5] for r in repeats.remove_repeats(docs(spark, rows)).collect()]
    assert sorted(got, key=key) == sorted(cut_out(rows, repeats.LENGTH), key=key) and len(seen) > 1


def test_kept_bytes_and_spans(spark):
    rows = passages(5)
    for r in repeats.remove_repeats(docs(spark, rows)).collect():
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] and len(r["spans"]) == 2 * r["n_spans"]
    assert repeats.remove_repeats(docs(spark, rows).limit(0)).count() == 0


def test_small_segments_give_the_same(monkeypatch):
    texts = [b"", *((t or "").encode() for _, t in passages(3)), b""]
    for of, sizes, length in ((repeats.occurrences, [len(t) for t in texts], repeats.LENGTH), (repeats.word_occurrences, [len(t.split()) for t in texts], repeats.PASSAGE)):
        monkeypatch.setattr(repeats, "SEGMENT", 1 << 20)
        whole = of(texts)
        monkeypatch.setattr(repeats, "SEGMENT", 1000)
        parts = of(texts)
        covered = lambda found: sorted((t, x) for t, first, n in zip(found[0], found[1], found[3], strict=True) for x in range(first, first + n))
        assert covered(whole) == covered(parts) == [(t, x) for t, n in enumerate(sizes) for x in range(n - length + 1)]


def words(rng, n):
    return [f"w{rng.randint(0, 5000)}" for _ in range(n)]


def near_rows():
    rng = random.Random(4)
    rows = []
    for _ in range(12):
        base = words(rng, rng.randint(60, 400))
        rows.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = base[:]
            for _ in range(rng.randint(1, 8)):
                copy[rng.randrange(len(copy))] = f"n{rng.randint(0, 99)}"
            rows.append(" ".join(copy))
    rows += ["one two three", "one  two THREE", "one two four", "", None, "a b c d e f " * 30, "a b c d e f " * 31]
    return list(enumerate(rows))


def brute_classes(rows):
    sets = [probminhash.shingles(probminhash.words_of((t or "").encode())) for _, t in rows]
    sets = [np.repeat(h, n) for h, n in sets]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if probminhash.similarity(sets[a], sets[b]) >= 0.8 - 1e-9:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    return label


@pytest.mark.parametrize("large", [2, 4096])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, large):
    """With further hubs in every bucket of more than two, and with blocks alone."""
    monkeypatch.setattr(probminhash, "LARGE", large)
    rows = near_rows()
    got = {r["doc_id"]: r["class_id"] for r in probminhash.near_duplicates(docs(spark, rows).repartition(3)).collect()}
    assert [got[i] for i, _ in rows] == brute_classes(rows)


def test_a_bucket_is_compared_whole(spark):
    rng = random.Random(8)
    base = words(rng, 100)
    pair = [" ".join(base), " ".join([*base[:-1], "other"])]
    ends = sorted(probminhash.key_of(t.split()) for t in pair)
    alone = [" ".join(words(rng, 100)) for _ in range(60)]
    keys = [probminhash.key_of(t.split()) for t in alone]
    assert min(keys) < ends[0] and ends[1] < max(keys)  # neither is one of the first hubs
    nodes = spark.createDataFrame([(k, [1]) for k in [*keys, *ends]], "key binary, bands array<long>")
    made = {bytes(r["key"]): bytes(r["label"]) for r in probminhash.links(docs(spark, list(enumerate(alone + pair))), nodes).collect()}
    assert made == {k: k for k in keys} | {k: ends[0] for k in ends}


def family(rng, n, planted):
    """Texts that share three quarters of their words with each other but too few for a link, and pairs that are links."""
    base = words(rng, 220)
    rows = []
    for _ in range(n):
        copy = base[:]
        for at in range(4, 220, 40):
            copy[at] = f"n{rng.randrange(10**9)}"
        rows.append(copy)
    for i in range(planted):
        near = rows[i][:]
        near[-1] = f"m{i}"
        rows.append(near)
    return [" ".join(r) for r in rows]


@pytest.mark.parametrize("block", [7, 1024])
def test_a_crowded_bucket_misses_no_link(spark, monkeypatch, block):
    """All texts in one bucket, without any rounds of hubs: blocks alone find the links among them."""
    monkeypatch.setattr(probminhash, "BLOCK", block)
    monkeypatch.setattr(probminhash, "COLUMNS", 64)
    rng = random.Random(6)
    texts = family(rng, 120, 20) + [" ".join(words(rng, 100)) for _ in range(20)]
    rng.shuffle(texts)
    sets = [np.repeat(*probminhash.shingles(t.split())) for t in texts]
    near = [probminhash.similarity(a, b) for i, a in enumerate(sets) for b in sets[:i]]
    assert sum(0.7 <= x < 0.8 for x in near) > 5000
    keys = [probminhash.key_of(t.split()) for t in texts]
    shingled = [(k, ((s >> np.uint64(32)).astype(np.uint32).view(np.int32)).tolist(), len(s)) for k, s in zip(keys, sets, strict=True)]
    frame = spark.createDataFrame(shingled, "key binary, shingles array<int>, length long")
    # One component of some size, so that it gets blocks of its own.
    labels = spark.createDataFrame([(k, keys[0] if i < 12 else k) for i, k in enumerate(keys)], "key binary, label binary")
    got = {bytes(r["key"]): bytes(r["label"]) for r in probminhash.completed(frame.selectExpr("1L as value", "key"), labels, frame, 0.8, len(keys)).collect()}
    want = brute_classes(list(enumerate(texts)))
    first = {want[i] for i in range(12)}
    want = [min(first) if x in first else x for x in want]
    assert len({*got.values()}) == len(set(want)) and all((got[keys[i]] == got[keys[0]]) == (want[i] == want[0]) for i in range(len(keys)))
    assert {frozenset(i for i, k in enumerate(keys) if got[k] == v) for v in got.values()} == {frozenset(i for i, x in enumerate(want) if x == v) for v in want}


def test_links_among_documents_by_brute_force(spark):
    """Of all links of 0.8 and more between documents of sf0.01, by every pair that shares a shingle, how many are within a class."""
    table = queries.table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r["doc_id"]: probminhash.words_of((r["text"] or "").encode()) for r in table.collect()}
    one = {probminhash.key_of(w): i for i, w in texts.items() if w}  # a document for each text
    sets = {i: np.repeat(*probminhash.shingles(texts[i])) for i in one.values()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for h in set(s.tolist()):
            holders[h].append(i)
    pairs = {(a, b) for held in holders.values() for n, b in enumerate(held) for a in held[:n]}
    near = [(a, b) for a, b in pairs if probminhash.similarity(sets[a], sets[b]) >= 0.8]
    class_of = {r["doc_id"]: r["class_id"] for r in probminhash.near_duplicates(table).collect()}
    found = sum(class_of[a] == class_of[b] for a, b in near)
    print(f"{found} of {len(near)} links")
    assert len(near) >= 5 and found >= 0.9 * len(near)
    # Nothing but links joins a class.
    label = {i: i for i in sets}
    for a, b in near:
        old, new = label[b], label[a]
        label = {i: new if x == old else x for i, x in label.items()} if old != new else label
    assert len({class_of[i] for i in sets}) == len(set(label.values()))


def test_planted_pairs_of_a_large_family_are_found(spark):
    rng = random.Random(9)
    rows = list(enumerate(family(rng, 1000, 30)))
    got = {r["doc_id"]: r["class_id"] for r in probminhash.near_duplicates(docs(spark, rows)).collect()}
    assert [got[i] for i, _ in rows] == [i if i < 1000 else i - 1000 for i, _ in rows]


def test_bounds_hold():
    rng = random.Random(5)
    sets = [np.array([rng.randint(0, 40) for _ in range(rng.randint(1, 60))], np.int32) for _ in range(60)]
    high = probminhash.bounds(sets[:30], sets[30:])
    for i, a in enumerate(sets[:30]):
        for j, b in enumerate(sets[30:]):
            assert probminhash.similarity(a, b) <= high[i, j] + 1e-5


def test_near_dedup_keeps_one_of_each_class(spark):
    rows = near_rows()
    frame = docs(spark, [*rows, rows[0], rows[0], (None, rows[1][1])])
    kept = probminhash.drop_near_duplicates(frame)
    assert kept.columns == frame.columns and kept.count() == len(set(brute_classes(rows)))
    assert probminhash.drop_near_duplicates(frame.limit(0)).count() == 0


def plain_similarity(a, b):
    p, q = Counter(a), Counter(b)
    p, q = ({k: v / sum(c.values()) for k, v in c.items()} for c in (p, q))
    return sum(1 / sum(max(p.get(e, 0) / p[d], q.get(e, 0) / q[d]) for e in p.keys() | q.keys()) for d in p.keys() & q.keys())


def test_probability_jaccard():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randint(0, 12) for _ in range(rng.randint(1, 30))] for _ in "ab")
        assert probminhash.similarity(np.array(a), np.array(b)) == pytest.approx(plain_similarity(a, b))
    assert probminhash.similarity(np.array([1, 1, 2]), np.array([2, 1, 1])) == pytest.approx(1)


def test_registers_estimate_it():
    rng = random.Random(3)
    a = [rng.randint(0, 300) for _ in range(900)]
    b = a[:700] + [rng.randint(300, 600) for _ in range(200)]
    weigh = lambda x: tuple(np.array(v) for v in zip(*sorted((hash(("h", k)) % (1 << 64), n) for k, n in Counter(x).items()), strict=True))
    sets = [(h.astype(np.uint64), n) for h, n in map(weigh, (a, b))]
    ra, rb = probminhash.sketch(sets)
    assert np.mean(ra == rb) == pytest.approx(plain_similarity(a, b), abs=0.12)


def test_components(spark):
    pairs = [(b"a", b"b"), (b"b", b"c"), (b"c", b"d"), (b"x", b"y"), (b"p", b"q"), (b"p", b"r"), (b"r", b"s")]
    got = {bytes(r["key"]): bytes(r["label"]) for r in probminhash.components(spark.createDataFrame(pairs, "a binary, b binary"), len(pairs)).collect()}
    assert got == {k: min(g) for g in ([b"a", b"b", b"c", b"d"], [b"x", b"y"], [b"p", b"q", b"r", b"s"]) for k in g}


def test_whole_table_queries(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in queries.table(spark, small, "documents").select("doc_id", "text").collect()]
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op4_suffix_arrays(spark, small).collect()]
    assert sorted(got) == sorted(cut_out(rows, 400))
    near = queries.op5_probminhash(spark, small).collect()
    assert len(near) == len(rows) and sum(r["kept"] for r in near) == len({r["class_id"] for r in near})
