"""Near-duplicates by ProbMinHash over weighted word shingles, banding and exact verification.

A text's shingles are its runs of SHINGLE lower-case words (fewer: all its words), weighted by how often they occur.
Each shingle sends out a Poisson process whose rate is its weight; an arrival falls on a random one of REGISTERS
registers, which keep the shingle that came first. Shingles stop once their next arrival is later than every register.
The share of equal registers estimates the probability Jaccard similarity.

Texts with equal words are one node. Nodes that share a band of registers meet in a bucket. In each bucket every member
is first held against two hubs, the members of smallest and largest key. Similarity is computed exactly from the
shingles; pairs of SIMILARITY or more are links. In further rounds, while its hubs bring links, a LARGE bucket takes as hubs
the CENTRAL members with most links (a text that others are copies of) and holds against them all members of other
components; and 2, 4, 8 ... members of components that gave no hub yet, which are held against the CENTRAL members with
most links of each other component. So large families become one component by stars, in proportion to their members.

At last buckets that still hold several components are compared whole, in blocks: a component of half a block or more
has blocks of its own, the others are dealt to blocks by component, and every two blocks that may hold members of
different components meet in one task. There all pairs are excluded by an exact bound at once, or verified, or already
in one component. The bound: where x is the weight of a's shingles that b has and y that of b's that a has, the
similarity is at most x y / (x + y - x y); x and y of all pairs of two blocks are two matrix products. No row is made
for a pair, and a large component isn't compared with itself. So each pair that shares a bucket is verified, excluded
or within one component.

Defined cases: null and blank texts have no shingles and are one class of their own; a null doc_id is a member like any
other (a class's id is its smallest doc_id that isn't null); repeated rows are in one class; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tanpura.llm.common import Rows, one_of_each, small_batches, small_side, stored, text_bytes

SHINGLE, SIMILARITY = 5, 0.8
#: Bands times rows: a pair of similarity 0.8 shares a band with probability 0.9999.
BANDS, BAND_ROWS = 30, 6
REGISTERS = BANDS * BAND_ROWS
#: Members with most links that a bucket takes as hubs in each further round.
CENTRAL = 2
#: Members of a block, shingles of a block (repeats included) beyond which it has fewer members, and columns of a matrix that is held at once.
BLOCK, BLOCK_SHINGLES, COLUMNS = 512, 1 << 21, 1 << 12
#: Members beyond which a bucket gets further hubs before it is compared in blocks.
LARGE = 8 * BLOCK
#: Shingles that are sketched at once, and words that a worker's memo holds.
GROUP_SHINGLES, MEMO_WORDS = 1 << 17, 200_000

_C = np.random.default_rng(7).integers(0, 1 << 63, 8, np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * _C[0]
    h ^= h >> np.uint64(29)
    h *= _C[1]
    return h ^ (h >> np.uint64(32))


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        return h


HASHES = WordHashes()


def words_of(raw: bytes) -> list[str]:
    return raw.decode("utf-8", "replace").lower().split()


def shingles(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in rising order, and their weights."""
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    w = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(w))
    h = np.full(len(w) - size + 1, np.uint64(size))
    for i in range(size):
        h = h * _C[2] + w[i : len(w) - size + 1 + i]
    return np.unique(mixed(h), return_counts=True)


def sketch(texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The registers of each text: hashes of the shingles that came first (0 where there are none)."""
    n = len(texts)
    first, won = np.full(n * REGISTERS, np.inf), np.zeros(n * REGISTERS, np.uint64)
    own = np.repeat(np.arange(n), [len(h) for h, _ in texts])
    h = np.concatenate([np.empty(0, np.uint64), *(h for h, _ in texts)])
    rate = np.concatenate([np.empty(0), *(w / max(1, w.sum()) for _, w in texts)])
    at, arrival = np.zeros(len(h)), 0
    while len(h):
        arrival += 1
        r = mixed(h + np.uint64(arrival * int(_C[3]) % (1 << 64)))
        at = at - np.log1p(-(r >> np.uint64(11)).astype(np.float64) / float(1 << 53)) / rate
        register = own * REGISTERS + (((mixed(r ^ _C[4]) >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(first, register, at)
        best = at == first[register]
        won[register[best]] = h[best]
        go_on = at < first.reshape(n, REGISTERS).max(axis=1)[own]
        h, rate, at, own = h[go_on], rate[go_on], at[go_on], own[go_on]
    return won.reshape(n, REGISTERS)


def band_hashes(registers: np.ndarray) -> np.ndarray:
    """One hash for each text and band."""
    parts = registers.reshape(len(registers), BANDS, BAND_ROWS)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * _C[5], (len(registers), BANDS))
    for i in range(BAND_ROWS):
        h = mixed(h * _C[6] + parts[:, :, i])
    return h.astype(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Probability Jaccard similarity of two multisets of shingle hashes.

    The sum over common d of 1 / (sum over all e of max(p_e / p_d, q_e / q_d)), by prefix sums in the order of q / p.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    p = np.bincount(place[: len(a)], minlength=len(both)) / len(a)
    q = np.bincount(place[len(a) :], minlength=len(both)) / len(b)
    ratio = np.full(len(both), np.inf)
    np.divide(q, p, out=ratio, where=p > 0)
    order = np.argsort(ratio, kind="stable")
    p, q, ratio = p[order], q[order], ratio[order]
    upto = np.searchsorted(ratio, ratio, "right")  # what has no larger ratio counts with p, the rest with q
    ps, qs = np.concatenate([[0], np.cumsum(p)]), np.concatenate([[0], np.cumsum(q)])
    common = (p > 0) & (q > 0)
    p, q, upto = p[common], q[common], upto[common]
    return float(np.sum(1 / (ps[upto] / p + (qs[-1] - qs[upto]) / q)))


SKETCH = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64()))])


def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, key of its words, band hashes; none without words)."""
    ids, keys, sets, held = [], [], [], 0

    def flush() -> pa.RecordBatch:
        bands = band_hashes(sketch(sets))
        rows = [b if len(s[0]) else [] for b, s in zip(bands, sets, strict=True)]
        made = pa.record_batch([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(rows, pa.list_(pa.int64()))], schema=SKETCH)
        ids.clear(), keys.clear(), sets.clear()
        return made

    for batch in batches:
        for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = words_of(raw)
            ids.append(doc_id)
            keys.append(key_of(words))
            sets.append(shingles(words))
            held += len(sets[-1][0])
            if held >= GROUP_SHINGLES or len(ids) >= 2000:
                yield flush()
                held = 0
    if ids:
        yield flush()


def key_of(words: list[str]) -> bytes:
    return xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "replace"))


SHINGLED = pa.schema([("key", pa.binary()), ("shingles", pa.list_(pa.int32()))])


def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (key, all shingles as 32-bit hashes, repeats included); texts that a task has seen once."""
    seen, out = set(), Rows(SHINGLED)
    for batch in batches:
        for raw in batch.column("text").to_pylist():
            words = words_of(raw)
            if (key := key_of(words)) not in seen and words:
                seen.add(key)
                h, n = shingles(words)
                yield from out.add((key, np.repeat((h >> np.uint64(32)).astype(np.uint32).view(np.int32), n)), 4 * int(n.sum()))
    yield from out.flush()


def compared(least: float):
    """For mapInArrow: pairs with their shingles to those of similarity least or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in ("sa", "sb")]
            each = [[np.asarray(c[i].values) for c in columns] for i in range(batch.num_rows)]
            made = pa.array([similarity(a, b) for a, b in each], pa.float64())
            rows = pa.record_batch([batch.column("a"), batch.column("b"), made], names=["a", "b", "similarity"])
            yield rows.filter(pa.array(np.asarray(made) >= least - 1e-9))

    return run


def components(links: DataFrame, rows: int) -> DataFrame:
    """(a, b) links, rows of them, to (key, label): the smallest key of each connected component, for every key with a link.

    Labels are lowered to the least of the neighbours' and then to their label's label, until none changes.
    """
    edges = stored(links.select("a", "b").union(links.select("b", "a")).distinct().toDF("key", "other"), "components-edges", 2 * rows)
    labels = stored(edges.groupBy("key").agg(F.least("key", F.min("other")).alias("label")), "components", 2 * rows)
    while True:
        known = small_side(labels)
        near = edges.join(known.toDF("other", "label"), "other").groupBy("key").agg(F.min("label").alias("near"))
        best = known.join(near, "key").select("key", "label", F.least("label", "near").alias("next"))
        jump = known.toDF("next", "far")
        lower = F.least("next", "far")
        moved = stored(best.join(jump, "next", "left").select("key", lower.alias("label"), (lower != F.col("label")).alias("changed")), "components", 2 * rows)
        labels = moved.select("key", "label")
        if moved.where("changed").isEmpty():
            return labels


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b) pairs to links of similarity least or more."""
    a = sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb"))
    whole = pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb")
    return whole.mapInArrow(compared(least), "a binary, b binary, similarity double")


def relabelled(labels: DataFrame, new: DataFrame, n: int, size: int) -> DataFrame:
    """labels (size rows) after new links (n rows), whose ends have different labels, join components, as a graph of labels."""
    known = small_side(labels)
    ends = new.join(known.toDF("a", "la"), "a").join(known.toDF("b", "lb"), "b").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    roots = small_side(components(ends, n)).toDF("label", "root")
    return stored(labels.join(roots, "label", "left").select("key", F.coalesce("root", "label").alias("label")), "labels", size)


def weights(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, shingle and weight (share of the row's shingles) of each distinct shingle of each row."""
    row = np.repeat(np.arange(len(sets), dtype=np.int64), [len(x) for x in sets])
    both, n = np.unique((row << 32) | np.concatenate(sets).view(np.uint32).astype(np.int64), return_counts=True)
    row = both >> 32
    return row, both & 0xFFFFFFFF, (n / np.array([len(x) for x in sets])[row]).astype(np.float32)


def bounds(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """An upper bound of the similarity of each pair of a left and a right multiset of shingles."""
    (lr, lc, lw), (rr, rc, rw) = weights(left), weights(right)
    common = np.intersect1d(lc, rc)  # others add nothing
    x, y = np.zeros((len(left), len(right)), np.float32), np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(common), COLUMNS):
        part = common[at : at + COLUMNS]
        dense = []
        for r, c, w, n in ((lr, lc, lw, len(left)), (rr, rc, rw, len(right))):
            place = np.minimum(np.searchsorted(part, c), len(part) - 1)
            own = part[place] == c
            m = np.zeros((n, len(part)), np.float32)
            m[r[own], place[own]] = w[own]
            dense += [m, (m > 0).astype(np.float32)]
        p, p_has, q, q_has = dense
        x += p @ q_has.T
        y += p_has @ q.T
    return np.divide(x * y, x + y - x * y, out=np.zeros_like(x), where=(x > 0) & (y > 0))


def block_links(sides: tuple[list, list], least: float) -> Iterator[tuple[bytes, bytes]]:
    """Links between members (key, label, shingles) of two blocks, or within the first if the second is empty, at most one for each two components that they join."""
    left, right = sides[0], sides[1] or sides[0]
    if not left:
        return
    high = bounds([m[2] for m in left], [m[2] for m in right])
    found = high >= least - 1e-4  # single precision
    root: dict[bytes, bytes] = {}

    def of(label: bytes) -> bytes:
        while (up := root.get(label, label)) != label:
            root[label] = root.get(up, up)
            label = up
        return label

    a, b = np.nonzero(np.triu(found, 1) if not sides[1] else found)
    for i in np.argsort(-high[a, b], kind="stable").tolist():
        (ka, la, sa), (kb, lb, sb) = left[a[i]], right[b[i]]
        la, lb = of(la), of(lb)
        if la != lb and similarity(sa, sb) >= least - 1e-9:
            root[lb] = la
            yield ka, kb


LINK = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def block_pairs(least: float):
    """For mapInArrow: rows (value, job, second, key, label, shingles), sorted by bucket and by the two blocks that meet, to links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, sides = Rows(LINK), None, ([], [])
        for batch in batches:
            shingles = batch.column("shingles")
            for i, (value, job, second, key, label) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("value", "job", "second", "key", "label")), strict=True)):
                if (value, job) != now:
                    if now is not None:
                        for link in block_links(sides, least):
                            yield from out.add(link)
                    now, sides = (value, job), ([], [])
                sides[second].append((key, label, np.array(shingles[i].values)))
        if now is not None:
            for link in block_links(sides, least):
                yield from out.add(link)
        yield from out.flush()

    return run


def completed(crowded: DataFrame, labels: DataFrame, sets: DataFrame, least: float, size: int) -> DataFrame:
    """labels (size rows) after every pair of a bucket of crowded (value, key) is verified, excluded exactly or within a component."""
    several = (F.count("*") > 3) & (F.min("label") < F.max("label"))  # of three, hubs have met all
    held = crowded.join(small_side(labels), "key")
    open_buckets = small_side(stored(held.groupBy("value").agg(several.alias("several")).where("several").select("value"), "open"))
    lengths = small_side(sets.select("key", "length"))
    members = stored(held.join(open_buckets, "value", "left_semi").join(lengths, "key"), "open-members")
    if members.isEmpty():
        return labels
    # A component's own blocks, by the key's hash; those of the others of its bucket, by the component's.
    sums = members.groupBy("value", "label").agg(F.count("*").alias("n"), F.sum("length").alias("length"))
    filled = F.greatest(F.col("n") / BLOCK, F.col("length") / BLOCK_SHINGLES)
    sums = stored(sums.withColumn("own", filled >= 0.5), "open-components")
    group = F.when(F.col("own"), F.col("label")).otherwise(F.lit(b""))
    groups = sums.groupBy("value", group.alias("group")).agg(F.sum("n").alias("n"), F.sum("length").alias("length")).withColumn("blocks", F.ceil(filled))
    groups = stored(groups.select("value", "group", "blocks"), "open-groups")
    number = F.pmod(F.xxhash64(F.when(F.col("group") == F.lit(b""), F.col("label")).otherwise(F.col("key"))), F.col("blocks"))
    own = sums.select("value", "label", group.alias("group"))
    placed = members.join(own, ["value", "label"]).join(groups, ["value", "group"]).select("value", "key", "label", "group", number.alias("number"))
    others = groups.select("value", F.col("group").alias("group2"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("number2"))
    met = placed.join(others, "value").where((F.col("group") != F.col("group2")) | (F.col("group") == F.lit(b"")))
    here, there = F.struct("group", "number"), F.struct(F.col("group2").alias("group"), F.col("number2").alias("number"))
    job = F.xxhash64(F.least(here, there), F.greatest(here, there))
    met = met.select("value", job.alias("job"), (here > there).cast("int").alias("second"), "key", "label")
    whole = met.join(sets, "key").repartition("value", "job").sortWithinPartitions("value", "job", "second")
    new = stored(whole.select("value", "job", "second", "key", "label", "shingles").mapInArrow(block_pairs(least), "a binary, b binary"), "links")
    n = new.count()
    return relabelled(labels, new, n, size) if n else labels


def links(docs: DataFrame, nodes: DataFrame, least: float = SIMILARITY) -> DataFrame | None:
    """(key, label) of the components that links between nodes (key, bands) make, for all nodes that share a band; None without any."""
    members = nodes.select("key", F.explode("bands").alias("value"))
    # Written, like other sides that are grouped, so that Spark can split a very large bucket in the join.
    ends = stored(members.groupBy("value").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count("*").alias("members")).where("first < last"), "buckets")
    # Members of buckets of two and more, each beside its bucket's hubs.
    crowded = stored(members.join(ends, "value"), "crowded")
    large = stored(ends.where(F.col("members") > LARGE).select("value", "first", "last"), "large")
    hubs = large.select("value", F.explode(F.array("first", "last")).alias("hub"))
    pairs = crowded.select("value", "key", F.explode(F.array("first", "last")).alias("hub")).where(F.col("key") != F.col("hub"))
    pairs = stored(pairs.select("value", F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b")), "pairs")
    if pairs.isEmpty():
        return None
    whole = crowded = crowded.select("value", "key")
    texts = docs.select("doc_id", text_bytes().alias("text")).mapInArrow(shingled, "key binary, shingles array<int>")
    sets = texts.join(crowded.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    sets = stored(sets.withColumn("length", F.size("shingles").cast("long")), "shingles")
    labels = keys = sets.select("key", F.col("key").alias("label"))
    size = keys.count()
    tried, bound = pairs.select("a", "b").distinct(), 1
    new = stored(verified(tried, sets, least), "links")
    found, n = new, new.count()
    if n:
        labels = relabelled(labels, new, n, size)
    label_of = lambda rows, key: rows.join(small_side(labels).withColumnRenamed("key", key), key)
    crowded = crowded.join(small_side(large).select("value"), "value", "left_semi")
    many = 0 if large.isEmpty() else crowded.count()
    pairs, hubs = pairs.join(small_side(large).select("value"), "value", "left_semi"), stored(hubs, "hubs")
    while n and many:
        # A bucket goes on while its hubs bring links and it has components that gave no hub yet.
        alive = small_side(stored(pairs.join(small_side(new), ["a", "b"], "left_semi").select("value").distinct(), "alive", many))
        known = stored(label_of(crowded.join(alive, "value", "left_semi"), "key").select("value", "key", "label"), "crowded", many)
        hubs = stored(hubs.join(alive, "value", "left_semi"), "hubs", many)
        used = small_side(stored(label_of(hubs, "hub").select("value", "label").distinct(), "used", many))
        degrees = stored(found.select("a").union(found.select("b")).toDF("key").groupBy("key").agg(F.count("*").alias("degree")), "degrees", size)
        some = F.xxhash64("key", F.lit(bound))
        rank = F.row_number().over(W.partitionBy("value", "label").orderBy(F.col("degree").desc_nulls_last(), some, "key"))
        known = stored(known.join(small_side(degrees), "key", "left").withColumn("rank", rank), "ranked", many)
        left = known.join(small_side(hubs).withColumnRenamed("hub", "key"), ["value", "key"], "left_anti").join(used.withColumn("used", F.lit(1)), ["value", "label"], "left")
        central = F.row_number().over(W.partitionBy("value").orderBy(F.col("degree").desc_nulls_last(), some, "key"))
        fresh = F.row_number().over(W.partitionBy("value").orderBy(F.col("used").asc_nulls_first(), some, "key"))
        places = left.withColumn("central", F.col("degree").isNotNull() & (central <= CENTRAL)).withColumn("fresh", F.col("used").isNull() & (fresh <= 2**bound))
        chosen = stored(places.where("central or fresh").select("value", F.col("key").alias("hub"), F.col("label").alias("hub_label"), "central"), "chosen", many)
        if chosen.isEmpty():
            break
        met = known.join(small_side(chosen), "value").where((F.col("label") != F.col("hub_label")) & (F.col("central") | (F.col("rank") <= CENTRAL)))
        pairs = stored(met.select("value", F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b")).join(tried, ["a", "b"], "left_anti"), "pairs")
        apart = pairs.select("a", "b").distinct()
        new = stored(verified(apart, sets, least), "links")
        crowded, hubs, tried, bound = known.select("value", "key"), hubs.union(chosen.select("value", "hub")), tried.union(apart), bound + 1
        found, n = found.union(new), new.count()
        if n:
            labels = relabelled(labels, new, n, size)
    return completed(whole, labels, sets, least, size)


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row for each row of docs: doc_id, class_id (the class's smallest doc_id), class_size, kept, key."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = stored(rows.select("doc_id", text_bytes().alias("text")).mapInArrow(sketched, "doc_id bigint, key binary, bands array<bigint>"), "sketches")
    nodes = own.where(F.size("bands") > 0).groupBy("key").agg(F.first("bands").alias("bands"))
    made = links(rows, nodes, least)
    ids = own.select("doc_id", "key")
    if made is not None:
        ids = ids.join(made, "key", "left").select("doc_id", "key", F.coalesce("label", "key").alias("label"))
    else:
        ids = ids.withColumn("label", F.col("key"))
    classes = ids.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("best"))
    kept = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("key") == F.col("best.key"))
    return ids.join(stored(classes, "classes"), "label").select("doc_id", "class_id", "class_size", kept.alias("kept"), "key")


def identity(doc_id: int | None, text: bytes) -> bytes:
    """What rows that may stand for each other share: id and words."""
    return (b"None|" if doc_id is None else b"%d|" % doc_id) + key_of(words_of(text))


def drop_near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stay, one of each class, with all their columns and their bytes, UTF-8 or not."""
    kept = near_duplicates(docs, least).where("kept")
    row = F.concat(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("None")), F.lit("|")).cast("binary"), F.col("key"))
    return one_of_each(docs, kept.select(row), identity)
