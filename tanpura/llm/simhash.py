"""Near-duplicates by SimHash (11): tiled exact comparison of fingerprints.

A fingerprint bit is set if it is set in over half the 64-bit hashes of a text's word shingles, repeats included. Equal
fingerprints are one node. Nodes are compared in tiles: a tile pair is one numpy exclusive-or of all its fingerprints and a
bit count, and is skipped if the two tiles' population counts lie further apart than the radius. No row is made for a pair: a
tile pair gives at most one row for each of its members, linked to the first of its component within the tile pair.

All tiles against all would be quadratic in the number of texts. Two fingerprints within the radius agree in one of
radius + 1 blocks of their bits (or in k of radius + k), so tiles are made within those that agree in the first bits of
such blocks; as many bits as bring the expected tile near TILE members. Whatever the number of bits, each pair within the
radius meets; it decides the amount of work only. A crowded block value has several tiles, cut by population count first.

Defined cases: null and blank texts have fingerprint 0, which is linked like any other; a null doc_id is a member like any
other (a component's id is its smallest doc_id that isn't null); repeated rows are in one component; an empty table gives
an empty result; texts are worked on as bytes, UTF-8 or not; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tanpura.llm.common import mapped, small_side, stored
from tanpura.llm.probminhash import components

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Fingerprints of a tile, about, and those compared at once with all of another tile.
TILE, ROWS = 2048, 256


def fingerprint(raw: bytes) -> int:
    """The SimHash of a text, as an unsigned number. bytes.lower and bytes.split take A-Z and \\x20\\x09-\\x0D only."""
    words = raw.lower().split()
    if not words:
        return 0
    whole = memoryview(b" ".join(words))
    size = min(SHINGLE, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashed = xxhash.xxh64_intdigest
    h = np.array([hashed(whole[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with fingerprint (a long, whose bits count) in place of the text."""
    return mapped(docs, text, "fingerprint bigint", lambda values: [pa.array(np.array([fingerprint(v) for v in values], np.uint64).view(np.int64))])


def plan(nodes: int, radius: int, tile: int) -> tuple[int, int, int]:
    """Blocks, how many of them agree, and how many first bits of each are taken.

    radius + 1 blocks of which 1 agrees while their bits suffice for tiles of so many nodes, else the fewest blocks of
    which more agree. None at all where one tile is enough.
    """
    bits = max(0, (nodes // tile).bit_length() - 1)
    agree = 1
    while agree < 4 and agree * (64 // (radius + agree)) < bits:
        agree += 1
    return radius + agree, agree, min(64 // (radius + agree), -(-bits // agree))


def block_keys(nodes: int, radius: int, tile: int) -> list[Column]:
    """For each choice of agreeing blocks a long made of the choice's number and those blocks' first bits."""
    blocks, agree, bits = plan(nodes, radius, tile)
    if not bits:
        return [F.lit(0).cast("long")]
    width = 64 // blocks
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), agree)):
        key = F.lit(number).cast("long")
        for b in chosen:
            key = F.shiftleft(key, bits).bitwiseOR(F.shiftrightunsigned("fingerprint", 64 - b * width - bits).bitwiseAND(F.lit((1 << bits) - 1)))
        keys.append(key)
    return keys


def pair_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The members of two tiles (or of one, if right is None) that are within the radius of another, and of each the first member of the component that such pairs make."""
    both, shift = (left, 0) if right is None else (np.concatenate([left, right]), len(left))
    other, found = both[shift:], []
    for at in range(0, len(left), ROWS):
        i, j = np.nonzero(np.bitwise_count(left[at : at + ROWS, None] ^ other[None, :]) <= radius)
        apart = i + at != j + shift
        found.append((i[apart] + at, j[apart] + shift))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    first = np.arange(len(both))
    while True:
        low, new = np.minimum(first[i], first[j]), first.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == first).all():
            break
        first = new
    moved = first != np.arange(len(both))
    return both[moved], both[first[moved]]


def compared(radius: int):
    """For mapInArrow: rows (left, right: arrays of fingerprints; right null for a tile with itself) to links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                left, right = (np.asarray(batch.column(c)[i].values).view(np.uint64) if batch.column(c)[i].is_valid else None for c in ("left", "right"))
                linked = pair_links(left, right, radius)
                if len(linked[0]):
                    yield pa.record_batch([pa.array(x.view(np.int64)) for x in linked], names=["a", "b"])

    return run


def tiles(nodes: DataFrame, count: int, radius: int, tile: int) -> DataFrame:
    """(key, number, low, high, members): each node in the tiles of its keys, with the tile's smallest and largest population count.

    A key's population counts are strung together until a tile is full; a population count with more nodes than a tile
    has several, by a hash.
    """
    ones = F.bit_count("fingerprint")
    dealt = nodes.select("fingerprint", ones.alias("ones"), F.explode(F.array(*block_keys(count, radius, tile))).alias("key"))
    rising = W.partitionBy("key").orderBy("ones").rowsBetween(W.unboundedPreceding, -1)
    counts = dealt.groupBy("key", "ones").agg(F.count("*").alias("n")).withColumn("pieces", F.ceil(F.col("n") / tile))
    before = lambda value: F.coalesce(F.sum(value).over(rising), F.lit(0))
    first = F.floor(before(F.col("n")) / tile) + before(F.col("pieces") - 1)  # pieces are numbered apart, but that the last may be shared
    placed = stored(counts.select("key", "ones", first.alias("first"), "pieces"), "simhash-places")
    number = F.col("first") + F.pmod(F.xxhash64("fingerprint"), F.col("pieces"))
    members = dealt.join(small_side(placed), ["key", "ones"]).select("key", number.alias("number"), "ones", "fingerprint")
    return members.groupBy("key", "number").agg(F.min("ones").alias("low"), F.max("ones").alias("high"), F.collect_list("fingerprint").alias("members"))


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): links that make the same components as all pairs of nodes (distinct fingerprints, written) within the radius."""
    made = stored(tiles(nodes, nodes.count(), radius, tile), "simhash-tiles")
    left = made.select("key", F.col("number").alias("n1"), F.col("low").alias("low1"), F.col("high").alias("high1"), F.col("members").alias("left"))
    right = made.select("key", F.col("number").alias("n2"), F.col("low").alias("low2"), F.col("high").alias("high2"), F.col("members").alias("right"))
    near = (F.col("n1") < F.col("n2")) & (F.col("low1") - F.col("high2") <= radius) & (F.col("low2") - F.col("high1") <= radius)
    pairs = left.join(right, "key").where(near).select("left", "right")
    alone = made.select(F.col("members").alias("left"), F.lit(None).cast("array<bigint>").alias("right"))
    return alone.union(pairs).mapInArrow(compared(radius), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    own = stored(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "simhashes")
    nodes = stored(own.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    found = stored(links(nodes, radius, tile), "simhash-links")
    many = found.count()
    if many:
        joined = small_side(components(found, many)).toDF("fingerprint", "label")
        nodes = nodes.join(joined, "fingerprint", "left").select("fingerprint", "least", F.coalesce("label", "fingerprint").alias("label"))
        ids = nodes.groupBy("label").agg(F.min("least").alias("component_id"))
        nodes = stored(nodes.join(ids, "label").select("fingerprint", "component_id"), "simhash-components")
    else:
        nodes = nodes.withColumnRenamed("least", "component_id")
    return own.join(small_side(nodes), "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
