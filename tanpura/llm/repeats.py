"""Removing repeated passages: bytes covered by a string of LENGTH bytes that also starts anywhere else.

Each window of LENGTH bytes has an anchor: the leftmost of its ANCHOR-byte substrings whose hash is smallest. Equal
windows have equal anchors at the same place, so windows need only be compared where anchors are equal. A run of
windows with one anchor is an occurrence: its anchor's hash (key) and the hash of all its bytes (context).

1. Occurrences whose key is nowhere else hold no repeated window and are left behind. A task first counts the keys
   that it sees itself; of those it sends one on to be counted and knows the others to be repeated, so no key brings
   more rows together than there are tasks.
2. A context that occurs twice is repeated in all its windows, and is folded to one copy. A context that is its key's
   only one is decided so.
3. The contexts of other keys are dealt by key into shards. A shard's contexts, with the anchor (equal within a key)
   written as one mark and the key's number, are strung together, and their suffix array is made by induced sorting.
   A window is repeated if its suffix shares the window's length with a neighbour in order, by the permuted common
   prefixes.
   A key with more than HOT contexts, which would fill a shard, is split: windows that reach far to the right of the
   anchor get an anchor that is longer to the right by half of what is free, the others one that is longer to the left.
   Their contexts, cut to what these windows cover, fold again, and what is left under each longer anchor goes into
   shards, or is split further until the anchor is the window.
4. Each document's repeated windows are gathered and the bytes that they cover are cut out.

Beside the bytes removed, passages are counted: maximal runs of at least PASSAGE words that also stand in another
document (another doc_id), whatever their length in bytes and the white space between words. They have anchors and
contexts of words in the same way; windows of contexts that differ are told apart by their hash.

Equality of anchors and contexts is by 64-bit hash under equal keys.

Defined cases: null text counts as empty; texts under LENGTH bytes lose nothing; overlaps and repeats within a text
count; equal rows repeat each other; null doc_ids are told apart by their text; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tanpura.llm.common import Rows, groups, small_batches, stored, text_bytes
from tanpura.llm.induced import permuted_prefixes, powers, substring, suffix_array

LENGTH, ANCHOR = 400, 256
SPAN = LENGTH - ANCHOR + 1
#: Words of a passage, and of the anchor in it.
PASSAGE, ANCHOR_WORDS = 51, 26
#: Window starts that are looked at together, symbols of a shard, contexts of a key that a shard takes, rows that a task counts together.
SEGMENT, SHARD, HOT, COUNTED = 1 << 20, 1 << 19, 1000, 1 << 19
PLACE_BITS, _MASK = 24, (1 << 64) - 1

_TABLE = np.random.default_rng(11).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def power(base: int, n: int) -> np.ndarray:
    """powers(base, n), kept for the next call."""
    if len(_powers.get(base, ())) < n:
        _powers[base] = powers(base, 1 << (n - 1).bit_length())
    return _powers[base][:n]


def sums_of(raw: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[raw] * power(_BASE, len(raw)), dtype=np.uint64)])


def hashes(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return substring(sums, start, stop, power(_INVERSE, len(sums)))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width values in a row."""
    n, rows = len(values), -(-len(values) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs_of(values: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and stop of the runs of equal values where ok."""
    edge = np.ones(len(values), bool)
    edge[1:] = (values[1:] != values[:-1]) | (ok[1:] != ok[:-1])
    first = np.flatnonzero(edge)
    stop = np.append(first[1:], len(values))
    return first[ok[first]], stop[ok[first]]


def anchors(h: np.ndarray, span: int) -> np.ndarray:
    """The place of the leftmost smallest hash of each span ones."""
    low = np.uint64((1 << PLACE_BITS) - 1)
    return (sliding_least((h & ~low) | np.arange(len(h), dtype=np.uint64), span) & low).astype(np.int64)


def joined(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 6


def occurrences(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of some texts: the text's number, first window's start in it, bytes before the anchor, windows, key and context of each occurrence."""
    found = []
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    for at in range(0, len(flat) - LENGTH + 1, SEGMENT):
        part = flat[at : at + SEGMENT + LENGTH - 1]
        sums = sums_of(part)
        n = len(part) - ANCHOR + 1
        h = hashes(sums, np.arange(n), np.arange(ANCHOR, ANCHOR + n))
        anchor = anchors(h, SPAN)
        end_of = np.repeat(ends - at, np.diff(np.clip(ends - at, 0, len(anchor)), prepend=0))  # of each window's text
        first, stop = runs_of(anchor, np.arange(LENGTH, LENGTH + len(anchor)) <= end_of)
        left, windows = anchor[first] - first, stop - first
        context = hashes(sums, first, stop - 1 + LENGTH) ^ ((left << 10) + windows).astype(np.uint64) * np.uint64(_BASE)
        text = np.searchsorted(ends, first + at, "right")
        found.append((text, first + at - (ends - sizes)[text], left, windows, h[anchor[first]].view(np.int64), context.view(np.int64)))
    return joined(found)


_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True


def word_places(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts and stops."""
    edge = np.flatnonzero(np.diff(_SPACE[flat], prepend=True, append=True))
    return edge[::2], edge[1::2]


def word_hashes(flat: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    made = [np.empty(0, np.uint64)]
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(stops, starts[at] + SEGMENT, "right")))
        made.append(hashes(sums_of(flat[starts[at] : stops[to - 1]]), starts[at:to] - starts[at], stops[at:to] - starts[at]))
        at = to
    return np.concatenate(made)


def word_sums(h: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power(_BASE, len(h)), dtype=np.uint64)])


#: Told apart from keys of bytes.
_WORDS = np.uint64(0x5851F42D4C957F2D)


def word_occurrences(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """As occurrences, in words."""
    found = []
    flat = np.frombuffer(b" ".join(texts), np.uint8)
    begin = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    starts, stops = word_places(flat)
    first_word = np.searchsorted(starts, begin)
    end_of = np.append(first_word[1:], len(starts))
    h_of = word_hashes(flat, starts, stops)
    for at in range(0, len(h_of) - PASSAGE + 1, SEGMENT):
        sums = word_sums(h_of[at : at + SEGMENT + PASSAGE - 1])
        n = len(sums) - ANCHOR_WORDS
        h = hashes(sums, np.arange(n), np.arange(ANCHOR_WORDS, ANCHOR_WORDS + n))
        anchor = anchors(h, PASSAGE - ANCHOR_WORDS + 1)
        places = np.arange(at, at + len(anchor))
        text = np.searchsorted(first_word, places, "right") - 1
        first, stop = runs_of(anchor, places + PASSAGE <= end_of[text])
        left, windows = anchor[first] - first, stop - first
        context = hashes(sums, first, stop - 1 + PASSAGE) ^ ((left << 10) + windows).astype(np.uint64) * np.uint64(_BASE)
        own = text[first]
        found.append((own, first + at - first_word[own], left, windows, (h[anchor[first]] ^ _WORDS).view(np.int64), context.view(np.int64)))
    return joined(found)


def identity(doc_id: int | None, raw: bytes) -> tuple[int, int]:
    """A document's id, or for null a hash of its text, and a further hash of its text."""
    h = xxhash.xxh3_128_intdigest(raw)
    return (h >> 64) - (1 << 63) if doc_id is None else doc_id, (h & 0xFFFFFFFF) - (1 << 31)


#: at packs the first window's start, the bytes (or words) before the anchor and the number of windows.
OCCURRENCE = pa.schema([("dealt", pa.int64()), ("sure", pa.bool_()), ("words", pa.bool_()), ("id", pa.int64()), ("h", pa.int32()), ("at", pa.int64()), ("key", pa.int64()), ("context", pa.int64())])
OCCURRENCE_SQL = "dealt bigint, sure boolean, words boolean, id bigint, h int, at bigint, key bigint, context bigint"


def packed(first: np.ndarray, left: np.ndarray, windows: np.ndarray) -> np.ndarray:
    return (first << 20) | (left << 10) | windows


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to occurrences. dealt is what they are to be counted by; sure: the key is known to be repeated."""
    held: list[tuple] = []
    n = 0

    def flush() -> pa.RecordBatch:
        words, ids, hs, at, key, context = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(key), bool)
        again[order[1:]] = same
        sure = again.copy()
        sure[order[:-1]] |= same
        # All but the first of a key are dealt anywhere.
        anywhere = (np.arange(len(key)).astype(np.uint64) * np.uint64(_BASE)).view(np.int64) ^ at
        held.clear()
        return pa.record_batch([pa.array(x) for x in (np.where(again, anywhere, key), sure, words, ids, hs, at, key, context)], schema=OCCURRENCE)

    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        for start, stop in groups(texts):
            part = texts[start:stop]
            own = [identity(i, t) for i, t in zip(ids[start:stop], part, strict=True)]
            own = np.array([x[0] for x in own], np.int64), np.array([x[1] for x in own], np.int32)
            for words, found in ((False, occurrences(part)), (True, word_occurrences(part))):
                text, first, left, windows, key, context = found
                if len(key):
                    held.append((np.full(len(key), words), own[0][text], own[1][text], packed(first, left, windows), key, context))
                    n += len(key)
            if n >= COUNTED:
                yield flush()
                n = 0
    if held:
        yield flush()


def cut(row: tuple[int, int, int]) -> tuple[int, int, int]:
    """first, left and windows of a packed place."""
    return row >> 20, (row >> 10) & 1023, row & 1023


PIECE = pa.schema([("words", pa.bool_()), ("key", pa.int64()), ("context", pa.int64()), ("times", pa.int64()), ("low_id", pa.int64()), ("high_id", pa.int64()), ("anchor", pa.int32()), ("left", pa.int32()), ("windows", pa.int32()), ("bytes", pa.binary())])
PIECE_SQL = "words boolean, key bigint, context bigint, times bigint, low_id bigint, high_id bigint, anchor int, left int, windows int, bytes binary"


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with the contexts that are to be read from them: the contexts' bytes."""
    out = Rows(PIECE)
    for batch in batches:
        for raw, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            places = None
            for x in wanted:
                first, left, windows = cut(x["at"])
                if x["words"]:
                    places = places or word_places(np.frombuffer(raw, np.uint8))
                    own = raw[places[0][first] : places[1][first + windows + PASSAGE - 2]]
                else:
                    own = raw[first : first + windows - 1 + LENGTH]
                anchor = ANCHOR_WORDS if x["words"] else ANCHOR
                yield from out.add((x["words"], x["key"], x["context"], x["times"], x["low_id"], x["high_id"], anchor, left, windows, own), len(own))
    yield from out.flush()


RUNS = pa.schema([("key", pa.int64()), ("context", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])
RUNS_SQL = "key bigint, context bigint, low int, high int"
END, MARK, DIGITS = 257, 258, 2


def shard_runs(shard: list[tuple]) -> Iterator[tuple]:
    """(key, context, low, high): runs of repeated windows in the contexts of a shard that occur once; all with an anchor of one length."""
    anchor = shard[0][5]
    numbers: dict[int, int] = {}
    parts, starts, at = [], [], 0
    for key, _, _, left, _, _, raw in shard:
        number = numbers.setdefault(key, len(numbers))
        data = np.frombuffer(raw, np.uint8).astype(np.int64) + 1
        mark = [MARK, number // 256 % 256 + 1, number % 256 + 1]
        parts += [data[:left], np.array(mark), data[left + anchor :], np.array([END])]
        starts.append(at)
        at += len(data) - anchor + 2 + DIGITS
    s = np.append(np.concatenate(parts), 0)
    sa = suffix_array(s, MARK + 1)
    # A window's symbols: its bytes outside the anchor, the mark and the key's number.
    size = LENGTH - anchor + 1 + DIGITS
    with_before = permuted_prefixes(s, sa, size)
    with_after = np.zeros_like(with_before)
    with_after[sa[:-1]] = with_before[sa[1:]]
    shared = np.maximum(with_before, with_after) >= size
    for (key, context, times, _, windows, _, _), start in zip(shard, starts, strict=True):
        if times == 1:
            own = np.concatenate([[False], shared[start : start + windows], [False]])
            edges = np.flatnonzero(own[1:] != own[:-1])
            for low, high in edges.reshape(-1, 2).tolist():
                yield key, context, low, high


def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by key to their runs of repeated windows, shard after shard."""
    out, shard, held, keys = Rows(RUNS), [], 0, 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "context", "times", "left", "windows", "anchor", "bytes")), strict=True):
            if shard and row[0] != shard[-1][0]:
                keys += 1
                if held >= SHARD or keys >= 256**DIGITS - 1 or row[5] != shard[-1][5]:
                    for run in shard_runs(shard):
                        yield from out.add(run)
                    shard, held, keys = [], 0, 0
            shard.append(row)
            held += len(row[-1])
    if shard:
        for run in shard_runs(shard):
            yield from out.add(run)
    yield from out.flush()


WINDOW = pa.schema([("key", pa.int64()), ("context", pa.int64()), ("low_id", pa.int64()), ("high_id", pa.int64()), ("low", pa.int32()), ("window", pa.int64())])
WINDOW_SQL = "key bigint, context bigint, low_id bigint, high_id bigint, low int, window bigint"


def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of words to a row for each of their windows, with the hash of its words."""
    for batch in batches:
        raws = batch.column("bytes").to_pylist()
        flat = np.frombuffer(b" ".join(raws), np.uint8)
        starts, stops = word_places(flat)
        first = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raws[:-1])]))
        windows = np.asarray(batch.column("windows"))
        at = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        place = np.repeat(first, windows) + at
        made = hashes(word_sums(word_hashes(flat, starts, stops)), place, place + PASSAGE)
        known = [pa.array(np.repeat(np.asarray(batch.column(c)), windows)) for c in ("key", "context", "low_id", "high_id")]
        yield pa.record_batch([*known, pa.array(at.astype(np.int32)), pa.array(made.view(np.int64))], schema=WINDOW)


PART = pa.schema([("old_key", pa.int64()), ("old_context", pa.int64()), ("offset", pa.int32()), *(f for f in PIECE if f.name != "words")])
PART_SQL = "old_key bigint, old_context bigint, offset int, key bigint, context bigint, times bigint, low_id bigint, high_id bigint, anchor int, left int, windows int, bytes binary"


def longer_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of hot keys to their parts under longer anchors: windows with half of the free bytes to the right of the anchor, and the others."""
    out = Rows(PART)
    for batch in batches:
        for key, context, times, low_id, high_id, anchor, left, windows, raw in zip(*(batch.column(c).to_pylist() for c in PIECE.names[1:]), strict=True):
            free = LENGTH - anchor
            more = -(-free // 2)
            # Window w has w + free - left bytes to the right of the anchor.
            turn = min(max(left + more - free, 0), windows)
            for side, low, high, at in ((b"L", 0, turn, left - more), (b"R", turn, windows, left)):
                if low < high:
                    part = raw[low : high - 1 + LENGTH]
                    new = xxhash.xxh3_64_intdigest(side + raw[at : at + anchor + more], key & _MASK) - (1 << 63)
                    own = xxhash.xxh3_64_intdigest(b"%d %d " % (at - low, high - low) + part) - (1 << 63)
                    yield from out.add((key, context, low, new, own, times, low_id, high_id, anchor + more, at - low, high - low, part), len(part))
    yield from out.flush()


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("n_passages", pa.int64()), ("spans", pa.list_(pa.int64())), ("passages", pa.list_(pa.int64())), ("kept", pa.binary())])
RESULT_SQL = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passages bigint, spans array<bigint>, passages array<bigint>, kept binary"


COVER_BITS = 41


def merged(covers: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of what the covers (words, low, high) of some rows cover: 2 * row + words, low and high, in order."""
    lengths = np.asarray(covers.value_lengths().fill_null(0))
    flat = covers.flatten()
    group = 2 * np.repeat(np.arange(len(lengths)), lengths) + flat.field("words").to_numpy(zero_copy_only=False)
    low, high = ((group << COVER_BITS) | np.asarray(flat.field(c)) for c in ("low", "high"))
    if not len(low):
        return (np.empty(0, np.int64),) * 3
    order = np.argsort(low, kind="stable")
    low, upto = low[order], np.maximum.accumulate(high[order])
    first = np.flatnonzero(np.append(True, low[1:] > upto[:-1]))
    low, high = low[first], upto[np.append(first[1:], len(upto)) - 1]
    mask = (1 << COVER_BITS) - 1
    return low >> COVER_BITS, low & mask, high & mask


def removed(with_text: bool):
    """For mapInArrow: documents with the bytes that are covered to the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(RESULT)
        for batch in batches:
            group, low, high = merged(batch.column("covers"))
            pairs = np.stack([low, high], axis=1).ravel()
            cut = 2 * np.searchsorted(group, np.arange(2 * batch.num_rows + 1))
            for i, (doc_id, raw) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                spans, words = pairs[cut[2 * i] : cut[2 * i + 1]].tolist(), pairs[cut[2 * i + 1] : cut[2 * i + 2]]
                kept = raw
                if spans:
                    edges = [0, *spans, len(raw)]
                    kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                passages = None
                if with_text:
                    starts, stops = word_places(np.frombuffer(raw, np.uint8)) if len(words) else (words, words)
                    passages = np.stack([starts[words[::2]], stops[words[1::2] - 1]], axis=1).ravel().tolist()
                row = (doc_id, len(raw), len(raw) - len(kept), len(spans) // 2, hashlib.sha256(kept).hexdigest(), len(words) // 2, spans, passages, kept if with_text else None)
                yield from out.add(row, (len(kept) if with_text else 0) + 8 * len(spans))
        yield from out.flush()

    return run


def identified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) with id and h."""
    for batch in batches:
        made = [identity(i, t) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)]
        yield pa.record_batch([pa.array([x[0] for x in made], pa.int64()), pa.array([x[1] for x in made], pa.int32()), batch.column("doc_id"), batch.column("text")], names=["id", "h", "doc_id", "text"])


def decided(contexts: DataFrame) -> DataFrame:
    """(key, context, times, ...) folded contexts to (key, context, low, high): those that occur twice, in all their windows."""
    return contexts.where("times > 1").select("key", "context", F.lit(0).alias("low"), F.col("windows").alias("high"))


def differing(read: DataFrame) -> DataFrame:
    """Contexts of bytes (PIECE) under keys that have several, to (key, context, low, high): repeated windows of those that occur once.

    By suffix arrays of shards; keys with more than HOT contexts under longer anchors.
    """
    # Written, so that Spark can split a key with very many contexts in the join.
    hot_keys = stored(read.groupBy("key", "anchor").agg(F.count("*").alias("n")).where((F.col("n") > HOT) & (F.col("anchor") < LENGTH)).select("key"), "repeats-hot")
    shards = 2 * int(read.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if hot_keys.isEmpty():
        return sharded_runs(read, shards)
    hot = read.join(hot_keys, "key", "left_semi")
    parts = stored(hot.select(*PIECE.names).mapInArrow(longer_anchors, PART_SQL), "repeats-parts")
    sums = parts.groupBy("key", "context").agg(F.sum("times").alias("times"), F.min("low_id").alias("low_id"), F.max("high_id").alias("high_id"), F.min(F.struct("anchor", "left", "windows", "bytes")).alias("x"))
    folded = stored(sums.select(F.lit(False).alias("words"), "key", "context", "times", "low_id", "high_id", "x.*"), "repeats-folded")
    several = stored(folded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "repeats-several")
    found = decided(folded).unionByName(differing(stored(folded.join(several, "key", "left_semi"), "repeats-contexts-bytes")))
    back = parts.join(stored(found, "repeats-found"), ["key", "context"])
    back = back.where("times = 1").select(F.col("old_key").alias("key"), F.col("old_context").alias("context"), (F.col("low") + F.col("offset")).alias("low"), (F.col("high") + F.col("offset")).alias("high"))
    return sharded_runs(read.join(hot_keys, "key", "left_anti"), shards).unionByName(back)


def sharded_runs(read: DataFrame, shards: int) -> DataFrame:
    return read.where(F.col("anchor") < LENGTH).repartition(shards, "key").sortWithinPartitions("anchor", "key", "context").mapInArrow(sharded, RUNS_SQL)


def shared_windows(read: DataFrame) -> DataFrame:
    """Contexts of words (PIECE) to (key, context, low, high): windows that another document has too."""
    windows = stored(read.mapInArrow(windows_of, WINDOW_SQL), "passage-windows")
    both = stored(windows.groupBy("key", "window").agg(F.min("low_id").alias("a"), F.max("high_id").alias("b")).where("a < b").select("key", "window"), "passage-shared")
    return windows.join(both, ["key", "window"], "left_semi").select("key", "context", "low", (F.col("low") + 1).alias("high"))


def repeated(rows: DataFrame) -> DataFrame:
    """(doc_id, text) to (id, h, words, low, high): bytes covered by repeated windows of one occurrence, or words of passages."""
    all_ = rows.mapInArrow(counted, OCCURRENCE_SQL)
    together = W.partitionBy("dealt")
    found = all_.withColumn("n", F.count("*").over(together)).where(F.col("sure") | (F.col("n") > 1)).select("words", "id", "h", "at", "key", "context")
    found = stored(found, "repeats-occurrences")
    sums = found.groupBy("words", "key", "context").agg(F.count("*").alias("times"), F.min("id").alias("low_id"), F.max("id").alias("high_id"), F.min(F.struct("id", "h", "at")).alias("one"))
    contexts = stored(sums.withColumn("windows", F.col("one.at").bitwiseAND(F.lit(1023)).cast("int")), "repeats-contexts")
    # Written, so that Spark can split a key with very many contexts in the join.
    keys = stored(contexts.groupBy("key").agg(F.count("*").alias("contexts")).where("contexts > 1").select("key"), "repeats-keys")
    several = contexts.join(keys, "key", "left_semi")
    entry = F.struct("one.at", "words", "key", "context", "times", "low_id", "high_id")
    wanted = several.select("one.id", "one.h", entry.alias("w")).groupBy("id", "h").agg(F.collect_list("w").alias("wanted"))
    texts = rows.mapInArrow(identified, "id bigint, h int, doc_id bigint, text binary")
    # Rows of equal doc_id and text would give a context's bytes more than once.
    read = stored(texts.join(wanted, ["id", "h"]).select("text", "wanted").mapInArrow(pieces, PIECE_SQL).dropDuplicates(["key", "context"]), "repeats-contexts-bytes")
    whole = decided(contexts.where("not words")).unionByName(contexts.where("words and low_id < high_id").select("key", "context", F.lit(0).alias("low"), F.col("windows").alias("high")))
    runs = stored(whole.unionByName(differing(read.where("not words"))).unionByName(shared_windows(read.where("words"))), "repeats-runs")
    first, size = F.shiftright("at", 20), F.when(F.col("words"), PASSAGE).otherwise(LENGTH)
    return found.join(runs, ["key", "context"]).select("id", "h", "words", (first + F.col("low")).alias("low"), (first + F.col("high") - 1 + size).alias("high"))


def remove_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, spans (start and stop in bytes of each removed run), and with the text passages (likewise) and kept (the remaining bytes), else null."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    covers = repeated(rows).groupBy("id", "h").agg(F.collect_list(F.struct("words", "low", "high")).alias("covers"))
    texts = rows.mapInArrow(identified, "id bigint, h int, doc_id bigint, text binary")
    return texts.join(covers, ["id", "h"], "left").select("doc_id", "text", "covers").mapInArrow(removed(with_text), RESULT_SQL)
