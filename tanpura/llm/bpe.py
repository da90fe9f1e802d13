"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

Texts are cut into pieces by the tokenizer's pattern; each distinct piece is encoded once by the library and
kept in a bounded memo. Token strings are written in the vocabulary's 256 printable characters, one for each
byte; decoding maps the characters back to bytes. A character may be split over tokens: byte offsets are exact,
and the character offset of a token counts the characters that begin before it.

Defined cases: a null text counts as empty and gives no tokens; bytes that aren't UTF-8 are replaced by U+FFFD
before encoding; special tokens in a text are ordinary text; repeated rows give repeated rows; an empty table
gives an empty table; other columns pass through, and an input column named as an output is replaced.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tanpura.llm.common import in_arrow, mapped, quoted, small_batches

#: Pieces, and code points in them, that a worker's memo holds before it's emptied.
MEMO_PIECES, MEMO_CHARS = 200_000, 16 << 20


def byte_table() -> dict[int, str]:
    """The printable character that stands for each byte: itself where printable, else the next one from U+0100."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Slices:
    """Short runs of numbers kept in one flat array, to be strung together by their numbers."""

    def __init__(self, kind: type):
        self.flat, self.starts, self.lengths = np.empty(1 << 10, kind), np.empty(1 << 10, np.int64), np.empty(1 << 10, np.int64)
        self.n = self.used = 0

    def extend(self, runs: Sequence[Sequence[int]]) -> None:
        lengths = np.fromiter(map(len, runs), np.int64, len(runs))
        values = np.fromiter(itertools.chain.from_iterable(runs), self.flat.dtype, int(lengths.sum()))
        while self.used + len(values) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.n + len(runs) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.empty_like(x)]) for x in (self.starts, self.lengths))
        self.flat[self.used : self.used + len(values)] = values
        self.starts[self.n : self.n + len(runs)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[self.n : self.n + len(runs)] = lengths
        self.n, self.used = self.n + len(runs), self.used + len(values)

    def strung(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of these numbers one after the other, and where each ends, from 0 on."""
        lengths = self.lengths[numbers]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
        return self.flat[np.repeat(self.starts[numbers] - ends[:-1], lengths) + np.arange(ends[-1])], ends


class ByteBPE:
    """A tokenizer file with its pattern, its ids as bytes, and a memo of encoded pieces."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.pattern = regex.compile(pattern)
        to_byte = {c: b for b, c in byte_table().items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        added = {a["id"] for a in json.loads(self.tokenizer.to_str())["added_tokens"]}
        bytes_of = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            bytes_of[i] = token.encode() if i in added else bytes(to_byte[c] for c in token)
        self.ordinary = set(vocabulary.values()) - added
        self.bytes = Slices(np.uint8)
        self.bytes.extend(bytes_of)
        self.begun = np.array([sum(b & 0xC0 != 0x80 for b in x) for x in bytes_of])
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.memo_chars = 0
        self.tokens = Slices(np.int32)

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids one after the other, and where each text ends, from 0 on."""
        pieces = [self.pattern.findall(t) for t in texts]
        if len(self.memo) > MEMO_PIECES or self.memo_chars > MEMO_CHARS:
            self.forget()
        memo = self.memo
        if new := list(set().union(*pieces).difference(memo)):
            self.tokens.extend([x.ids for x in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)])
            memo.update(zip(new, range(len(memo), len(memo) + len(new)), strict=True))
            self.memo_chars += sum(map(len, new))
        counts = [0, *itertools.accumulate(map(len, pieces))]
        numbers = np.fromiter(map(memo.__getitem__, itertools.chain.from_iterable(pieces)), np.int64, counts[-1])
        ids, ends = self.tokens.strung(numbers)
        return ids, ends[counts]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of texts that are given as by encode, likewise."""
        raw, stops = self.bytes.strung(ids)
        return raw, stops[ends]

    def offsets(self, ids: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each text: where its tokens start in bytes, and how many characters begin before that; last, its ends."""
        made = []
        for per in (self.bytes.lengths[ids], self.begun[ids]):
            upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(per)])
            made.append([upto[a : b + 1] - upto[a] for a, b in itertools.pairwise(ends)])
        return made[0], made[1]


@functools.lru_cache(maxsize=2)
def loaded(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def default_vocabulary() -> tuple[str, str]:
    """File and pattern of the public byte-level vocabulary of 50k tokens."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def as_binary(raw: np.ndarray, stops: np.ndarray) -> pa.Array:
    """Bytes one after the other, and where each value ends, as an Arrow array."""
    return pa.Array.from_buffers(pa.binary(), len(stops) - 1, [None, pa.py_buffer(stops.astype(np.int32)), pa.py_buffer(raw)])


def encode(df: DataFrame, text: str = "text", vocabulary: tuple[str, str] | None = None, offsets: bool = False, decoded: bool = False) -> DataFrame:
    """df without its text, with token_ids array<int>; with offsets also byte_offsets and char_offsets array<int>.

    decoded adds what decode() would, in the same pass: one Python worker instead of two for each task.
    """
    path, pattern = vocabulary or default_vocabulary()
    outs = ["token_ids array<int>", *(["byte_offsets array<int>", "char_offsets array<int>"] if offsets else []), *(["decoded binary"] if decoded else [])]

    def make(values: list[bytes]) -> list[pa.Array]:
        bpe = loaded(path, pattern)
        ids, ends = bpe.encode([v.decode("utf-8", "replace") for v in values])
        made = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))]
        made += [pa.array(m, pa.list_(pa.int32())) for m in (bpe.offsets(ids, ends) if offsets else ())]
        return made + ([as_binary(*bpe.decode(ids, ends))] if decoded else [])

    return mapped(df, text, ", ".join(outs), make)


def decode(df: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """df with decoded binary: the bytes that token_ids stand for. decoded.cast("string") is the text."""
    path, pattern = vocabulary or default_vocabulary()
    small_batches(df.sparkSession)
    names = [c for c in df.columns if c.lower() != "decoded"]
    schema = StructType([*(df.schema[c] for c in names), StructField("decoded", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch in batches:
            lists = batch.column("token_ids")
            ids, ends = np.asarray(lists.flatten()), np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))]).astype(np.int64)
            yield pa.record_batch([*(batch.column(c) for c in names), as_binary(*bpe.decode(ids, ends))], names=schema.names)

    return in_arrow(df.select(*(F.col(quoted(c)) for c in names)), run, schema)


def digests(df: DataFrame) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 from token_ids and decoded."""
    joined = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return df.withColumns({"n_tokens": F.size("token_ids").cast("long"), "ids_sha256": F.sha2(joined, 256), "decoded_sha256": F.sha2("decoded", 256)})
