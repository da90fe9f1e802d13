"""Byte-level BPE (operator 2) and token counts (8) against the tiktoken library and plain counting."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tanpura.llm import bpe, queries, tokenscan

TEXTS = ["", None, " ", "Hello world", "naïve café — ½ ١٢٣", "🤦🏼‍♂️ x", "<|endoftext|> is text", "a" * 3000, "don't  \r\n\t we'll\n\n", "\x00\x01�", "日本語のテキスト"]


@pytest.fixture(scope="module")
def reference():
    lines = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "kept", [9]) for i, t in enumerate(texts)], "doc_id long, text string, decoded string, token_ids array<int>")


def test_ids_and_offsets(spark, reference):
    rows = bpe.encode(docs(spark), offsets=True).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        text = TEXTS[r["doc_id"]] or ""
        ids = reference.encode_ordinary(text)
        assert r["token_ids"] == ids and r["decoded"] == "kept"
        parts = [reference.decode_single_token_bytes(i) for i in ids]
        assert r["byte_offsets"] == [0, *np.cumsum([len(p) for p in parts]).tolist()]
        raw = text.encode()
        assert r["char_offsets"] == [sum(b & 0xC0 != 0x80 for b in raw[:at]) for at in r["byte_offsets"]]


def test_round_trip_with_split_characters(spark):
    for r in bpe.decode(bpe.encode(docs(spark))).collect():
        assert bytes(r["decoded"]).decode() == (TEXTS[r["doc_id"]] or "")


def test_decoding_in_the_same_pass(spark):
    rows = bpe.encode(docs(spark), offsets=True, decoded=True)
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in rows.collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


def test_nulls_in_ids_decode_to_nothing(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [64])], "doc_id long, token_ids array<int>")
    assert {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(rows).collect()} == {1: b"", 2: b"", 3: b"a"}


def test_query_over_a_whole_table(spark, small, reference):
    texts = {r["doc_id"]: r["text"] or "" for r in queries.table(spark, small, "documents").collect()}
    got = queries.op2_bpe(spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = reference.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_empty_table(spark):
    assert bpe.decode(bpe.encode(docs(spark).limit(0))).count() == 0
    assert tokenscan.document_counts(docs(spark).limit(0)).count() == 0


@pytest.mark.parametrize("block", [1, 2, 7, 1 << 16])
def test_token_counts_over_any_blocks(spark, reference, block):
    got = {r["doc_id"]: r for r in tokenscan.document_counts(docs(spark).coalesce(1), block_tokens=block).collect()}
    at = 0
    for i, text in enumerate(TEXTS):
        n = len(reference.encode_ordinary(text or ""))
        assert (got[i]["ordinal"], got[i]["start"], got[i]["n_tokens"], got[i]["complete"]) == (i, at, n, True)
        at += n + 1


def test_flat_files_without_labels(spark, tmp_path):
    sep = tokenscan.SEPARATOR
    for name, ids in {"a": [1, 2, sep, sep, 3, 4, 5], "b": [sep], "c": [7] * 100 + [sep], "d": []}.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
    rows = tokenscan.token_counts(spark, f"file://{tmp_path}", block_tokens=3).collect()
    got = sorted((r["file"][-1], r["ordinal"], r["start"], r["n_tokens"], r["complete"]) for r in rows)
    assert got == [("a", 0, 0, 2, True), ("a", 1, 3, 0, True), ("a", 2, 4, 3, False), ("b", 0, 0, 0, True), ("c", 0, 0, 100, True)]


def test_long_file_scans_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(tokenscan, "SUPER", 2)
    texts = ["word " * n for n in (0, 5, 1, 30, 0, 0, 12, 3)]
    got = tokenscan.document_counts(docs(spark, texts).coalesce(1), block_tokens=4).collect()
    one = tokenscan.document_counts(docs(spark, texts).coalesce(1)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, one)) and len(got) == len(texts)


def test_files_are_flat_ids(spark, tmp_path, reference):
    tokenscan.flat_files(docs(spark).coalesce(1), f"file://{tmp_path}/x", file_documents=4)
    files = sorted((tmp_path / "x/tokens").glob("part-*"))
    assert len(files) == 3
    ids = [np.frombuffer(f.read_bytes(), "<u2").tolist() for f in files]
    want = [reference.encode_ordinary(t or "") + [tokenscan.SEPARATOR] for t in TEXTS]
    assert ids == [sum(want[i : i + 4], []) for i in range(0, len(want), 4)]


def test_odd_files_and_vocabularies_are_refused(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"\x01\x02\x03")
    with pytest.raises(Exception, match="16-bit"):
        tokenscan.token_counts(spark, f"file://{tmp_path}").collect()
    for separator in (7, 1 << 16):
        with pytest.raises(ValueError, match="16-bit"):
            tokenscan.flat_files(docs(spark), f"file://{tmp_path}/y", separator=separator)


def test_token_count_query_agrees_with_encoding(spark, small):
    counts = {r["doc_id"]: r["n_tokens"] for r in queries.op8_token_counts(spark, small).collect()}
    assert counts == {r["doc_id"]: r["n_tokens"] for r in queries.op2_bpe(spark, small).collect()}
