"""Byte-level BPE against the library that reads rank files."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from helpers import cases, clashing, repeated
from hypothesis import given, settings
from hypothesis import strategies as st
from lumenread.llm import byte_codec

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=byte_codec.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def worker():
    return byte_codec.Coder(RANKS, PATTERN)


def numbers(worker, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in worker.ids(texts)]


def test_alphabet_is_one_to_one():
    assert len(set(byte_codec.ALPHABET)) == 256 and byte_codec.spelled(b"a b\n") == "aĠbĊ"


def test_ids_match_the_library(library, worker):
    rng = random.Random(1)
    strange = ["".join(rng.choice("abcdeirnst   \n▁'.,AÉé漢字\x00\t😀ﬁ0123\x1c\x85​　 'st") for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    periodic = [rng.choice(["a", "ab", "aab", "ÃÂ", "é", "=", "-", "0", "aaab", "ha"]) * rng.randint(1, 300) for _ in range(500)]
    spaces = [a + " " * i + b for i in range(6) for a in ("", "x", "x\n", "\t") for b in ("", "y", "\ny", "'s", "　z")]
    texts = [*strange, *periodic, *spaces, *[t or "" for _, t, *_ in cases()]]
    assert numbers(worker, texts) == [library.encode_ordinary(t) for t in texts]
    assert numbers(worker, texts[::-1]) == [library.encode_ordinary(t) for t in texts[::-1]]  # from what is remembered


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_any_text(library, worker, texts):
    assert numbers(worker, texts) == [library.encode_ordinary(t) for t in texts]
    assert all("".join(byte_codec.chunks_of(t)) == t for t in texts)


def test_code_points_of_each_kind(library, worker):
    texts = [f"x{chr(c)}y 1{chr(c)}2 !{chr(c)}? {chr(c)}{chr(c)}  {chr(c)}z  " for c in [*range(0x3100), *range(0x3100, 0x110000, 97)] if not 0xD800 <= c < 0xE000]
    assert numbers(worker, texts) == [library.encode_ordinary(t) for t in texts]


def test_split_characters(library, worker):
    text = "a 😀é漢"
    ids = library.encode_ordinary(text)
    assert any(library.decode_single_token_bytes(i).decode("utf-8", "ignore") == "" for i in ids)  # tokens that end inside a character
    assert worker.codec.decode(ids) == text
    assert worker.codec.decode(ids[:-1]).startswith("a 😀é") and worker.codec.decode(ids[:2]).endswith("�")


def test_chunks_forgotten_and_long(library, monkeypatch):
    monkeypatch.setattr(byte_codec, "CACHE", 3)
    monkeypatch.setattr(byte_codec, "AT_ONCE", 10)
    small = byte_codec.Coder(RANKS, PATTERN)
    texts = ["one two three four five six", "one two  three\n four five six" * 3, "w" * 5000 + " w " + "é" * 3000]
    assert numbers(small, texts) == [library.encode_ordinary(t) for t in texts] and len(small.known) == 3


@pytest.mark.parametrize("rows", [repeated(), []], ids=["repeated", "empty"])
def test_operator(spark, library, rows):
    sha = lambda data: hashlib.sha256(data).hexdigest()
    found = byte_codec.encode_digests(clashing(spark, rows), RANKS, PATTERN).collect()
    want = [(i, len(x := library.encode_ordinary(t or "")), sha(np.array(x, "<u4").tobytes()), sha((t or "").encode())) for i, t, *_ in rows]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_ids_offsets_and_way_back(spark, library):
    rows = repeated()
    encoded = byte_codec.encode_ids(clashing(spark, rows), RANKS, PATTERN)
    found = encoded.collect()
    assert sorted(((r["doc_id"], list(r["ids"]), r["decoded"]) for r in found), key=str) == sorted(((i, library.encode_ordinary(t or ""), t or "") for i, t, *_ in rows), key=str)
    for r in found:
        for i, first, last in zip(r["ids"], r["starts"], r["ends"], strict=True):
            token = library.decode_single_token_bytes(i)
            covered = r["decoded"][first:last].encode()
            assert token in covered  # the characters that it is part of
    back = byte_codec.decode_ids(encoded, RANKS, PATTERN).collect()
    assert sorted(map(tuple, back), key=str) == sorted(((i, t or "") for i, t, *_ in rows), key=str)
