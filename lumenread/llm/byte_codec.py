"""Byte-level BPE encoding and decoding of whole texts with the tokenizers library over Arrow batches.

A rank file names byte strings and their ranks. Each byte is written as one printable character
(the byte alphabet), so the library's merges over characters are merges over bytes. The rank file
has no merges: every way to put a token together from two others is a merge with the token's rank,
the shorter first half first, so that of overlapping equals the leftmost goes first. A match of
the pattern that is a token as a whole is that token. Merges never cross a match.

No match of the pattern runs from a character that isn't white space into a space, so a text falls
into chunks at such places, which are encoded apart: a worker remembers frequent chunks, and the
unknown ones of an Arrow batch go to the library together. So no encoding is held of a long text.

Decoding writes ids as alphabet characters and these as bytes again. Tokens can end inside of a
character: bytes are joined before they are read as UTF-8, and offsets of such tokens cover the
whole character that they are part of.

Defined results: null text counts as empty and has no ids; its decoded text is empty. Rows are
independent, so repeated rows give repeated results. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Chunks that a worker remembers, each of at most LONGEST characters.
CACHE, LONGEST = 1_000_000, 64
#: Characters of unknown chunks that the library gets at once.
AT_ONCE = 1 << 20


def byte_alphabet() -> list[str]:
    """The character of each byte: printable Latin-1 as it is, the others from code point 256 on in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


ALPHABET = byte_alphabet()
BYTES = {ord(c): b for b, c in enumerate(ALPHABET)}


def spelled(token: bytes) -> str:
    return "".join(map(ALPHABET.__getitem__, token))


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, file))}


class ByteCodec:
    """Encoder and decoder by the ranks of one file and a pattern."""

    def __init__(self, rank_file: str, pattern: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are what runs side by side
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = read_ranks(rank_file)
        if len({len(t) for t in ranks if len(t) == 1}) != 1 or sum(len(t) == 1 for t in ranks) != 256:
            raise ValueError("a rank file needs every single byte")
        halves = sorted((rank, cut, token) for token, rank in ranks.items() for cut in range(1, len(token)) if token[:cut] in ranks and token[cut:] in ranks)
        self.model = Tokenizer(models.BPE(
            vocab={spelled(t): r for t, r in ranks.items()}, merges=[(spelled(t[:cut]), spelled(t[cut:])) for _, cut, t in halves], ignore_merges=True))
        self.model.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.tokens = {r: spelled(t) for t, r in ranks.items()}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_offsets(self, texts: list[str]) -> list[tuple[list[int], list[tuple[int, int]]]]:
        """Ids and the characters (first, after the last) that each covers."""
        return [(e.ids, e.offsets) for e in self.model.encode_batch(texts, add_special_tokens=False)]

    def bytes_of(self, ids: Iterable[int]) -> bytes:
        return "".join(map(self.tokens.__getitem__, ids)).translate(BYTES).encode("latin-1")

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; a character whose bytes aren't all there becomes the replacement character."""
        return self.bytes_of(ids).decode("utf-8", "replace")


def is_open(chunk: str) -> bool:
    """Whether a match may run from the end of a chunk into a space after it."""
    return not chunk or chunk[-1].isspace()


def chunks_of(text: str) -> list[str]:
    """A text cut before spaces that follow a character other than white space. A space in front of a chunk is part of it."""
    out: list[str] = []
    parts = text.split(" ")
    at = parts[0]
    for part in parts[1:]:
        if is_open(at):
            at = f"{at} {part}"
        else:
            out.append(at)
            at = f" {part}"
        # a part that follows an open one is joined to it, so runs of white space stay whole
    return [*out, at] if at else out


class Coder:
    """What a worker keeps from one batch and task to the next: the codec and frequent chunks' ids as little-endian bytes.

    A chunk of a space and a word is kept under the word. That a chunk's ids spell the chunk is seen
    when they are made, by decoding them.
    """

    def __init__(self, rank_file: str, pattern: str):
        self.codec = ByteCodec(rank_file, pattern)
        self.known: dict[str, bytes] = {}

    def made(self, chunks: list[str]) -> Iterator[tuple[str, bytes]]:
        """Chunks and their ids, some at a time in the library."""
        first = 0
        while first < len(chunks):
            last, size = first, 0
            while last < len(chunks) and size < AT_ONCE:
                size += len(chunks[last])
                last += 1
            group = chunks[first:last]
            encoded = self.codec.encode(group)
            if self.codec.bytes_of(i for ids in encoded for i in ids) != "".join(group).encode():
                raise ValueError("ids don't spell the text that they are made of")
            yield from zip(group, (np.array(ids, "<u4").tobytes() for ids in encoded), strict=True)
            first = last

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian bytes."""
        cut = [t.split(" ") for t in texts]
        new = set().union(*cut) - self.known.keys()
        joined = {word for word in new if is_open(word)}
        # texts with runs of white space that end in a space are cut in the general way, the others at every space
        odd = {i: chunks_of(texts[i]) for i, words in enumerate(cut) if not joined.isdisjoint(words)}
        rest = dict(self.made([*{*(words[0] for words in cut), *(c for chunks in odd.values() for c in chunks)}]))
        for chunk, ids in self.made([f" {word}" for word in new - joined]):
            into = self.known if len(self.known) < CACHE and len(chunk) <= LONGEST else rest
            into[chunk[1:] if into is self.known else chunk] = ids
        known = self.known
        for i, words in enumerate(cut):
            if i in odd:
                yield b"".join([rest[c] for c in odd[i]])
            else:
                yield rest[words[0]] + b"".join([known[w] if w in known else rest[f" {w}"] for w in words[1:]])


def coder(rank_file: str, pattern: str) -> Coder:
    return common.kept(("bytes", rank_file, pattern), lambda: Coder(rank_file, pattern))


def digests(rank_file: str, pattern: str):
    """A function for mapInArrow: n_tokens and the digests of the ids and of the decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = coder(rank_file, pattern)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for doc_ids, texts in common.documents_of(batches):
            counts, shas, plains = [], [], []
            for text, ids in zip(texts, worker.ids(texts), strict=True):
                counts.append(len(ids) // 4)
                shas.append(sha(ids))
                plains.append(sha(text.encode()))  # every chunk's ids were seen to decode to the chunk
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(shas, pa.string()), "decoded_sha256": pa.array(plains, pa.string())})

    return run


def encode_digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Per document the number of ids and the digests of the ids and of the bytes decoded from them."""
    common.bound_batches(docs.sparkSession)
    return common.keyed_texts(docs).mapInArrow(digests(rank_file, pattern), SCHEMA)


def encode_ids(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Per document its ids, the characters (start, end) that each covers, and the text decoded from them."""
    common.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = coder(rank_file, pattern).codec
        for doc_ids, texts in common.documents_of(batches):
            ids, starts, ends = [], [], []
            for text in texts:
                of_text: tuple[list, list, list] = ([], [], [])
                begin = 0
                for chunk in chunks_of(text):
                    numbers, spans = codec.encode_offsets([chunk])[0]
                    of_text[0].extend(numbers)
                    of_text[1].extend(begin + a for a, _ in spans)
                    of_text[2].extend(begin + b for _, b in spans)
                    begin += len(chunk)
                for column, values in zip((ids, starts, ends), of_text, strict=True):
                    column.append(values)
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.array(ids, kind), "starts": pa.array(starts, kind), "ends": pa.array(ends, kind),
                "decoded": pa.array([codec.decode(x) for x in ids], pa.string())})

    return common.keyed_texts(docs).mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>, decoded string")


def decode_ids(rows: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids (null: none), read as UTF-8; characters that aren't whole become U+FFFD."""
    common.bound_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = coder(rank_file, pattern).codec
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array([codec.decode(x or ()) for x in batch.column("ids").to_pylist()], pa.string())})

    return rows.selectExpr("cast(doc_id as long) doc_id", "cast(ids as array<int>) ids").mapInArrow(run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(common.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
