"""Token counts that follow edits, over a segment tree of pre-tokens per document.

A text is split into pre-tokens by the tokenizer's pattern; its tokens are the sum over them.
Leaves hold a pre-token's characters and tokens, in blocks, and a binary tree holds the blocks'
sums. An edit re-splits the text from the pre-token CONTEXT characters before it until a
boundary falls together with an old one behind it, re-encodes only these pre-tokens and updates
the sums above their blocks. The pattern looks neither back nor more than CONTEXT characters
ahead, so everything outside is as a whole new count would have it.

Defined results: null text counts as empty and has no tokens. Positions of edits count
characters of the text as the edits before left it, and are clipped to it. Null edits are none.
Rows are independent. Other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLOCK = 64
CONTEXT = 4
CACHE = 600_000
SCHEMA = "doc_id long, n_chars long, n_pretokens long, n_tokens long, edited_chars long, edited_tokens long, n_edits long, reencoded long"
EDITS = "array<struct<start:long,end:long,text:string>>"


class Counter:
    """Splits text into pre-tokens and counts the tokens of each; frequent ones are remembered."""

    def __init__(self, rank_file: str, pattern: str):
        import tiktoken

        with open(rank_file, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known = common.Filled(lambda piece: len(self.encoding.encode_ordinary(piece)), CACHE)

    def leaves(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        n = len(pieces)
        return np.fromiter(map(len, pieces), np.int64, n), np.fromiter(map(self.known.__getitem__, pieces), np.int64, n)


class TokenTree:
    """Characters and tokens of one text's pre-tokens, with sums over ranges of them."""

    def __init__(self, text: str, counter: Counter, leaves: tuple[np.ndarray, np.ndarray] | None = None):
        self.text, self.counter = text, counter
        self.build(*(counter.leaves(counter.pattern.findall(text)) if leaves is None else leaves))

    def build(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.blocks = [(chars[a: a + BLOCK], tokens[a: a + BLOCK]) for a in range(0, max(1, len(chars)), BLOCK)]
        self.size = 1 << (len(self.blocks) - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        if len(chars):
            starts = np.arange(0, len(chars), BLOCK)
            self.sums[self.size: self.size + len(starts)] = np.stack([np.add.reduceat(chars, starts), np.add.reduceat(tokens, starts)], 1)
        at = self.size
        while at > 1:
            self.sums[at // 2: at] = self.sums[at: 2 * at: 2] + self.sums[at + 1: 2 * at: 2]
            at //= 2

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def n_leaves(self) -> int:
        return sum(len(chars) for chars, _ in self.blocks)

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([c for c, _ in self.blocks]), np.concatenate([t for _, t in self.blocks])

    def find(self, place: int) -> tuple[int, int, int]:
        """Block and index of the leaf that holds a character, and the leaf's first character."""
        at, first = 1, 0
        while at < self.size:
            at *= 2
            if place >= first + self.sums[at, 0]:
                first += int(self.sums[at, 0])
                at += 1
        block = min(at - self.size, len(self.blocks) - 1)
        if at - self.size != block:  # behind the last character
            first = int(self.sums[1, 0] - self.sums[self.size + block, 0])
        chars = self.blocks[block][0]
        ends = np.cumsum(chars)
        index = int(np.searchsorted(ends, place - first, side="right"))
        return block, index, first + (int(ends[index - 1]) if index else 0)

    def put(self, block: int, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.blocks[block] = chars, tokens
        at = self.size + block
        self.sums[at] = chars.sum(), tokens.sum()
        while at > 1:
            at //= 2
            self.sums[at] = self.sums[2 * at] + self.sums[2 * at + 1]

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace characters [start, end) by new; the number of pre-tokens re-encoded."""
        start = min(max(0, start), len(self.text))
        end = min(max(start, end), len(self.text))
        block, index, first = self.find(max(0, start - CONTEXT))
        shift = len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        # old boundaries from the first leaf in question on
        last, leaf, old = block, index, first
        pieces: list[str] = []
        for found in self.counter.pattern.finditer(self.text, pos=first):
            pieces.append(found[0])
            goal = found.end() - shift
            if found.end() < start + len(new) or goal < end:
                continue
            while old < goal and last < len(self.blocks):
                chars = self.blocks[last][0]
                if leaf >= len(chars):
                    last, leaf = last + 1, 0
                    continue
                old += int(chars[leaf])
                leaf += 1
            if old == goal:
                break
        else:  # no boundary fell together before the end
            last, leaf = len(self.blocks) - 1, len(self.blocks[-1][0])
        if last == len(self.blocks):
            last, leaf = last - 1, len(self.blocks[-1][0])
        chars, tokens = self.counter.leaves(pieces)
        head, tail = self.blocks[block], self.blocks[last]
        chars = np.concatenate([head[0][:index], chars, tail[0][leaf:]])
        tokens = np.concatenate([head[1][:index], tokens, tail[1][leaf:]])
        if len(chars) > 8 * BLOCK:
            rest = self.blocks
            rest[block: last + 1] = [(chars, tokens)]
            self.build(*self.leaves())
        else:
            none = np.zeros(0, np.int64)
            for k in range(block + 1, last + 1):
                self.put(k, none, none)
            self.put(block, chars, tokens)
        return len(pieces)


def counter_of(rank_file: str, pattern: str) -> Counter:
    return common.kept(("counter", rank_file, pattern), lambda: Counter(rank_file, pattern))


def follow(docs: DataFrame, edits: Column, rank_file: str, pattern: str, stored: bool = False) -> DataFrame:
    """Counts of each text before and after its edits (an array of start, end and text).

    With stored, docs are rows of trees(): no text is split or encoded but for what its edits touch.
    """
    common.bound_batches(docs.sparkSession)
    leaves = ["chars", "tokens"] if stored else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(rank_file, pattern)
        for batch in batches:
            rows = []
            kept = zip(*(batch.column(c) for c in leaves), strict=True) if leaves else repeat(None)
            for doc_id, text, steps, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "edits")), kept, strict=False):
                tree = TokenTree(text, counter, None if own is None else tuple(x.values.to_numpy().astype(np.int64) for x in own))
                before = len(text), tree.n_leaves, tree.n_tokens
                again = [tree.edit(s["start"], s["end"], s["text"]) for s in steps or ()]
                rows.append((doc_id, *before, len(tree.text), tree.n_tokens, len(again), sum(again)))
            columns = zip(*rows, strict=True) if rows else [()] * 8
            names = [part.split(" ")[0] for part in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    rows = docs.select("doc_id", common.text_or_empty().alias("text"), edits.cast(EDITS).alias("edits"), *leaves)
    return rows.mapInArrow(run, SCHEMA)


def trees(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Each text with its tree's leaves, to be kept: characters and tokens of its pre-tokens. follow() reads them back."""
    common.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(rank_file, pattern)
        for ids, texts in common.documents_of(batches):
            leaves = [counter.leaves(counter.pattern.findall(t)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(texts, pa.string()), *(pa.array([x[k].astype(np.int32) for x in leaves], pa.list_(pa.int32())) for k in (0, 1))],
                names=["doc_id", "text", "chars", "tokens"])

    return common.keyed_texts(docs).mapInArrow(run, "doc_id long, text string, chars array<int>, tokens array<int>")


def three_edits() -> Column:
    """A replacement in the first half, an insertion in the middle and a deletion at the end of each text."""
    text = common.text_or_empty()
    n = F.length(text)
    quarter, half = F.floor(n / 4), F.floor(n / 2)
    step = lambda a, b, new: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"), new.alias("text"))
    return F.array(
        step(quarter, F.least(quarter + 16, n), F.reverse(F.substring(text, quarter.cast("int") + 1, F.lit(16)))),
        step(half, half, F.substring(text, F.lit(1), F.lit(24))),
        step(F.greatest(n + F.least(n, F.lit(24)) - 8, F.lit(0)), n + 24, F.lit("")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return follow(common.read(spark, sf_dir, "documents"), three_edits(), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
