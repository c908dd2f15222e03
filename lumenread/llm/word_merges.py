"""Merges of many words at once, for a tokenizer file whose words end in a marked symbol.

The words are rows of a matrix of symbols. In each step every row merges its pair of least
rank (the leftmost, if there are several), exactly as merging a word alone would; pairs are
looked up in an open-addressing table. Only words that normalisation and splitting provably
leave whole are taken; the caller has the tokenizer itself encode all others.
"""

from __future__ import annotations

import json

import numpy as np
import regex

#: Letters that NFC leaves alone and whose lower case is one letter, then a run of marks.
PLAIN = regex.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,:;!?|*%&$#]*)")
NONE = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordMerges:
    def __init__(self, tokenizer_file: str):
        with open(tokenizer_file, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, self.end = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.final = np.array([vocab[c + self.end] for c in letters], np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.bits = 20
        slot = self.slot(keys)
        self.keys = np.full((1 << self.bits) + 64, np.uint64(2**64 - 1))
        self.ranks = np.full((1 << self.bits) + 64, NONE)
        self.probes = 1
        for key, at, rank in zip(keys.tolist(), slot.tolist(), range(len(keys)), strict=True):
            step = 0
            while self.ranks[at + step] != NONE:
                step += 1
            self.keys[at + step], self.ranks[at + step] = key, rank
            self.probes = max(self.probes, step + 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where there is no merge (symbols below 0 are none)."""
        keys = left.astype(np.uint64) << np.uint64(16) | right.astype(np.uint64) & np.uint64(0xFFFF)
        at = self.slot(keys)
        out = np.where(self.keys[at] == keys, self.ranks[at], NONE)
        for step in range(1, self.probes):
            lost = np.flatnonzero((out == NONE) & (self.ranks[at + step - 1] != NONE))
            if not len(lost):
                break
            hit = self.keys[at[lost] + step] == keys[lost]
            out[lost[hit]] = self.ranks[at[lost[hit]] + step]
        out[(left < 0) | (right < 0)] = NONE
        return out

    def ids(self, words: list[str]) -> list[bytes]:
        """Ids of lower-case words without white space, as little-endian unsigned 32-bit integers."""
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        out: list[bytes] = [b""] * len(raw)
        edges = [0, 6, 9, 12, 16, 24, 40, 1 << 40]
        for a, b in zip(edges, edges[1:], strict=False):
            rows = np.flatnonzero((sizes > a) & (sizes <= b))
            for at in range(0, len(rows), 20_000):
                part = rows[at: at + 20_000]
                self.merge([raw[i] for i in part.tolist()], sizes[part], part, out)
        return out

    def merge(self, raw: list[bytes], sizes: np.ndarray, rows: np.ndarray, out: list[bytes]) -> None:
        if not len(rows):
            return
        width = int(sizes.max())
        data = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in raw]), np.uint8).reshape(-1, width)
        symbols = self.inner[data]
        places = np.arange(width)
        symbols[np.arange(len(rows)), sizes - 1] = self.final[data[np.arange(len(rows)), sizes - 1]]
        symbols[places >= sizes[:, None]] = -1
        sizes = sizes.copy()
        ranks = np.full((len(rows), width), NONE)
        if width > 1:
            ranks[:, :-1] = self.rank(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(len(rows), -1)
        while len(rows):
            at = ranks.argmin(1)
            line = np.arange(len(rows))
            least = ranks[line, at]
            done = least == NONE
            if done.any():
                for i, n, ids in zip(rows[done].tolist(), sizes[done].tolist(), symbols[done].astype("<u4"), strict=True):
                    out[i] = ids[:n].tobytes()
                keep = ~done
                rows, sizes, symbols, ranks, at, least = rows[keep], sizes[keep], symbols[keep], ranks[keep], at[keep], least[keep]
                if not len(rows):
                    break
                line = np.arange(len(rows))
            # the merged symbol takes the place of the first; what follows moves up by one
            moved = places[None, :-1] > at[:, None]
            symbols[:, :-1] = np.where(moved, symbols[:, 1:], symbols[:, :-1])
            ranks[:, :-1] = np.where(moved, ranks[:, 1:], ranks[:, :-1])
            symbols[:, -1], ranks[:, -1] = -1, NONE
            symbols[line, at] = self.made[least]
            sizes -= 1
            after = np.minimum(at + 1, width - 1)
            ranks[line, at] = np.where(at + 1 < width, self.rank(symbols[line, at], symbols[line, after]), NONE)
            has = at > 0
            ranks[line[has], at[has] - 1] = self.rank(symbols[line[has], at[has] - 1], symbols[line[has], at[has]])
