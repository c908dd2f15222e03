"""SentencePiece merge-type encoding by backtracking, and decoding, for whole texts.

An encoding by merges is the one sequence of pieces in which every two neighbours are
compatible: merging their joint characters anew gives exactly these two pieces. So a text
is read from the left; at each place the longest piece (an Aho-Corasick automaton finds all
pieces) that is compatible with the one before is taken. Where none fits, the last piece
is given up, its end is marked in a bitfield of failed positions and a shorter one is tried.

No piece holds a space mark after another character, so a text falls into chunks (a run of
marks and the characters up to the next mark) that are encoded independently of each other.
Pieces of only marks share one score; a run of marks is therefore merged directly.

Defined results: null text counts as empty and has no ids; its decoded text is empty.
Rows are independent, so repeated rows give repeated results. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

MARK = "▁"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Words that a worker remembers.
CACHE = 800_000


class PieceCodec:
    """Encoder and decoder over the pieces and scores of one model file."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.byte_of: dict[int, int] = {}
        self.silent = set()
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.byte_of[i] = int(piece[3:5], 16)
            elif model.is_control(i) or model.is_unknown(i):
                self.silent.add(i)
            else:
                self.ids[piece] = i
                self.score[piece] = model.get_score(i)
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a space mark after another character: chunks would depend on each other")
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if piece.strip(MARK):
                self.automaton.add_word(piece, (len(piece), piece))
        self.automaton.make_automaton()
        self._fits: dict[tuple[str, str], bool] = {}
        self._alone: dict[str, bool] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces of a text by merging: best score first, then leftmost. Single characters stay as they are."""
        parts: list[str | None] = list(text)
        after = [*range(1, len(parts)), -1]
        before = [-1, *range(len(parts) - 1)] if parts else []
        queue: list[tuple[float, int, str, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (made := parts[i] + parts[j]) in self.score:
                heapq.heappush(queue, (-self.score[made], i, made, j))

        for i in range(len(parts)):
            offer(i)
        while queue:
            _, i, made, j = heapq.heappop(queue)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != made:
                continue
            parts[i], parts[j] = made, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [p for p in parts if p is not None]

    def reachable(self, piece: str) -> bool:
        """Whether merging a piece's own characters gives the piece."""
        if (known := self._alone.get(piece)) is None:
            known = self._alone[piece] = len(piece) == 1 or self.merged(piece) == [piece]
        return known

    def fits(self, left: str, right: str) -> bool:
        """Whether merging the joint characters anew gives these two pieces."""
        if (known := self._fits.get((left, right))) is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            known = self._fits[left, right] = self.merged(left + right) == [left, right]
        return known

    def backtrack(self, text: str) -> list[str]:
        """The pieces of a text all of whose characters are pieces."""
        size = len(text)
        found: list[list[tuple[int, str]]] = [[] for _ in range(size)]
        for end, (length, piece) in self.automaton.iter(text):
            found[end - length + 1].append((length, piece))  # ends ascend, so the longest is last
        if text[0] == MARK and (not found[0] or found[0][0][0] > 1):
            found[0].insert(0, (1, MARK))
        failed = 0
        taken: list[str] = []
        tries: list[int] = []
        at, k = 0, len(found[0]) - 1
        while at < size:
            options = found[at]
            while k >= 0:
                length, piece = options[k]
                if not failed >> (at + length) & 1 and (self.fits(taken[-1], piece) if taken else self.reachable(piece)):
                    break
                k -= 1
            if k >= 0:
                taken.append(piece)
                tries.append(k)
                at += length
                k = len(found[at]) - 1 if at < size else 0
            else:
                if not taken:
                    raise ValueError(f"no encoding of {text!r}")
                failed |= 1 << at
                at -= len(taken.pop())
                k = tries.pop() - 1
        return taken

    def chunk(self, chunk: str) -> list[int]:
        """Ids of one chunk: some marks, then characters that aren't marks."""
        marks = len(chunk) - len(chunk.lstrip(MARK))
        body = chunk[marks - 1:] if 0 < marks < len(chunk) else chunk[marks:]
        out: list[str] = []
        run = ""
        for c in body:
            if c in self.ids:
                run += c
            else:
                out += self.backtrack(run) if run else []
                out.append(c)
                run = ""
        out += self.backtrack(run) if run else []
        if 0 < marks < len(chunk):
            # the last mark may have joined the first piece; if not, it belongs to the run
            lone = out[0] == MARK
            out = self.merged(MARK * (marks - (not lone))) + out[lone:]
        elif marks:
            out = self.merged(MARK * marks)
        ids: list[int] = []
        for piece in out:
            i = self.ids.get(piece)
            ids += [i] if i is not None else [self.byte_ids[b] for b in piece.encode()]
        return ids

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The chunks of a text after the mark that each text gets in front."""
        if not text:
            return []
        words = text.replace(MARK, " ").split(" ")
        if "" not in words:
            return [MARK + w for w in words]
        out, marks = [], 0
        for word in words:
            marks += 1
            if word:
                out.append(MARK * marks + word)
                marks = 0
        return [*out, MARK * marks] if marks else out

    def encode(self, text: str) -> list[int]:
        return [i for chunk in self.chunks(text) for i in self.chunk(chunk)]

    def spelled(self, ids: list[int]) -> str:
        """The characters of ids, marks as spaces; runs of byte pieces are read as UTF-8."""
        out, raw = [], bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            if i not in self.silent:
                out.append(self.pieces[i].replace(MARK, " "))
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.spelled(ids)
        return text[1:] if text.startswith(" ") else text


class Digester:
    """What a worker keeps from one batch and task to the next: the codec and the ids of frequent words.

    A word is remembered by its ids alone: that its ids spell it was seen when they were made.
    Words of which that isn't so are in odd, and texts with such words are decoded id by id.
    """

    def __init__(self, model_file: str):
        self.codec, self.odd = PieceCodec(model_file), set()
        self.known = common.Filled(self.make, CACHE)

    def make(self, word: str) -> str:
        ids = self.codec.chunk(MARK + word)
        if self.codec.spelled(ids) != " " + word:
            self.odd.add(word)
        return ",".join(map(str, ids))

    def row(self, text: str) -> tuple[int, str, str]:
        text = text.replace(MARK, " ")
        words = text.split(" ")
        if not text or "" in words or not self.odd.isdisjoint(words):
            ids = self.codec.encode(text)
            return len(ids), _sha(",".join(map(str, ids))), _sha(self.codec.decode(ids))
        numbers = ",".join(map(self.known.__getitem__, words))
        plain = text if self.odd.isdisjoint(words) else self.codec.decode([int(i) for i in numbers.split(",")])
        return numbers.count(",") + 1, _sha(numbers), _sha(plain)


def digester(model_file: str) -> Digester:
    return common.kept(("pieces", model_file), lambda: Digester(model_file))


def digests(model_file: str):
    """A function for mapInArrow: n_tokens and the digests of ids and of decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = digester(model_file).row
        for ids, texts in common.documents_of(batches):
            counts, shas, plains = zip(*map(row, texts), strict=True) if texts else ((), (), ())
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(counts, pa.int64()),
                "ids_sha256": pa.array(shas, pa.string()), "decoded_sha256": pa.array(plains, pa.string())})

    return run


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode_digests(docs: DataFrame, model_file: str) -> DataFrame:
    """Per document the number of ids, the digest of the ids and of the text decoded from them."""
    common.bound_batches(docs.sparkSession)
    return common.keyed_texts(docs).mapInArrow(digests(model_file), SCHEMA)


def encode_ids(docs: DataFrame, model_file: str) -> DataFrame:
    """Per document its ids and the text decoded from them."""
    common.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(model_file)
        for ids, texts in common.documents_of(batches):
            encoded = [codec.encode(t) for t in texts]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, pa.int64()), "ids": pa.array(encoded, pa.list_(pa.int32())),
                "decoded": pa.array([codec.decode(x) for x in encoded], pa.string())})

    return common.keyed_texts(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(common.read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
