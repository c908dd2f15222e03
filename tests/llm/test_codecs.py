import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import cases, clashing, repeated
from lumenread.llm import edit_counts, packing, piece_codec
from lumenread.llm.word_merges import PLAIN, WordMerges

PIECES, WORDS, RANKS = (public_tokenizers.path(n) for n in ("piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def strange(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdeirnst   \n▁'.,AÉé漢字\x00\t😀ﬁ0123") for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_pieces_match_the_library(library):
    codec = piece_codec.PieceCodec(PIECES)
    digester = piece_codec.Digester(PIECES)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    texts = [*strange(3000, 1), *[" " * k + "the" + " " * j + "x" for k in range(18) for j in range(18)], *[t or "" for _, t, *_ in cases()]]
    for text in texts:
        want = library.encode(text)
        assert codec.encode(text) == want and codec.decode(want) == library.decode(want)
        assert digester.row(text) == (len(want), sha(",".join(map(str, want))), sha(library.decode(want)))


@pytest.mark.parametrize("rows", [repeated(), []], ids=["repeated", "empty"])
def test_piece_operator(spark, library, rows):
    found = piece_codec.encode_ids(clashing(spark, rows), PIECES).collect()
    want = [(i, library.encode(t or "")) for i, t, *_ in rows]
    assert sorted(((r["doc_id"], list(r["ids"]), r["decoded"]) for r in found), key=str) == sorted(((i, x, library.decode(x)) for i, x in want), key=str)
    assert piece_codec.encode_digests(clashing(spark, rows), PIECES).count() == len(rows)


def test_merges_match_the_library():
    from tokenizers import Tokenizer

    tokenizer, merges = Tokenizer.from_file(WORDS), WordMerges(WORDS)
    rng = random.Random(2)
    words = list({"".join(rng.choice("abcdeéßñilnorstuz") for _ in range(rng.randint(1, 45))) for _ in range(3000)}) + ["a" * k for k in range(1, 30)]
    assert all(PLAIN.fullmatch(w) for w in words)
    assert [np.frombuffer(x, "<u4").tolist() for x in merges.ids(words)] == [tokenizer.encode(w, add_special_tokens=False).ids for w in words]


@pytest.mark.parametrize("rows", [repeated(), []], ids=["repeated", "empty"])
def test_packing(spark, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    capacity = 256
    found = packing.pack_documents(clashing(spark, rows), WORDS, capacity).collect()
    want = []
    for i, t, *_ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i, k, a, len(ids[a:a + capacity]), zlib.crc32(np.array(ids[a:a + capacity], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), capacity))]
    assert sorted([tuple(r)[:5] for r in found], key=str) == sorted(want, key=str)
    ends = {}
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(x <= capacity for x in ends.values())


def best_fit_decreasing(sizes, capacity):
    """One piece after the other: what is left in each sequence."""
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = min((g for g in gaps if g >= s), default=None)
        if fit is None:
            gaps.append(capacity - s)
        else:
            gaps[gaps.index(fit)] -= s
    return gaps


def laid(places):
    """Pieces (offset, length) by sequence."""
    used = {}
    for length, a, b, first, each, offset in places:
        for r in range(b - a):
            used.setdefault(first + r // each, []).append((offset + r % each * length, length))
    return used


def gapless(used, capacity):
    return all(sum(n for _, n in x) == max(o + n for o, n in x) <= capacity and len({o for o, _ in x}) == len(x) for x in used.values())


def test_sweep_is_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(200):
        sizes = [rng.randint(1, 60) for _ in range(rng.randint(1, 80))]
        places, left, gaps = packing.sweep([(s, 0, sizes.count(s)) for s in set(sizes)], [], 60, 0)
        used = laid(places)
        assert sum(map(len, used.values())) == len(sizes) and gapless(used, 60) and not left
        assert len(used) == len(best_fit_decreasing(sizes, 60)) and sum(g * (b - a) for g, a, b in gaps) == 60 * len(used) - sum(sizes)
    assert packing.sweep([], []) == ([], [], [])
    # without new sequences what finds no gap is left
    assert packing.sweep([(5, 0, 3), (9, 0, 1)], [(6, 7, 9)], 60) == ([(5, 0, 2, 7, 1, 54)], [(9, 0, 1), (5, 2, 3)], [(1, 7, 9)])


@pytest.mark.parametrize("seed", range(4))
def test_supersteps_pack_as_well_as_best_fit_decreasing(spark, seed):
    rng = random.Random(seed)
    draw = [lambda: rng.randint(1, 100), lambda: int(100 * rng.random() ** 3) + 1, lambda: rng.choice([34, 51, 26, 17]), lambda: rng.randint(20, 48)][seed]
    sizes = [draw() for _ in range(3000)]
    counts = spark.createDataFrame([(s, sizes.count(s)) for s in set(sizes)], "length long, n long")
    used = laid([(r["size"], r["first"], r["end"], r["first_sequence"], r["each"], r["offset"]) for r in packing.places_of(counts, 100).collect()])
    assert sorted(n for x in used.values() for _, n in x) == sorted(sizes) and gapless(used, 100)
    assert len(used) <= 1.01 * len(best_fit_decreasing(sizes, 100)) + 1


def test_lengths_are_ranked_in_shares(spark, monkeypatch):
    """A common length is ranked in several groups, and every piece has a place of its own."""
    monkeypatch.setattr(packing, "RANKED", 10)
    rows = [(i, 0, 0, 7 if i % 3 else 4096, i) for i in range(500)]
    found = [(r["sequence_id"], r["offset"], r["length"]) for r in packing.pack(spark.createDataFrame(rows, packing.PIECES)).collect()]
    assert len(found) == len(set(found)) == 500 and len({s for s, _, _ in found}) == 168


def test_trees_follow_edits():
    counter = edit_counts.Counter(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(3)
    for _ in range(300):
        tree = edit_counts.TokenTree("".join(rng.choice("abc de'srtvmll  \n\t.,é漢12") for _ in range(rng.choice([0, 3, 40, 3000]))), counter)
        for _ in range(5):
            a = rng.randint(0, len(tree.text) + 1)
            tree.edit(a, a + rng.randint(0, rng.choice([2, 30, 800])), "".join(rng.choice("abc de'srtvmll  \n\t.,é漢12") for _ in range(rng.choice([0, 1, 5, 60, 900]))))
            chars, tokens = tree.leaves()
            assert tree.n_tokens == tokens.sum() == len(counter.encoding.encode_ordinary(tree.text))
            assert chars.tolist() == [len(p) for p in counter.pattern.findall(tree.text)] and tree.sums[1, 0] == len(tree.text)


@pytest.mark.parametrize("rows", [repeated(), []], ids=["repeated", "empty"])
def test_edit_counts(spark, rows):
    counter = edit_counts.Counter(RANKS, public_tokenizers.PATTERN)
    found = edit_counts.follow(clashing(spark, rows), edit_counts.three_edits(), RANKS, public_tokenizers.PATTERN).collect()
    want = []
    for i, t, *_ in rows:
        text = new = t or ""
        n = len(text)
        new = new[: n // 4] + new[n // 4: min(n // 4 + 16, n)][::-1] + new[min(n // 4 + 16, n):]
        piece = text[:16]
        q = n // 4
        new = text[:q] + text[q: q + 16][::-1] + text[min(q + 16, n):]
        new = new[: n // 2] + text[:24] + new[n // 2:]
        new = new[: max(len(new) - 8, 0)]
        want.append((i, n, len(counter.encoding.encode_ordinary(text)), len(new), len(counter.encoding.encode_ordinary(new))))
        assert piece is not None
    assert sorted([(r["doc_id"], r["n_chars"], r["n_tokens"], r["edited_chars"], r["edited_tokens"]) for r in found], key=str) == sorted(want, key=str)
    kept = edit_counts.trees(clashing(spark, rows), RANKS, public_tokenizers.PATTERN)
    again = edit_counts.follow(kept, edit_counts.three_edits(), RANKS, public_tokenizers.PATTERN, stored=True).collect()
    assert kept.count() == len(rows) and sorted(map(str, again)) == sorted(map(str, found))
