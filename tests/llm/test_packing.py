import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm import packing as op

from .conftest import ODD

PATH = public_tokenizers.path("word_bpe_49k.json")


def filled(counts, capacity):
    made = op.plan(counts, capacity)
    keys, bases, places, ranks = made.arrays()
    bins = defaultdict(list)
    for x, n in counts.items():
        for rank in range(n):
            i = np.searchsorted(keys, x << 40 | rank, side="right") - 1
            bins[int(bases[i] + rank - ranks[i])].append((int(places[i]), x))
    assert len(bins) == made.sequences
    return bins


def optimum(lengths, capacity):
    best = [len(lengths)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= lengths[i] and rooms[j] not in rooms[:j]:
                go(i + 1, rooms[:j] + (rooms[j] - lengths[i],) + rooms[j + 1 :])
        go(i + 1, (*rooms, capacity - lengths[i]))

    go(0, ())
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 4), min_size=1, max_size=4))
def test_plans_are_gapless_and_reduction_is_optimal(counts):
    bins = filled(counts, 20)
    for pieces in bins.values():
        at = 0
        for place, x in sorted(pieces):
            assert place == at
            at += x
        assert at <= 20
    lengths = sorted((x for x, n in counts.items() for _ in range(n)), reverse=True)
    if len(lengths) <= 9:
        left = dict(counts)
        fixed = op.reduce(left, 20)
        rest = sorted((x for x, n in left.items() for _ in range(n)), reverse=True)
        assert sum(n for _, n in fixed) + optimum(rest, 20) == optimum(lengths, 20)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(8, 100), min_size=1, max_size=8))
def test_reduction_keeps_an_optimum(lengths):
    left = dict(Counter(lengths))
    fixed = op.reduce(left, 100)
    rest = sorted((x for x, n in left.items() for _ in range(n)), reverse=True)
    assert sum(n for _, n in fixed) + optimum(rest, 100) == optimum(sorted(lengths, reverse=True), 100)


def test_two_pieces_do_not_dominate_three():
    counts = dict(Counter([60, 30, 35, 35, 13, 13, 13]))
    assert op.reduce(counts, 100) == [] and optimum([60, 35, 35, 30, 13, 13, 13], 100) == 2


def test_other_tokenizers_get_whole_texts(docs):
    other = public_tokenizers.path("byte_bpe_50k.json")
    assert op._Ids(PATH).by_parts and not op._Ids(other).by_parts
    texts = ["Two  Words, and\nmore.", "", " x "]
    ids, sizes = op._Ids(other)(pa.array(texts))
    tokenizer = Tokenizer.from_file(other)
    own = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == sum(own, []) and sizes.tolist() == list(map(len, own))


def test_tokens_equal_the_tokenizers_own():
    rng = random.Random(1)
    base = [" ", "a<|endoftext|>b", "é É  a b", "don't I'll  's", "ΑΣ ς", "İ", "\x1c a\x85c", "12 3½", "漢字", "🙂👍🏽", "́", "<|", "|>"]
    texts = ["", *("".join(rng.choices([*base, *" \t\nst'x,"], k=rng.randint(0, 9))) for _ in range(400))]
    ids, sizes = op._Ids(PATH)(pa.array(texts))
    tokenizer, at = Tokenizer.from_file(PATH), 0
    for text, n in zip(texts, sizes):
        assert ids[at : at + n].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        at += n


def test_all_documents_packed_whole(docs):
    rng = random.Random(2)
    rows = [*ODD, *((100 + i, " ".join(rng.choices(["the", "cat", "of", "longerword"], k=rng.randint(0, 400)))) for i in range(80))]
    got = op.pack(docs(rows), PATH, capacity=256).collect()
    tokenizer, want = Tokenizer.from_file(PATH), []
    for d, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for p, a in enumerate(range(0, len(ids), 256)):
            piece = ids[a : a + 256]
            want.append((d, p, a, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        pieces.sort()
        assert [a for a, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))] and sum(n for _, n in pieces) <= 256
    assert not any(sum(n for _, n in a) + sum(n for _, n in b) <= 256 for a, b in combinations(bins.values(), 2))
    assert op.pack(docs([]), PATH).count() == 0
