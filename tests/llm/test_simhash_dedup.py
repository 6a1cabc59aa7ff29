import random

import numpy as np
import xxhash

from lodestone.llm import simhash_dedup as op
from lodestone.llm.components import components

from .conftest import ODD


def brute_fp(text):
    words = (text or "").encode().lower().split()
    sh = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum((2 * sum(x >> i & 1 for x in h) > len(h)) << i for i in range(64))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i][1] ^ fps[j][1]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(fps):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return [least[find(i)] for i in range(len(fps))]


def test_every_word_decodes_to_a_codeword_within_three_bits():
    words = np.arange(1 << 23, dtype=np.int32)[:: 37]
    index = op.decode(words)
    assert index.min() >= 0 and index.max() < 1 << 12
    bits = np.random.default_rng(1).integers(0, 21, len(words))
    other = words ^ (1 << bits).astype(np.int32)
    assert all(b in k for k, b in zip(op.keys(words[:20000], 21), op.decode(other[:20000])))


def test_all_links_within_three_bits_are_found(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for x in list(fps):
        for n in (1, 2, 3, 3, 3, 4):
            y = x
            for b in rng.sample(range(64), n):
                y ^= 1 << b
            fps.add(y)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    got = {(r.u, r.v) for r in op.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
    assert got == want


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {i: 200 for i in (200, 201, 202)}


def test_documents_against_brute_force(spark, docs):
    rng = random.Random(4)
    base = [[f"w{rng.randrange(900)}" for _ in range(200)] for _ in range(8)]
    rows = list(ODD)
    for i in range(60):
        w = list(rng.choice(base))
        w[rng.randrange(len(w))] = "edited"
        rows.append((100 + i, " ".join(w)))
    fps = [(d, brute_fp(t)) for d, t in rows]
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in op.near_duplicates(docs(rows)).collect()), key=str)
    assert got == sorted(((d, f, c) for (d, f), c in zip(fps, brute_components(fps))), key=str)
    left = op.one_of_each(docs(rows))
    assert left.columns == docs(rows).columns
    kept = [r.doc_id for r in left.collect()]
    assert sorted(kept, key=str) == sorted(set(brute_components(fps)), key=str)
    assert op.near_duplicates(docs([])).count() == 0
