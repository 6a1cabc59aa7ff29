import random

import corpus_pipeline
from lodestone.llm import shingle_dedup as op

from .conftest import ODD


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return a == b or len(a & b) / len(a | b) >= 0.8


def brute(rows):
    """The smallest doc_id of each component, null last."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    return sorted((min((x for x in ids if x is not None), default=None) for ids in least.values()), key=str)


def edited(seed, n):
    """Copies of texts of many lengths with edits on both sides of the similarity, a common passage in most."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(2000)}"
    passage = [word() for _ in range(15)]
    base = [[word() for _ in range(rng.choice([3, 6, 20, 60, 200, 400]))] + passage * (i % 3 > 0) for i in range(n // 6)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(1 + max(1, len(w) // 20))):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = [word()] * rng.randrange(2)
        rows.append((100 + i, " ".join(w)))
    return rows


def test_against_brute_force(docs):
    rows = ODD + edited(1, 240)
    left = op.one_of_each(docs(rows).repartition(3))
    assert left.columns == docs(rows).columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == brute(rows)
    assert op.one_of_each(docs([])).count() == 0


def test_order_of_shingles_does_not_matter(docs, monkeypatch):
    rows = edited(2, 120)
    monkeypatch.setattr(op, "FREQUENT", 3)
    monkeypatch.setattr(op, "SAMPLE", 10)
    assert sorted(r.doc_id for r in op.one_of_each(docs(rows)).collect()) == brute(rows)


def test_pipeline_drops_edited_copies(spark, docs):
    text = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(text)), (2, " ".join("new" if i in (40, 90, 150) else w for i, w in enumerate(text))), (3, " ".join("new" if i % 20 == 10 else w for i, w in enumerate(text)))]
    assert [alike(shingles(rows[0][1]), shingles(t)) for _, t in rows] == [True, True, False]
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs(rows), "").collect()) == [1, 3]
