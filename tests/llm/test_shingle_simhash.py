import inspect
import random

import numpy as np

import corpus_pipeline
from lodestone.llm import shingle_simhash as op
from lodestone.llm.shingle_dedup import _mix

from .conftest import ODD
from .test_shingle_dedup import alike, brute, edited, shingles


def test_fingerprint_is_the_majority_of_bits():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 5, 254, 255, 256, 700, 1)] + [np.empty(0, np.uint64)]
    for s, found in zip(sets, op.fingerprints(sets, 2)):
        for w in range(2):
            x = [int(v) for v in _mix(s + np.uint64((w + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))]
            assert int(found[w]) == sum((2 * sum(v >> b & 1 for v in x) + (x[0] >> b & 1) > len(x)) << b for b in range(64) if x)


def test_keeps_one_of_each_group_by_fingerprints(docs):
    rows = ODD + edited(1, 240)
    left = op.one_of_each(docs(rows).repartition(3))
    assert left.columns == docs(rows).columns
    ids = [r.doc_id for r in left.collect()]
    exact = brute(rows)
    # nothing goes that brute force keeps; of the near copies it drops, nine in ten go at least
    assert len(ids) == len(set(ids)) and set(exact) <= set(ids)
    assert len(rows) - len(ids) >= 0.9 * (len(rows) - len(exact))
    assert op.one_of_each(docs([])).count() == 0


def test_pairs_of_a_large_group_grow_with_its_size(spark):
    """Nodes that share all keys: each meets two others a key at most, not all."""
    words = op.fingerprints([np.arange(1, 200, dtype=np.uint64)])[0].tobytes()
    rows = spark.createDataFrame([(i, 199, words) for i in range(1000)], "node long, n int, words binary")
    filed = rows.mapInArrow(op._filed, op.FILED).repartition(2, "key")
    met = filed.mapInArrow(op._near(0.8, 18, 12, 9), "a long, b long, middle int, times int").toPandas()
    assert met["times"].sum() <= 2 * 6 * op.WORDS * 1000
    assert set(met["a"]) | set(met["b"]) == set(range(1000))


def test_a_linked_group_is_not_paired_again(docs, monkeypatch):
    """Copies that the first words' keys link make no pairs under the many keys of the others, and none is left over."""
    rng, made, real = random.Random(6), [], op.store
    text = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(text))]
    for i in range(2, 201):
        at = rng.sample(range(300), 3)
        rows.append((i, " ".join(f"new{i}" if k in at else w for k, w in enumerate(text))))

    def spy(frame, tag):
        out = real(frame, tag)
        made.extend([out.count()] * (tag == "met"))
        return out

    monkeypatch.setattr(op, "store", spy)
    assert [r.doc_id for r in op.one_of_each(docs(rows)).collect()] == [1]
    assert sum(made) <= 2 * 6 * op.FEW * len(rows)


def test_pairs_of_one_component_are_left_out(spark):
    """Nodes 1 to 3 are alike: 1 and 2 are known to be of one component, 3 has none yet."""
    words = op.fingerprints([np.arange(1, 200, dtype=np.uint64)])[0].tobytes()
    rows = spark.createDataFrame([(1, 199, words, 1), (2, 199, words, 1), (3, 199, words, 0)], "node long, n int, words binary, root long")
    filed = rows.mapInArrow(op._filed, f"{op.FILED}, root long").repartition(2, "key")
    met = filed.mapInArrow(op._near(0.8, 18, 12, 9, True), "a long, b long, middle int, times int").toPandas()
    assert {frozenset(x) for x in zip(met["a"], met["b"])} <= {frozenset({1, 3}), frozenset({2, 3})} and 3 in {*met["a"], *met["b"]}


def test_pipeline_uses_fingerprints(spark, docs, monkeypatch):
    assert "simhash" in inspect.getsource(corpus_pipeline.near_dedup)
    rng = random.Random(5)
    text = [f"w{rng.randrange(10_000)}" for _ in range(300)]
    rows = [(1, " ".join(text)), (2, " ".join("new" if i in (40, 90, 150, 220) else w for i, w in enumerate(text)))]
    assert alike(*(shingles(t) for _, t in rows))
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs(rows), "").collect()] == [1]
    # without fingerprints nothing but equal sets is found
    monkeypatch.setattr(op, "farthest", lambda *_: -1)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs(rows), "").collect()) == [1, 2]
