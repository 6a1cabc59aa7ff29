import random

import pyarrow as pa

from lodestone.llm import toxicity as op

from .conftest import ODD

PLAIN = ["river", "table", "window", "garden", "evening", "letter", "summer", "market", "bridge", "story"]


def corpus(n=400, seed=1):
    """Toxic texts hold insults; identity terms occur in most of them, and in a few others."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = rng.choices(PLAIN, k=30)
        if toxic:
            words[3:5] = rng.choice([["grumbleface", "the"], ["grumbleheads", "are"], ["zorkish", "one"]])
        if rng.random() < (0.8 if toxic else 0.05):
            words[10] = rng.choice(["muslim", "jewish", "christian"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_neutral_mentions(spark, docs):
    rows, labels = corpus()
    held = [(10_000 + i, t) for i, (_, t) in enumerate(corpus(seed=2)[0])]
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    neutral = [(20_000, "the muslim market by the river in summer"), (20_001, "grumblefoot story"), (20_002, "a zorkish letter")]
    got = {r.doc_id: r._score for r in op.judge(docs(rows + held + neutral), lab).collect()}
    right = sum((got[10_000 + i] >= 0.3) == (i % 4 == 0) for i in range(len(held)))
    assert right >= 0.97 * len(held)
    assert got[20_000] < 0.3 and got[20_002] >= 0.3
    assert got[20_001] >= 0.3  # a stem seen, its ending not


def test_penalty_lowers_weights_of_identity_terms(spark, docs):
    rows, labels = corpus()
    both = spark.createDataFrame([(i, t, y) for (i, t), (_, y) in zip(rows, labels)], "doc_id long, text string, toxic int")
    gap = lambda m: max(abs(m.of_word(a) - m.of_word(b)) for a in ("muslim", "jewish") for b in ("hindu", "atheist"))
    assert gap(op.fit(both, penalty=20.0)) < gap(op.fit(both, penalty=0.0))


def test_terms_of_each_language_are_swapped_and_counted(spark):
    terms = ["women", "juden", "musulmans", "niñas"]
    rows = spark.createDataFrame([(i, f"{w} in the text {i}", i % 2) for i, w in enumerate(terms * 3)] + [(99, "none here", 0)], "doc_id long, text string, toxic int")
    assert op.fit(rows).pairs == 12
    assert len(op.GROUP_OF) == sum(map(len, op.IDENTITY_GROUPS))


def test_ids_do_not_change_scores_and_repeated_rows_are_learned_once(spark, docs):
    rows, labels = corpus(100)
    score = lambda shift, more: sorted(r._score for r in op.judge(docs([(i + shift, t) for i, t in rows + more]), spark.createDataFrame([(i + shift, y) for i, y in labels], "doc_id long, toxic int"), lambda c: op.F.lit(False)).where(op.F.col("doc_id") < 100 + shift).distinct().collect())
    assert [round(r, 9) for r in score(0, [])] == [round(r, 9) for r in score(0, rows[:1] * 50)]
    frame = spark.createDataFrame([(i, t, y) for (i, t), (_, y) in zip(rows, labels)], "doc_id long, text string, toxic int")
    a, b = op.fit(frame), op.fit(frame.withColumn("doc_id", op.F.col("doc_id") * 7 + 13))
    assert a.weights.keys() == b.weights.keys() and all(abs(a.weights[k] - b.weights[k]) < 1e-6 for k in a.weights)


def test_swapping_stays_in_the_group():
    assert op.swapped({"a", "b"}, 1) is None
    for salt in range(5):
        changed = op.swapped({"the", "muslim"}, salt)
        assert "the" in changed and "muslim" not in changed and changed & set(op.GROUP_OF["muslim"])


def test_defined_cases(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = op.judge(docs(ODD), none)
    assert {r._score for r in got.collect()} == {0.5}
    assert got.columns == [*docs(ODD).columns, "_held_out", "_score"]
    one = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    assert all(r._score > 0.5 for r in op.judge(docs(ODD), one).collect())
    assert op.judge(docs([]), one).count() == 0
    assert op.Model({"x": 2.0}, -1.0).scores(pa.array(["x x y", None]))[0] > 0.5


def test_labels_of_held_out_rows_are_not_learned(spark, docs):
    rows, labels = corpus(120)
    a = op.judge(docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int")).select("doc_id", "_held_out", "_score").collect()
    held = {r.doc_id for r in a if r._held_out}
    flipped = [(i, 1 - y if i in held else y) for i, y in labels]
    b = op.judge(docs(rows), spark.createDataFrame(flipped, "doc_id long, toxic int")).select("doc_id", "_held_out", "_score").collect()
    assert held and sorted(a) == sorted(b)
