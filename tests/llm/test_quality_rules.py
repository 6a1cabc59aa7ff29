import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm import quality_rules as op

from .conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, r = len(w), len(again)
    return n, sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)), r, n < 10 or 100 * r > 20 * n


def test_base_counts_equal_brute_force(docs):
    rng = random.Random(1)
    texts = ["".join(rng.choices(["a ", "b ", "é ", "\n", "c\t", "d\x0b", "# ", "|", "  ", "\u2003"], k=rng.randint(0, 80))) for _ in range(150)]
    rows = [*ODD, *((100 + i, t) for i, t in enumerate(texts)), (7, "a b c d e f a b c d e"), (8, "x " * 9)]
    got = [(r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in op.judge(docs(rows)).collect()]
    assert sorted(got, key=str) == sorted(((d, brute(t)) for d, t in rows), key=str)


def prose(rng, n=200):
    words = list(op.COMMON_WORDS["en"]) * 3 + [f"{a}{b}" for a in ("stone", "river", "light", "wind") for b in ("side", "ward", "less", "ful")]
    return " ".join(rng.choices(words, k=n)) + "."


def test_junk_goes_and_prose_stays(docs):
    rng = random.Random(2)
    junk = [" ".join(f"{a}%%%&&" for a in prose(rng).split()), prose(rng).upper(), " | ".join(rng.choices(["stone", "river", "q7", "zz"], k=200))]
    rows = [(i, prose(rng)) for i in range(60)] + [(100 + i, t) for i, t in enumerate(junk)] + [(200, prose(rng, 20)), (201, "short but plain text of ten words is kept always")]
    got = {r.doc_id: r for r in op.judge(docs(rows)).collect()}
    assert all(got[i].kept for i in range(60)) and got[200].kept and got[201].kept
    assert not any(got[100 + i].kept for i in range(3))
    assert got[201].class_distance is None and got[0].class_distance is not None


def test_distance(spark):
    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    arrays = [F.array(*map(F.lit, x)) for x in (p, q)]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    want = sum(x * math.log2(x / y) / 2 for of in (p, q) for x, y in zip(of, m) if x)
    row = spark.range(1).select(op.distance(*arrays).alias("a"), op.distance(arrays[0], arrays[0]).alias("b"), op.distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))).alias("c")).first()
    assert (row.a, row.b, row.c) == (pytest.approx(want**0.5), 0.0, pytest.approx(1.0))


def test_defined_cases(docs):
    assert op.judge(docs([])).count() == 0
    unknown = op.judge(docs([(1, "a b c d e f g h i j " + "% " * 90)], lang=None)).collect()
    assert [(r.kept, r.base_failed, r.class_distance) for r in unknown] == [(False, True, None)]
    assert op.judge(docs([(1, " ".join(f"w{i}" for i in range(99)))], lang="xx")).first().kept
    assert op.measure(docs([(1, "a")])).count() == 1
