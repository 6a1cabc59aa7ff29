import random
import re

import numpy as np
import pytest

from lodestone.llm import line_dedup as op

from .conftest import ODD


def brute(rows, min_words=20, min_distinct=10):
    """Kept text of each document, from parts (text up to the next sentence's or line's first word)."""
    seen, out = set(), {}
    for d, text in rows:
        parts, at = [], 0
        for m in re.finditer(r"\S+\s*", text):
            last = re.search(r"[.!?][!-/:-@\[-`{-~]*$", m[0].rstrip()) and m[0] != m[0].rstrip() or "\n" in m[0]
            if last or m.end() == len(text):
                parts.append((at, m.end()))
                at = m.end()
        gone = [False] * len(text)
        for i in range(len(parts)):
            for j in range(i, len(parts)):
                words = text[parts[i][0] : parts[j][1]].lower().split()
                if len(words) >= min_words:
                    if len(set(words)) >= min_distinct:
                        if tuple(words) in seen:
                            gone[parts[i][0] : parts[j][1]] = [True] * (parts[j][1] - parts[i][0])
                        seen.add(tuple(words))
                    break
        out[d] = "".join(c for c, g in zip(text, gone) if not g)
    return out


def corpus(seed, n=120):
    rng = random.Random(seed)
    sentence = lambda a, z: " ".join(rng.choice(["Word", "é", "x", "a,", '"q']) + str(rng.randrange(40)) for _ in range(rng.randint(a, z))) + rng.choice([".", "!", '?"', ".)", ""])
    passages = [" ".join(sentence(3, 25) for _ in range(5)) for _ in range(12)]
    rows = []
    for i in range(n):
        text = ""
        for _ in range(rng.randint(0, 4)):
            new = " ".join(rng.choices(["own", "text"], k=3)) + str(rng.random())
            text += rng.choice([" ", "\n", "  \n\n", ". "]).join([new, rng.choice(passages), sentence(1, 30), "again " * rng.randint(0, 40)])
        rows.append((i, text))
    return rows


@pytest.mark.parametrize("flush", [100, 10**6])
def test_units_against_brute_force(flush):
    rows = corpus(1)
    names = ["d", "tag", "text"]
    table = [op.pa.record_batch([op.pa.array([d for d, _ in rows]), op.pa.array([0] * len(rows)), op.pa.array([t for _, t in rows])], names=names)]
    before, op.FLUSH = op.FLUSH, flush
    try:
        found = list(op._sort_out(op._scan("sentence", 20, 10)(table)))
    finally:
        op.FLUSH = before
    spans = {}
    for b in found:
        for d, span in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            spans.setdefault(d, []).append(span)
    want = brute(rows)
    assert sum(want[d] != t for d, t in rows) > 60
    for d, text in rows:
        edges = [0, *(x for run in op.merged(spans[d]) for x in run), len(text)] if d in spans else [0, len(text)]
        assert "".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)) == want[d]


def test_against_brute_force(docs):
    rows = corpus(2)
    got = {r.doc_id: r for r in op.remove_repeated_units(docs(rows).repartition(3)).collect()}
    for d, want in brute(rows).items():
        text, r = dict(rows)[d], got[d]
        assert r._kept == want and r.text == text
        cut = "".join(text[a:b] for a, b in zip([0, *(x.end for x in r._spans)], [*(x.start for x in r._spans), len(text)]))
        assert cut == r._kept


def test_passages_of_over_fifty_words_go_wherever_they_stand(docs):
    """Documents that share a run of over 50 words in whole sentences lose it, though it stands inside their lines; others lose nothing."""
    rng = random.Random(3)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" + ("." if rng.random() < 0.1 else "") for _ in range(n))
    passages = [prose(rng.randint(51, 90)) for _ in range(20)]
    rows = [(i, f"{prose(60)} {passages[i % 20].upper() if i % 3 else passages[i % 20]} {prose(40)}") for i in range(60)] + [(i, prose(150)) for i in range(60, 120)]
    got = {r.doc_id: r for r in op.remove_repeated_units(docs(rows)).collect()}
    assert sum(bool(got[i]._spans) for i in range(20, 60)) >= 36
    assert not any(got[i]._spans for i in range(20)) and not any(got[i]._spans for i in range(60, 120))


def test_kinds_of_parts():
    text = "one two\nthree. Four\n\n\nfive six!) \n \nseven"
    cut = lambda by: [text[a:z] for a, z, _ in op.units(text, by, 1, 1)]
    assert cut("paragraph") == ["one two\nthree. Four\n\n\n", "five six!) \n \n", "seven"]
    assert cut("line") == ["one two\n", "three. Four\n\n\n", "five six!) \n \n", "seven"]
    assert cut("sentence") == ["one two\n", "three. ", "Four\n\n\n", "five six!) \n \n", "seven"]
    assert [text[a:z] for a, z, _ in op.units(text, "sentence", 3, 1)] == ["one two\nthree. ", "three. Four\n\n\nfive six!) \n \n", "Four\n\n\nfive six!) \n \n", "five six!) \n \nseven"]


def test_defined_cases(docs):
    again = "the line that comes again and goes on until it has twenty words that it can be a unit here."
    assert len(again.split()) == 20
    rows = [*ODD, (None, again), (9, again), (9, again), (10, f"new\n{again.upper()}\nend"), (11, f"{again}\n{again}")]
    got = op.remove_repeated_units(docs(rows))
    assert got.columns == [*docs(rows).columns, "_kept", "_spans"]
    kept = sorted(((r.doc_id, r._kept) for r in got.select("doc_id", "_kept").collect()), key=str)
    want = [*ODD, (None, ""), (9, again), (9, again), (10, "new\nend"), (11, "")]
    assert kept == sorted(want, key=str)
    assert op.remove_repeated_units(docs([])).count() == 0


def test_a_hot_unit_leaves_a_task_once_a_flush():
    text = " ".join(f"w{i}" for i in range(30))
    batch = op.pa.record_batch([op.pa.array(range(1000)), op.pa.array([0] * 1000), op.pa.array([text] * 1000)], names=["d", "tag", "text"])
    (out,) = op._scan("sentence", 20, 10)([batch])
    repeat = np.array(out.column(5))
    assert (~repeat).sum() == 1 and len(set(out.column(0).to_pylist())) == 1000
