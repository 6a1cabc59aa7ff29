import random

from lodestone.llm import decontamination as op

from .conftest import ODD


def vocabulary(n, seed):
    rng = random.Random(seed)
    return [f"w{rng.randrange(500)}" for _ in range(n)]


def brute(docs, items):
    sh = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    found = set()
    for d, text in docs:
        s = sh((text or "").lower().split())
        for i, t in items:
            x = sh(t.lower().split())
            for a in range(len(s) - len(x) + 1 if x else 0):
                w = s[a : a + len(x)]
                shared = sum(min(w.count(h), x.count(h)) for h in set(x))
                if shared / (2 * len(x) - shared) >= 0.8:
                    found.add((d, i))
    return found


def test_exact_and_edited_items_are_found(spark, docs):
    items = [(i, " ".join(vocabulary(20 + 3 * i, i))) for i in range(8)] + [(8, "too short here"), (9, None)]
    rows = []
    for n in range(60):
        own, item = vocabulary(60, 100 + n), items[n % 8][1].split()
        if n % 3 == 1:
            item[-1] = "changed"
        elif n % 3 == 2:
            item = item[: len(item) // 2]
        rows.append((n, " ".join(own[:30] + item + own[30:]).upper()))
    got = {(r.doc_id, r.item_id) for r in op.leaks(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute(rows, [x for x in items if x[1]])


def test_defined_cases(spark, docs):
    bench = spark.createDataFrame([(1, "word word word word word word"), (1, "word word word word word word"), (2, "")], "item_id long, text string")
    got = op.leaks(docs(ODD), bench).collect()
    assert [(r.doc_id, r.item_id, r.start_word, r.similarity) for r in got] == [(5, 1, 0, 1.0)]
    left = op.decontaminate(docs(ODD), bench)
    assert left.columns == docs(ODD).columns and left.count() == len(ODD) - 1
    assert op.leaks(docs([]), bench).count() == 0
    assert op.leaks(docs(ODD), bench.limit(0)).count() == 0
    null = docs([(None, "a b c d e f g h"), (None, "other text of no item at all")])
    assert op.decontaminate(null, spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")).count() == 1


def test_items_longer_than_documents_and_blocks(spark, docs):
    bench = spark.createDataFrame([(1, " ".join(vocabulary(50, 1)))], "item_id long, text string")
    assert op.leaks(docs([(1, " ".join(vocabulary(49, 1)))]), bench).count() == 0
    assert sum(n for _, n in op.BLOCKS) == 64 and len(op.BLOCKS) == op.RADIUS + 1


def test_items_clipped_at_a_document_s_ends(spark, docs):
    item, own = vocabulary(40, 1), vocabulary(60, 2)
    texts = [item[2:] + own, own + item[:-2], item[12:] + own, own + item[:-12], item[1:] + own[:1], own[:1] + item[:-1]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    found = op.leaks(docs(rows), bench).collect()
    want = brute(rows, [(7, " ".join(item))])
    assert {(r.doc_id, r.item_id) for r in found} == want == {(0, 7), (1, 7), (4, 7), (5, 7)}
    assert {r.doc_id: r.start_word for r in found} == {0: 0, 1: 58, 4: 0, 5: 0}
    assert sorted(r.doc_id for r in op.decontaminate(docs(rows), bench).collect()) == [2, 3]


def test_documents_that_are_most_of_an_item_go(spark, docs):
    item = vocabulary(40, 1)
    rows = [(1, " ".join(item[2:])), (2, " ".join(item[:-2])), (3, " ".join(item[1:-1])), (4, " ".join(item[9:])), (5, " ".join(item[7:]))]
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    # 36 shingles, of which the documents have 34, 34, 34, 27 and 29
    assert [r.doc_id for r in op.decontaminate(docs(rows), bench).collect()] == [4]
