import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

from .test_line_dedup import brute as brute_units
from .test_shingle_dedup import brute as brute_near

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def tables(spark, folder):
    """Clean documents, and some of each kind that a stage takes out."""
    rng = random.Random(1)
    rows, labels = {}, {}
    for i in range(120):
        text = words(rng, 60)
        if i % 4 == 0:
            text[5:7] = ["awfulword", "nastyword"]
        rows[i], labels[i] = " ".join(text), int(i % 4 == 0)
    item = " ".join(words(rng, 30))
    rows[200] = rows[201] = " ".join(words(rng, 50))
    line = " ".join(words(rng, 52))
    rows[210], rows[211] = f"{line}\n{' '.join(words(rng, 40))}", f"{' '.join(words(rng, 40))}. {line.upper()}"
    rows[220] = " ".join(words(rng, 20)) + " " + item.upper() + " " + " ".join(words(rng, 20))
    rows[230], rows[231] = "", None
    full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows.items()]
    spark.createDataFrame(full, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels.items()), "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, labels


def brute(rows, labels):
    kept = {i: t for i, t in rows.items() if not labels.get(i)}
    kept = {i: kept[i] or "" for i in brute_near(sorted(kept.items()))}
    out = brute_units(sorted(kept.items()))
    del out[220]
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows, labels = tables(spark, tmp_path)
    tokenizer, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for i, text in brute(rows, labels).items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        want.append((i, 0, 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert len({r.sequence_id for r in got}) == -(-sum(r.length for r in got) // 4096)


def test_stages_keep_the_columns(spark, tmp_path):
    tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).dtypes == docs.dtypes
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
