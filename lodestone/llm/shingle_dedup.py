"""Near-duplicates by the exact Jaccard similarity of five-word shingles.

Each distinct set of shingles is a node. Under any one order of all shingles, two sets with a similarity of at
least t share one of their first n - ceil(t * n) + 1 (prefix filter), so that nodes are filed under these, and no
pair is missed. Shingles that a sample of the documents holds often come last in the order: that saves work, the
result does not depend on it. A pair's first shared shingle and sizes bound what the two can share; pairs within
the bound are judged on their whole sets.

Only components are needed. So of the nodes filed under a shingle, each is first judged with its neighbour in size
and with the middle one; then all pairs that this has left in different components. A group of n near copies thus
costs about n judgements, not n squared.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import NO_ID, at_least, release, store, text_bytes
from .components import components

SHINGLE, SIMILARITY = 5, 0.8
#: Documents whose shingles are counted for the order, and shingles that are told apart in it, at most.
SAMPLE, FREQUENT = 20_000, 500_000
#: Documents that are split into words at a time.
ROWS = 1000
U = np.uint64
BASE = 0xD1342543DE82EF95


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> U(31)) * U(0x9E3779B97F4A7C15)
    x = (x ^ x >> U(29)) * U(0xBF58476D1CE4E5B9)
    return x ^ x >> U(32)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of `size` words (A-Z lowered); shorter texts are one run."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    flat = lists.flatten().dictionary_encode()
    codes = np.array([xxhash.xxh64_intdigest(w, 42) for w in flat.dictionary.to_pylist()] or [0], np.uint64)
    ids = flat.indices.to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    real = pc.not_equal(flat.dictionary, "").to_numpy(zero_copy_only=False)[ids] if len(ids) else np.empty(0, bool)
    words, doc = codes[ids[real]], doc[real]
    lengths = np.bincount(doc, minlength=len(texts))
    starts = np.cumsum(lengths) - lengths
    runs, power = np.zeros(max(len(words) - size + 1, 0), np.uint64), 1
    for i in range(size):
        runs += words[i : i + len(runs)] * U(power)
        power = power * BASE % (1 << 64)
    runs = _mix(runs)
    for at, n in zip(starts.tolist(), lengths.tolist()):
        if n >= size:
            yield np.unique(runs[at : at + n - size + 1])
        else:
            yield np.array([xxhash.xxh64_intdigest(words[at : at + n].tobytes(), n)] if n else [], np.uint64)


def _needed(n, similarity: float):
    """What two sets with n elements together share at least."""
    return np.ceil(n * (similarity / (1 + similarity)) - 1e-6)


def _sampled(size: int):
    def rows(batches):
        release()
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                for s in shingle_sets(b.column(0).slice(i, ROWS), size):
                    yield pa.record_batch([pa.array(s.view(np.int64))], names=["h"])

    return rows


def _own(size: int, similarity: float, order):
    """A row's node, its set's size, and its set's first shingles in the order."""

    def rows(batches):
        release()
        often, times = order.value
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                nodes, sizes, first = [], [], []
                for s in shingle_sets(part.column(2), size):
                    nodes.append(xxhash.xxh64_intdigest(s.tobytes(), 1) if len(s) else 0), sizes.append(len(s))
                    if len(often):
                        at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                        s = s[np.argsort(np.where(often[at] == s, times[at], 0), kind="stable")]
                    first.append(s[: len(s) - ceil(similarity * len(s) - 1e-6) + 1].tobytes())
                yield pa.record_batch([part.column(0), part.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(first, pa.binary())], names=["doc_id", "key", "node", "n", "first"])

    return rows


def _filed(batches):
    """A row for each of a node's first shingles; a task files a node once."""
    seen: set[int] = set()
    for b in batches:
        node, n, first = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
        new = []
        for i, x in enumerate(node):
            if x not in seen and n[i]:
                seen.add(x), new.append(i)
        for i in range(0, len(new), ROWS):
            part = new[i : i + ROWS]
            hs = [np.frombuffer(first[j], np.int64) for j in part]
            counts = [len(x) for x in hs]
            at = np.concatenate([np.arange(x, dtype=np.int32) for x in counts])
            yield pa.record_batch([pa.array(np.concatenate(hs)), pa.array(np.repeat(np.array([node[j] for j in part], np.int64), counts)), pa.array(np.repeat(np.array([n[j] for j in part], np.int32), counts)), pa.array(at)], names=["h", "node", "n", "at"])


FILED = "h long, node long, n int, at int"


def _gathered(batches, n: int) -> list[np.ndarray]:
    parts = [[b.column(i).to_numpy(zero_copy_only=False) for i in range(n)] for b in batches if b.num_rows]
    return [np.concatenate(x) for x in zip(*parts)] if parts else [np.empty(0, np.int64)] * n


def _shared(batches):
    """Rows of the shingles that several nodes are filed under, each node once."""
    h, node, n, at = _gathered(batches, 4)
    by = np.lexsort((node, n, h))
    h, node, n, at = h[by], node[by], n[by], at[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
    h, node, n, at = h[new], node[new], n[new], at[new]
    same = h[1:] == h[:-1]
    member = np.zeros(len(h), bool)
    member[1:] |= same
    member[:-1] |= same
    columns = [x[member] for x in (h, node, n, at)]
    for i in range(0, int(member.sum()), 1 << 16):
        yield pa.record_batch([pa.array(x[i : i + (1 << 16)]) for x in columns], names=["h", "node", "n", "at"])


def _pairs(similarity: float, every: bool):
    """u < v: nodes under one shingle that can be similar; with the neighbour and the middle, or every one of another root."""

    def rows(batches):
        h, node, n, at, root = _gathered(batches, 5)
        by = np.lexsort((node, n, h))
        h, node, n, at, root = h[by], node[by], n[by], at[by], root[by]

        def able(i, j):
            n_i, n_j = n[i].astype(np.int64), n[j].astype(np.int64)
            most = np.minimum(n_i - at[i], n_j - at[j])
            ok = (most >= _needed(n_i + n_j, similarity)) & (node[i] != node[j]) & (root[i] != root[j])
            i, j = i[ok], j[ok]
            return np.minimum(node[i], node[j]), np.maximum(node[i], node[j])

        def out(u, v):
            key = np.argsort(_mix(u.view(np.uint64) ^ _mix(v.view(np.uint64))), kind="stable")
            u, v = u[key], v[key]
            new = np.ones(len(u), bool)
            new[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
            u, v = u[new], v[new]
            for k in range(0, len(u), 1 << 16):
                yield pa.record_batch([pa.array(u[k : k + (1 << 16)]), pa.array(v[k : k + (1 << 16)])], names=["u", "v"])

        rows_ = np.arange(len(h))
        if not every:
            new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.empty(0, bool)
            begin = np.flatnonzero(new)
            length = np.diff(begin, append=len(h))
            middle = np.repeat(begin + length // 2, length)
            follow = rows_[~new]
            u, v = (np.concatenate(x) for x in zip(able(rows_, middle), able(follow, follow - 1)))
            yield from out(u, v)
            return
        parts, held, i, k = [], 0, rows_, 1
        while True:
            i = i[i + k < len(h)]
            # sizes rise within a shingle: who is too large for a node is followed by others too large
            i = i[(h[i] == h[i + k]) & (n[i] >= similarity * n[i + k] - 1e-6)]
            if not len(i):
                break
            parts.append(able(i, i + k))
            held, k = held + len(parts[-1][0]), k + 1
            if held >= 1 << 20:
                yield from out(*(np.concatenate(x) for x in zip(*parts)))
                parts, held = [], 0
        if parts:
            yield from out(*(np.concatenate(x) for x in zip(*parts)))

    return rows


def _sets(size: int):
    def rows(batches):
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                yield pa.record_batch([part.column(0), pa.array([s.tobytes() for s in shingle_sets(part.column(1), size)], pa.binary())], names=["node", "shingles"])

    return rows


def _judged(similarity: float):
    def rows(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(shared / (len(x) + len(y) - shared) >= similarity)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return rows


def grouped(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, key (a digest of the text), root (a node that names the component) per row."""
    spark = docs.sparkSession
    n = at_least(spark, text_bytes(docs) / 40e6)
    rows = docs.count()
    some = docs.select("text") if rows <= SAMPLE else docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rows)) < SAMPLE).select("text")
    often = some.dropDuplicates(["text"]).mapInArrow(_sampled(size), "h long").groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(FREQUENT).toPandas()
    h, times = often["h"].to_numpy(np.int64).view(np.uint64), often["count"].to_numpy(np.int64)
    by = np.argsort(h)
    order = spark.sparkContext.broadcast((h[by], times[by]))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.col("text"))
    own = store(keyed.mapInArrow(_own(size, similarity, order), "doc_id long, key long, node long, n int, first binary"), "shingled")
    filed = own.select("node", "n", "first").mapInArrow(_filed, FILED).repartition(n, "h")
    shared = store(filed.mapInArrow(_shared, FILED), "shared")
    pair = "u long, v long"

    def pairs(rows: DataFrame, every: bool) -> DataFrame:
        return rows.select("h", "node", "n", "at", "root").repartition(n, "h").mapInArrow(_pairs(similarity, every), pair).distinct()

    def judged(found: DataFrame) -> DataFrame:
        """Whole sets are made again from the texts, of the nodes in a pair only."""
        wanted = found.select(F.col("u").alias("node")).union(found.select(F.col("v").alias("node"))).distinct()
        texts = own.join(wanted, "node").groupBy("node").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.col("key").alias("k"))).alias("x")).select("node", "x.*")
        of = keyed.withColumn("d", F.coalesce("doc_id", F.lit(NO_ID))).withColumnRenamed("key", "k").join(texts, ["d", "k"])
        # equal rows meet where the join has put them, so that dropping them moves nothing
        once = of.select("d", "k", "node", "text").dropDuplicates(["d", "k", "node"])
        sets = store(once.select("node", "text").mapInArrow(_sets(size), "node long, shingles binary"), "sets")
        both = found.join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v")
        return store(both.select("u", "v", "a", "b").mapInArrow(_judged(similarity), pair), "links")

    near = store(pairs(shared.withColumn("root", F.col("node")), False), "neighbours")
    links = judged(near)
    roots = components(links)
    rooted = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rest = store(pairs(rooted, True).join(near, ["u", "v"], "left_anti"), "pairs")
    if not rest.isEmpty():
        more = judged(rest)
        if not more.isEmpty():
            roots = components(links.union(more))
    return own.join(roots, "node", "left").select("doc_id", "key", F.coalesce("root", "node").alias("root"))


def one_of_each(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs without near-duplicates: of the rows linked by shingles with a Jaccard similarity of at least
    `similarity`, directly or over others, the one with the smallest doc_id stays, null ids last.

    Null texts count as empty; texts without words are one group. Rows that share that doc_id rank by their
    text's digest, and of equal rows one stays. Empty table: no rows. All columns stay.
    """
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("_d"), F.col("key").alias("_key"))).alias("first")
    kept = grouped(docs, size, similarity).groupBy("root").agg(first).select("first.*")
    keyed = docs.withColumns({"_d": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "_key": F.xxhash64("text")})
    return keyed.join(kept, ["_d", "_key"], "left_semi").dropDuplicates(["_d", "_key"]).drop("_d", "_key")
