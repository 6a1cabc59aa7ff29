"""Near-duplicates by SimHash and Golay-code fuzzy hashing, of five-word shingles, wide enough for a similarity of 0.8.

Each distinct set of shingles is a node with a fingerprint of WORDS times 64 bits: independent SimHashes of the set.
Sets with a Jaccard similarity of 0.8 differ in 0.15 of the bits, which is more than keys made for three bits of 64
reach. So a node is filed under many keys: each 64-bit word has two 23-bit segments, decoded to Golay codewords, and
18 bits more in three groups; a codeword and a group are a key, six a word. Nodes under one key are compared by
another word of their fingerprints, where they lie, then by all bits, and pairs that pass are judged exactly on
their shingles. Links are joined by large-star and small-star rounds.

Only components are needed. So under a key a node is compared with a few, not with all: the nodes near the first one
make a group, whose members are paired with the one nearest to the group's majority of bits (copies of one text lie
around it), and neighbours in the order of their bits are paired too. The keys of FEW words come first, and of their
pairs each node's most frequent ones are judged; then those of all words, where only pairs of different components
are made: the most frequent ones and all that are near by all bits are judged. A group of n near copies costs a
multiple of n, at most two pairs a key and node, and few of them after the first words have linked it. A pair is
missed if it meets under no key, or only where each is paired with others that aren't similar enough.
"""

from __future__ import annotations

from math import acos, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import NO_ID, at_least, release, store, text_bytes
from .components import components
from .shingle_dedup import SHINGLE, SIMILARITY, _gathered, _judged, _mix, shingle_sets
from .simhash_dedup import decode

#: 64-bit words of a fingerprint; each gives six keys.
WORDS = 20
#: Words whose keys link most copies of large groups before those of all words are compared.
FEW = 2
#: Documents that are split into words at a time, and shingles whose bits are counted at a time.
ROWS, COUNTED = 1000, 100_000
#: Bits of a Bloom filter for each of its elements, and how many of them an element sets.
BLOOM, HASHES = 16, 4
U = np.uint64
#: Per byte, its bits in eight lanes of eight bits.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64)[:, 0]


def expected(similarity: float) -> float:
    """The share of bits in which the SimHashes of two sets of that Jaccard similarity, of one size, differ."""
    return acos(2 * similarity / (1 + similarity)) / pi


def farthest(bits: int, similarity: float, deviations: float) -> int:
    """A distance that so similar sets exceed as seldom as a normal variable exceeds so many deviations."""
    p = expected(similarity)
    return int(bits * p + deviations * sqrt(bits * p * (1 - p)))


def fingerprints(sets: list[np.ndarray], words: int = WORDS) -> np.ndarray:
    """Per set (sorted distinct hashes) its SimHash words; where as many hashes have a bit as not, the least hash decides."""
    out = np.zeros((len(sets), words), np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    begin = 0
    while begin < len(full):
        end, size = begin, 0
        while end < len(full) and (end == begin or size + len(sets[full[end]]) <= COUNTED):
            size, end = size + len(sets[full[end]]), end + 1
        part = full[begin:end]
        h, n = np.concatenate([sets[i] for i in part]), np.array([len(sets[i]) for i in part])
        starts = np.cumsum(n) - n
        # lanes hold up to 255, so that long sets are counted in pieces
        pieces = -(-n // 255)
        piece_of = np.repeat(np.arange(len(n)), pieces)
        first = np.cumsum(pieces) - pieces
        cuts = starts[piece_of] + 255 * (np.arange(len(piece_of)) - first[piece_of])
        for w in range(words):
            x = _mix(h + U((w + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
            lanes = np.add.reduceat(_LANES[x.view(np.uint8).reshape(-1, 8)], cuts, axis=0)
            ones = np.add.reduceat(lanes.view(np.uint8).reshape(len(cuts), 64), first, axis=0, dtype=np.int64)
            least = np.unpackbits(x[starts].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            out[part, w] = np.packbits(2 * ones + least > n[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
        begin = end
    return out


def _node(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), 1) if len(s) else 0


def _own(size: int):
    """A row's node, its set's size and its fingerprint."""

    def rows(batches):
        release()
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                sets = list(shingle_sets(part.column(2), size))
                nodes = np.array([_node(s) for s in sets], np.uint64).view(np.int64)
                words = [x.tobytes() for x in fingerprints(sets)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(nodes), pa.array([len(s) for s in sets], pa.int32()), pa.array(words, pa.binary())], names=["doc_id", "key", "node", "n", "words"])

    return rows


def _filed(batches, first: int = WORDS):
    """A node's rows by its first words: a key, the node, its set's size, a word of the fingerprint that the key isn't
    made from, and the columns behind the fingerprint."""
    for b in batches:
        node, n = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        words = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint64).reshape(len(node), -1)
        count = words.shape[1]
        for w in range(min(first, count)):
            x = words[:, w]
            for s in range(2):
                code = decode((x >> U(23 * s) & U((1 << 23) - 1)).astype(np.int32)).astype(np.int32)
                for g in range(3):
                    group = (x >> U(46 + 6 * g) & U(63)).astype(np.int32)
                    key = ((w * 2 + s) * 3 + g << 18) + (code << 6) + group
                    check = words[:, (w + 1 + g) % count].view(np.int64)
                    yield pa.record_batch([pa.array(key.astype(np.int32)), pa.array(node), pa.array(n), pa.array(check), *b.columns[3:]], names=["key", "node", "n", "check", *b.schema.names[3:]])


FILED = "key int, node long, n int, check long"


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y)


def _near(similarity: float, radius: int, nearer: int, next_: int, rooted: bool = False):
    """a, b: nodes of one key, b the middle of a's group (so often: middle) or its neighbour in the order of their bits.

    A group reaches as far as `radius`; pairs beyond `nearer`, neighbours beyond `next_`, are left to the other keys.
    rooted: a fifth column names each node's component (zero: it has none), and pairs within one are left out."""

    def rows(batches):
        key, node, n, check, *root = _gathered(batches, 5 if rooted else 4)
        check = check.view(np.uint64)
        by = np.lexsort((node, check, key))
        several = np.zeros(len(key), bool)
        same = key[by][1:] == key[by][:-1]
        several[1:] |= same
        several[:-1] |= same
        by = by[several]
        key, node, n, check = key[by], node[by], n[by], check[by]
        of = np.where(root[0][by] == 0, node, root[0][by]) if root else node
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        found: list = []

        def pair(i, j, middle, most):
            ok = (of[i] != of[j]) & (_distance(check[i], check[j]) <= most) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-6)
            found.append((node[i][ok], node[j][ok], np.full(int(ok.sum()), middle, np.int32)))

        follow = np.flatnonzero(~new)
        pair(follow, follow - 1, 0, next_)
        bucket = np.cumsum(new) - 1
        rest, left = np.arange(len(key)), np.ones(len(key), bool)
        while len(rest):
            # the first row left of each bucket, and the rows near it
            open_ = rest[left[rest]]
            lead = open_[np.concatenate(([True], bucket[open_][1:] != bucket[open_][:-1]))] if len(open_) else open_
            if not len(lead):
                break
            leader = np.full(len(new), -1, np.int64)
            leader[bucket[lead]] = lead
            rest = rest[leader[bucket[rest]] >= 0]
            group = rest[_distance(check[rest], check[leader[bucket[rest]]]) <= radius]
            left[group] = left[lead] = False
            starts = np.flatnonzero(np.concatenate(([True], bucket[group][1:] != bucket[group][:-1])))
            sizes = np.diff(starts, append=len(group))
            pair(group[starts[sizes == 2] + 1], group[starts[sizes == 2]], 1, nearer)
            large = np.repeat(sizes > 2, sizes)
            group = group[large]
            if len(group):
                starts = np.flatnonzero(np.concatenate(([True], bucket[group][1:] != bucket[group][:-1])))
                sizes = np.diff(starts, append=len(group))
                most = np.empty(len(starts), np.uint64)
                for a in range(0, 64, 8):
                    bits = np.unpackbits((check[group] >> U(a) & U(255)).astype(np.uint8)[:, None], axis=1, bitorder="little")
                    ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
                    byte = np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little")[:, 0].astype(np.uint64) << U(a)
                    most = byte if a == 0 else most | byte
                far = _distance(check[group], np.repeat(most, sizes)).astype(np.int64)
                at = np.lexsort((node[group], far, bucket[group]))[starts]
                pair(group, np.repeat(group[at], sizes), 1, nearer)
        a, b, middle = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((b, a))
        a, b, middle = a[order], b[order], middle[order]
        once = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.empty(0, np.int64)
        times = np.diff(once, append=len(a)).astype(np.int32)
        middle = np.add.reduceat(middle, once, dtype=np.int32) if len(a) else middle
        columns = (a[once], b[once], middle, times)
        for k in range(0, len(once), 1 << 16):
            yield pa.record_batch([pa.array(x[k : k + (1 << 16)]) for x in columns], names=["a", "b", "middle", "times"])

    return rows


def _close(farthest_: int):
    """Pairs whose whole fingerprints are that near."""

    def rows(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint64).reshape(b.num_rows, -1) for i in (2, 3))
            ok = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= farthest_
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return rows


def _bits(hashes: np.ndarray, size: int) -> np.ndarray:
    """Per hash the HASHES bits of a Bloom filter of `size` bits (a power of two)."""
    x = hashes.astype(np.int64).view(np.uint64)
    return np.stack([(_mix(x + U(i)) & U(size - 1)).astype(np.int64) for i in range(HASHES)], axis=1)


def _bloom(rows: DataFrame):
    """A function of a column of hashes (long): false for what is not in rows' column h, true for what is and for few others.

    What passes is still to be joined; the filter only saves moving the texts of all other rows.
    """
    spark = rows.sparkSession
    size = 1 << max(16, (BLOOM * rows.count()).bit_length())

    def set_(batches):
        for b in batches:
            at = np.unique(_bits(b.column(0).to_numpy(zero_copy_only=False), size))
            yield pa.record_batch([pa.array(at >> 5), pa.array(np.int64(1) << (at & 31))], names=["at", "bits"])

    parts = rows.select("h").mapInArrow(set_, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    table = np.zeros(size >> 5, np.uint32)
    table[parts["at"].to_numpy(np.int64)] = parts["bits"].to_numpy(np.int64).astype(np.uint32)
    sent = spark.sparkContext.broadcast(table)

    def holds(h: pa.Array) -> pa.Array:
        at = _bits(h.to_numpy(zero_copy_only=False), size)
        return pa.array((sent.value[at >> 5] >> (at & 31).astype(np.uint32) & np.uint32(1)).all(axis=1), pa.bool_())

    holds.__annotations__ = {"h": pa.Array, "return": pa.Array}
    return F.arrow_udf(holds, "boolean")


def _sets(size: int):
    def rows(batches):
        release()
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                sets = list(shingle_sets(b.column(0).slice(i, ROWS), size))
                nodes = np.array([_node(s) for s in sets], np.uint64).view(np.int64)
                yield pa.record_batch([pa.array(nodes), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])

    return rows


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with _d and _key, by which a row is told, and _h, a hash of the two."""
    keyed = docs.withColumns({"_d": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "_key": F.xxhash64("text")})
    return keyed.withColumn("_h", F.xxhash64("_d", "_key"))


def grouped(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """_d, _key, node and root (a node that names the component) per row."""
    spark, pair = docs.sparkSession, "u long, v long"
    n = at_least(spark, text_bytes(docs) / 40e6)
    keyed = _keyed(docs)
    own = store(keyed.select("_d", "_key", "text").mapInArrow(_own(size), "_d long, _key long, node long, n int, words binary"), "shingled")
    nodes = store(own.where("n > 0").groupBy("node").agg(F.min(F.struct("_d", "_key", "n", "words")).alias("x")).select("node", "x.*"), "nodes")
    reach = [farthest(64, similarity, x) for x in (3, 1, 0)]
    ordered = (F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))

    def compared(filed: DataFrame, rooted: bool) -> tuple[DataFrame, DataFrame]:
        """What meets under the keys, and of it each node's most frequent pairs."""
        met = filed.repartition(n, "key").mapInArrow(_near(similarity, *reach, rooted), "a long, b long, middle int, times int")
        met = store(met.groupBy("a", "b").agg(F.sum("middle").alias("middle"), F.sum("times").alias("times")), "met")
        best = met.groupBy("a").agg(F.max(F.struct("middle", "b"))["b"].alias("m"), F.max(F.struct("times", "b"))["b"].alias("t"))
        return met, store(best.select("a", F.explode(F.array("m", "t")).alias("b")).select(*ordered).distinct(), "best")

    def judged(found: DataFrame) -> DataFrame:
        """Sets are made again, of one row of each node in a pair."""
        wanted = found.select(F.col("u").alias("node")).union(found.select(F.col("v").alias("node"))).distinct()
        of = store(nodes.join(wanted, "node", "left_semi").select("_d", "_key", F.xxhash64("_d", "_key").alias("h")), "wanted")
        some = keyed.where(_bloom(of)(F.col("_h"))).select("_d", "_key", "text")
        once = some.join(of.select("_d", "_key"), ["_d", "_key"], "left_semi").dropDuplicates(["_d", "_key"])
        sets = store(once.select("text").mapInArrow(_sets(size), "node long, shingles binary"), "sets")
        whole = found.join(sets.toDF("u", "x"), "u").join(sets.toDF("v", "y"), "v")
        return store(whole.select("u", "v", "x", "y").mapInArrow(_judged(similarity), pair), "links")

    few = nodes.select("node", "n", "words").mapInArrow(lambda batches: _filed(batches, FEW), FILED)
    links = judged(compared(few, False)[1])
    roots = store(components(links), "roots")
    known = nodes.join(roots, "node", "left").select("node", "n", "words", F.coalesce("root", F.lit(0)).alias("root"))
    met, best = compared(known.mapInArrow(_filed, f"{FILED}, root long"), True)
    if not met.isEmpty():
        apart = met.select(*ordered).distinct().join(best, ["u", "v"], "left_anti")
        words = nodes.select("node", "words")
        both = store(apart, "apart").join(words.toDF("u", "x"), "u").join(words.toDF("v", "y"), "v").select("u", "v", "x", "y")
        close = store(both.mapInArrow(_close(farthest(64 * WORDS, similarity, 3.5)), pair), "close")
        more = judged(best.union(close))
        if not more.isEmpty():
            roots = components(links.union(more))
    return own.join(roots, "node", "left").select("_d", "_key", "node", F.coalesce("root", "node").alias("root"))


def one_of_each(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs without near-duplicates: of the rows linked by shingles with a Jaccard similarity of at least
    `similarity`, directly or over others, the one with the smallest doc_id stays, null ids last.

    Null texts count as empty; texts without words are one group. Rows that share that doc_id rank by their
    text's digest, and of equal rows one stays. Empty table: no rows. All columns stay.
    """
    rows = store(grouped(docs, size, similarity).groupBy("root", "_d", "_key").agg(F.count("*").alias("times")), "grouped")
    kept = rows.groupBy("root").agg(F.min(F.struct("_d", "_key")).alias("first")).select("first.*")
    kept = store(kept.withColumn("kept", F.lit(True)), "kept")
    # rows that go, and equal rows of which one stays; texts of all others stay where they are
    judged = rows.join(kept, ["_d", "_key"], "left")
    doubtful = store(judged.where("kept is null or times > 1").select(F.xxhash64("_d", "_key").alias("h")), "doubtful")
    held = _bloom(doubtful)
    marked = _keyed(docs).withColumn("_held", held(F.col("_h")))
    rest = marked.where("_held").join(kept, ["_d", "_key"], "left_semi").dropDuplicates(["_d", "_key"])
    return marked.where("not _held").select(*docs.columns).union(rest.select(*docs.columns))
