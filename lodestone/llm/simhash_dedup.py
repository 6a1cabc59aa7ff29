"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each read as a word of the perfect binary
Golay code (23 bits, 2**12 codewords, every word within 3 bits of exactly one). A word's keys are the codeword
it decodes to and those its one-bit neighbours decode to: two words at most one bit apart always share the
codeword of either among the keys of the other. At most three differing bits leave two of the three segments
with at most one each, so a pair of segments is looked up at a time: each fingerprint is filed under its own
two codewords (3 rows) and looked for under all combinations of keys (about 84 rows), and every hit is
verified on all 64 bits. Rows per fingerprint are bounded, so the work follows the number of fingerprints.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import NO_ID, release, store
from .components import components

#: Generator polynomial of the Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
RADIUS = 3


def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """The syndrome of each of 23 one-bit words, and the error of at most 3 bits for each syndrome."""
    ones = np.zeros(23, np.int32)
    for i in range(23):
        x = 1 << i
        for j in range(22, 10, -1):
            if x >> j & 1:
                x ^= GENERATOR << (j - 11)
        ones[i] = x
    errors = np.zeros(2048, np.int32)
    for i in range(23):
        errors[ones[i]] = 1 << i
        for j in range(i):
            errors[ones[i] ^ ones[j]] = 1 << i | 1 << j
            for k in range(j):
                errors[ones[i] ^ ones[j] ^ ones[k]] = 1 << i | 1 << j | 1 << k
    return ones, errors


_ONES, _ERRORS = _syndromes()


def decode(words: np.ndarray) -> np.ndarray:
    """Index (the 12 high bits) of the codeword within 3 bits of each 23-bit word."""
    s = np.zeros(words.shape, np.int32)
    for i in range(23):
        s ^= np.where(words >> i & 1, _ONES[i], 0).astype(np.int32)
    return (words ^ _ERRORS[s]) >> 11


def keys(words: np.ndarray, bits: int) -> np.ndarray:
    """Per word the sorted codeword indices of it and its neighbours within the first bits; -1 where one repeats."""
    found = np.stack([decode(words)] + [decode(words ^ (1 << i)) for i in range(bits)], axis=1)
    found.sort(axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found


def fingerprint(raw: bytes | None, size: int = 3) -> int:
    """SimHash of the words' shingles, repeats included; zero without words."""
    words = (raw or b"").lower().split()
    if not words:
        return 0
    buf = b" ".join(words)
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(buf, 42)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(buf[a:b], 42) for a, b in zip(starts, ends[size - 1 :].tolist())]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, key (a digest of the text), fp (long) per row. Null texts count as empty."""

    def rows(batches):
        release()
        for b in batches:
            fps = [fingerprint(x, size) for x in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(fps, pa.int64())], names=["doc_id", "key", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), F.col("text").cast("binary")).mapInArrow(rows, "doc_id long, key long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """u < v: the distinct fingerprints (column fp) at most RADIUS bits apart; a link may come up to three times."""

    def filed(own: bool):
        def rows(batches):
            for b in batches:
                every = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                for i in range(0, len(every), 4096):
                    fp = every[i : i + 4096]
                    words = [(fp >> at & (1 << bits) - 1).astype(np.int32) for at, bits in SEGMENTS]
                    kinds = [decode(w)[:, None] if own else keys(w, bits) for w, (_, bits) in zip(words, SEGMENTS)]
                    for n, (x, y) in enumerate(PAIRS):
                        both = (kinds[x].astype(np.int64)[:, :, None] << 12) + kinds[y][:, None, :] + (n << 24)
                        ok = (kinds[x] >= 0)[:, :, None] & (kinds[y] >= 0)[:, None, :]
                        row, _, _ = np.nonzero(ok)
                        yield pa.record_batch([pa.array(both[ok]), pa.array(fp[row])], names=["key", "fp"])

        return rows

    small = fps.select("fp").mapInArrow(filed(True), "key long, fp long").withColumnRenamed("fp", "v")
    large = fps.select("fp").mapInArrow(filed(False), "key long, fp long").withColumnRenamed("fp", "u")
    near = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS)
    return large.join(small, "key").where(near).select("u", "v")


def grouped(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, key, fp, root (a fingerprint that names the component), component_id per row."""
    own = store(fingerprints(docs, size), "fingerprints")
    nodes = store(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.select("fp", "root").join(least, "root")
    return own.join(named, "fp").select("doc_id", "key", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, size: int = 3) -> DataFrame:
    """One row per document: doc_id, fp, component_id (smallest doc_id reachable over links of fingerprints).

    Equal fingerprints are one node, so copies are never expanded into pairs. Null texts count as empty; texts
    without words have fingerprint zero and link like any other. Repeated rows keep a row each; a null doc_id
    never becomes a component_id unless its component has no other. Empty table: no rows. Other columns are
    not read.
    """
    return grouped(docs, size).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, size: int = 3) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest doc_id stays, null ids last.

    Rows that share that doc_id rank by their text's digest, and of equal rows one stays. All columns stay.
    """
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("_d"), F.col("key").alias("_key"))).alias("first")
    kept = grouped(docs, size).groupBy("root").agg(first).select("first.*")
    keyed = docs.withColumns({"_d": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "_key": F.xxhash64("text")})
    return keyed.join(kept, ["_d", "_key"], "left_semi").dropDuplicates(["_d", "_key"]).drop("_d", "_key")
