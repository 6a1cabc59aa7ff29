"""Benchmark decontamination by SimHash windows of an item's size, with DataFrame functions only.

Texts are compared as words (runs of letters and digits, lower case) by their five-word shingles. A document's
windows that can be similar to an item share a shingle with it, so that windows are placed where one of the
item's shingles occurs, aligned with its place in the item; where the aligned window would reach over an end of
the document, as with an item clipped there, the window at that end is taken. A window's SimHash fingerprint is compared with
those of the items of its size by multi-index blocks: two fingerprints at most RADIUS bits apart agree in at
least one of RADIUS + 1 blocks, so equality on a block finds all of them. What lies within the radius is then
verified exactly: the shingles, weighted by how often they occur, must have a Jaccard similarity of at least
0.8. At that similarity fingerprints differ in about 9 bits, deviating by 3; the radius leaves four times that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import NO_ID, store

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 20
#: Shingles of items, and documents with a hit, that are broadcast at most; beyond, joins shuffle.
BROADCAST_SHINGLES, BROADCAST_DOCUMENTS = 2_000_000, 100_000
#: (first bit, bits) of each block.
BLOCKS = [(64 * i // (RADIUS + 1), 64 * (i + 1) // (RADIUS + 1) - 64 * i // (RADIUS + 1)) for i in range(RADIUS + 1)]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(w: Column) -> Column:
    """Hashes of all runs of SHINGLE words, in order; none of shorter texts."""
    every = F.transform(F.sequence(F.lit(1), F.size(w) - SHINGLE + 1), lambda i: F.xxhash64(F.slice(w, i, SHINGLE)))
    return F.when(F.size(w) >= SHINGLE, every).otherwise(F.array().cast("array<bigint>"))


def fingerprint(hashes: Column) -> Column:
    """SimHash: bit i is set if more than half of the hashes have it."""
    bit = lambda i: F.aggregate(hashes, F.lit(0), lambda n, h: n + F.when(F.getbit(h, i) == 1, 1).otherwise(0))
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(bit(i) * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def blocks(fp: Column) -> Column:
    return F.array(*(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, at).bitwiseAND((1 << n) - 1).alias("value")) for i, (at, n) in enumerate(BLOCKS)))


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two lists of hashes, repeats as weights."""
    times = lambda x, h: F.size(F.filter(x, lambda y: y == h))
    shared = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, h: n + F.least(times(a, h), times(b, h)))
    return shared / (F.size(a) + F.size(b) - shared)


def _exploded(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that later projections read instead of computing it again."""
    return df.select("*", F.explode(F.array(F.struct(value.alias("x")))).alias("_one")).withColumn(name, F.col("_one.x")).drop("_one")


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY, whole: bool = False) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, key, item_id, similarity, start_word.

    start_word is the first word of the most similar window, from 0. Null and empty texts, and items of fewer
    than five words, match nothing. Repeated items are items of their own; key (a digest of the text) tells rows
    apart that share a doc_id or have none, and equal rows count as one. An item longer than the document is
    compared with all of it if whole, else not at all. Empty tables: no rows. Other columns are not read.
    """
    items = _exploded(benchmark.select("item_id", words(F.col("text")).alias("w")), "hashes", shingles(F.col("w"))).where("size(hashes) > 0")
    items = _exploded(items.select("item_id", "hashes"), "fp", fingerprint(F.col("hashes"))).withColumn("n", F.size("hashes"))
    items = store(items.withColumn("item", F.xxhash64("item_id", "hashes")).dropDuplicates(["item_id", "item"]), "items")
    of_items = items.select("n", F.posexplode("hashes").alias("at", "h")).distinct()
    bounded = of_items.count() <= BROADCAST_SHINGLES

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if bounded else df

    key = F.xxhash64("text")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), F.col("text"))
    hashed = _exploded(_exploded(own, "w", words(F.col("text"))).select("doc_id", "key", "w"), "hashes", shingles(F.col("w"))).select("doc_id", "key", "hashes")
    hits = hashed.select("doc_id", "key", F.size("hashes").alias("m"), F.posexplode("hashes").alias("p", "h")).join(small(of_items), "h")
    fits = F.col("n") <= F.col("m")
    start = F.greatest(F.least(F.col("p") - F.col("at"), F.col("m") - F.col("n")), F.lit(0))
    hits = hits.where(fits | (F.col("m") >= threshold * F.col("n")) if whole else fits)
    hits = hits.groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), "key").agg(F.collect_set(F.struct(start.alias("start"), "n")).alias("places"))
    hits = store(hits, "hits")
    few = hits.count() <= BROADCAST_DOCUMENTS
    found = own.withColumn("d", F.coalesce("doc_id", F.lit(NO_ID))).join(F.broadcast(hits) if few else hits, ["d", "key"])
    found = _exploded(_exploded(found.dropDuplicates(["d", "key"]), "w", words(F.col("text"))).select("doc_id", "key", "w", "places"), "hashes", shingles(F.col("w")))
    windows = found.select("doc_id", "key", F.explode(F.transform("places", lambda x: F.struct(x["start"].alias("start"), x["n"].alias("n"), F.slice("hashes", x["start"] + 1, x["n"]).alias("window")))).alias("x")).select("doc_id", "key", "x.*")
    windows = store(_exploded(windows, "fp", fingerprint(F.col("window"))), "windows")
    filed = items.select("item_id", "hashes", F.col("n"), F.col("fp").alias("item_fp"), F.explode(blocks(F.col("fp"))).alias("b"))
    near = windows.withColumn("b", F.explode(blocks(F.col("fp")))).join(small(filed), ["n", "b"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    # a pair that agrees in several blocks is judged in the first of them
    differ = F.col("fp").bitwiseXOR(F.col("item_fp"))
    earlier = F.lit(False)
    for i, (at, n) in enumerate(BLOCKS[:-1]):
        earlier = earlier | ((F.col("b.block") > i) & (F.shiftrightunsigned(differ, at).bitwiseAND((1 << n) - 1) == 0))
    judged = _exploded(near.where(~earlier), "similarity", similarity(F.col("window"), F.col("hashes"))).where(F.col("similarity") >= threshold)
    best = judged.groupBy("doc_id", "key", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("start"))).alias("best"))
    return best.select("doc_id", "key", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.start")).alias("start_word"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark item, or are most of one. All columns stay."""
    found = leaks(docs, benchmark, whole=True).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_d"), F.col("key").alias("_key")).distinct()
    match = (F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == found["_d"]) & (F.xxhash64(docs["text"]) == found["_key"])
    return docs.join(found, match, "left_anti")
