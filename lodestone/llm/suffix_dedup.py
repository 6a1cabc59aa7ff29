"""Exact removal of repeated byte strings across documents by sharded suffix arrays.

Suffix arrays are built per shard, so equal strings must meet in one shard, and only strings that can repeat
should be sorted at all. Every window of `width` bytes has a minimizer, the gram of `gram` bytes with the least
hash in it; equal windows have equal minimizers at equal places. The windows of one minimizer occurrence form a
segment of less than two widths. Segments are dealt by their minimizer's hash:

1. Each task reduces its segments to the earliest of each exact text, so that a hot passage leaves a task once.
2. In each shard of hashes, repeats of a segment's exact text are known to be repeats whole; of hashes with
   several different texts the earliest segment of each text is a candidate.
3. Candidates' bytes are fetched, and a suffix array by induced sorting with permuted common prefixes over the
   texts of a block of hashes finds the windows that occur in several of them; all but the earliest are repeats.
4. The repeats of a document are merged and cut out.

Windows are compared with the whole input, never with what is left of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import NO_ID, at_least, merged, store, text_bytes
from .suffix_array import common_prefixes, suffix_array

BLOCK = 1 << 20
GRAM = 24
#: Segments reduced at a time in a task.
FLUSH = 1 << 20
#: Bytes of candidates under one suffix array, more only if they share a minimizer.
SHARD = 2 << 20
KNOWN = 255
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> U(31)) * U(0x9E3779B97F4A7C15)
    x = (x ^ x >> U(29)) * U(0xBF58476D1CE4E5B9)
    return x ^ x >> U(32)


class _Hashes:
    """Polynomial hashes modulo 2**64 of all substrings of a block."""

    base = 0xD1342543DE82EF95
    symbols = _mix(np.arange(1, 257, dtype=np.uint64) * U(0xA0761D6478BD642F))
    powers = inverses = None

    def __init__(self, body: np.ndarray):
        n = len(body)
        if _Hashes.powers is None or len(_Hashes.powers) < n + 1:
            size = max(n, 2 * BLOCK) + 1
            for name, x in (("powers", self.base), ("inverses", pow(self.base, -1, 1 << 64))):
                of = np.full(size, x, np.uint64)
                of[0] = 1
                setattr(_Hashes, name, np.cumprod(of, dtype=np.uint64))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.symbols[body] * self.powers[:n], dtype=np.uint64)))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix((self.sums[b] - self.sums[a]) * self.inverses[a])

    def grams(self, k: int) -> np.ndarray:
        return _mix((self.sums[k:] - self.sums[:-k]) * self.inverses[: len(self.sums) - k])


def segments(body: np.ndarray, ends: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of a block of pieces that end at ends: each minimizer's hash, its segment's digest, first window, windows, and place."""
    n, w = len(body), width - gram + 1
    if n < width:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 3
    hashes = _Hashes(body)
    grams = hashes.grams(gram)
    bits = U(int(n).bit_length())
    least = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while 2 * size <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if w > size:
        least = np.minimum(least[: size - w], least[w - size :])
    at = (least & U((1 << int(bits)) - 1)).astype(np.int64)
    first = np.arange(len(at))
    whole = first + width <= np.repeat(ends, np.diff(ends, prepend=0))[: len(at)]
    first, at = first[whole], at[whole]
    if not len(first):
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 3
    cut = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
    windows = np.diff(cut, append=len(at))
    a, at = first[cut], at[cut]
    digest = _mix(hashes(a, a + windows + width - 1) ^ ((at - a) * 256 + windows).astype(np.uint64))
    return grams[at], digest, a, windows, at - a


def _pieces(batches, width: int) -> Iterator[tuple[list, list, list, list]]:
    """Blocks of whole documents, or of parts of long ones that overlap by a window less a byte."""
    ids, tags, starts, bodies, size = [], [], [], [], 0
    for b in batches:
        for d, t, body in zip(*(b.column(i).to_pylist() for i in range(3))):
            if body is None or len(body) < width:
                continue
            for at in range(0, len(body) - width + 1, BLOCK):
                piece = body[at : at + BLOCK + width - 1]
                ids.append(d), tags.append(t), starts.append(at), bodies.append(piece)
                size += len(piece)
                if size >= BLOCK:
                    yield ids, tags, starts, bodies
                    ids, tags, starts, bodies, size = [], [], [], [], 0
    if bodies:
        yield ids, tags, starts, bodies


def _firsts(h, digest, d, tag, place) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the earliest row of each (h, digest), and of the later ones; what equals the earliest is in neither."""
    both = _mix(h ^ digest * U(0x2545F4914F6CDD1D))
    order = np.argsort(both, kind="stable")
    same = both[order][1:] == both[order][:-1]
    first, later = np.ones(len(h), bool), np.zeros(len(h), bool)
    member = np.zeros(len(h), bool)
    member[1:] |= same
    member[:-1] |= same
    rows = order[member]
    if len(rows):
        start = place[rows] >> 32
        by = np.lexsort((start, tag[rows], d[rows], both[rows]))
        rows, start = rows[by], start[by]
        new = np.concatenate(([True], (h[rows][1:] != h[rows][:-1]) | (digest[rows][1:] != digest[rows][:-1])))
        head = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
        first[rows[~new]] = False
        later[rows[(d[rows] != d[rows][head]) | (tag[rows] != tag[rows][head]) | (start != start[head])]] = True
    return first, later


SCHEMA = "h long, digest long, d long, tag long, place long"


def _scan(width: int, gram: int):
    """Rows of SCHEMA; d and tag (its text's digest) name a document; place packs first window (high 32 bits), windows (8) and the minimizer's place (8)."""

    def flush(parts):
        h, digest, d, tag, place = (np.concatenate(x) for x in zip(*parts))
        first, later = _firsts(h, digest, d, tag, place)
        kept = first | later
        h, digest, d, tag, place, first = h[kept], digest[kept], d[kept], tag[kept], place[kept], first[kept]
        # what is known already needs no meeting place, and is dealt evenly
        h = np.where(first, h, _mix(place.view(np.uint64) ^ tag.view(np.uint64) ^ d.view(np.uint64) * U(0xD6E8FEB86659FD93)))
        place = np.where(first, place, place | KNOWN)
        for i in range(0, len(h), 1 << 16):
            yield pa.record_batch([pa.array(x[i : i + (1 << 16)]) for x in (h.view(np.int64), digest.view(np.int64), d, tag, place)], names=["h", "digest", "d", "tag", "place"])

    def rows(batches):
        parts, size = [], 0
        for ids, tags, starts, bodies in _pieces(batches, width):
            lengths = np.array([len(x) for x in bodies])
            ends = np.cumsum(lengths)
            h, digest, a, windows, place = segments(np.frombuffer(b"".join(bodies), np.uint8), ends, width, gram)
            if not len(h):
                continue
            of = np.searchsorted(ends, a, side="right")
            start = a - (ends - lengths)[of] + np.array(starts)[of]
            parts.append((h, digest, np.array(ids, np.int64)[of], np.array(tags, np.int64)[of], start << 32 | windows << 8 | place))
            size += len(h)
            if size >= FLUSH:
                yield from flush(parts)
                parts, size = [], 0
        if parts:
            yield from flush(parts)

    return rows


def _columns(batches, n: int) -> list[np.ndarray]:
    parts = [[b.column(i).to_numpy(zero_copy_only=False) for i in range(n)] for b in batches if b.num_rows]
    return [np.concatenate(x) for x in zip(*parts)] if parts else [np.empty(0, np.int64)] * n


def _sort_out(batches):
    """Of the segments of a shard of hashes: known repeats (repeat), and candidates for a suffix array."""
    h, digest, d, tag, place = _columns(batches, 5)
    h, digest = h.view(np.uint64), digest.view(np.uint64)
    known = place & 255 == KNOWN
    yield from _placed(h[known], d[known], tag[known], place[known], True)
    rows = np.flatnonzero(~known)
    order = rows[np.argsort(h[rows], kind="stable")]
    same = h[order][1:] == h[order][:-1]
    member = np.zeros(len(order), bool)
    member[1:] |= same
    member[:-1] |= same
    rows = order[member]
    h, digest, d, tag, place = h[rows], digest[rows], d[rows], tag[rows], place[rows]
    first, later = _firsts(h, digest, d, tag, place)
    yield from _placed(h[later], d[later], tag[later], place[later], True)
    h, d, tag, place = h[first], d[first], tag[first], place[first]
    if len(h):
        same = h[1:] == h[:-1]
        member = np.zeros(len(h), bool)
        member[1:] |= same
        member[:-1] |= same
        yield from _placed(h[member], d[member], tag[member], place[member], False)


def _placed(h, d, tag, place, repeat: bool):
    for i in range(0, len(h), 1 << 16):
        cut = slice(i, i + (1 << 16))
        yield pa.record_batch([pa.array(h[cut].view(np.int64)), pa.array(d[cut]), pa.array(tag[cut]), pa.array(place[cut]), pa.array(np.full(len(h[cut]), repeat))], names=["h", "d", "tag", "place", "repeat"])


def _fetch(width: int):
    def rows(batches):
        for b in batches:
            for d, tag, body, hs, places in zip(*(b.column(i).to_pylist() for i in range(5))):
                out = []
                for p in places:
                    at = p >> 32
                    out.append(body[at : at + (p >> 8 & 255) + width - 1])
                yield pa.record_batch([pa.array(hs, pa.int64()), pa.array([d] * len(hs), pa.int64()), pa.array([tag] * len(hs), pa.int64()), pa.array(places, pa.int64()), pa.array(out, pa.binary())], names=["h", "d", "tag", "place", "body"])

    return rows


def repeats_of(bodies: list[bytes], d: np.ndarray, tag: np.ndarray, place: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the bodies that also occur earlier, as (index of the body, offset in it). The earliest is by (d, tag, start)."""
    lengths = np.array([len(x) for x in bodies])
    starts = np.cumsum(lengths + 1) - lengths - 1
    text = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8)
    s = text.astype(np.int32) + 2
    s[starts + lengths] = 1
    order = suffix_array(np.concatenate((s, [0])))[1:]
    shared = common_prefixes(text, order, width)
    of = np.repeat(np.arange(len(bodies)), lengths + 1)
    offset = np.arange(len(text)) - starts[of]
    # a run of suffixes that share a width; those too near to a body's end to be a window never join one that is
    run = np.cumsum(shared[order] < width)
    valid = offset[order] + width <= lengths[of[order]]
    order, run = order[valid], run[valid]
    same = np.zeros(len(order), bool)
    equal = run[1:] == run[:-1]
    same[1:] |= equal
    same[:-1] |= equal
    order, run = order[same], run[same]
    b = of[order]
    begin = (place[b] >> 32) + offset[order]
    by = np.lexsort((begin, tag[b], d[b], run))
    if len(by):
        new = np.concatenate(([True], run[by][1:] != run[by][:-1]))
        first = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
        # equal rows of the table bring the same window twice
        later = (d[b][by] != d[b][first]) | (tag[b][by] != tag[b][first]) | (begin[by] != begin[first])
        order = order[by][later]
    return of[order], offset[order]


def _sorted_out(width: int):
    """Suffix arrays over blocks of hashes: d, tag, span of the windows that also occur earlier."""

    def rows(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        h, d, tag, place = (np.concatenate(x) for x in zip(*([b.column(i).to_numpy() for i in range(4)] for b in batches)))
        bodies = [x for b in batches for x in b.column(4).to_pylist()]
        order = np.argsort(h, kind="stable")
        size = np.cumsum([len(bodies[i]) + 1 for i in order])
        new = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
        begin = 0
        while begin < len(order):
            base = size[begin - 1] if begin else 0
            stop = new[(new > begin) & (size[new - 1] - base >= SHARD)][:1]
            stop = int(stop[0]) if len(stop) else len(order)
            part = order[begin:stop]
            of, offset = repeats_of([bodies[i] for i in part], d[part], tag[part], place[part], width)
            begin = stop
            if not len(of):
                continue
            key = of.astype(np.int64) << 32 | offset
            key.sort()
            cut = np.concatenate(([0], np.flatnonzero(np.diff(key) != 1) + 1))
            last = np.concatenate((cut[1:], [len(key)])) - 1
            whose = part[key[cut] >> 32]
            start = (place[whose] >> 32) + (key[cut] & 0xFFFFFFFF)
            end = start + (key[last] - key[cut]) + width
            yield pa.record_batch([pa.array(d[whose]), pa.array(tag[whose]), pa.array(start << 32 | end)], names=["d", "tag", "span"])

    return rows


def _cut(batches):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for b in batches:
        ids, n_bytes, kept, spans = [], [], [], []
        for doc_id, body, own in zip(*(b.column(i).to_pylist() for i in range(3))):
            body = body or b""
            runs = merged(own) if own else []
            ids.append(doc_id), n_bytes.append(len(body))
            spans.append([{"start": x, "end": y} for x, y in runs])
            edges = [0, *(x for run in runs for x in run), len(body)]
            kept.append(b"".join(body[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)) if runs else body)
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kind)], names=["doc_id", "n_bytes", "kept", "spans"])


def remove_repeats(docs: DataFrame, width: int = 100, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_bytes, kept (binary), spans (array of start, end in bytes: what was removed).

    Removes each byte covered by a string of `width` bytes that also starts earlier: in a smaller doc_id, or
    earlier in the same document; overlaps count. Null texts count as empty, a null doc_id ranks last. Rows that
    share a doc_id rank by a digest of their text; equal rows count as one, and each gets its result. Texts
    shorter than `width` and empty tables lose nothing. Other columns are not read.
    """
    if not width // 8 <= gram < width < 128:
        raise ValueError("width must be under 128 and gram shorter than it")
    spark = docs.sparkSession
    body = F.col("text").cast("binary")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64("text").alias("tag"), body.alias("body"), F.col("doc_id").cast("long").alias("doc_id"))
    n = at_least(spark, text_bytes(docs) / 40e6)
    found = keyed.select("d", "tag", "body").mapInArrow(_scan(width, gram), SCHEMA).repartition(n, "h")
    found = store(found.mapInArrow(_sort_out, "h long, d long, tag long, place long, repeat boolean"), "segments")
    candidates = found.where("not repeat")
    of = candidates.groupBy("d", "tag").agg(F.collect_list("h").alias("hs"), F.collect_list("place").alias("places"))
    bodies = keyed.select("d", "tag", "body").join(of, ["d", "tag"]).select("d", "tag", "body", "hs", "places")
    shards = bodies.mapInArrow(_fetch(width), "h long, d long, tag long, place long, body binary").repartition(at_least(spark, candidates.count() / 100e3), "h")
    sorted_out = shards.mapInArrow(_sorted_out(width), "d long, tag long, span long")
    start = F.shiftright("place", 32)
    windows = F.shiftright("place", 8).bitwiseAND(255)
    known = found.where("repeat").select("d", "tag", (F.shiftleft(start, 32) + start + windows + (width - 1)).alias("span"))
    spans = known.union(sorted_out).groupBy("d", "tag").agg(F.collect_list("span").alias("spans"))
    return keyed.join(spans, ["d", "tag"], "left").select("doc_id", "body", "spans").mapInArrow(_cut, "doc_id long, n_bytes long, kept binary, spans array<struct<start:long,end:long>>")
