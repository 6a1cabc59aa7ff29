"""Probabilistic suffix tree over words, and the unigram base it is compared with.

A document is a start mark, its words and an end mark. The states of the tree are contexts: up to `depth` symbols
before the next one. A state's distribution is its own counts mixed with its parent's distribution (the context
less its first symbol); the root's is the base: each training token's count and one for unknown words. A context
is retained if it occurs twice or more, its parent is retained and has several successors, and its distribution
diverges from its parent's: over all training tokens that follow it, each left out of the counts that predict it,
its own distribution gains `divergence` digits a token on average. A token is scored by the longest suffix of what
precedes it that is a retained state. All words and contexts of the corpus are candidates: the tree grows with it.

Nothing of the tree comes to the driver or to every task. Documents are kept in buckets of bounded size, words and
contexts as 64-bit hashes. A bucket sends out its counts, sorted and packed by shards of the hashes, and gets the
totals back in the same order; of longer contexts it sends only those whose parts other buckets share, since no
other total can differ from its own. Then all contexts' gains travel the same way, with their totals, and one bit comes
back: whether their sum is enough. A hot word is one entry a bucket. What came back is kept in buckets, so that it moves
once and not at each later step.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import added, at_least, remainder, store_by, text_bytes

U = np.uint64
DEPTH, DIVERGENCE = 2, 0.01
#: What a state with many tokens leaves to its parent.
LEFT = 0.3
#: Bytes of text in a bucket.
BUCKET = 8e6
#: Gains are added up in thousandths of a digit, as whole numbers, so that their order does not matter.
UNIT = 1000
START, END = U(1), U(2)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> U(31)
    x *= U(0x9E3779B97F4A7C15)
    x ^= x >> U(29)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(32)
    return x


def _numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct hashes, a place of each, and the number of the hash at each place."""
    order = np.argsort(hashes)
    same = hashes[order]
    new = np.flatnonzero(np.concatenate(([True], same[1:] != same[:-1])) if len(same) else np.empty(0, bool))
    number = np.empty(len(hashes), np.int32)
    number[order] = np.repeat(np.arange(len(new), dtype=np.int32), np.diff(new, append=len(hashes)))
    return same[new], order[new], number


def _left(total: np.ndarray) -> np.ndarray:
    """The weight of a state's parent: one without tokens, and LEFT with many."""
    return LEFT + (1 - LEFT) / (total + 1)


def _bucket(ids: pa.Array, text: pa.Array, held: pa.Array, number: int) -> pa.RecordBatch:
    """A row of TOKENS: documents, and their tokens as places in the list of word hashes."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text))
    flat = lists.flatten().dictionary_encode()
    words = flat.dictionary.to_numpy(zero_copy_only=False)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    at = flat.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    doc = np.repeat(np.arange(len(text)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    empty = np.flatnonzero(words == "")
    if len(empty):  # white space at either end splits off an empty part
        real = at != empty[0]
        at, doc = at[real], doc[real]
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    lengths = np.bincount(doc, minlength=len(text)).astype(np.int64)
    return pa.record_batch([pa.array([number]), one(ids), one(held), one(pa.array(lengths)), one(pa.array(at)), one(pa.array(codes.view(np.int64)))], names=["bucket", "doc_ids", "held", "lengths", "ids", "words"])


TOKENS = "bucket long, doc_ids array<long>, held array<boolean>, lengths array<long>, ids array<int>, words array<long>"


def _tokenised(most: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        parts, size = [], 0
        for b in batches:
            text = b.column(1).cast(pa.large_string()).fill_null("")
            ends, begin = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False)), 0
            while begin < b.num_rows:
                gone = int(ends[begin - 1]) if begin else 0
                stop = min(int(np.searchsorted(ends, gone + most - size)) + 1, b.num_rows)
                parts.append((b.column(0)[begin:stop], text[begin:stop], b.column(2)[begin:stop]))
                size += int(ends[stop - 1]) - gone
                begin = stop
                if size >= most:
                    yield _bucket(*(pa.concat_arrays(x) for x in zip(*parts)), number)
                    parts, size, number = [], 0, number + 1
        if parts:
            yield _bucket(*(pa.concat_arrays(x) for x in zip(*parts)), number)

    return rows


class Bucket:
    """A bucket's grams: each position's symbol with up to depth symbols before it, counted here and by everyone.

    A gram of d + 1 symbols is a context of the position behind it. known: by step, the totals of what the bucket
    sent, in the order of its keys. Steps are the counts of grams of 0 to depth symbols before one; then, for all contexts'
    gains, whether they are enough.
    """

    def __init__(self, row: pa.Table, known: dict[int, np.ndarray]):
        doc_ids, held, lengths, ids, words = (row.column(k).combine_chunks().values for k in ("doc_ids", "held", "lengths", "ids", "words"))
        self.doc_ids, self.held, self.lengths, self.known = doc_ids, held, lengths.to_numpy(), known
        self.number = row.column("bucket")[0].as_py()
        self.doc = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths + 2)
        ends = np.cumsum(self.lengths + 2)
        self.place = (np.arange(len(self.doc)) - (ends - self.lengths - 2)[self.doc]).astype(np.int32)
        inner = (self.place > 0) & (self.place <= self.lengths[self.doc])
        # the words' hashes, and the marks', are numbered; so the tokens need no sorting
        alphabet = _mix(np.concatenate(([START, END], words.to_numpy().view(np.uint64))) * U(0xA0761D6478BD642F))
        of = np.where(self.place == 0, 0, 1)
        of[inner] = ids.to_numpy() + 2
        self.train = ~held.to_numpy(zero_copy_only=False)[self.doc]
        self.codes = alphabet[of]
        self.alphabet, _, number = _numbered(alphabet)
        self.words = number[of]
        # of each level: the positions with a gram, their hashes, its distinct ones, and which of these each position has
        self.grams, self.total, self.shared = [], [], []
        #: Positions whose context may be extended by a symbol.
        self.open = np.ones(len(self.doc), bool)
        self.candidates: list[np.ndarray] = []

    def _spread(self, rows: np.ndarray, values: np.ndarray, kind) -> np.ndarray:
        out = np.zeros(len(self.doc), kind)
        out[rows] = values
        return out

    def count(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts grams of d symbols before one. Returns keys that others may have as well, and their counts here."""
        rows = np.flatnonzero((self.place >= d) & self.open)
        if d == 0:
            hashes, keys, number = self.codes, self.alphabet, self.words
            may = np.ones(len(keys), bool)
        else:
            shorter, of, _, _ = self.grams[d - 1]
            hashes = _mix((of if len(shorter) == len(self.doc) else self._spread(shorter, of, np.uint64))[rows] ^ self.codes[rows - d] * U(2 * d + 1))
            keys, first, number = _numbered(hashes)
            at = rows[first]
            may = self.shared[d - 1][at] & self.shared[d - 1][at - 1]
        own = np.bincount(number[self.train[rows]], minlength=len(keys)).astype(np.int64)
        total = own.copy()
        if d in self.known:
            total[may] = self.known[d]
        self.grams.append((rows, hashes, keys, number))
        self.total.append(self._spread(rows, total[number], np.int64))
        self.shared.append(self._spread(rows, (total != own)[number], bool))
        return keys[may], own[may]

    def narrow(self, d: int, n: int) -> None:
        """Leaves open the positions whose context of d symbols occurs twice and whose parent has several successors."""
        behind = np.flatnonzero((self.place >= d) & self.open)
        seen, parts = self.total[d - 1][behind - 1], self.total[d - 1][behind]
        # a parent's tokens: those of the context that is a symbol shorter
        whole = self.total[d - 2][behind - 1] if d > 1 else n
        self.open = np.zeros(len(self.doc), bool)
        self.open[behind[(seen >= 2) & (parts < whole)]] = True
        self.candidates.append(self.open)

    def counts(self, depth: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts grams of up to depth symbols before one, and returns the longest as count does."""
        out = self.count(0)
        for d in range(1, depth + 1):
            out = self.count(d)
            self.narrow(d, n)
        # what follows needs neither the hashes of positions nor the longest grams
        self.grams = [(rows, None, keys, number) for rows, _, keys, number in self.grams[:depth]]
        self.codes = None
        return out

    def gains(self, n: int, v: int) -> tuple[list[np.ndarray], ...]:
        """For each length of contexts: its distinct ones, which of them others share, their gains here, the candidates' contexts, and totals."""
        keys, shared, own, contexts, totals = [], [], [], [], []
        p = self.total[0] / max(n + v, 1)
        for d, open_ in enumerate(self.candidates, 1):
            rows, _, each, number = self.grams[d - 1]
            behind = np.flatnonzero(open_)
            number = (number if len(rows) == len(self.doc) else self._spread(rows, number, np.int32))[behind - 1]
            live = np.flatnonzero(self.train[behind])
            at = behind[live]
            rest = self.total[d - 1][at - 1] - 1
            left = _left(rest)
            before = p[at]
            p[at] = (1 - left) * (self.total[d][at] - 1) / np.maximum(rest, 1) + left * before
            gain = np.log10(p[at] / before)
            some = np.zeros(len(each), bool)
            some[number] = self.shared[d - 1][behind - 1]
            keys.append(each)
            shared.append(some)
            own.append(np.rint(np.bincount(number[live], gain, len(each)) * UNIT).astype(np.int64))
            contexts.append(number)
            total = np.zeros(len(each), np.int64)
            total[number] = self.total[d - 1][behind - 1]
            totals.append(total)
        return keys, shared, own, contexts, totals

    def sent_gains(self, n: int, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys of the contexts that others may have as well, their gains here, and their totals everywhere."""
        keys, shared, own, _, totals = self.gains(n, v)
        keys, own, totals = (np.concatenate([x[s] for x, s in zip(y, shared)]) for y in (keys, own, totals))
        order = np.argsort(keys)
        return keys[order], own[order], totals[order]

    def retained(self, n: int, v: int, divergence: float) -> Iterator[np.ndarray]:
        """For each length, the positions whose context is a state of the tree."""
        keys, shared, own, contexts, totals = self.gains(n, v)
        back = self.known.get(len(self.candidates) + 1)
        if back is not None:
            sent = np.concatenate([x[s] for x, s in zip(keys, shared)])
            came = np.empty(len(sent), np.int64)
            came[np.argsort(sent)] = back
        begin, parent = 0, np.ones(len(self.doc), bool)
        for d, gain in enumerate(own, 1):
            enough = gain >= divergence * UNIT * totals[d - 1]
            if back is not None:
                end = begin + int(shared[d - 1].sum())
                enough[shared[d - 1]] = came[begin:end] > 0
                begin = end
            behind = np.flatnonzero(self.candidates[d - 1])
            parent = self._spread(behind, enough[contexts[d - 1]], bool) & parent
            yield np.flatnonzero(parent)

    def up_to(self, step: int, depth: int, n: int, v: int) -> tuple[np.ndarray, ...]:
        """What the bucket sends at a step; the steps before it are known."""
        out = self.counts(min(step, depth), n)
        return out if step <= depth else self.sent_gains(n, v)

    def scores(self, depth: int, n: int, v: int, divergence: float) -> tuple[np.ndarray, np.ndarray]:
        """log10 probabilities of all positions by the base and by the tree, zero at start marks."""
        self.counts(depth, n)
        base = (self.total[0] + 1) / (n + v + 1)
        p = base.copy()
        for d, at in enumerate(self.retained(n, v, divergence), 1):
            total = self.total[d - 1][at - 1]
            left = _left(total)
            p[at] = (1 - left) * self.total[d][at] / total + left * p[at]
        marks = self.place == 0
        return np.where(marks, 0.0, np.log10(base)), np.where(marks, 0.0, np.log10(p))


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers, byte by byte of all of them at a time, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<i8").reshape(-1)


SENT = "bucket long, shard int, keys binary, data binary, totals binary"


def _rows(number: int, keys: np.ndarray, values: np.ndarray, *totals: np.ndarray, shards: int) -> pa.Table:
    """A row for each shard of the hashes that holds some of the sorted keys; totals come with gains only."""
    of = ((keys >> U(32)) * U(shards) >> U(32)).astype(np.int64)
    cut = np.flatnonzero(np.diff(of, prepend=-1))
    parts = list(zip(cut.tolist(), [*cut[1:].tolist(), len(keys)]))
    steps = [_packed(np.diff(keys[a:z], prepend=U(0)).view(np.int64)) for a, z in parts]
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    columns = ([number] * len(parts), of[cut], steps, [_packed(values[a:z]) for a, z in parts], [_packed(x[a:z]) for x in totals for a, z in parts] or [None] * len(parts))
    return pa.table([pa.array(x, k) for x, k in zip(columns, kinds)], names=["bucket", "shard", "keys", "data", "totals"])


def _first_counts(shards: int):
    """Each bucket's words, of which nothing is known yet."""

    def rows(batches):
        for b in batches:
            for i in range(b.num_rows):
                bucket = Bucket(pa.table(b.slice(i, 1)), {})
                yield from _rows(bucket.number, *bucket.count(0), shards=shards).to_batches()

    return rows


def _summed(divergence: float):
    """Sums of all that was sent, to each sender in its order; in bucket -1 how many keys have a positive one. Of gains
    it is told only whether they are enough for the key's total."""

    def rows(batches):
        parts = [row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(5)))]
        if not parts:
            return
        keys = [np.cumsum(_unpacked(k).view(np.uint64), dtype=np.uint64) for _, _, k, _, _ in parts]
        values, sizes = np.concatenate([_unpacked(x) for _, _, _, x, _ in parts]), [len(k) for k in keys]
        keys = np.concatenate(keys)
        order = np.argsort(keys)
        new = np.concatenate(([True], keys[order][1:] != keys[order][:-1]))
        total, each = np.add.reduceat(values[order], np.flatnonzero(new)), np.empty(len(keys), np.int64)
        each[order] = total[np.cumsum(new) - 1]
        if parts[0][4] is not None:
            each = (each >= divergence * UNIT * np.concatenate([_unpacked(x) for _, _, _, _, x in parts])).astype(np.int64)
        own = np.split(each, np.cumsum(sizes)[:-1])
        yield pa.record_batch([pa.array([-1]), pa.array([int((total > 0).sum())], pa.int32()), pa.array([b""], pa.binary())], names=["bucket", "shard", "data"])
        for (number, shard, *_), x in zip(parts, own):
            yield pa.record_batch([pa.array([number]), pa.array([shard], pa.int32()), pa.array([_packed(x)], pa.binary())], names=["bucket", "shard", "data"])

    return rows


def _known(table: pa.Table) -> dict[int, np.ndarray]:
    """By step, what came back, in the order of shards and so of keys."""
    out: dict[int, list] = {}
    for step, _, data in sorted(zip(*(table.column(x).to_pylist() for x in ("step", "shard", "data"))), key=lambda x: x[:2]):
        out.setdefault(step, []).append(_unpacked(data))
    return {step: np.concatenate(x) for step, x in out.items()}


def _sent(step: int, shards: int, depth: int, n: int, v: int):
    def rows(row: pa.Table, known: pa.Table) -> pa.Table:
        if not row.num_rows:
            return _rows(0, np.empty(0, np.uint64), np.empty(0, np.int64), shards=shards)
        bucket = Bucket(row, _known(known))
        return _rows(bucket.number, *bucket.up_to(step, depth, n, v), shards=shards)

    return rows


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scored(depth: int, *sizes):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def rows(row: pa.Table, known: pa.Table) -> pa.Table:
        if not row.num_rows:
            return pa.table([pa.array([], k) for k in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=names)
        bucket = Bucket(row, _known(known))
        base, log = bucket.scores(depth, *sizes)
        of = lambda x: np.bincount(bucket.doc, x, len(bucket.lengths))
        n_known = of((bucket.total[0] > 0) & (bucket.place > 0)).astype(np.int64)
        return pa.table([bucket.doc_ids, bucket.held, pa.array(bucket.lengths + 1), pa.array(n_known), pa.array(of(base)), pa.array(of(log))], names=names)

    return rows


def score(docs: DataFrame, held_out: Column | None = None, depth: int = DEPTH, divergence: float = DIVERGENCE, bucket: float = BUCKET) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the documents that are not held out (default: crc32(doc_id as text) mod 7 is 2). Words are
    lower-cased (A-Z), then comes a document's end; score is the tree's log10 probability of all of them,
    base_score that of the smoothed unigram counts. Words count as equal if 64 bits of their hashes are. Null
    texts count as empty: one token, the end. Rows with a null doc_id are learned from. Repeated rows are separate
    documents. Without training documents the base gives each token probability one, and so does the tree. Empty
    table: no rows. Other columns are not read.
    """
    held = F.coalesce(held_out if held_out is not None else remainder(F.col("doc_id"), 7) == 2, F.lit(False))
    n_parts = at_least(docs.sparkSession, text_bytes(docs) / 4 / bucket)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out"))
    tokens = store_by(text.mapInArrow(_tokenised(bucket), TOKENS), "bucket", n_parts, "tokens")
    shards = 4 * n_parts  # of which each of the shuffle's partitions gets about four

    def exchanged(sent: DataFrame, step: int) -> DataFrame:
        sums = sent.repartition(n_parts, "shard").mapInArrow(_summed(divergence), "bucket long, shard int, data binary")
        return sums.withColumn("step", F.lit(step)).repartition(n_parts, "bucket")

    name = f"totals_{uuid.uuid4().hex}"
    known = store_by(exchanged(tokens.mapInArrow(_first_counts(shards), SENT), 0), "bucket", n_parts, "totals", name)
    v = int(known.where("bucket = -1").agg(F.sum("shard")).first()[0] or 0)
    learned = tokens.select(F.explode(F.arrays_zip("held", "lengths")).alias("x")).where("not x.held").agg(F.sum(F.col("x.lengths") + 1), F.count("*")).first()
    total, starts = int(learned[0] or 0), int(learned[1] or 0)
    sizes = (depth, total, v - (starts > 0))  # the start mark is counted with the words, and is none

    def passed(function, kind):
        return tokens.groupBy("bucket").cogroup(known.where("bucket >= 0").groupBy("bucket")).applyInArrow(function, kind)

    for step in range(1, depth + 2 if depth else 1):
        known = added(exchanged(passed(_sent(step, shards, *sizes), SENT), step), name)
    return passed(_scored(*sizes, divergence), SCORED).withColumn("train_tokens", F.lit(total).cast("long"))
