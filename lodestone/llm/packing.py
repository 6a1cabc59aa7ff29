"""Best-fit packing of tokenised documents after Martello-Toth dominance reduction.

A sequence holds `capacity` tokens, so there are at most that many distinct piece lengths, and the whole
instance is a histogram of them, of bounded size whatever the corpus. The driver packs the histogram: sets of
one or two pieces that provably dominate every other way to place the larger of them are fixed for good, which
shrinks the instance; the rest goes best-fit by decreasing length. Both work on whole counts at a time and
yield groups of sequences of one pattern. Pieces of one length are interchangeable: each gets a rank among
them, computed in the executors, and the rank says which sequence and place it has.
"""

from __future__ import annotations

import bisect
import json
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import held, store, text_bytes

CAPACITY = 4096
#: Pieces of one length and salt that are ranked together.
GROUP = 50_000


def reduce(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fixes dominating sets: takes them out of counts, and returns (lengths, number of sequences).

    A piece that fits with no other is alone. A piece and the largest partner that fits dominate all other sets
    with that piece if the two fill the sequence, if no two further pieces fit, or if no three further ones do and
    the partner is at least as long as any two that fit together: the partner may then change places with them.
    """
    fixed = []

    def take(n: int, *lengths: int) -> None:
        fixed.append((lengths, n))
        for x in lengths:
            counts[x] -= n
            if not counts[x]:
                del counts[x], lengths_left[bisect.bisect_left(lengths_left, x)]

    lengths_left = sorted(counts)
    for x in sorted(counts, reverse=True):
        while counts.get(x):
            room = capacity - x
            i = bisect.bisect_right(lengths_left, room) - 1
            while i >= 0 and lengths_left[i] == x and counts[x] == 1:
                i -= 1
            if i < 0:
                take(counts[x] if 2 * x > capacity else 1, x)
                continue
            k = lengths_left[i]
            n = counts[x] // 2 if k == x else min(counts[x], counts[k])
            least = lengths_left[0]
            if k != room and 2 * least <= room and (3 * least <= room or _two(lengths_left, room) > k):
                break
            take(n, x, k)
    return fixed


def _two(lengths: list[int], room: int) -> int:
    """The largest sum of two lengths, one maybe twice, that is at most room; zero without one."""
    best, j = 0, len(lengths) - 1
    for i, x in enumerate(lengths):
        while j >= i and x + lengths[j] > room:
            j -= 1
        if j < i:
            break
        best = max(best, x + lengths[j])
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit by decreasing length over whole counts: (lengths, number of sequences) of each pattern."""
    open_: dict[int, list] = {}
    rooms: list[int] = []

    def put(pattern, n, room) -> None:
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append((pattern, n))

    for x in sorted(counts, reverse=True):
        left = counts[x]
        while left:
            i = bisect.bisect_left(rooms, x)
            if i < len(rooms):
                room = rooms[i]
                pattern, n = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[i]
            else:
                room, pattern, n = capacity, (), left
            each = min(room // x, left)
            full = min(n, left // each)
            put(pattern + (x,) * each, full, room - each * x)
            if pattern and n > full:
                put(pattern, n - full, room)
            left -= each * full
    return [group for groups in open_.values() for group in groups]


@dataclass
class Plan:
    """By length, runs of ranks: where each begins, its first sequence, and its place in the sequences."""

    sequences: int = 0
    runs: dict[int, list] = field(default_factory=dict)

    def add(self, lengths: tuple[int, ...], n: int, used: dict[int, int]) -> None:
        at = 0
        for x in lengths:
            self.runs.setdefault(x, []).append((used.get(x, 0), self.sequences, at))
            used[x] = used.get(x, 0) + n
            at += x
        self.sequences += n

    def arrays(self) -> tuple[np.ndarray, ...]:
        rows = np.array([(x << 40 | rank, base, at, rank) for x, runs in sorted(self.runs.items()) for rank, base, at in runs], np.int64).reshape(-1, 4)
        return tuple(rows[np.argsort(rows[:, 0])].T.copy())


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    counts, out, used = {x: n for x, n in counts.items() if n}, Plan(), {}
    for lengths, n in reduce(counts, capacity):
        out.add(lengths, n, used)
    for lengths, n in best_fit(counts, capacity):
        out.add(lengths, n, used)
    return out


def splits_at_white_space(made: dict) -> bool:
    """Whether a tokenizer, as its file describes it, lower-cases and then keeps only pieces without white space, letters apart from points."""
    listed = lambda x, key: x[key] if x and x["type"] == "Sequence" else [x] if x else []
    normal = [x["type"] for x in listed(made.get("normalizer"), "normalizers")]
    first = (listed(made.get("pre_tokenizer"), "pretokenizers") or [{}])[0]
    pieces = first.get("pattern", {}).get("Regex") if first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") else None
    if "Lowercase" not in normal or not set(normal) <= {"NFC", "Replace", "Lowercase"} or pieces is None:
        return False
    return all(regex.findall(pieces, f"ab{x}cd") == ["ab", "cd"] for x in map(chr, (9, 10, 11, 12, 13, 32))) and regex.findall(pieces, "ab. cd, ef") == ["ab", ".", "cd", ",", "ef"]


class _Ids:
    """Token ids of texts. Of a tokenizer that lower-cases, and drops white space first of all, no token reaches over
    white space or depends on case, so that each distinct part is tokenised once; others get whole texts.

    Parts are tokenised many at a time, with a special token between them. Two generations of known parts keep
    the frequent ones and bound the memory.
    """

    BETWEEN = "<|startoftext|>"

    def __init__(self, path: str, most: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.new, self.old, self.most = Tokenizer.from_file(path), {}, {}, most
        self.between = self.tokenizer.token_to_id(self.BETWEEN)
        self.by_parts = splits_at_white_space(json.loads(self.tokenizer.to_str()))

    def learn(self, words: list[str], at_a_time: int = 400) -> None:
        if self.between is None:
            plain, rest = [], words
        else:
            rest = [w for w in words if "<|" in w]
            plain = [w for w in words if "<|" not in w]
        groups = [plain[i : i + at_a_time] for i in range(0, len(plain), at_a_time)]
        for group in groups:
            # one at a time: what the library returns is many times the size of the ids
            ids = np.array(self.tokenizer.encode_batch_fast([self.BETWEEN.join(group)], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(ids == self.between).tolist()
            for w, a, z in zip(group, [0, *(x + 1 for x in cut)], [*cut, len(ids)]):
                self.new[w] = ids[a:z].tobytes()
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            self.new[w] = np.array(e.ids, np.uint32).tobytes()

    def known(self, words: list[str]) -> list[bytes]:
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        missing = []
        for w in words:
            if w not in self.new:
                if (ids := self.old.get(w)) is None:
                    missing.append(w)
                else:
                    self.new[w] = ids
        self.learn(missing)
        return list(map(self.new.__getitem__, words))

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many belong to each text."""
        if not self.by_parts:
            own = [np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, np.uint32) for x in text.to_pylist()]
            return np.concatenate([np.empty(0, np.uint32), *own]), np.array([len(x) for x in own], np.int64)
        # case and a point or comma after a letter change no other token, and make for fewer distinct parts
        if not pc.any(pc.match_substring(text, "<|")).as_py():
            text = pc.replace_substring_regex(pc.ascii_lower(text), r"([a-z])([.,])(\s|$)", r"\1 \2\3")
        lists = pc.ascii_split_whitespace(text)
        flat = lists.flatten().dictionary_encode()
        parts, at = self.known(flat.dictionary.to_pylist()), flat.indices.to_numpy(zero_copy_only=False)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        pool = np.frombuffer(b"".join(parts), np.uint32)
        begin = np.cumsum(sizes) - sizes
        n = sizes[at]
        ends = np.cumsum(n)
        ids = pool[np.repeat(begin[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        total = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(lengths)))]
        return ids, np.diff(total)


def _pieces(path: str, end: int, capacity: int, rows_at_a_time: int = 1000):
    def rows(batches):
        # a worker keeps its tokenizer from task to task
        ids_of = held(path, lambda: _Ids(path))
        for b in batches:
            for i in range(0, b.num_rows, rows_at_a_time):
                part = b.slice(i, rows_at_a_time)
                ids, sizes = ids_of(part.column(1).fill_null(""))
                out, at = [], 0
                for doc_id, n in zip(part.column(0).to_pylist(), sizes.tolist()):
                    own = np.append(ids[at : at + n], np.uint32(end)).astype("<u4")
                    at += n
                    for p, start in enumerate(range(0, n + 1, capacity)):
                        piece = own[start : start + capacity]
                        out.append((doc_id, p, start, len(piece), zlib.crc32(piece)))
                columns = list(zip(*out))
                yield pa.record_batch([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows


def pieces(docs: DataFrame, tokenizer: str, end: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the end id, cut only where they exceed capacity."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(tokenizer, end, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows that have a length (at most capacity), each with sequence_id and offset. cut is read twice: store it first."""
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    made = plan(histogram, capacity)
    salts = max(1, -(-sum(histogram.values()) // GROUP))
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    sizes = salted.groupBy("length", "_salt").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", "_salt", F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("_rank", rank - 1).join(sizes, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    names = cut.columns
    runs = cut.sparkSession.sparkContext.broadcast(made.arrays())

    def rows(batches):
        keys, bases, places, ranks = runs.value
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in ("length", "_rank"))
            run = np.searchsorted(keys, length << 40 | rank, side="right") - 1
            own = [b.column(b.schema.get_field_index(x)) for x in names]
            yield pa.record_batch([*own, pa.array(bases[run] + rank - ranks[run]), pa.array(places[run])], names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.mapInArrow(rows, f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, end: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece with the end id alone. Repeated rows are packed each; which of equal
    pieces gets which place is not told apart by anything but their order by doc_id and piece. A null doc_id
    stays null. Empty table: no rows. Other columns are not read. The tokenizer's file is opened in each
    task, so its path must exist on all machines, as an installed package's does.
    """
    spread = max(1, int(text_bytes(docs) / 16e6))
    if docs.rdd.getNumPartitions() < spread // 4:
        docs = docs.select("doc_id", "text").repartition(spread)
    return place(store(pieces(docs, tokenizer, end, capacity), "pieces"), capacity)
