"""Removal of repeated lines, sentences or paragraphs by global digests of their normalised text.

A text is cut at line ends and, by default, after sentences as well. A unit begins at each cut and runs over as
many of these parts as make up min_words words, so that short parts count with what follows them, and a passage
inside a longer line is found from its first whole sentence on. Units overlap; what is removed is their union.

Each task keeps the earliest unit of each digest and gives out the others as repeats, so that a unit which a
third of all rows hold leaves a task once a flush; the earliest ones meet by digest, once.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import NO_ID, WORD, at_least, merged, release, store, text_bytes

#: Shorter units, and those of fewer distinct words, repeat by chance.
MIN_WORDS, MIN_DISTINCT = 20, 10
#: Units reduced at a time in a task.
FLUSH = 500_000
_WS = r"[\x20\x09-\x0D]"
_WORDS = re.compile(WORD)
#: What ends a part; it reaches to the first word of the next one.
ENDS = {
    "sentence": re.compile(rf"[.!?][!-/:-@\[-`{{-~]*{_WS}+|\n{_WS}*"),
    "line": re.compile(rf"\n{_WS}*"),
    "paragraph": re.compile(rf"\n[\x20\x09\x0B-\x0D]*\n{_WS}*"),
}


def units(text: str, by: str = "sentence", min_words: int = MIN_WORDS, min_distinct: int = MIN_DISTINCT) -> list[tuple[int, int, bytes]]:
    """Start and end (in characters, the white space behind it included) and digest of each unit.

    The digest is 128 bits of the words (runs without ASCII white space) in lower case, single spaces between.
    What is left at the end of a text with too few words, or has too few distinct ones, is no unit.
    """
    cuts = [0, *(m.end() for m in ENDS[by].finditer(text)), len(text)]
    parts = [_WORDS.findall(text[a:z].lower()) for a, z in zip(cuts, cuts[1:])]
    found, stop, n = [], 0, 0
    for start, own in enumerate(parts):
        while n < min_words and stop < len(parts):
            n += len(parts[stop])
            stop += 1
        if n < min_words:
            break
        if own:
            words = [w for part in parts[start:stop] for w in part]
            if len(set(words)) >= min_distinct:
                found.append((cuts[start], cuts[stop], xxhash.xxh3_128_digest(" ".join(words))))
        n -= len(own)
    return found


def _earliest(h1, h2, d, tag, span) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the earliest row of each digest, and of those at later places; what equals the earliest is in neither."""
    first, later = np.ones(len(h1), bool), np.zeros(len(h1), bool)
    order = np.argsort(h1, kind="stable")
    same = h1[order][1:] == h1[order][:-1]
    member = np.zeros(len(h1), bool)
    member[1:] |= same
    member[:-1] |= same
    rows = order[member]
    if len(rows):
        rows = rows[np.lexsort((span[rows], tag[rows], d[rows], h2[rows], h1[rows]))]
        new = np.concatenate(([True], (h1[rows][1:] != h1[rows][:-1]) | (h2[rows][1:] != h2[rows][:-1])))
        head = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
        first[rows[~new]] = False
        later[rows] = (d[rows] != d[head]) | (tag[rows] != tag[head]) | (span[rows] != span[head])
    return first, later


UNIT = "h1 long, h2 long, d long, tag long, span long"


def _batches(columns, names):
    for i in range(0, len(columns[0]), 1 << 16):
        yield pa.record_batch([pa.array(x[i : i + (1 << 16)]) for x in columns], names=names)


def _scan(by: str, min_words: int, min_distinct: int):
    """Rows of UNIT and whether they are repeats for sure; a span packs start and end."""

    def flush(both, d, tag, span):
        both = np.frombuffer(b"".join(both), np.int64).reshape(-1, 2)
        h1, h2, d, tag, span = both[:, 0].copy(), both[:, 1].copy(), np.array(d, np.int64), np.array(tag, np.int64), np.array(span, np.int64)
        first, later = _earliest(h1, h2, d, tag, span)
        kept = first | later
        # a repeat needs no meeting place, and is dealt evenly
        h1 = np.where(later, np.random.default_rng(len(h1)).integers(0, 1 << 62, len(h1)), h1)
        yield from _batches([x[kept] for x in (h1, h2, d, tag, span, later)], ["h1", "h2", "d", "tag", "span", "repeat"])

    def rows(batches):
        release()
        both, ids, tags, spans = [], [], [], []
        for b in batches:
            for d, tag, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                for start, end, digest in units(text or "", by, min_words, min_distinct):
                    both.append(digest), ids.append(d), tags.append(tag), spans.append(start << 32 | end)
                if len(both) >= FLUSH:
                    yield from flush(both, ids, tags, spans)
                    both, ids, tags, spans = [], [], [], []
        if both:
            yield from flush(both, ids, tags, spans)

    return rows


def _sort_out(batches):
    """d, tag, span of all repeats among the units of a shard of digests."""
    parts = [[b.column(i).to_numpy(zero_copy_only=False) for i in range(6)] for b in batches if b.num_rows]
    if not parts:
        return
    h1, h2, d, tag, span, repeat = (np.concatenate(x) for x in zip(*parts))
    rest = np.flatnonzero(~repeat)
    _, later = _earliest(*(x[rest] for x in (h1, h2, d, tag, span)))
    repeat[rest[later]] = True
    yield from _batches([x[repeat] for x in (d, tag, span)], ["d", "tag", "span"])


def _cut(batches):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    release()
    for b in batches:
        kept, spans = [], []
        for text, gone in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            runs = merged(gone) if gone else []
            edges = [0, *(x for run in runs for x in run), len(text or "")]
            kept.append("".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)) if runs else text)
            spans.append([{"start": a, "end": z} for a, z in runs])
        yield pa.record_batch([*b.columns[2:], pa.array(kept, pa.string()), pa.array(spans, kind)], names=[*b.schema.names[2:], "_kept", "_spans"])


def _place() -> tuple[Column, Column]:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.coalesce(F.xxhash64("text"), F.lit(0))


def remove_repeated_units(docs: DataFrame, by: str = "sentence", min_words: int = MIN_WORDS, min_distinct: int = MIN_DISTINCT) -> DataFrame:
    """docs with `_kept`, the text without the units that also occur earlier, and `_spans`, what was removed.

    by: "sentence" (parts end after sentences and lines), "line" or "paragraph" (ended by blank lines). Units are
    compared in lower case and with single spaces. Of equal units the earliest stays: in the smallest doc_id,
    there the first. Spans are character offsets in the original text, the white space behind a removed unit
    included; they are maximal and do not touch. Null texts stay null, a null doc_id ranks last. Rows that share
    a doc_id rank by a digest of their text; equal rows count as one, and each keeps what that one keeps. Empty
    table: no rows. All columns stay; names beginning with an underscore are reserved.
    """
    (d, tag), n = _place(), at_least(docs.sparkSession, text_bytes(docs) / 40e6)
    own = docs.select(d.alias("d"), tag.alias("tag"), "text").mapInArrow(_scan(by, min_words, min_distinct), f"{UNIT}, repeat boolean")
    gone = store(own.repartition(n, "h1").mapInArrow(_sort_out, "d long, tag long, span long"), "repeats")
    gone = gone.groupBy("d", "tag").agg(F.collect_list("span").alias("_gone")).select(F.col("d").alias("_d"), F.col("tag").alias("_tag"), "_gone")
    keyed = docs.withColumn("_d", d).withColumn("_tag", tag)
    joined = keyed.join(gone, ["_d", "_tag"], "left").select(F.col("text").alias("_text"), "_gone", *(F.col(f"`{c}`") for c in docs.columns))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(_cut, f"{kinds}, _kept string, _spans array<struct<start:long,end:long>>")
