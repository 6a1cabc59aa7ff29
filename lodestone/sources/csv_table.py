"""Delimited text: fields in quotes over any number of lines, ragged records, and the check of quotes.

Lines are read in parallel. Whether a line begins within quotes depends on all lines before it, so that each
block of lines is first reduced to what it does to either state; the driver folds these few numbers, and each
block is then cut into records from its own state. Records that cross a border between blocks are put together
from their pieces by a shuffle of these pieces alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Parser:
    """Records of one text; `"` quotes a field and is doubled in one. Blank lines are no records."""

    def __init__(self, delimiter: str = ",", strict: bool = True):
        self.delimiter, self.strict = delimiter, strict

    def feed_all(self, text: str) -> Iterator[list[str]]:
        at, n, d = 0, len(text), self.delimiter
        while at < n:
            if text[at] in "\r\n":
                at += 1
                continue
            fields = []
            while True:
                if at < n and text[at] == '"':
                    value, at = self._quoted(text, at + 1)
                else:
                    end = at
                    while end < n and text[end] != d and text[end] not in "\r\n":
                        end += 1
                    value, at = text[at:end], end
                fields.append(value)
                if at < n and text[at] == d:
                    at += 1
                    continue
                break
            yield fields

    def _quoted(self, text: str, at: int) -> tuple[str, int]:
        parts = []
        while True:
            end = text.find('"', at)
            if end < 0:
                if self.strict:
                    raise ValueError("a quoted field is not ended")
                return "".join([*parts, text[at:]]), len(text)
            parts.append(text[at:end])
            if text[end + 1 : end + 2] == '"':
                parts.append('"')
                at = end + 2
                continue
            at = end + 1
            if at < len(text) and text[at] != self.delimiter and text[at] not in "\r\n":
                if self.strict:
                    raise ValueError("text after a closing quote")
                stop = at
                while stop < len(text) and text[stop] != self.delimiter and text[stop] not in "\r\n":
                    stop += 1
                parts.append(text[at:stop])
                at = stop
            return "".join(parts), at


def segments(line: str, quoted: bool, delimiter: str) -> tuple[list[str], bool]:
    """A line's parts between carriage returns outside of quotes, and whether the next line begins within quotes."""
    if not quoted and '"' not in line:
        return line.split("\r"), False
    stop = re.compile(f"[\r{re.escape(delimiter)}]")
    out, begin, at = [], 0, 0
    while True:
        if quoted:
            end = line.find('"', at)
            if end < 0:
                return [*out, line[begin:]], True
            if line[end + 1 : end + 2] == '"':
                at = end + 2
                continue
            quoted, at = False, end + 1
        elif line[at : at + 1] == '"' and (at == begin or line[at - 1] == delimiter):
            quoted, at = True, at + 1
            continue
        found = stop.search(line, at)
        if not found:
            return [*out, line[begin:]], False
        at = found.end()
        if found[0] == "\r":
            out.append(line[begin : at - 1])
            begin = at


def _blocks(batches) -> Iterator[tuple[int, list[str]]]:
    """Neighbouring lines of one block."""
    block, lines = None, []
    for b in batches:
        for own, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if own != block:
                if lines:
                    yield block, lines
                block, lines = own, []
                line = line.removeprefix("\ufeff") if own == 0 else line
            lines.append(line)
    if lines:
        yield block, lines


def _reduced(delimiter: str):
    def rows(batches):
        for block, lines in _blocks(batches):
            states, starts = [False, True], [0, 0]
            for line in lines:
                for k in (0, 1):
                    parts, after = segments(line, states[k], delimiter)
                    starts[k] += sum(x != "" for x in parts[states[k] :])
                    states[k] = after
            yield pa.record_batch([pa.array([x]) for x in (block, states[0], states[1], starts[0], starts[1])], names=["block", "plain", "quoted", "n_plain", "n_quoted"])

    return rows


def _cut(delimiter: str, begin: dict):
    """Whole records as fields; the pieces of those that cross a border as lines."""

    def rows(batches):
        parser = Parser(delimiter)
        for block, lines in _blocks(batches):
            quoted, number = begin[block]
            number -= 1
            out, record, first = [], [], quoted
            for line in lines:
                parts, after = segments(line, quoted, delimiter)
                for i, part in enumerate(parts):
                    if not quoted and part == "":
                        continue
                    number += not quoted
                    record.append(part)
                    quoted = after and i + 1 == len(parts)
                    if not quoted:
                        whole = "\n".join(record)
                        out.append((number, block, None, whole) if first else (number, block, next(parser.feed_all(whole), [""]), None))
                        record, first = [], False
            if record:
                out.append((number, block, None, "\n".join(record)))
            for k in range(0, len(out), 2000):
                columns = list(zip(*out[k : k + 2000]))
                yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string()))], names=["record", "block", "fields", "piece"])

    return rows


def _joined(delimiter: str):
    def rows(batches):
        parser = Parser(delimiter)
        for b in batches:
            fields = [next(parser.feed_all(x), [""]) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(fields, pa.list_(pa.string()))], names=["record", "fields"])

    return rows


def records(lines: DataFrame, delimiter: str = ",") -> DataFrame:
    """lines: block, value, in the order of their blocks within each partition. Returns record (dense, from 0), fields."""
    lines = lines.select("block", "value")
    reduced = sorted(lines.mapInArrow(_reduced(delimiter), "block long, plain boolean, quoted boolean, n_plain long, n_quoted long").collect())
    begin, quoted, number = {}, False, 0
    for r in reduced:
        begin[r.block] = (quoted, number)
        number += r.n_quoted if quoted else r.n_plain
        quoted = r.quoted if quoted else r.plain
    if quoted:
        raise ValueError("a quoted field is not ended")
    cut = lines.mapInArrow(_cut(delimiter, begin), "record long, block long, fields array<string>, piece string")
    whole = cut.where("fields is not null").select("record", "fields")
    pieces = cut.where("fields is null").groupBy("record").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "piece"))), lambda x: x["piece"]), "\n").alias("text"))
    return whole.union(pieces.mapInArrow(_joined(delimiter), "record long, fields array<string>"))
