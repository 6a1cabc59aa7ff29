"""Running a query, and reading its result: pages, cells, copies and exports."""

from __future__ import annotations

import csv
import io
import os
import tempfile
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import preview
from .model import ROW, Dataset, Kind, Query, dense_ids
from .search import filters, search
from .sort import arranged, ordered

POS = "__pos"
VIEW_ROWS, VIEW_COLUMNS, VIEW_CHARS = 256, 128, 512
COPY_CELLS, COPY_BYTES, CELL_CHARS = 1_000_000, 64 << 20, 1_000_000


@dataclass
class View:
    """rows: ROW and POS, the dense rank in the view, by which all reading is filtered; None for all rows in source order."""

    data: Dataset
    rows: DataFrame | None = None
    kinds: list[Kind] | None = None

    def frame(self) -> DataFrame:
        """All columns with POS, unordered. Wide rows are joined to the ranks, so that a sort moves keys alone."""
        if self.rows is None:
            return self.data.df.withColumn(POS, F.col(ROW))
        return self.data.df.join(self.rows, ROW)

    def count(self) -> int:
        return (self.data.df if self.rows is None else self.rows).count()

    def slice(self, start: int, n: int) -> DataFrame:
        """Rows start to start + n of the view, ordered; past its end there are none."""
        return self.frame().where((F.col(POS) >= start) & (F.col(POS) < start + n)).orderBy(POS)


def matching(data: Dataset, query: Query) -> DataFrame:
    """The rows that the filters and the search keep, in no order."""
    df = data.df
    for test in (filters(data, query.filters, query.case_sensitive), search(data, query)):
        if test is not None:
            df = df.where(test)
    return df


def run(data: Dataset, query: Query, kinds: list[Kind] | None = None) -> View:
    """Checked as a whole before anything runs, so that a faulty query leaves an earlier view as it was."""
    if not query.text and not query.filters and query.sort is None:
        return View(data, None, kinds)
    found = matching(data, query)
    by = ordered(data, query.sort, kinds) if query.sort else [(F.col(ROW), "asc")]
    keys = found.select(ROW, *(f"c{i}" for i in ([query.sort.column] if query.sort else [])))
    return View(data, _ranked(keys, by), kinds)


def _ranked(keys: DataFrame, by: list) -> DataFrame:
    rows = arranged(keys, by).select(F.col(ROW).alias("_row"))
    return dense_ids(rows).select(F.col("_row").alias(ROW), F.col(ROW).alias(POS))


def top(data: Dataset, query: Query, n: int, kinds: list[Kind] | None = None) -> DataFrame:
    """The first n rows of a sorted view without ranking the rest."""
    by = ordered(data, query.sort, kinds) if query.sort else [(F.col(ROW), "asc")]
    return arranged(matching(data, query), by).limit(n)


def viewport(view: View, start: int, n: int, columns: list[int]) -> list[dict]:
    """At most VIEW_ROWS rows by VIEW_COLUMNS columns, values cut to VIEW_CHARS characters."""
    n, columns = min(n, VIEW_ROWS), columns[:VIEW_COLUMNS]
    cells = view.data.cells()
    rows = view.slice(start, n).select(ROW, *(preview(cells[c], VIEW_CHARS).alias(f"v{i}") for i, c in enumerate(columns)))
    return [{"row": r[0], "values": list(r[1:])} for r in rows.collect()]


def cell(view: View, row: int, column: int, limit: int = CELL_CHARS) -> dict:
    from ..functions.binary_text import readable_hex

    value = view.data.df.where(F.col(ROW) == row).select(view.data.cells()[column]).first()
    if value is None:
        raise IndexError(f"no row {row}")
    return {"value": value[0][:limit], "truncated": len(value[0]) > limit, "decoded": readable_hex(value[0])}


def _written(rows, delimiter: str, end: str) -> str:
    out = io.StringIO()
    csv.writer(out, delimiter=delimiter, lineterminator=end).writerows(rows)
    return out.getvalue()


def copy_range(view: View, first: int, last: int, columns: list[int]) -> str:
    """Rows first to last (both included) as tab-separated text; a single cell as it is."""
    n = last - first + 1
    if n * len(columns) > COPY_CELLS:
        raise ValueError("too many cells to copy")
    cells = view.data.cells()
    wanted = view.slice(first, n).select(*(cells[c].alias(f"v{i}") for i, c in enumerate(columns)))
    # sized before it is fetched, so that the driver never holds more
    if (wanted.agg(F.sum(F.octet_length(F.concat(*wanted.columns)))).first()[0] or 0) > COPY_BYTES:
        raise ValueError("too much text to copy")
    rows = [list(r) for r in wanted.collect()]
    text = rows[0][0] if len(rows) == len(columns) == 1 else _written(rows, "\t", "\r\n").removesuffix("\r\n")
    if len(text.encode()) > COPY_BYTES:
        raise ValueError("too much text to copy")
    return text


def check_export_path(data: Dataset, path: str) -> None:
    if data.source and os.path.exists(path) and os.path.exists(data.source) and os.path.samefile(path, data.source):
        raise ValueError("an export must not replace its source")
    if data.source and os.path.realpath(path) == os.path.realpath(data.source):
        raise ValueError("an export must not replace its source")


def export_csv(view: View, path: str, headers: list[str] | None = None) -> int:
    """All rows in view order as one CSV file, put in place when complete; returns the rows. Rows stream through the driver."""
    data = view.data
    check_export_path(data, path)
    rows = view.frame().orderBy(POS).select(*(c.alias(f"v{i}") for i, c in enumerate(data.cells())))
    handle, temp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    n = 0
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
            out = csv.writer(f, lineterminator="\n")
            out.writerow(headers or data.headers)
            for r in rows.toLocalIterator():
                out.writerow(list(r))
                n += 1
        os.replace(temp, path)
    finally:
        if os.path.exists(temp):
            os.unlink(temp)
    return n


def export_parts(view: View, path: str) -> None:
    """As export_csv, distributed: a folder of CSV files whose names follow the view's order."""
    data = view.data
    rows = view.frame().repartitionByRange(POS).sortWithinPartitions(POS)
    rows.select(*(c.alias(h) for c, h in zip(data.cells(), data.headers))).write.csv(path, header=True, escape='"', emptyValue="")


def restricted(data: Dataset, rows: DataFrame) -> Dataset:
    """The dataset of the rows whose ROW is in the frame."""
    return Dataset(data.df.join(rows.select(ROW), ROW, "left_semi"), data.headers, data.kind, data.description, data.warnings, data.source, data.generated, data.hidden)


def page(data: Dataset, start: int, n: int = 128, chars: int = 1024) -> list[dict]:
    rows = data.df.where((F.col(ROW) >= start) & (F.col(ROW) < start + n)).orderBy(ROW)
    return [{"row": r[0], "values": list(r[1:])} for r in rows.select(ROW, *(preview(c, chars).alias(f"v{i}") for i, c in enumerate(data.cells()))).collect()]


def source_fragment(path: str, offset: int, limit: int = 8 << 20) -> dict:
    """Decoded source text from a byte offset: cut after the last line end in the second half, or between characters."""
    with open(path, "rb") as f:
        size = f.seek(0, os.SEEK_END)
        f.seek(offset)
        raw = f.read(limit)
    end = len(raw)
    if offset + end < size:
        at = raw.rfind(b"\n", end // 2)
        if at >= 0:
            end = at + 1
        else:
            while end and offset + end < size and _continues(path, offset + end):
                end -= 1
    body = raw[:end]
    text = body.decode("utf-8", "strict")
    if offset == 0:
        text = text.removeprefix("﻿")
    return {"text": text, "next": offset + end, "eof": offset + end >= size, "whole": offset == 0 and offset + end >= size, "newlines": text.count("\n")}


def _continues(path: str, at: int) -> bool:
    with open(path, "rb") as f:
        f.seek(at)
        return (f.read(1) or b"\0")[0] & 0xC0 == 0x80


def forward_filled(df: DataFrame, value: str, order: str, by: list[str] | None = None) -> DataFrame:
    """df with value replaced by the last one at or before each row that isn't null."""
    w = Window.partitionBy(*(by or [])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))
