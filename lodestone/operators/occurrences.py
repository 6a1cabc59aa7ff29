"""Every match of a pattern: row, column, and byte offsets in the cell."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import regexes
from .model import ROW, Dataset

HITS = "row long, column int, start long, end long"


@lru_cache(64)
def _compiled(pattern: str):
    import regex

    return regex.compile(pattern)


def _found(pattern: str):
    def rows(batches):
        compiled = _compiled(pattern)
        for b in batches:
            out: list[tuple] = []
            for row, column, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                wide = not text.isascii()
                last = -1
                for m in compiled.finditer(text):
                    a, z = m.span()
                    if a == z == last:
                        continue  # an empty match right after another match
                    last = z
                    if wide:
                        a = len(text[:a].encode())
                        z = a + len(m[0].encode())
                    out.append((row, column, a, z))
            columns = list(zip(*out)) or [()] * 4
            yield pa.record_batch([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["row", "column", "start", "end"])

    return rows


def hits(data: Dataset, pattern: str, case_sensitive: bool = False, literal: bool = True, columns: list[int] | None = None, row: int | None = None, where: Column | None = None, within: DataFrame | None = None) -> DataFrame:
    """All matches that don't overlap, in all cells or in some columns or one row; within: a frame of ROW to look in.

    Cells that cannot match are sorted out before any leaves the JVM. Missing cells count as empty ones.
    """
    if pattern == "":
        raise ValueError("nothing to search for")
    pattern = regexes.quote(pattern) if literal else pattern
    df = data.df if row is None else data.df.where(F.col(ROW) == row)
    if where is not None:
        df = df.where(where)
    if within is not None:
        df = df.join(within.select(ROW), ROW, "left_semi")
    cells = data.cells()
    picked = [F.struct(F.lit(i).alias("column"), cells[i].alias("text")) for i in (columns if columns is not None else range(len(cells)))]
    every = df.select(ROW, F.explode(F.array(*picked)).alias("x")).select(ROW, "x.column", "x.text").where(F.col("text").rlike(regexes.java(pattern, case_sensitive)))
    return every.mapInArrow(_found(regexes.python(pattern, case_sensitive)), HITS)


def counts(found: DataFrame) -> dict:
    r = found.agg(F.count("*").alias("hits"), F.count_distinct("row").alias("rows")).first()
    return {"hits": r.hits, "rows": r.rows}


def hit_page(found: DataFrame, start: int, n: int) -> DataFrame:
    """Hits start to start + n in the order of row, column and place; takes the first ones only, never ranks all."""
    first = found.orderBy("row", "column", "start").limit(start + n)
    return first.withColumn("at", F.row_number().over(Window.orderBy("row", "column", "start")) - 1).where(F.col("at") >= start).drop("at")
