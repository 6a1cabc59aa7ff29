"""Type inference and the total order of a view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from .model import ROW, Dataset, Kind, Sort

FIRST, LAST = 512, 128


def infer(data: Dataset, rows: int | None = None) -> list[Kind]:
    """Of the first FIRST rows and the last LAST beyond them, blank cells left out: what all cells of a column are."""
    rows = data.df.count() if rows is None else rows
    sample = data.df.where((F.col(ROW) < FIRST) | (F.col(ROW) >= max(FIRST, rows - LAST)))
    counts = []
    for i, v in enumerate(data.cells()):
        blank = scalars.trimmed(v) == ""
        counts += [F.count_if(~blank).alias(f"n{i}"), F.count_if(scalars.date(v).isNotNull()).alias(f"d{i}"), F.count_if(scalars.timestamp(v).isNotNull()).alias(f"t{i}"), F.count_if(scalars.number(v).isNotNull()).alias(f"f{i}")]
    if not counts:
        return []
    r = sample.agg(*counts).first()
    kinds = []
    for i, name in enumerate(data.headers):
        n = r[f"n{i}"]
        epoch = any(x in name.lower() for x in ("timestamp", "epoch", "unix"))
        kinds.append(Kind.TEXT if not n else Kind.DATE if r[f"d{i}"] == n else Kind.TIMESTAMP if epoch and r[f"t{i}"] == n else Kind.NUMBER if r[f"f{i}"] == n else Kind.TEXT)
    return kinds


Key = tuple[Column, str]


def order(v: Column, kind: Kind, descending: bool = False) -> list[Key]:
    """Sort keys, each with the name of its direction: valid values, then other text, then blanks, whichever direction; within each by direction."""
    blank = scalars.trimmed(v) == ""
    if kind == Kind.TEXT:
        bucket, keys = F.when(blank, 2).otherwise(0), [scalars.text_key(v)]
    else:
        whole = {Kind.NUMBER: scalars.number_key, Kind.DATE: scalars.date, Kind.TIMESTAMP: scalars.timestamp}[kind](v)
        parts = ("sign", "order", "digits") if kind == Kind.NUMBER else ("second", "nano")
        bucket = F.when(blank, 2).when(whole.isNotNull(), 0).otherwise(1)
        keys = [*(whole[x] for x in parts), F.when(whole.isNull(), scalars.text_key(v))]
    turn = "desc_nulls_last" if descending else "asc_nulls_first"
    return [(bucket, "asc"), *((k, turn) for k in keys)]


def arranged(df: DataFrame, by: list[Key | Column]) -> DataFrame:
    """df in the order of the keys, which are computed once a row; a sort by expressions computes them at each comparison."""
    by = [k if isinstance(k, tuple) else (k, "asc") for k in by]
    keyed = df.select("*", *(k.alias(f"_order{i}") for i, (k, _) in enumerate(by)))
    return keyed.orderBy(*(getattr(F.col(f"_order{i}"), turn)() for i, (_, turn) in enumerate(by))).drop(*(f"_order{i}" for i in range(len(by))))


def ordered(data: Dataset, sort: Sort, kinds: list[Kind] | None = None) -> list[Key]:
    if not 0 <= sort.column < len(data.headers):
        raise ValueError(f"no column {sort.column}")
    kind = sort.kind or (kinds or infer(data))[sort.column]
    return [*order(data.cells()[sort.column], kind, sort.descending), (F.col(ROW), "asc")]
