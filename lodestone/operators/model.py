"""The query and what it runs over: a table of text columns in a fixed row order."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import stored

#: Reserved columns: the dense 0-based source row, and the fields that the source row really had.
ROW, FIELDS = "__row_id", "__fields"


class Kind(str, Enum):
    TEXT, NUMBER, DATE, TIMESTAMP = "text", "number", "date", "timestamp"


@dataclass(frozen=True)
class Filter:
    """op: contains, notContains, equals, notEquals, startsWith, regex, empty or notEmpty."""

    column: int
    op: str
    text: str = ""


@dataclass(frozen=True)
class Sort:
    column: int
    descending: bool = False
    kind: Kind | None = None


@dataclass(frozen=True)
class Query:
    """Search and filters must all hold; at most one sort key. mode: auto or text."""

    text: str = ""
    regex: bool = False
    mode: str = "auto"
    case_sensitive: bool = False
    filters: tuple[Filter, ...] = ()
    sort: Sort | None = None


@dataclass
class Dataset:
    """df has ROW, then a string column for each header, named c0, c1, ...; FIELDS where rows may be short."""

    df: DataFrame
    headers: list[str]
    kind: str = "table"
    description: str = ""
    warnings: list[str] = field(default_factory=list)
    source: str = ""
    generated: dict[int, str] = field(default_factory=dict)
    hidden: set[int] = field(default_factory=set)

    def cells(self) -> list[Column]:
        return [F.coalesce(F.col(f"c{i}"), F.lit("")) for i in range(len(self.headers))]

    @property
    def ragged(self) -> bool:
        return FIELDS in self.df.columns


def dense_ids(df: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """df with ROW: dense, 0-based, in the order of the columns given, or else of the frame's partitions.

    Counts per partition are the only thing that the driver sees. An ordered frame is dealt by ranges first, so
    that no task holds more than its range. The rows are written before they are counted: computed anew, the
    ranges could differ.
    """
    if order:
        df = df.orderBy(*order)
    df = stored(df.withColumn("_at", F.monotonically_increasing_id()), "rows")
    part = F.shiftright("_at", 33)
    sizes = sorted((r.p, r.n) for r in df.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    starts, total = {}, 0
    for p, n in sizes:
        starts[p], total = total, total + n
    start = F.element_at(F.create_map(*(F.lit(x).cast("long") for kv in starts.items() for x in kv)), part) if starts else F.lit(0)
    return df.select((start + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("long").alias(ROW), *(c for c in df.columns if c != "_at"))


def from_frame(df: DataFrame, key: list[str], columns: list[str] | None = None) -> Dataset:
    """A dataset over any frame: its columns as text, rows ordered by key columns."""
    columns = columns or [c for c in df.columns if c not in key]
    picked = df.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"c{i}") for i, c in enumerate(columns)))
    rows = dense_ids(picked, [F.col(f"_k{i}") for i in range(len(key))])
    return Dataset(rows.drop(*(f"_k{i}" for i in range(len(key)))), columns)
