"""Filters and whole-row search as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import regexes
from ..functions.scalars import extension
from .model import FIELDS, Dataset, Filter, Query

OPS = ("contains", "notContains", "equals", "notEquals", "startsWith", "regex", "empty", "notEmpty")


class QueryError(ValueError):
    pass


def predicate(v: Column, op: str, text: str = "", case_sensitive: bool = False) -> Column:
    """One filter on a column; a missing value is the empty text, and white space is not empty."""
    v = F.coalesce(v, F.lit(""))
    if op not in OPS:
        raise QueryError(f"unknown operator {op!r}")
    if op.startswith("not"):
        return ~predicate(v, op[3].lower() + op[4:], text, case_sensitive)
    if op == "empty":
        return v == ""
    if op == "regex":
        return v.rlike(regexes.java(text, case_sensitive))
    if case_sensitive:
        return {"contains": F.contains, "startsWith": F.startswith}[op](v, F.lit(text)) if op != "equals" else v == text
    literal = regexes.quote(text)
    return v.rlike("(?iu)" + {"contains": literal, "equals": rf"\A{literal}\z", "startsWith": rf"\A{literal}"}[op])


def filters(data: Dataset, wanted: tuple[Filter, ...], case_sensitive: bool) -> Column | None:
    cells, found = data.cells(), []
    for f in wanted:
        if not 0 <= f.column < len(cells):
            raise QueryError(f"no column {f.column}")
        found.append(predicate(cells[f.column], f.op, f.text, case_sensitive))
    return reduce(lambda a, b: a & b, found) if found else None


def parsed(query: Query) -> tuple[list[str], str]:
    """Extensions and a pattern of the language of regexes; the pattern is empty if only extensions are asked for."""
    if query.mode == "text" and not query.regex:
        return [], regexes.quote(query.text)
    rest, wanted = query.text.strip(), []
    if m := re.match(r"(?i)ext:(\S*)\s*", rest):
        wanted = [x.lower().lstrip(".") for x in m[1].split(";") if x]
        if not wanted or any(not x or re.search(r"[/\\:*?]", x) for x in wanted):
            raise QueryError("an extension is missing or has a forbidden character")
        rest = rest[m.end() :]
    if m := re.match(r"(?i)regex:", rest):
        return wanted, rest[m.end() :].strip()
    if query.regex and not wanted:
        return [], rest if rest != query.text.strip() else query.text
    return wanted, rest if query.regex or rest.startswith("(?") else regexes.quote(rest)


def search(data: Dataset, query: Query) -> Column | None:
    """True where any one cell matches; None if nothing is searched for. Cells that a short row lacks don't count."""
    if query.text == "":
        return None
    wanted, pattern = parsed(query)
    translated = regexes.java(pattern, query.case_sensitive)

    def cell(v: Column) -> Column:
        return v.rlike(translated) if not wanted else extension(v).isin(wanted) & v.rlike(translated) if pattern else extension(v).isin(wanted)

    hits = [F.coalesce(cell(v), F.lit(False)) for v in data.cells()]
    if data.ragged:
        hits = [h & (F.col(FIELDS) > i) for i, h in enumerate(hits)]
    return reduce(lambda a, b: a | b, hits) if hits else F.lit(False)
