"""JSON as a table: objects flattened to pointers, arrays kept as compact text, numbers as they are written."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Lexeme(str):
    """A number, in its own spelling."""


def _constant(name: str):
    raise ValueError(f"{name} is not JSON")


_DECODER = json.JSONDecoder(parse_int=Lexeme, parse_float=Lexeme, parse_constant=_constant)
_SPACE = re.compile(r"[ \t\r\n]*")


def compact(x) -> str:
    """JSON text without spaces, numbers in their own spelling."""
    if isinstance(x, Lexeme):
        return str(x)
    if isinstance(x, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{compact(v)}" for k, v in x.items()) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(compact, x)) + "]"
    return json.dumps(x, ensure_ascii=False)


def flatten(x, at: str = "") -> list[tuple[str, str]]:
    """(pointer, text) of a value's leaves in source order; the root of what is no object is called value."""
    if isinstance(x, dict) and x:
        return [leaf for k, v in x.items() for leaf in flatten(v, f"{at}/{k.replace('~', '~0').replace('/', '~1')}")]
    text = str(x) if isinstance(x, str) else compact(x)
    return [(at or "value", text)]


def documents(text: str, lines: bool = False):
    """Values of a text, one after the other; the elements of an array that stands alone, unless lines holds."""
    at = _SPACE.match(text).end()
    single = not lines and text[at : at + 1] == "["
    while at < len(text):
        try:
            x, at = _DECODER.raw_decode(text, at)
        except ValueError as e:
            raise ValueError(f"invalid JSON: {e}") from None
        at = _SPACE.match(text, at).end()
        if single:
            if at < len(text):
                raise ValueError("invalid JSON: data after the array")
            yield from x
        else:
            yield x


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("pointer", T.StringType()), T.StructField("value", T.StringType())])))
def flattened_udf(text: pd.Series) -> pd.Series:
    def one(t):
        return [] if t is None else [{"pointer": p, "value": v} for x in documents(t) for p, v in flatten(x)]

    return text.map(one)
