"""Text in bytes: strings of three encodings at any offset, hexadecimal spellings, and readable fields."""

from __future__ import annotations

import bisect
import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = T.ArrayType(T.StructType([T.StructField("offset", T.LongType()), T.StructField("len", T.LongType()), T.StructField("encoding", T.StringType()), T.StructField("text", T.StringType())]))
#: Script ranges, and characters other than letters and digits that text may hold.
SCRIPTS = (("latin", 0xC0, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("arabic", 0x750, 0x77F), ("indic", 0x900, 0xDFF), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("east", 0x3040, 0x30FF), ("east", 0x3400, 0x9FFF), ("east", 0xAC00, 0xD7AF))
MARKS = ((0xA0, 0xBF), (0x300, 0x36F), (0x2000, 0x200D), (0x2010, 0x2027), (0x202F, 0x203E), (0x20A0, 0x20CF), (0x3000, 0x303F), (0xFE00, 0xFE0F))
EMOJI = ((0x2600, 0x27BF), (0x1F000, 0x1FAFF))
#: Weight per byte of a candidate by its evidence, and what changes an unmarked UTF-16 one's.
WITH_BOM, AS_UTF8, AS_UTF16 = 128, 32, 36
PER_SPACE, PER_BOUNDARY, PER_RARE = 96, -128, -96


def _alnum(c: str) -> bool:
    # letters, letter-like marks and numbers
    return c.isalnum() or unicodedata.category(c) in ("Nl", "No") or (not c.isascii() and unicodedata.category(c) in ("Mc", "Mn") and not 0x300 <= ord(c) <= 0x36F and c.isidentifier())


def _emoji(c: str) -> bool:
    return any(a <= ord(c) <= z for a, z in EMOJI)


_kinds: dict[str, tuple] = {}


def _kind(c: str) -> tuple[bool, bool, bool, str | None]:
    """Whether text may hold the character, whether it is a word's, an emoji; and the script of a letter beyond ASCII."""
    found = _kinds.get(c)
    if found is None:
        o = ord(c)
        if o < 128:
            found = (c.isprintable() or c in "\t\n\r", c.isalnum(), False, None)
        else:
            word, emoji = _alnum(c), _emoji(c)
            text = c != "�" and (word or emoji or any(a <= o <= z for a, z in MARKS))
            script = next((s for s, a, z in SCRIPTS if a <= o <= z), "other") if c.isalpha() else None
            found = (text, word, emoji, script)
        if len(_kinds) < 100_000:
            _kinds[c] = found
    return found


@dataclass
class _Candidate:
    start: int
    end: int
    encoding: str
    text: str
    weight: int


def _utf8(data: bytes):
    """(offset, width, character) from the start; None for a byte that begins none."""
    at = 0
    while at < len(data):
        first = data[at]
        width = 1 if first < 0x80 else 2 if 0xC2 <= first <= 0xDF else 3 if 0xE0 <= first <= 0xEF else 4 if 0xF0 <= first <= 0xF4 else 0
        try:
            c = data[at : at + width].decode("utf-8") if width and at + width <= len(data) else None
        except UnicodeDecodeError:
            c = None
        yield at, width if c else 1, c
        at += width if c else 1


def _utf16(data: bytes, parity: int, order: str):
    at = parity
    while at + 1 < len(data):
        unit = int.from_bytes(data[at : at + 2], order)
        if 0xD800 <= unit < 0xDC00 and at + 3 < len(data) and 0xDC00 <= (low := int.from_bytes(data[at + 2 : at + 4], order)) < 0xE000:
            yield at, 4, chr(0x10000 + ((unit - 0xD800) << 10) + low - 0xDC00)
            at += 4
        else:
            yield at, 2, None if 0xD800 <= unit < 0xE000 else chr(unit)
            at += 2


def _judged(run: list[tuple[int, int, str]], bom: bool, encoding: str) -> _Candidate | None:
    """The candidate that a run of text characters makes, if there is evidence enough that it is text."""
    while run and run[-1][2].isspace():
        trailing = len(run) - len("".join(c for _, _, c in run).rstrip())
        spaces_after, run = run[len(run) - trailing :], run[: len(run) - trailing]
        break
    else:
        spaces_after = []
    if not run:
        return None
    kinds = [_kind(c) for _, _, c in run]
    plain = sum(k[1] and c.isascii() for k, (_, _, c) in zip(kinds, run))
    wide = sum(k[1] and not c.isascii() for k, (_, _, c) in zip(kinds, run))
    emoji = sum(k[2] and not k[1] for k in kinds)
    scripts = [k[3] for k in kinds if k[1] and k[3]]
    weak = bool(scripts) and scripts[-1] in ("east", "other") and not bom
    utf8 = encoding == "UTF-8"
    if not (utf8 or bom or plain >= 3 or (wide >= 4 and not weak) or emoji >= 2):
        return None
    if plain + wide + emoji < (1 if bom else 2 if emoji >= 2 else 4):
        return None
    start, end = run[0][0], run[-1][0] + run[-1][1]
    weight = (end - start) * (WITH_BOM if bom else AS_UTF8 if utf8 else AS_UTF16)
    if not utf8 and not bom:
        spaces = sum(c.isspace() for _, _, c in run) + len(spaces_after)
        words = [(k[1], c.isascii()) for k, (_, _, c) in zip(kinds, run)]
        boundaries = sum(a[0] and b[0] and a[1] != b[1] for a, b in zip(words, words[1:]))
        rare = sum(0x460 <= ord(c) <= 0x52F for _, _, c in run)
        weight += PER_SPACE * spaces
        weight = max(0, weight + PER_BOUNDARY * boundaries)
        weight = max(0, weight + PER_RARE * rare)
    return _Candidate(start, end, encoding, "".join(c for _, _, c in run), weight)


def _runs(chars, encoding: str) -> list[_Candidate]:
    out, run, bom, script = [], [], False, None
    wide = encoding != "UTF-8"

    def close():
        nonlocal run, bom, script
        if run and (found := _judged(run, bom, encoding)):
            out.append(found)
        run, bom, script = [], False, None

    for at, width, c in chars:
        if c == "﻿":
            close()
            bom = True
            continue
        if c is None or not _kind(c)[0]:
            close()
            continue
        _, word, _, own = _kind(c)
        if wide and not bom and script and own and own != script:
            close()
        if wide and not run and not bom and own in ("east", "other"):
            continue
        if run or not c.isspace():
            run.append((at, width, c))
            if word and own:
                script = own
    close()
    return out


def spans(data: bytes) -> list[dict]:
    """Strings of UTF-8 and of UTF-16 of either byte order at any offset, the heaviest set without overlaps."""
    found = _runs(_utf8(data), "UTF-8")
    for order, name in (("little", "UTF-16LE"), ("big", "UTF-16BE")):
        for parity in (0, 1):
            found += _runs(_utf16(data, parity, order), name)
    found.sort(key=lambda x: (x.end, x.start))
    ends = [x.end for x in found]
    best, before = [0], []
    for i, x in enumerate(found):
        p = bisect.bisect_right(ends, x.start, 0, i)
        before.append(p)
        best.append(max(best[-1], best[p] + x.weight))
    chosen, i = [], len(found)
    while i:
        if best[before[i - 1]] + found[i - 1].weight > best[i - 1]:
            chosen.append(found[i - 1])
            i = before[i - 1]
        else:
            i -= 1
    return [{"offset": x.start, "len": x.end - x.start, "encoding": x.encoding, "text": x.text} for x in reversed(chosen)]


def readable(data: bytes) -> str | None:
    """The whole of valid UTF-8, mark and closing zeros left out; else the strings found, a line each; else None."""
    try:
        text = data.removeprefix(b"\xef\xbb\xbf").rstrip(b"\0").decode("utf-8")
        if text and all(_kind(c)[0] for c in text) and any(_kind(c)[1] or _kind(c)[2] for c in text):
            return text
    except UnicodeDecodeError:
        pass
    return "\n".join(x["text"] for x in spans(data)) or None


_PAIR = "[0-9A-Fa-f]{2}"
_BETWEEN = r"(?:[ \t\n\r\f]+(?:,[ \t\n\r\f]*)?|,[ \t\n\r\f]*)"
#: Spellings of bytes, each with the fewest bytes that it must have.
SPELLINGS = (
    (re.compile(rf"[xX]'((?:{_PAIR})+)'"), 4),
    (re.compile(rf"\\[xX]((?:{_PAIR})+)"), 4),
    (re.compile(rf"((?:\\[xX]{_PAIR}[ \t\n\r\f]*)+)"), 4),
    (re.compile(rf"(?:0[xX])?((?:{_PAIR})+)"), 9),
    (re.compile(rf"((?:0[xX]{_PAIR}{_BETWEEN})*0[xX]{_PAIR})"), 4),
    (re.compile(rf"((?:{_PAIR}{_BETWEEN})*{_PAIR})"), 4),
)


def readable_hex(text: str) -> str | None:
    """Readable text of a value that as a whole spells bytes in hexadecimal; None otherwise."""
    if len(text) > 1 << 20 or not text.isascii():
        return None
    text = text.strip(" \t\n\r\f")
    inner = text[1:-1].strip(" \t\n\r\f") if text[:1] + text[-1:] in ("[]", "{}") and len(text) > 1 else None
    for i, (shape, least) in enumerate(SPELLINGS):
        if m := shape.fullmatch(inner if inner is not None and i > 3 else text):
            data = bytes.fromhex(re.sub(r"0[xX](?=[0-9A-Fa-f]{2})|\\[xX]|[\s,]", "", m[1]) if i in (2, 4, 5) else m[1])
            return readable(data) if len(data) >= least else None
    return None


@F.pandas_udf(SPAN)
def spans_udf(data: pd.Series) -> pd.Series:
    return data.map(lambda x: spans(bytes(x)) if x is not None else [])


@F.pandas_udf(T.StringType())
def readable_udf(data: pd.Series) -> pd.Series:
    return data.map(lambda x: readable(bytes(x)) if x is not None else None)


@F.pandas_udf(T.StringType())
def readable_hex_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda x: readable_hex(x) if x is not None else None)
