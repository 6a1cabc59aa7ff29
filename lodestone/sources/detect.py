"""What a file is, from its name and its first bytes."""

from __future__ import annotations

import json
import re
from collections import Counter
from pathlib import PurePosixPath

SAMPLE = 128 << 10
#: Extensions of source code, each read line by line; file signatures.
CODE = {"md": "markdown", "markdown": "markdown", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "javascript", "py": "python", "ps1": "powershell", "psm1": "powershell", "sh": "shell", "bash": "shell", "bat": "shell", "cmd": "shell", "yaml": "yaml", "yml": "yaml", "rs": "text", "go": "text", "c": "text", "h": "text", "cpp": "text", "cs": "text", "java": "text"}
OLE, EVTX, REGISTRY, SQLITE, ESE = bytes.fromhex("D0CF11E0A1B11AE1"), b"ElfFile\0", b"regf", b"SQLite format 3\0", bytes.fromhex("EFCDAB89")
ENCODINGS = {"utf-8": "utf-8", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be", "windows-1251": "cp1251", "windows-1252": "cp1252"}


def encoding_of(head: bytes) -> str:
    return "utf-16le" if head.startswith(b"\xff\xfe") else "utf-16be" if head.startswith(b"\xfe\xff") else "utf-8"


def is_binary(head: bytes, whole: bool) -> bool:
    """A zero byte, over one control character in a hundred, or UTF-8 that is broken before its last character."""
    if not head:
        return False
    control = sum(c < 32 and c not in (9, 10, 12, 13) for c in head)
    if b"\0" in head or control * 100 > len(head):
        return True
    try:
        head.decode("utf-8")
    except UnicodeDecodeError as e:
        return whole or e.start < len(head) - 3 or e.reason != "unexpected end of data"
    return False


def ruler(lines: list[str]) -> list[str] | None:
    """Names of a table whose second line is a ruler and whose next lines have as many fields."""
    if len(lines) < 3:
        return None
    names = lines[0].split()
    body = [x for x in lines[2:] if x.strip()][:16]
    if not 2 <= len(names) <= 64 or len(lines[1].strip()) < 5 or set(lines[1].strip()) - set("-= +"):
        return None
    return names if body and all(len(x.split()) >= len(names) for x in body) else None


def delimiter(sample: str) -> str | None:
    """The candidate whose most usual width covers four fifths of the first 32 records; more records, then wider, wins."""
    from .csv_table import Parser

    best, score = None, -1
    for candidate in (",", "\t", ";", "|"):
        rows = []
        try:
            for fields in Parser(candidate, strict=False).feed_all(sample):
                rows.append(len(fields))
                if len(rows) == 32:
                    break
        except ValueError:
            continue
        if not rows:
            continue
        counts = Counter(rows)
        width, n = max(counts.items(), key=lambda x: (x[1], x[0]))
        if width > 1 and n * 5 >= len(rows) * 4 and n * 1000 + min(width, 999) >= score:
            best, score = candidate, n * 1000 + min(width, 999)
    return best


def looks_like_json(text: str) -> bool:
    text = text.lstrip("﻿ \t\r\n")
    if text[:1] not in ("{", "["):
        return False
    try:
        json.JSONDecoder().raw_decode(text)
    except ValueError as e:
        # broken off by the sample's end, not by what stands there
        return e.pos >= len(text.rstrip()) - 1 or "Unterminated" in str(e) or len(text) >= SAMPLE // 2
    return True


def kind_of(name: str, head: bytes, whole: bool, forced: str | None = None, auto_text: bool = True) -> str:
    """usn, arn, evtx, registry, sqlite, ese, xml, binary, ruler, json, jsonl, csv, or a kind of text."""
    if forced:
        return forced
    base = PurePosixPath(name).name
    ext = base.rsplit(".", 1)[-1].lower() if "." in base else ""
    if ext == "usn" or re.fullmatch(r"(?i)\$UsnJrnl(:\$J(:\$DATA)?)?", base):
        return "usn"
    if ext == "arn" and head.startswith(OLE):
        return "arn"
    if head.startswith(EVTX) or ext == "evtx":
        return "evtx"
    for signature, kind in ((REGISTRY, "registry"), (SQLITE, "sqlite")):
        if head.startswith(signature):
            return kind
    if head[4:8] == ESE:
        return "ese"
    encoding = encoding_of(head)
    if encoding == "utf-8":
        start = head.removeprefix(b"\xef\xbb\xbf").lstrip()
        if ext == "xml" or start.startswith(b"<?xml") or (start.startswith(b"<") and ext not in ("md", "markdown", "html", "htm")):
            return "xml"
        if is_binary(head, whole):
            return "binary"
    text = head.decode(ENCODINGS[encoding], "ignore").removeprefix("﻿")
    lines = text.splitlines()
    if auto_text and ext not in CODE and ruler(lines if whole else lines[:-1] or lines):
        return "ruler"
    if ext in CODE:
        return CODE[ext]
    if ext in ("jsonl", "ndjson"):
        return "jsonl"
    if ext == "json" or looks_like_json(text):
        return "json"
    if ext == "txt" and not auto_text:
        return "text"
    if ext in ("csv", "tsv", "psv") or delimiter(text if whole else text[: text.rfind("\n") + 1]):
        return "csv"
    return "text"
