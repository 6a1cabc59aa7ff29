"""XML as a table of paths, values and kinds. Entities of a document type stay literal, and nothing is fetched."""

from __future__ import annotations

import re
from collections.abc import Iterator

_NAME = r"[^\s/>=<\"'&!?]+"
_MARKUP = re.compile(
    r"<!--(?P<comment>.*?)-->|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<\?(?P<pi>.*?)\?>|<!DOCTYPE\s+(?P<doctype>(?:[^\[\]<>\"']|\"[^\"]*\"|'[^']*'|\[(?:[^\]\"']|\"[^\"]*\"|'[^']*')*\])*)>"
    rf"|</(?P<end>{_NAME})\s*>|<(?P<start>{_NAME})(?P<attributes>(?:\s+{_NAME}\s*=\s*(?:\"[^\"<]*\"|'[^'<]*'))*)\s*(?P<empty>/?)>",
    re.S,
)
_ATTRIBUTE = re.compile(rf"({_NAME})\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_ENTITIES = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}
DTD_WARNING = "The document type is kept as text. Its entities stay literal, and nothing outside the file is loaded."


def unescape(text: str, literal_unknown: bool) -> str:
    def one(m: re.Match) -> str:
        name = m[1]
        if name is None:
            raise ValueError("invalid XML: an entity is not ended")
        if name in _ENTITIES:
            return _ENTITIES[name]
        if name.startswith("#"):
            try:
                code = int(name[2:], 16) if name[1:2] == "x" else int(name[1:])
                if not code or 0xD800 <= code < 0xE000:
                    raise ValueError
                return chr(code)
            except (ValueError, OverflowError):
                raise ValueError(f"invalid XML: no character {m[0]}") from None
        if literal_unknown:
            return m[0]
        raise ValueError(f"invalid XML: unknown entity {m[0]}")

    return re.sub(r"&(?:([^;]*);)?", one, text) if "&" in text else text


def rows(text: str) -> Iterator[tuple[str, str, str]]:
    """(path, value, kind) in source order; text, CDATA and entities beside one another are one value."""
    stack: list[tuple[str, dict[str, int], str]] = []
    pending, doctype, at = "", False, 0

    def here() -> str:
        return stack[-1][0] if stack else "/"

    for m in _MARKUP.finditer(text):
        between = text[at : m.start()]
        if "<" in between:
            raise ValueError(f"invalid XML at character {at + between.index('<')}")
        at = m.end()
        pending += unescape(between, doctype)
        if m["cdata"] is not None:
            pending += m["cdata"]
            continue
        if pending:
            yield here(), pending, "text" if pending.strip() else "whitespace"
            pending = ""
        if m["comment"] is not None:
            yield here(), m["comment"], "comment"
        elif m["pi"] is not None:
            declared = re.match(r"xml\s", m["pi"])
            yield ("/", m["pi"], "declaration") if declared else (here(), m["pi"], "processing instruction")
        elif m["doctype"] is not None:
            doctype = True
            yield "/", m["doctype"], "doctype"
        elif m["end"] is not None:
            if not stack or stack[-1][2] != m["end"]:
                raise ValueError(f"invalid XML: </{m['end']}> ends no element")
            stack.pop()
        else:
            name, index = m["start"], 1
            if stack:
                index = stack[-1][1][name] = stack[-1][1].get(name, 0) + 1
            path = f"{stack[-1][0] if stack else ''}/{name}[{index}]"
            yield path, "", "element"
            for key, double, single in _ATTRIBUTE.findall(m["attributes"]):
                yield f"{path}/@{key}", unescape(double or single, doctype), "attribute"
            if not m["empty"]:
                stack.append((path, {}, name))
    rest = text[at:]
    if "<" in rest:
        raise ValueError(f"invalid XML at character {at + rest.index('<')}")
    if stack:
        raise ValueError("invalid XML: an element is not ended")
    pending += unescape(rest, doctype)
    if pending:
        yield "/", pending, "text" if pending.strip() else "whitespace"
