"""Column names: generated, made unique, and localised."""

from __future__ import annotations

MAX_COLUMNS = 16_384
#: Names of generated columns by language.
GENERATED = {"en": {"column": "Column {}", "text": "Text"}, "ru": {"column": "Столбец {}", "text": "Текст"}}


def unique(names: list[str]) -> list[str]:
    """Names with ` (2)`, ` (3)`, ... after those that are taken by an earlier one."""
    out, taken = [], set()
    for name in names:
        candidate, n = name, 2
        while candidate in taken:
            candidate, n = f"{name} ({n})", n + 1
        taken.add(candidate)
        out.append(candidate)
    return out


def completed(names: list[str], width: int, language: str = "en") -> tuple[list[str], dict[int, str]]:
    """Names for all columns, and which of them are generated."""
    if width > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} columns")
    generated = {i: "column" for i in range(width) if i >= len(names) or not names[i].strip()}
    full = [names[i] if i < len(names) and names[i] != "" else GENERATED[language]["column"].format(i + 1) for i in range(width)]
    return unique(full), generated


def localised(names: list[str], generated: dict[int, str], language: str) -> list[str]:
    """Generated names in another language; those of the source stay, and the outcome is unique again."""
    own = {n for i, n in enumerate(names) if i not in generated}
    out = []
    for i, name in enumerate(names):
        if i in generated:
            base = GENERATED[language][generated[i]].format(i + 1)
            name, n = base, 2
            while name in own or name in out:
                name, n = f"{base} ({n})", n + 1
        out.append(name)
    return out
