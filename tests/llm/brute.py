"""Plain versions of the operators for small tables."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def shingles(text: str | None, size: int = 5) -> set[tuple[str, ...]]:
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))}


def groups(rows: list[tuple[int, str | None]]) -> dict[int, int]:
    """Smallest id reachable by links of likeness 0.8, by id."""
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1:]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                r, s = sorted((root(i), root(j)))
                up[s] = r
    return {i: root(i) for i, _ in rows}


def line_dedup(rows: list[tuple[int, str | None]]) -> dict[int, str | None]:
    """Kept texts by id, for distinct ids."""
    first, out = {}, {}
    for i, text in sorted(rows):
        if text is None:
            out[i] = None
            continue
        lines = text.split("\n")
        counted = [k for k, x in enumerate(lines) if x.strip(" \t\r\x0b\x0c")]
        trimmed = [lines[k].strip(" \t\r\x0b\x0c") for k in counted]
        gone = set()
        for p in range(len(trimmed) - 2):
            if first.setdefault(tuple(trimmed[p:p + 3]), (i, p)) != (i, p):
                gone |= {p, p + 1, p + 2}
        kept, at = [], -1
        for line in lines:
            at += bool(line.strip(" \t\r\x0b\x0c"))
            if at not in gone:
                kept.append(line)
        out[i] = "\n".join(kept)
    return out
