"""Words and their 64-bit hashes over whole texts, computed with numpy for many texts at once.

Words are `[^\\x20\\x09-\\x0D]+` of the UTF-8 text with A-Z lower-cased. Hashes are polynomial in the word's bytes
modulo 2**64 and then mixed; two of a billion different words are equal with probability below 0.03.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

MULTIPLIER = 0x9E3779B97F4A7C15 | 1
CHUNK_BYTES = 1 << 21
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose result bits depend on all bits."""
    out = x >> np.uint64(31)
    out ^= x
    out *= np.uint64(0x7FB5D329728EA185)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x81DADEF4BC2DD44D)
    out ^= out >> np.uint64(33)
    return out


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in ((0, MULTIPLIER), (1, pow(MULTIPLIER, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and ending of every word of `data`; the ending is a number for the word's last two bytes."""
    low = np.frombuffer(data, np.uint8)
    low = np.where((low >= 65) & (low <= 90), low + np.uint8(32), low)
    inside = np.zeros(len(low) + 2, np.int8)
    inside[1:-1] = (low != 32) & ((low < 9) | (low > 13))
    change = np.diff(inside)
    start, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    up, down = _tables(len(low) + 1)
    total = np.zeros(len(low) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    value = (total[end] - total[start]) * down[start]
    before = np.where(end - start > 1, low[end - 2], 0) if len(end) else end
    ending = low[end - 1].astype(np.int64) + 256 * before.astype(np.int64)
    return mix(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), start, ending


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Slices of `texts` of about CHUNK_BYTES (one text at least): first and end index, joined bytes, first byte of each text."""
    first, size, parts = 0, 0, []
    for i, text in enumerate(texts):
        parts.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(parts[-1]) + 1
        if size >= CHUNK_BYTES or i + 1 == len(texts):
            yield first, i + 1, b"\n".join(parts), np.cumsum([0] + [len(p) + 1 for p in parts])[:-1]
            first, size, parts = i + 1, 0, []


def of_texts(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Word hashes of each text, in order."""
    for _, _, data, at in chunks(texts):
        value, start, _ = hashes(data)
        yield from np.split(value, np.searchsorted(start, at[1:]))


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of all runs of `size` words; of the whole sequence, if it is shorter; none without words."""
    if len(words) == 0:
        return words
    width = min(size, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        total = mix(total * np.uint64(0x2545F4914F6CDD1D) + words[k:len(words) - width + 1 + k])
    return total
