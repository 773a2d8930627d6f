"""A prefix tree over globally ordered sets, and the Jaccard search in it.

The sets are sorted arrays of unsigned 64-bit numbers. Sorting the arrays among each other and noting how many
leading items neighbours share gives the tree in two flat lists: a path is an array, a branch is a shared length.
"""

from __future__ import annotations

import numpy as np


def needed(n: int, m: int, percent: int = 80) -> int:
    """Smallest intersection with which sets of n and m items reach the likeness: 100 * I >= percent * (n + m - I)."""
    return -(-percent * (n + m) // (100 + percent))


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading items two arrays share."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


class PrefixTree:
    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.paths = [sets[i] for i in self.order]
        self.branch = [0] + [shared(a, b) for a, b in zip(self.paths, self.paths[1:])]

    def search(self, probe: np.ndarray, percent: int = 80, step: int = 256) -> list[int]:
        """Indexes of the sets that reach the likeness with `probe`.

        Walks the paths in order. The overlap counted along a shared beginning is taken over from the path before;
        a path, or what is left of it, is cut off when the overlap so far plus what remains on either side is too small.
        """
        found = []
        counts = np.zeros(1, np.int64)  # overlap after 0, 1, ... items of the current path, as far as it was walked
        for k, path in enumerate(self.paths):
            least = needed(len(path), len(probe), percent)
            at = min(self.branch[k], len(counts) - 1)
            counts = counts[:at + 1]
            pieces, overlap, alive = [counts], int(counts[-1]), True
            while True:
                used = int(np.searchsorted(probe, path[at - 1], "right")) if at else 0
                if overlap + min(len(path) - at, len(probe) - used) < least:
                    alive = False
                    break
                if at == len(path):
                    break
                part = path[at:at + step]
                place = np.minimum(np.searchsorted(probe, part), len(probe) - 1)
                pieces.append(overlap + np.cumsum(probe[place] == part))
                overlap, at = int(pieces[-1][-1]), at + len(part)
            counts = np.concatenate(pieces)
            if alive and overlap >= least:
                found.append(self.order[k])
        return found
