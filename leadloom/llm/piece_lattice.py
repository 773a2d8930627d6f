"""SentencePiece segmentations sampled without replacement, and decoding.

A text's lattice holds every way to write it in the model's pieces; a path's weight is the product of its pieces' weights, by
default falling with a piece's rank, to the power ALPHA. Backward sums over the lattice turn weights into the probability of
each next piece, so paths can be drawn piece by piece. The sampler is a perturbed A-star search: subspaces of paths
(a beginning, and the next pieces it must not take) wait in a queue ordered by the largest Gumbel-perturbed log probability
inside them. The first in the queue yields its best path, and splits into the subspaces beside that path, whose own maxima
are truncated at it. The first k paths are a sample of k without replacement. Each comes with its log probability, its perturbed
one, and the log of its inclusion probability given the (k+1)-th maximum. All draws come from the row's key and a seed.

Pieces never reach over the start of a word, so each word has a small lattice of its own, kept by the worker while it
is in use (at most MOST_EDGES edges). Characters without a piece are written as their bytes.

Defined results: null and empty texts have one segmentation, the empty one, with probability 1; a text with fewer than k
segmentations gives them all, each with inclusion 1; repeated rows get equal samples; a null id is a key like any other. Extra
columns are not used. Decoding an encoded text gives back the text as the model normalises it.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, compress, repeat

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import register, table
from leadloom.llm.words import MULTIPLIER, mix

K, ALPHA, SEED = 3, 1.0, 42
MOST_EDGES, TEXTS_AT_ONCE, CHARACTERS_AT_ONCE = 6_000_000, 128, 1 << 20
DEPTH, _ALL = 60.0, (1 << 64) - 1
SPACE = "▁"  # fixed value: how the model writes a space
_WORD = re.compile(f"{SPACE}+[^{SPACE}\\n\\t]*|[\\n\\t]|[^{SPACE}\\n\\t]+")


class Pieces:
    """The model's pieces with their log weights, and the lattices of the words met so far.

    A node is a place in a word. Node n has the edges low[n], low[n] + 1, ..., longest first: the summed shares up to
    each, its own share, the node it leads to (-1 at the word's end) and its piece.
    """

    def __init__(self, path: str, alpha: float = ALPHA):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i))]
        if any(SPACE in names[i].lstrip(SPACE) or "\n" in names[i] or "\t" in names[i] for i in plain):
            raise ValueError("a piece reaches over the start of a word")
        ranked = sorted(plain, key=lambda i: -self.model.get_score(i))
        self.weight = {names[i]: (i, -alpha * math.log(rank + 2)) for rank, i in enumerate(ranked)}
        self.byte_ids = np.zeros(256, np.int64)
        for i in range(size):
            if self.model.is_byte(i):
                self.byte_ids[int(names[i][3:5], 16)] = i
        self.byte_weight = -alpha * math.log(size + 2)
        byte_of = {int(i): bytes([b]) for b, i in enumerate(self.byte_ids)}
        self.surface = [byte_of.get(i) or names[i].replace(SPACE, " ").encode() for i in range(size)]
        self.longest = max(len(names[i]) for i in plain)
        hashes = np.array([self._hash(n) for n in self.weight], np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        assert (self.hashes[1:] != self.hashes[:-1]).all()
        # Where a piece stands among the hashes, by their upper bits; -1 where several pieces share a place.
        where = self._slot(self.hashes) >> 2
        self.at = np.zeros(1 << 20, np.int32)
        self.at[where] = np.arange(len(self.hashes))
        same, times = np.unique(where, return_counts=True)
        self.at[same[times > 1]] = -1
        self.names = np.array([i for i, _ in self.weight.values()], np.int64)[order]
        self.weights = np.array([w for _, w in self.weight.values()])[order]
        # Beginnings of pieces, by the upper bits of their hashes: no piece starts where a place's bit is not set.
        starts = {n[:i] for n in self.weight for i in range(1, len(n) + 1)}
        self.begins = np.zeros(1 << 22, bool)
        self.begins[self._slot(np.array([self._hash(n) for n in starts], np.uint64))] = True
        sizes = np.array([len(x) for x in self.surface])
        self.surface_size, self.surface_start = sizes, np.cumsum(sizes) - sizes
        self.surface_bytes = np.frombuffer(b"".join(self.surface), np.uint8)
        self.low = np.empty(1 << 14, np.int64)
        self.run, self.p = np.empty(1 << 16), np.empty(1 << 16)
        self.end, self.piece = np.empty(1 << 16, np.int32), np.empty(1 << 16, np.int32)
        self.clear()

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return (hashes * np.uint64(MULTIPLIER) >> np.uint64(42)).astype(np.int64)

    @staticmethod
    def _hash(name: str) -> int:
        return sum((ord(c) + 1) * pow(MULTIPLIER, t, 1 << 64) for t, c in enumerate(name)) % (1 << 64)

    def clear(self) -> None:
        """Forget the words; the arrays stay as large as they were."""
        self.start: dict[str, int] = {}
        self.nodes = self.size = 0

    def _find(self, hashes: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """For each hash the place of its piece among all pieces, if it is one's."""
        hit = self.at[slots >> 2]
        odd = np.flatnonzero(hit < 0)
        if len(odd):
            hit[odd] = np.minimum(np.searchsorted(self.hashes, hashes[odd]), len(self.hashes) - 1)
        return hit

    def learn(self, words: list[str]) -> None:
        """Add the lattices of new words, all at once: find every piece in them, then sum backwards from the ends."""
        if not words:
            return
        length = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        total, stop = len(code), np.repeat(np.cumsum(length), length)
        left = stop - np.arange(total)  # characters to the word's end
        found = []  # per piece length: places in ascending order, pieces, weights
        value, place, single = np.zeros(total, np.uint64), np.arange(total), np.zeros(total, bool)
        for n in range(1, min(self.longest, int(length.max())) + 1):
            place = place[left[place] >= n]
            now = value[place] + (code[place + n - 1] + np.uint64(1)) * np.uint64(pow(MULTIPLIER, n - 1, 1 << 64))
            slot = self._slot(now)
            open_ = np.flatnonzero(self.begins[slot])
            place, now, slot = place[open_], now[open_], slot[open_]
            value[place] = now
            hit = self._find(now, slot)
            good = np.flatnonzero(self.hashes[hit] == now)
            hit = hit[good]
            found.append((place[good], self.names[hit], self.weights[hit]))
            if n == 1:
                single[place[good]] = True
        bare = np.flatnonzero(~single)  # as bytes: -1 - code stands for the character
        bytes_ = 1 + (code[bare] > 0x7F) + (code[bare] > 0x7FF) + (code[bare] > 0xFFFF)
        found.insert(0, (bare, -1 - code[bare].astype(np.int64), self.byte_weight * bytes_))

        # Edges place by place; longer pieces, mostly the likelier ones, first.
        many = np.zeros(total, np.int64)
        for where, _, _ in found:
            many[where] += 1
        first = np.cumsum(many) - many
        free, edges = first.copy(), int(many.sum())
        size, piece, weight = np.empty(edges, np.int64), np.empty(edges, np.int64), np.empty(edges)
        for n in range(len(found) - 1, -1, -1):
            where, what, heavy = found[n]
            slot = free[where]
            free[where] += 1
            size[slot], piece[slot], weight[slot] = max(n, 1), what, heavy
        at = np.repeat(np.arange(total), many)

        most = int(left.max())
        ends_first = left[at].astype(np.uint16 if most < 1 << 16 else np.int64)
        order = np.argsort(ends_first, kind="stable")
        beta, log = np.zeros(total + 1), np.empty(edges)
        bounds = np.searchsorted(ends_first[order], np.arange(1, most + 2))
        after = np.where(size < left[at], at + size, total)  # beta is 0 at a word's end
        for a, b in zip(bounds[:-1], bounds[1:]):
            own = order[a:b]
            sums, node = weight[own] + beta[after[own]], at[own]
            head = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            top = np.maximum.reduceat(sums, head)
            beta[node[head]] = top + np.log(np.add.reduceat(np.exp(sums - np.repeat(top, np.diff(np.append(head, b - a)))), head))
            log[own] = sums - beta[node]
        log[first[many == 1]] = 0.0
        share = np.exp(log)
        run = share.copy()  # summed node by node, so that a word's lattice is the same wherever it is built
        for n in range(1, int(many.max())):
            here = first[many > n] + n
            run[here] += run[here - 1]
        run[first + many - 1] = 1.0
        end = np.where(size < left[at], self.nodes + at + size, -1)
        for name, new, filled in (("low", self.size + first, self.nodes), ("run", run, self.size), ("p", share, self.size),
                                  ("end", end, self.size), ("piece", piece, self.size)):
            held = getattr(self, name)
            if filled + len(new) + 1 > len(held):
                grown = np.empty(max(filled + len(new) + 1, 2 * len(held)), held.dtype)
                grown[:filled] = held[:filled]
                held = grown
                setattr(self, name, held)
            held[filled:filled + len(new)] = new
        self.start.update(zip(words, (self.nodes + np.cumsum(length) - length).tolist()))
        self.nodes, self.size = self.nodes + total, self.size + len(at)
        self.low[self.nodes] = self.size

    def places(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The first node of every word of each text; new words are learnt."""
        words = list(chain.from_iterable(texts))
        found = np.fromiter(map(self.start.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(found < 0)
        if len(new):
            again = list(compress(words, (found < 0).tolist()))
            self.learn(list(dict.fromkeys(again)))
            found[new] = np.fromiter(map(self.start.__getitem__, again), np.int64, len(new))
        return np.split(found, np.cumsum([len(ws) for ws in texts])[:-1]) if texts else []

    def draw(self, nodes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From each node to the end of its word, edges drawn by their shares: the edges in order, the entry each belongs to, its number there.

        The n-th draw of an entry depends on its key and n alone.
        """
        entry = np.flatnonzero(nodes >= 0)
        node, entries, edges, n = nodes[entry], [], [], 0
        while len(entry):
            n += 1
            u, edge = _uniform(keys[entry], n), self.low[node]
            late = np.flatnonzero(u >= self.run[edge])
            while len(late):
                edge[late] += 1
                late = late[u[late] >= self.run[edge[late]]]
            entries.append(entry)
            edges.append(edge)
            node = self.end[edge].astype(np.int64)
            more = np.flatnonzero(node >= 0)
            entry, node = entry[more], node[more]
        many = np.zeros(len(nodes), np.int64)
        for one in entries:
            many[one] += 1
        first = np.cumsum(many) - many
        out = np.empty(int(many.sum()), np.int64)
        for turn, (one, edge) in enumerate(zip(entries, edges)):
            out[first[one] + turn] = edge
        entries = np.repeat(np.arange(len(nodes)), many)
        return out, entries, np.arange(1, len(out) + 1) - first[entries]

    def sample(self, texts: list[np.ndarray], keys: list[int], k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """For each text (the first nodes of its words) up to k distinct paths, best perturbed first.

        A path: edges, log probability, perturbed log probability, log inclusion probability. All texts take a step
        together: each takes the first subspace out of its queue and draws the path's remainder.
        """
        searches = [_Search(starts, key) for starts, key in zip(texts, keys)]
        for turn in range(k):
            steps = [(s, step) for s in searches if (step := s.next(self, turn))]
            if not steps:
                break
            nodes = [np.concatenate([[step.node], s.starts[step.word + 1:]]) for s, step in steps]
            sizes = np.array([len(x) for x in nodes])
            word_keys = _mixed(np.repeat(np.array([step.key for _, step in steps], np.uint64), sizes), np.concatenate([np.arange(n) for n in sizes]))
            edges, entries, turns = self.draw(np.concatenate(nodes), word_keys)
            # What lies beside each new edge: its mass, and a maximum truncated at the path's own.
            owner = np.repeat(np.arange(len(steps)), sizes)[entries]
            share = self.p[edges]
            log, rest = np.log(share), 1 - share
            cuts, after, start = np.searchsorted(owner, np.arange(len(steps) + 1)), np.empty(len(edges)), np.empty(len(edges))
            for n, (_, step) in enumerate(steps):
                part = slice(cuts[n], cuts[n + 1])
                np.cumsum(log[part], out=after[part])
                after[part] += step.before
                start[part] = np.concatenate([[step.before], after[part][:-1]])[:part.stop - part.start]
            # What lies DEPTH nats further down the path holds no maximum that counts (with a chance of exp(-DEPTH)).
            limits = np.full(len(edges), -np.inf)
            near = np.flatnonzero((start > np.array([step.before for _, step in steps])[owner] - DEPTH) & (rest > 1e-12))
            waits = -np.log1p(-_uniform(_mixed(word_keys[entries[near]], turns[near]), 1 << 20))
            limits[near] = -np.logaddexp(-np.array([step.top for _, step in steps])[owner[near]], np.log(waits) - start[near] - np.log(rest[near]))
            inside = entries - (np.cumsum(sizes) - sizes)[owner]
            for n, (s, step) in enumerate(steps):
                part = slice(cuts[n], cuts[n + 1])
                s.add(step, edges[part], inside[part] + step.word, start[part], float(after[part.stop - 1]) if part.stop > part.start else step.before, limits[part], k - turn)
        return [s.result() for s in searches]

    def ids_all(self, paths: list[np.ndarray]) -> Iterator[np.ndarray]:
        """The ids of each path of edges."""
        every = self.piece[np.concatenate(paths)] if paths else np.zeros(0, np.int32)
        bare = np.flatnonzero(every < 0)
        bare = bare[every[bare] >= -128]
        every[bare] = self.byte_ids[-1 - every[bare]]
        whole = not len(every) or every.min() >= 0
        last = 0
        for path in paths:
            names, last = every[last:last + len(path)], last + len(path)
            yield names.astype("<u4") if whole else self._with_bytes(names.astype(np.int64))

    def _with_bytes(self, names: np.ndarray) -> np.ndarray:
        bare = np.flatnonzero(names < 0)
        if len(bare):  # characters without a piece become their bytes; those of one byte have by now
            data = [self.byte_ids[list(chr(-1 - c).encode("utf-8", "surrogatepass"))] for c in names[bare].tolist()]
            names = np.concatenate([x for a, b, d in zip(np.append(0, bare + 1), bare, data) for x in (names[a:b], d)] + [names[bare[-1] + 1:]])
        return names.astype("<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 text of the ids: pieces and bytes joined, spaces written plainly, without the model's leading space."""
        return next(self.decode_all([ids]))

    def decode_all(self, paths: list[np.ndarray]) -> Iterator[bytes]:
        """The text of each path, gathered for all of them at once."""
        ids = np.concatenate(paths) if paths else np.zeros(0, np.int64)
        size = self.surface_size[ids]
        stop = np.cumsum(size)
        where = np.repeat((self.surface_start[ids] - stop + size).astype(np.int32 if len(ids) < 1 << 24 else np.int64), size)
        where += np.arange(len(where), dtype=where.dtype)
        data = self.surface_bytes[where].tobytes()
        last = np.append(0, stop)[np.cumsum([0] + [len(p) for p in paths])].tolist()
        for a, b in zip(last[:-1], last[1:]):
            yield data[a:b].removeprefix(b" ")


@dataclass
class _Step:
    """A subspace taken out of the queue: a beginning (`path` up to `place`), the edge after it, and what bounds it."""

    top: float
    key: int
    path: int = -1
    place: int = 0
    edge: int = -1
    word: int = -1  # of the edge; the words after it are drawn anew
    node: int = -1  # where the edge leads inside its word
    before: float = 0.0  # log probability up to and with the edge


class _Search:
    """The queue of one text's subspaces, and the paths found so far."""

    def __init__(self, starts: np.ndarray, key: int):
        self.starts, self.key, self.draws = starts, key % 2**64, 0
        self.queue: list[tuple[float, int, int, tuple[int, ...]]] = []
        self.paths: list[tuple] = []  # edges, their words, log probability before each, whole, perturbed

    def uniform(self) -> float:
        self.draws += 1
        return (_mixed_one(self.key, self.draws) >> 11) * 2.0 ** -53

    def next(self, model: Pieces, turn: int) -> _Step | None:
        key = _mixed_one(self.key, turn + (1 << 32))
        if turn == 0:
            return _Step(-math.log(-math.log1p(-self.uniform())), key)
        if not self.queue:
            return None
        top, path, place, taken = heapq.heappop(self.queue)
        edges, words, before, _, _ = self.paths[path]
        first = int(edges[place])
        # The edges of one node stand together and their summed shares end at 1.
        low = int(np.searchsorted(model.low[:model.nodes], first, "right")) - 1
        free = [e for e in range(int(model.low[low]), int(model.low[low + 1])) if e not in taken]
        shares = model.p[free].tolist()
        mark, at = self.uniform() * sum(shares), 0
        while at < len(free) - 1 and mark >= shares[at]:
            mark, at = mark - shares[at], at + 1
        edge, mass = free[at], sum(shares) - shares[at]
        if len(free) > 1 and mass > 0:
            wait = -math.log1p(-self.uniform())
            limit = -_log_add(top, math.log(wait) - float(before[place]) - math.log(mass))
            heapq.heappush(self.queue, (-limit, path, place, (*taken, edge)))
        return _Step(-top, key, path, place, edge, int(words[place]), int(model.end[edge]), float(before[place]) + math.log(model.p[edge]))

    def add(self, step: _Step, edges, words, before, total: float, limits, k: int) -> None:
        """A path, and the subspaces beside it; no more than the k largest of those are looked at from now on."""
        if step.path >= 0:
            old = self.paths[step.path]
            edges = np.concatenate([old[0][:step.place], [step.edge], edges])
            if k > 1:  # nothing is taken from beside the last path
                words = np.concatenate([old[1][:step.place], [step.word], words])
                before = np.concatenate([old[2][:step.place + 1], before])
        skip = len(edges) - len(limits)
        open_ = np.flatnonzero(limits > -np.inf)
        if len(open_) > k:
            open_ = open_[np.argpartition(-limits[open_], k - 1)[:k]] if k > 1 else open_[[limits[open_].argmax()]]
        for b in open_.tolist():
            heapq.heappush(self.queue, (-float(limits[b]), len(self.paths), skip + b, (int(edges[skip + b]),)))
        self.paths.append((edges, words, before, total, step.top))

    def result(self) -> list[tuple[np.ndarray, float, float, float]]:
        limit = -self.queue[0][0] if self.queue else -math.inf
        return [(edges, total, top, _log_inclusion(total - limit)) for edges, _, _, total, top in self.paths]


def _mixed(keys: np.ndarray, n) -> np.ndarray:
    return mix(keys + mix(np.atleast_1d(n).astype(np.uint64) + np.uint64(MULTIPLIER)))


def split(text: str) -> list[str]:
    """The words of a normalised text, spaces in front; line ends and tabs are words of their own."""
    if " " in text or SPACE * 2 in text:
        return _WORD.findall(text)
    return list(filter(None, text.replace(SPACE, " " + SPACE).replace("\n", " \n ").replace("\t", " \t ").split(" ")))


def _mix_one(x: int) -> int:
    """`mix` of one number."""
    x ^= x >> 31
    x = x * 0x7FB5D329728EA185 & _ALL
    x ^= x >> 27
    x = x * 0x81DADEF4BC2DD44D & _ALL
    return x ^ x >> 33


def _mixed_one(key: int, n: int) -> int:
    return _mix_one(key + _mix_one(n + MULTIPLIER & _ALL) & _ALL)


def _log_add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def _uniform(keys: np.ndarray, n) -> np.ndarray:
    """A number in [0, 1) for each key and n, equal wherever it is asked for."""
    return (_mixed(keys, n) >> np.uint64(11)) * 2.0 ** -53


def _log_inclusion(x: float) -> float:
    """log(1 - exp(-exp(x)))"""
    if x > 4:
        return math.log1p(-math.exp(-math.exp(min(x, 700))))
    return math.log(-math.expm1(-math.exp(x))) if x > -30 else x


@lru_cache(maxsize=2)
def pieces(path: str, alpha: float) -> Pieces:
    return Pieces(path, alpha)


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of at most TEXTS_AT_ONCE texts and about CHARACTERS_AT_ONCE characters."""
    at = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if i + 1 - at == TEXTS_AT_ONCE or size >= CHARACTERS_AT_ONCE or i + 1 == len(texts):
            yield at, i + 1
            at, size = i + 1, 0


def sample(docs: DataFrame, k: int = K, path: str | None = None, alpha: float = ALPHA, seed: int = SEED, with_ids: bool = False) -> DataFrame:
    """Per row up to k rows: doc_id, sample (from 1), n_pieces, ids_crc32, log_prob, perturbed, log_inclusion, round_trip (, ids)."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    kind = ("array<struct<sample int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, log_inclusion double, round_trip boolean"
            + (", ids array<int>>>" if with_ids else ">>"))

    @F.pandas_udf(kind)
    def draw(texts: pd.Series, keys: pd.Series) -> pd.Series:
        model, texts, out = pieces(path, alpha), texts.tolist(), []
        row_keys = _mixed(keys.to_numpy().astype(np.uint64), seed).tolist()
        for at, stop in _slices(texts):
            some = [model.model.normalize(t) if t else "" for t in texts[at:stop]]
            if model.size > MOST_EDGES:
                model.clear()
            every = model.sample(model.places([split(t) for t in some]), row_keys[at:stop], k)
            ids = list(model.ids_all([edges for found in every for edges, *_ in found]))
            back, ids = model.decode_all(ids), iter(ids)
            for text, found in zip(some, every):
                rows, plain = [], text.replace(SPACE, " ").encode("utf-8", "surrogatepass").removeprefix(b" ")
                for n, (_, total, top, inclusion) in enumerate(found, 1):
                    own = next(ids)
                    row = {"sample": n, "n_pieces": len(own), "ids_crc32": zlib.crc32(own), "log_prob": total, "perturbed": top,
                           "log_inclusion": inclusion, "round_trip": next(back) == plain}
                    rows.append(row | {"ids": own.astype(np.int32)} if with_ids else row)
                out.append(rows)
        return pd.Series(out, dtype=object)

    return docs.select("doc_id", F.inline(draw("text", F.xxhash64("doc_id"))))


def decode(encoded: DataFrame, path: str | None = None, alpha: float = ALPHA) -> DataFrame:
    """`encoded` (with ids) and `decoded`, the text of its ids."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        return pd.Series([pieces(path, alpha).decode(np.asarray(x)).decode("utf-8", "replace") if x is not None else None for x in ids], dtype=object)

    return encoded.withColumn("decoded", text("ids"))


def op3_piece_lattice(spark, folder):
    return sample(table(spark, folder, "documents").select("doc_id", "text"))


register("op3_piece_lattice")(op3_piece_lattice)
