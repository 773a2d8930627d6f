"""LM scoring with a probabilistic suffix tree over words.

Tokens are the words of a text and one end. The tree's alphabet holds every word with at least SYMBOL_SHARE of the training
tokens, and for the rest one symbol per word ending (`CLASSES` hashed pairs of last bytes); a rare word's probability
is that of its symbol times its add-one share inside the symbol. Contexts are all single symbols and all sequences of up to DEPTH
symbols that occur twice in the training texts. Next-symbol counts are kept from two on (one, after single symbols), less DISCOUNT each; what
is left of a context's counts, and MU more, goes to the distribution of the context without its oldest symbol, down to
the alphabet's own add-one distribution. A context stays if its next symbols gain at least DIVERGENCE nats each over that
distribution (their Kullback-Leibler divergence) beyond KIND_COST nats for each kept next symbol, or if a longer one that
stays ends in it. A token is scored in the state of the longest
suffix of what precedes it that stayed.

The tree grows with the texts and is never in one place. Its top, the contexts with at least HOT_SHARE of the training tokens (at
most DEPTH/HOT_SHARE) with their next symbols of at least NEXT_SHARE, is broadcast. Their other next symbols are
a written table, joined to the places that need them. Below it, the places after each context just
outside the top meet in one task, which holds that branch whole: a branch has less than HOT_SHARE of the training tokens, and a task
takes about BRANCH_TOKENS of them at a time and grows whole branches of about GROWN_TOKENS together. Neither share changes a result. Counts of words are exact and of the
whole training text; those below KNOWN_SHARE are joined to the texts' rare words by a shuffle. Texts are read twice, for the counts of
words and for their symbols, which are written and learnt from; shuffle files go with the step that made them.

Defined results: null and empty texts consist of the end alone; a null id counts as the text '' in the split; repeated rows are
scored, and learnt from, each; without training rows every base score is 0, since V and N are, and the model gives
every token to one symbol; extra columns are not used.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm import words
from leadloom.llm.common import crc_of_id, keep, register, table

DEPTH, CLASSES = 3, 4096
SYMBOL_SHARE, KNOWN_SHARE = 1e-5, 1e-6
HOT_SHARE, NEXT_SHARE = 1 / 4096, 2.5e-7  # of the training tokens; contexts and next symbols above are broadcast
MU, DISCOUNT, DIVERGENCE, KIND_COST = 1.0, 0.8, 0.01, 1.0
START = CLASSES  # the symbol before a text; frequent words follow
BITS = 20  # of a symbol's number
NONE = (1 << BITS) - 1  # stands where a context has no further symbol
END = words.hashes(b"\x00end")[0]
CHUNK_TOKENS, SLICE_TOKENS, FRAME_ROWS = 1 << 21, 1 << 18, 1 << 18
BRANCH_TOKENS, BUCKETS = 1 << 20, 8  # tokens a task holds at a time; buckets at least
GROWN_TOKENS = 1 << 17  # tokens whose branches a task grows at a time, as the working arrays are many times their size
GROUP_BITS = 12  # rows with equal higher bits of their number get their sums back together
#: While a step is written: its shuffle files are deleted at its end, and tables of symbols take less room.
STEP_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]):
    """The session with these settings; what it had comes back."""
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _step(df: DataFrame, name: str) -> DataFrame:
    """As `keep`, without the shuffle files."""
    with _set(df.sparkSession, STEP_SETTINGS):
        return keep(df, name)


def _tokens(texts: list[str | None]):
    """Hash, class and first-token positions of the tokens of many texts, each text closed with the end token."""
    for _, _, data, at in words.chunks(texts):
        value, start, ending = words.hashes(data)
        stop = np.append(np.searchsorted(start, at[1:]), len(value))
        value, classes = np.insert(value, stop, END), np.insert(_class(ending), stop, 0)
        yield value, classes, np.concatenate([[0], stop[:-1] + np.arange(1, len(stop))])


def _class(ending: np.ndarray) -> np.ndarray:
    return (words.mix(ending.astype(np.uint64)) % np.uint64(CLASSES)).astype(np.int64)


def _summed(parts, most: int = CHUNK_TOKENS):
    """Distinct rows of the (key, ...) arrays with their number of occurrences, for at most `most` rows at a time."""
    held, size = [], 0

    def flush():
        keys = np.concatenate([h[0] for h in held])
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return [keys[first], *[np.concatenate([h[k] for h in held])[order[first]] for k in range(1, len(held[0]))]], np.diff(np.append(first, len(keys)))

    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= most:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def word_counts(texts: DataFrame) -> DataFrame:
    """word (hash), class and n over all tokens of `text`; summed per slice before the shuffle."""
    def count(batches):
        parts = (x[:2] for batch in batches for x in _tokens(batch.text.tolist()))
        for (word, classes), n in _summed(parts):
            for at in range(0, len(n), FRAME_ROWS):
                part = slice(at, at + FRAME_ROWS)
                yield pd.DataFrame({"word": word[part].astype(np.int64), "class": classes[part], "n": n[part]})

    found = texts.select("text").mapInPandas(count, "word long, class long, n long")
    return _step(found.groupBy("word", "class").agg(F.sum("n").alias("n")), "words")


@dataclass
class Tree:
    """The top of the tree as sorted arrays; a context of depth d is a row of `codes[d]`, whose code is (context of depth d-1, symbol)."""

    symbols: np.ndarray  # hashes of frequent words
    symbol_at: np.ndarray  # their place in the order of counts, most first; symbols are numbered so, as small numbers pack well
    first: np.ndarray  # log probability of each symbol without context
    class_log: np.ndarray  # log of each class's tokens + distinct words + 1
    known: np.ndarray  # hashes of the words whose counts are at hand
    known_n: np.ndarray
    train_tokens: int = 0
    distinct: int = 0
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))  # symbols that are contexts of the top
    codes: list[np.ndarray] = field(default_factory=list)  # by depth - 2
    stays: list[np.ndarray] = field(default_factory=list)  # by depth - 1
    rest: list[np.ndarray] = field(default_factory=list)  # log of what a context leaves to the shorter one
    next_keys: list[np.ndarray] = field(default_factory=list)  # (context, symbol)
    next_log: list[np.ndarray] = field(default_factory=list)
    levels: list[DataFrame] = field(default_factory=list)  # all next symbols of the top: key, n, log; stays on the driver

    def __getstate__(self):
        return {**self.__dict__, "levels": []}

    def number(self, value: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Symbol of each token."""
        hit, place = _find(self.symbols, value)
        return np.where(hit, START + 1 + self.symbol_at[place], classes) if len(self.symbols) else classes

    def contexts(self, symbol: np.ndarray, start: np.ndarray, depth: int) -> list[np.ndarray]:
        """For each token, its context of depth 1, 2, ... as a row number, -1 where the top has none."""
        before = _before(symbol, start)
        out = [np.where(self.hot[before], before, -1)]
        for d in range(2, depth + 1):
            longer = np.full(len(symbol), -1, np.int64)
            longer[1:] = out[-1][:-1]  # the context of the token before, one shorter
            usable = (longer >= 0) & (before != START)
            hit, place = _find(self.codes[d - 2], (longer << BITS) + before)
            out.append(np.where(usable & hit, place, -1))
        return out


def _before(symbol: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The symbol before each token."""
    before = np.empty_like(symbol)
    before[1:] = symbol[:-1]
    before[start] = START
    return before


def _find(ordered: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether and where each wanted value stands in the sorted array."""
    if not len(ordered):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    place = np.minimum(np.searchsorted(ordered, wanted), len(ordered) - 1)
    return ordered[place] == wanted, place


def _next_counts(rows: DataFrame, tree: Tree, depth: int) -> DataFrame:
    """key (context row and symbol) and n, for the contexts of one depth; `rows` has the symbols of each text."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def parts(frames):
        tree = shared.value
        for frame in frames:
            size = frame.n_tokens.to_numpy(np.int64)
            for a, b in _runs((np.cumsum(size) - size) // SLICE_TOKENS):
                symbol = np.frombuffer(b"".join(frame.symbols.iloc[a:b]), np.int32).astype(np.int64)
                context = tree.contexts(symbol, np.cumsum(size[a:b]) - size[a:b], depth)[-1]
                yield (((context << BITS) + symbol)[context >= 0],)

    def count(frames):
        for (key,), n in _summed(parts(frames)):
            for at in range(0, len(n), FRAME_ROWS):
                yield pd.DataFrame({"key": key[at:at + FRAME_ROWS], "n": n[at:at + FRAME_ROWS]})

    return rows.select("n_tokens", "symbols").mapInPandas(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _pairs(rows: DataFrame, *columns: str) -> list[np.ndarray]:
    frame = rows.toPandas()
    return [frame[c].to_numpy(np.int64) for c in columns]


def learn(texts: DataFrame, depth: int = DEPTH) -> tuple[Tree, DataFrame]:
    """The top of the training texts' tree, and the written counts of all their words."""
    tree, counts = _alphabet(texts)
    _grow(tree, _walked(texts.select(F.lit(0).alias("doc_id"), "text"), tree, F.lit(True)), depth)
    return tree, counts


def _alphabet(texts: DataFrame) -> tuple[Tree, DataFrame]:
    """A tree with symbols and no contexts, and the written counts of all words."""
    counts = word_counts(texts)
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    end = np.int64(END.astype(np.int64)[0])
    # At most 1/KNOWN_SHARE rows.
    known, known_n = _pairs(counts.where(F.col("n") >= KNOWN_SHARE * total).select("word", "n"), "word", "n")
    order = np.argsort(known.astype(np.uint64))
    known, known_n = known[order].astype(np.uint64), known_n[order]
    often = (known_n >= max(2, SYMBOL_SHARE * total)) | (known == np.uint64(end.astype(np.uint64)))
    symbols, n = known[often], known_n[often]
    symbol_at = np.empty(len(symbols), np.int64)
    symbol_at[np.argsort(-n, kind="stable")] = np.arange(len(symbols))
    rare = counts.where((F.col("n") < max(2, SYMBOL_SHARE * total)) & (F.col("word") != int(end)))
    class_of, class_n, class_words = _pairs(rare.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")), "class", "n", "words")
    weight = np.ones(START + 1 + len(symbols))
    weight[START] = 0  # never follows anything
    weight[class_of] += class_n
    weight[START + 1 + symbol_at] += n
    class_log = np.zeros(CLASSES)
    class_log[class_of] = np.log(class_n + class_words + 1)
    with np.errstate(divide="ignore"):
        tree = Tree(symbols, symbol_at, np.log(weight / weight.sum()), class_log, known, known_n, int(total), int(distinct))
    least = max(2, HOT_SHARE * total)
    tree.hot = weight - 1 >= least
    tree.hot[START] = known_n[known == np.uint64(end.astype(np.uint64))].sum() >= least  # as many as there are texts
    return tree, counts


def _grow(tree: Tree, texts: DataFrame, depth: int = DEPTH) -> None:
    """Add the contexts of the top, from the symbols of the training texts."""
    total, ending, size = tree.train_tokens, int(tree.number(END, np.zeros(1, np.int64))[0]), len(tree.first)
    least = max(2, HOT_SHARE * total)
    grown, shorter_of, gains = np.zeros(0, np.int64), [np.zeros(0, np.int64)], []
    for d in range(1, depth + 1):
        if d > 1:
            grown = grown[(grown & ((1 << BITS) - 1)) != ending]
            if not len(grown):
                break
            tree.codes.append(grown)  # keys of one depth are the codes of the next
        shorter_of.append(_shorter(tree, shorter_of, d, size))
        rows, sure = _step(_next_counts(texts, tree, d), "next"), 2 if d > 1 else 1
        # One row per context of the top.
        stats = rows.groupBy(F.shiftright("key", BITS).alias("context")).agg(
            F.sum("n").alias("n"), F.sum(F.when(F.col("n") >= sure, F.col("n")).otherwise(0)).alias("kept"), F.sum((F.col("n") >= sure).cast("long")).alias("kinds"))
        owner, *found = _pairs(stats, "context", "n", "kept", "kinds")
        of_context, kept, kinds = (np.zeros(len(shorter_of[d]), np.int64) for _ in found)
        for into, values in zip((of_context, kept, kinds), found):
            into[owner] = values
        left = MU + np.maximum(of_context - kept, 0) + DISCOUNT * kinds
        level = _step(_logs(tree, rows.where(F.col("n") >= sure), shorter_of[d], of_context, left), "level")
        tree.levels.append(level)
        tree.rest.append(np.log(left / (of_context + MU)))
        frame = level.where(F.col("n") >= max(sure, NEXT_SHARE * total)).select("key", "log").toPandas().sort_values("key")  # at most 1/NEXT_SHARE
        tree.next_keys.append(frame.key.to_numpy(np.int64))
        tree.next_log.append(frame.log.to_numpy(float))
        grown = np.sort(_pairs(rows.where(F.col("n") >= least).select("key"), "key")[0])  # at most 1/HOT_SHARE
        gain = (of_context - kept) * tree.rest[-1]
        for row, more in level.groupBy(F.shiftright("key", BITS)).agg(F.sum("gain")).collect():
            gain[row] += more
        gains.append(gain >= DIVERGENCE * np.maximum(of_context, 1))
    for d in range(len(gains), 0, -1):
        if d < len(gains):
            gains[d - 1][np.unique(shorter_of[d + 1][gains[d]])] = True
    tree.stays = gains


def _shorter(tree: Tree, shorter_of: list[np.ndarray], depth: int, symbols: int) -> np.ndarray:
    """The row of each context of one depth without its oldest symbol."""
    if depth == 1:
        return np.full(symbols, -1)
    # Without its oldest symbol, (x..., y) is the context (shorter(x...), y) of the depth below.
    code = tree.codes[depth - 2]
    head, last = code >> BITS, code & ((1 << BITS) - 1)
    if depth == 2:
        return last
    hit, shorter = _find(tree.codes[depth - 3], (shorter_of[depth - 1][head] << BITS) + last)
    assert hit.all(), "a context's suffix is at least as frequent"
    return shorter


def _logs(tree: Tree, rows: DataFrame, shorter: np.ndarray, of_context: np.ndarray, left: np.ndarray) -> DataFrame:
    """key, n, log and gain over the shorter context, of all next symbols of one depth's contexts."""
    shared = rows.sparkSession.sparkContext.broadcast((tree.first, shorter, of_context, left))

    def parents(frames):
        for frame in frames:
            key = frame.key.to_numpy(np.int64)
            yield frame.assign(parent=(shared.value[1][key >> BITS] << BITS) + (key & ((1 << BITS) - 1)))

    def logs(frames):
        first, _, of_context, left = shared.value
        for frame in frames:
            key, n = frame.key.to_numpy(np.int64), frame.n.to_numpy(np.int64)
            context = key >> BITS
            below = frame.below.to_numpy(float) if "below" in frame else first[key & ((1 << BITS) - 1)]
            log = np.log(n - DISCOUNT + left[context] * np.exp(below)) - np.log(of_context[context] + MU)
            yield pd.DataFrame({"key": key, "n": n, "log": log, "gain": n * (log - below) - KIND_COST})

    if tree.levels:
        below = tree.levels[-1].select(F.col("key").alias("parent"), F.col("log").alias("below"))
        rows = rows.mapInPandas(parents, "key long, n long, parent long").join(below.hint("merge"), "parent").select("key", "n", "below")
    return rows.mapInPandas(logs, "key long, n long, log double, gain double")


def _evaluate(tree: Tree, contexts: list[np.ndarray], symbol: np.ndarray, rare=None) -> np.ndarray:
    """Log probability of each symbol; contexts[d-1] is the context row of depth d, -1 from where the state is shorter.

    `rare` has, by depth, the keys and logs of next symbols that are not broadcast.
    """
    total, open_ = np.zeros(len(symbol)), np.ones(len(symbol), bool)
    for d in range(len(contexts), 0, -1):
        at = np.flatnonzero(open_ & (contexts[d - 1] >= 0))
        context = contexts[d - 1][at]
        key, value, found = (context << BITS) + symbol[at], tree.rest[d - 1][context], np.zeros(len(at), bool)
        for keys, logs in [(tree.next_keys[d - 1], tree.next_log[d - 1]), *([rare[d - 1]] if rare else [])]:
            hit, place = _find(keys, key)
            value[hit] = logs[place[hit]]
            found |= hit
        total[at] += value
        open_[at[found]] = False
    return np.where(open_, total + tree.first[symbol], total)


@dataclass
class Branches:
    """What tokens with equal contexts of the top's edge share: symbols before each token, its own, and its states below the top."""

    past: np.ndarray  # the last three symbols before the token, newest in the highest bits
    symbol: np.ndarray
    learnt: np.ndarray  # whether the token is of a training text
    rare: list[tuple[np.ndarray, np.ndarray]]  # as for `_evaluate`
    top: list[np.ndarray] = field(default_factory=list)  # contexts of the top by depth - 1
    log: np.ndarray | None = None  # of the longest state below the top that stays, nan without one
    stays: np.ndarray | None = None
    base: np.ndarray | None = None  # log in the longest context of the top

    def grow(self, tree: Tree) -> Branches:
        """Learn the contexts below the top from the training tokens, as `_grow` does those of the top."""
        order = np.argsort(self.past, kind="stable")
        past, symbol, learnt = self.past[order], self.symbol[order], self.learnt[order]
        parts = [(past >> BITS * (DEPTH - d)) & NONE for d in range(1, DEPTH + 1)]
        self.top = [np.where(x >= 0, x, -1) for x in _top(tree, parts)]
        value, reach = _evaluate(tree, self.top, symbol, self.rare), sum((x >= 0).astype(np.int8) for x in self.top)
        base, levels = value, []
        for d in range(1, DEPTH + 1):
            # Contexts below the top that occur often enough; others change nothing.
            use, least = np.flatnonzero((reach < d) & (parts[d - 1] != NONE)), 2 if d > 1 else 1
            owner = _owners(past[use] >> BITS * (DEPTH - d))
            enough = np.bincount(owner, learnt[use]) >= least
            use = use[enough[owner]]
            if not len(use):
                continue
            owner, seen = _owners(past[use] >> BITS * (DEPTH - d)), learnt[use]
            size = int(owner[-1]) + 1
            pair, at = np.unique((owner << BITS) + symbol[use], return_inverse=True)
            context, first = pair >> BITS, np.empty(len(pair), np.int64)
            first[at] = use
            n, total = np.bincount(at, seen, len(pair)), np.bincount(owner, seen, size)
            sure = n >= least
            kept, kinds = np.bincount(context, n * sure, size), np.bincount(context, sure, size)
            left = MU + np.maximum(total - kept, 0) + DISCOUNT * kinds
            rest, below = np.log(left / (total + MU)), value[first]
            log = np.where(sure, np.log(np.maximum(n - DISCOUNT, 0) + left[context] * np.exp(below)) - np.log(total[context] + MU), below + rest[context])
            gain = np.bincount(context, np.where(sure, n * (log - below) - KIND_COST, 0), size) + (total - kept) * rest
            value = value.copy()
            value[use] = log[at]
            levels.append((use, owner, value[use], gain >= DIVERGENCE * np.maximum(total, 1)))
        self.log = np.full(len(symbol), np.nan)
        longer = np.zeros(len(symbol), bool)
        for use, owner, logs, stays in reversed(levels):
            # Longer contexts that stay keep the ones they end in.
            stay = (stays | (np.bincount(owner, longer[use]) > 0))[owner]
            unset = stay & np.isnan(self.log[use])
            self.log[use[unset]] = logs[unset]
            longer[use[stay]] = True
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        self.log, self.stays, self.base, self.top = self.log[back], longer[back], base[back], [x[back] for x in self.top]
        return self

    def whole(self, tree: Tree) -> np.ndarray:
        """Log probability of each token in the longest state that stays, of the top where none does below it."""
        deepest = np.zeros(len(self.symbol), bool)
        for stays, context in zip(tree.stays, self.top):
            deepest = np.where(context >= 0, stays[context] if len(stays) else False, deepest)
        log = np.where(np.isnan(self.log), self.base, self.log)
        open_ = np.isnan(self.log) & ~deepest & (self.top[0] >= 0 if self.top else False)
        if open_.any():
            log[open_] = _states(tree, [c[open_] for c in self.top], self.symbol[open_], self.rare)
        return log


def _owners(code: np.ndarray) -> np.ndarray:
    """The number of each token's run of equal codes."""
    return np.cumsum(np.append(False, code[1:] != code[:-1]))[:len(code)]


def _top(tree: Tree, parts: list[np.ndarray]) -> list[np.ndarray]:
    """Rows of the top's contexts made of the symbols parts[0] (newest), parts[1], ...; -1 where there is none."""
    out = []
    for d in range(1, len(tree.stays) + 1):
        row = np.where(parts[d - 1] == NONE, -1, np.where(tree.hot[np.where(parts[d - 1] == NONE, 0, parts[d - 1])], parts[d - 1], -1))
        for k in range(d - 2, -1, -1):
            hit, place = _find(tree.codes[d - 2 - k], (row << BITS) + parts[k])
            row = np.where((row >= 0) & hit, place, -1)
        out.append(row)
    return out


def _portions(tree: Tree, past: np.ndarray, most: int = GROWN_TOKENS):
    """Indexes of about `most` tokens at a time, in the order of their pasts; tokens of one branch stay together."""
    order = np.argsort(past, kind="stable")
    ordered, at = past[order], 0
    while at < len(past):
        stop = min(at + most, len(past))
        last = ordered[stop - 1:stop]
        reach = sum(int(x[0] >= 0) for x in _top(tree, [(last >> BITS * (DEPTH - d)) & NONE for d in range(1, DEPTH + 1)]))
        shift = BITS * (DEPTH - min(reach + 1, DEPTH))
        stop = int(np.searchsorted(ordered, ((last[0] >> shift) + 1) << shift))
        yield order[at:stop]
        at = stop


def _states(tree: Tree, contexts: list[np.ndarray], symbol: np.ndarray, rare=None) -> np.ndarray:
    """Log probability of each symbol in the longest of its contexts of the top that stays."""
    longest = np.zeros(len(symbol), np.int64)
    for d, context in enumerate(contexts, 1):
        if len(tree.stays[d - 1]):
            longest[(context >= 0) & tree.stays[d - 1][context]] = d
    return _evaluate(tree, [np.where(longest >= d, c, -1) for d, c in enumerate(contexts, 1)], symbol, rare)


def _missing(tree: Tree, contexts: list[np.ndarray], symbol: np.ndarray):
    """By depth, the tokens (and their keys) whose next symbol has to be looked up in the written tables."""
    open_ = np.ones(len(symbol), bool)
    for d in range(len(contexts), 0, -1):
        at = np.flatnonzero(open_ & (contexts[d - 1] >= 0))
        key = (contexts[d - 1][at] << BITS) + symbol[at]
        hit, _ = _find(tree.next_keys[d - 1], key)
        open_[at[hit]] = False
        yield d, at[~hit], key[~hit]


TOKENS = "bucket long, group long, past binary, symbol binary, place binary, log binary, depth int"


def _branches(rows: DataFrame, tree: Tree, buckets: int, mode: str) -> DataFrame:
    """Tokens by bucket of the first context outside the top, as arrays: past, symbol and place (row within its group, highest bit: held out).

    Tokens whose contexts and next symbols all are in the broadcast come with their sums instead. Mode `open` leaves these out and
    takes only training tokens with a context of the top that has not stayed so far; `rare` gives bucket, depth and key
    of the next symbols to be looked up.
    """
    open_only, complete = mode == "open", NEXT_SHARE * tree.train_tokens <= 1
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def split(frames):
        tree = shared.value
        depth = len(tree.stays)
        for frame in frames:
            frame = frame[~frame.held_out] if open_only else frame
            group = frame.row.to_numpy(np.int64) >> GROUP_BITS
            size = frame.n_tokens.to_numpy(np.int64)
            slices = (np.cumsum(size) - size) // BRANCH_TOKENS
            for a, b in _runs(group, slices):
                held = frame.iloc[a:b]
                symbol = np.frombuffer(b"".join(held.symbols), np.int32).astype(np.int64)
                start = np.cumsum(size[a:b]) - size[a:b]
                place = (held.row.to_numpy(np.int64) & ((1 << GROUP_BITS) - 1)) | (held.held_out.to_numpy(bool).astype(np.int64) << 15)
                place = np.repeat(place, size[a:b])
                contexts = tree.contexts(symbol, start, depth) if depth else []
                parts = [_before(symbol, start)]
                for _ in range(1, DEPTH):
                    last = np.append(NONE, parts[-1][:-1])
                    last[start] = NONE
                    parts.append(last)
                reach = sum(((x >= 0).astype(np.int8) for x in contexts), np.zeros(len(symbol), np.int8))
                within = reach == DEPTH
                for d in range(1, DEPTH + 1):
                    within |= (reach == d - 1) & (parts[d - 1] == NONE)
                if open_only:
                    chosen = np.zeros(len(symbol), bool)
                    for d, c in enumerate(contexts, 1):
                        chosen |= (c >= 0) & ~tree.stays[d - 1][c]
                    chosen &= ~within
                else:
                    if mode == "rare":
                        for d, at, wanted in _missing(tree, contexts, symbol):
                            bucket = _bucket([x[at] for x in parts], reach[at], within[at], symbol[at], buckets)
                            order = _order(wanted, bucket, buckets)
                            bucket, wanted = bucket[order], wanted[order]
                            new = np.append(True, (bucket[1:] != bucket[:-1]) | (wanted[1:] != wanted[:-1]))[:len(at)]
                            yield pd.DataFrame({"bucket": bucket[new], "depth": d, "key": wanted[new]})
                        continue
                    ready = within.copy()
                    if not complete:
                        inside = np.flatnonzero(within)
                        for _, at, _ in _missing(tree, [c[inside] for c in contexts], symbol[inside]):
                            ready[inside[at]] = False
                    if ready.any():
                        log = _states(tree, [c[ready] for c in contexts], symbol[ready])
                        sums = np.bincount(place[ready] & 0x7FFF, log)
                        rows_of = np.unique(place[ready] & 0x7FFF)
                        yield pd.DataFrame({"bucket": [int(group[a] % buckets)], "group": [group[a]], "past": [b""], "symbol": [b""],
                                            "place": [rows_of.astype(np.uint16).tobytes()], "log": [sums[rows_of].tobytes()], "depth": 0})
                    chosen = ~ready
                if not chosen.any():
                    continue
                chosen = np.flatnonzero(chosen)
                parts = [x[chosen] for x in parts]
                bucket, past = _bucket(parts, reach[chosen], within[chosen], symbol[chosen], buckets), (parts[0] << 2 * BITS) + (parts[1] << BITS) + parts[2]
                order = _order(past, bucket, buckets)
                chosen, bucket, past = chosen[order], bucket[order], past[order]
                cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1), len(bucket)]
                at = list(zip(cuts, cuts[1:]))
                own, place = symbol[chosen].astype(np.int32), place[chosen].astype(np.uint16)
                yield pd.DataFrame({"bucket": bucket[cuts[:-1]], "group": group[a], "past": [_packed(np.diff(past[x:y], prepend=0)) for x, y in at],
                                    "symbol": [_packed(own[x:y]) for x, y in at], "place": [_packed(place[x:y]) for x, y in at], "log": b"", "depth": 0})

    return rows.mapInPandas(split, "bucket long, depth int, key long" if mode == "rare" else TOKENS)


def _packed(values: np.ndarray) -> bytes:
    """Compressed byte by byte of the numbers: their count, the length of each part, then all lowest bytes, and so on."""
    codec = pa.Codec("zstd", 1)
    parts = [codec.compress(plane.tobytes(), asbytes=True) for plane in values.view(np.uint8).reshape(len(values), -1).T]
    return np.array([len(values), *map(len, parts)], np.int32).tobytes() + b"".join(parts)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    codec, width = pa.Codec("zstd", 1), np.dtype(kind).itemsize
    size, *lengths = np.frombuffer(data, np.int32, width + 1)
    planes, at = np.empty((size, width), np.uint8), 4 * (width + 1)
    for k, length in enumerate(lengths):
        planes[:, k] = np.frombuffer(codec.decompress(data[at:at + length], int(size)), np.uint8)
        at += length
    return planes.view(kind).ravel()


def _size(data: bytes) -> int:
    return int(np.frombuffer(data, np.int32, 1)[0])


def _looked_up(frames):
    """Next symbols (bucket, depth, key, value) packed by bucket and depth: keys as the past of tokens is, values as logs."""
    def packed(held):
        frame = pd.concat(held).sort_values(["bucket", "depth", "key"])
        bucket, depth, key, value = (frame[c].to_numpy() for c in ("bucket", "depth", "key", "value"))
        cuts = list(_runs(bucket, depth))
        first = [a for a, _ in cuts]
        return pd.DataFrame({"bucket": bucket[first], "group": -1, "past": [_packed(np.diff(key[a:b], prepend=0)) for a, b in cuts], "symbol": b"",
                             "place": b"", "log": [value[a:b].tobytes() for a, b in cuts], "depth": depth[first]})

    held, size = [], 0
    for frame in frames:
        if len(frame):
            held.append(frame)
            size += len(frame)
        if size >= FRAME_ROWS:
            yield packed(held)
            held, size = [], 0
    if held:
        yield packed(held)


def _bucket(parts: list[np.ndarray], reach: np.ndarray, within: np.ndarray, symbol: np.ndarray, buckets: int) -> np.ndarray:
    """By the context at the edge of the top; tokens with no longer one need none of their branch and are spread by their symbol.

    parts: the symbols before each token, newest first; reach: the length of its longest context of the top.
    """
    key = np.zeros(len(symbol), np.int64)
    for d in range(1, DEPTH + 1):
        key = np.where(reach >= d - 1, (key << BITS) + parts[d - 1], key)
    mixed = words.mix(key.astype(np.uint64))
    return (np.where(within, words.mix(mixed + symbol.astype(np.uint64)), mixed) % np.uint64(buckets)).astype(np.int64)


def _order(value: np.ndarray, bucket: np.ndarray, buckets: int) -> np.ndarray:
    """Indexes by bucket, then value."""
    order = np.argsort(value)
    of = bucket[order]
    return order[np.argsort(of.astype(np.uint16) if buckets <= 1 << 16 else of, kind="stable")]


def _runs(*keys: np.ndarray):
    """First and end index of each run of rows with equal keys."""
    if len(keys[0]):
        change = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        cuts = [0, *(np.flatnonzero(change) + 1), len(keys[0])]
        yield from zip(cuts, cuts[1:])


def _by_bucket(frames):
    """The rows of one bucket after the other."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        for a, b in _runs(frame.bucket.to_numpy()):
            if held and held[-1].bucket.iloc[0] != frame.bucket.iloc[a]:
                yield pd.concat(held)
                held = []
            held.append(frame.iloc[a:b])
    if held:
        yield pd.concat(held)


def _model(rows: DataFrame, tree: Tree) -> DataFrame:
    """row and model, the log probability of its symbols in the whole tree."""
    tokens = rows.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    buckets = max(BUCKETS, -(-tokens // BRANCH_TOKENS))
    context = rows.sparkSession.sparkContext

    rare = None
    if NEXT_SHARE * tree.train_tokens > 1:
        wanted = _branches(rows, tree, buckets, "rare")  # the same from other rows comes again, which is less than a shuffle to tell
        written = [level.where(F.col("n") < NEXT_SHARE * tree.train_tokens).select(F.lit(d).cast("int").alias("depth"), "key", F.col("log").alias("value"))
                   for d, level in enumerate(tree.levels, 1)]
        rare = _step(wanted.join(reduce(DataFrame.unionByName, written).hint("merge"), ["depth", "key"]), "rare")
        rare = rare.select("bucket", "depth", "key", "value").mapInPandas(_looked_up, TOKENS)

    def gathered(mode):
        found = _branches(rows, tree, buckets, mode)
        found = found if rare is None else found.unionByName(rare)
        return found.repartition(buckets, "bucket").sortWithinPartitions("bucket")

    def grown(tree, frame):
        tokens, more = frame[frame.symbol.str.len() > 0], []
        for d in range(1, DEPTH + 1):
            found = frame[frame.depth == d]
            key = np.concatenate([np.zeros(0, np.int64), *[np.cumsum(_unpacked(x, np.int64)) for x in found.past]])
            order = np.argsort(key)
            more.append((key[order], np.concatenate([np.zeros(0), *[np.frombuffer(x) for x in found.log]])[order]))
        place = np.concatenate([_unpacked(x, np.uint16) for x in tokens.place])
        past = np.concatenate([np.cumsum(_unpacked(x, np.int64)) for x in tokens.past])
        symbol = np.concatenate([_unpacked(x, np.int32) for x in tokens.symbol])
        branches = ((at, Branches(past[at], symbol[at].astype(np.int64), place[at] < 1 << 15, more).grow(tree)) for at in _portions(tree, past))
        return branches, place

    if not all(stay[np.unique(c)].all() for stay, c in _edges(tree)):
        top = context.broadcast(tree)

        def forced(frames):
            for frame in _by_bucket(frames):
                if not frame.symbol.str.len().any():
                    continue
                for _, found in grown(top.value, frame)[0]:
                    for d, c in enumerate(found.top, 1):
                        row = np.unique(c[found.stays & (c >= 0)])
                        yield pd.DataFrame({"depth": np.full(len(row), d), "context": row})

        # At most the contexts of the top.
        for d, c in zip(*_pairs(_step(gathered("open").mapInPandas(forced, "depth long, context long").distinct(), "forced"), "depth", "context")):
            tree.stays[d - 1][c] = True
    whole = context.broadcast(tree)

    def sums(frames):
        for frame in _by_bucket(frames):
            ready = frame[(frame.depth == 0) & (frame.log.str.len() > 0)]
            yield pd.DataFrame({"group": ready.group, "place": ready.place, "log": ready.log})
            if not frame.symbol.str.len().any():
                continue
            branches, place = grown(whole.value, frame)
            frame = frame[frame.symbol.str.len() > 0]
            log = np.empty(len(place))
            for at, found in branches:
                log[at] = found.whole(whole.value)
            size = [_size(x) for x in frame.place]
            key = (np.repeat(frame.group.to_numpy(np.int64), size) << GROUP_BITS) + (place & 0x7FFF).astype(np.int64)
            row, at = np.unique(key, return_inverse=True)
            total, cuts = np.bincount(at, log, len(row)), list(_runs(row >> GROUP_BITS))
            yield pd.DataFrame({"group": [row[a] >> GROUP_BITS for a, _ in cuts], "log": [total[a:b].tobytes() for a, b in cuts],
                                "place": [(row[a:b] & ((1 << GROUP_BITS) - 1)).astype(np.uint16).tobytes() for a, b in cuts]})[["group", "place", "log"]]

    def totals(frames):
        held, total = None, np.zeros(1 << GROUP_BITS)
        seen = np.zeros(1 << GROUP_BITS, bool)

        def finish():
            at = np.flatnonzero(seen)
            return pd.DataFrame({"row": (held << GROUP_BITS) + at, "model": total[at]})

        for frame in frames:
            for group, place, log in zip(frame.group, frame.place, frame.log):
                if held is not None and group != held:
                    yield finish()
                    total[:], seen[:] = 0, False
                held, place = group, np.frombuffer(place, np.uint16)
                total[place] += np.frombuffer(log)
                seen[place] = True
        if held is not None:
            yield finish()

    found = gathered("all").mapInPandas(sums, "group long, place binary, log binary")
    # Written, so that the tokens' shuffle files are gone before the rare words are joined.
    return _step(found.repartition("group").sortWithinPartitions("group").mapInPandas(totals, "row long, model double"), "model")


def _edges(tree: Tree):
    """Which contexts stay, and the rows that are contexts of the top, by depth."""
    for d, stay in enumerate(tree.stays):
        yield stay, np.flatnonzero(tree.hot) if not d else np.arange(len(stay))


def score(docs: DataFrame, tree: Tree, counts: DataFrame, training: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row; `training` marks the learnt rows."""
    return _scored(_walked(docs, tree, training), tree, counts)


def _walked(docs: DataFrame, tree: Tree, training: Column) -> DataFrame:
    """The written rows with a number, their symbols, sums of counts that are at hand, and the other words."""
    shared = docs.sparkSession.sparkContext.broadcast(tree)

    @F.pandas_udf("n_tokens long, n_known long, base double, own double, words array<long>, times array<long>, symbols binary")
    def walk(texts: pd.Series) -> pd.DataFrame:
        tree, rows = shared.value, []
        _, at = _find(tree.known, tree.symbols)
        numbers, logs = np.full(len(tree.known), -1), np.log(tree.known_n + 1.0)
        numbers[at] = START + 1 + tree.symbol_at  # symbols are known words
        for value, classes, start in _tokens(texts.tolist()):
            known, place = _find(tree.known, value)
            symbol, own = classes, np.zeros(len(value))
            if len(tree.known):
                symbol = np.where(known & (numbers[place] >= 0), numbers[place], classes)
                own = np.where(known, logs[place], 0)
            rare, log = symbol < START, np.zeros(len(symbol))
            log[rare] -= tree.class_log[symbol[rare]]
            log[rare & known] += own[rare & known]
            base, stops, symbol = np.where(known, own, 0), np.append(start[1:], len(value)), symbol.astype(np.int32)
            for a, b in zip(start, stops):
                word, times = np.unique(value[a:b][~known[a:b]], return_counts=True)
                rows.append((b - a, int(known[a:b].sum()), base[a:b].sum(), log[a:b].sum(), word.astype(np.int64), times.astype(np.int64), symbol[a:b].tobytes()))
        return pd.DataFrame(rows, columns=["n_tokens", "n_known", "base", "own", "words", "times", "symbols"])

    walked = docs.select("doc_id", (~training).alias("held_out"), walk("text").alias("r")).select("doc_id", "held_out", "r.*")
    # The row number is written with the row, so later reads agree on it.
    return _step(walked.withColumn("row", F.monotonically_increasing_id()), "walked")


def _scored(walked: DataFrame, tree: Tree, counts: DataFrame) -> DataFrame:
    """The result of `score`, from written rows."""
    model = _model(walked.select("row", "held_out", "n_tokens", "symbols"), tree)
    rare = walked.select("row", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("times").alias("times"))))
    found = rare.join(counts.where(F.col("n") < KNOWN_SHARE * tree.train_tokens).select("word", "n").hint("merge"), "word")
    added = found.groupBy("row").agg(F.sum(F.col("times") * F.log(F.col("n") + 1.0)).alias("added"), F.sum("times").alias("added_known"))
    whole = walked.drop("words", "times", "symbols").join(added.hint("merge"), "row", "left").join(model.hint("merge"), "row")
    more, each = F.coalesce("added", F.lit(0.0)), float(np.log(tree.train_tokens + tree.distinct + 1))
    ln10 = float(np.log(10))
    return whole.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("added_known", F.lit(0).cast("long"))).alias("n_known"),
                        F.lit(tree.train_tokens).cast("long").alias("train_tokens"), ((F.col("base") + more - F.col("n_tokens") * each) / ln10).alias("base_score"),
                        ((F.col("model") + F.col("own") + more) / ln10).alias("score"))


def op9_suffix_tree(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    training = crc_of_id() % 7 != 2
    tree, counts = _alphabet(docs.where(training))
    walked = _walked(docs, tree, training)
    _grow(tree, walked.where(~F.col("held_out")))
    return _scored(walked, tree, counts)


register("op9_suffix_tree")(op9_suffix_tree)
