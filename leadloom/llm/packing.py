"""Best-fit packing of tokenised documents into sequences of a fixed capacity, by bin completion.

A document's ids are closed with an end id; only longer ones are cut, into pieces of the capacity. How many pieces
there are of each length says all about the packing, and has at most `capacity` rows at any data size. The search works
on these counts: it takes the largest length left, enumerates the undominated fillings around it, prunes by the waste
that a better solution may still have, and applies a filling as often as the counts allow. Best-fit decreasing gives the
first incumbent; the search ends at the lower bound or when its budget of fillings is spent. The solution is a list of
patterns; every piece finds its place by its rank among the pieces of its length, which Spark counts in buckets.

Defined results: null and empty texts are one piece holding the end id; repeated rows are packed as often as they
occur; an empty table gives no rows; null ids are allowed; extra columns are not used. Sequence numbers start at 0.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.common import keep, register, table
from leadloom.llm.word_bpe import tokenizer

CAPACITY, END = 2048, 0
#: Fillings tried before the search settles for its incumbent; pieces ranked in one bucket, on average.
BUDGET, BUCKET_ROWS = 4000, 50_000

Pattern = tuple[tuple[int, int], ...]  # (length, how many), longest first


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, text_key, piece, start, length, ids_crc32 and, if asked for, ids of every piece."""
    kind = "array<struct<piece int, start long, length long, crc long" + (", ids array<int>>>" if with_ids else ">>")

    @F.pandas_udf(kind)
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder, tail = tokenizer(path), np.array([end], "<u4").tobytes()
        try:
            for texts in batches:
                out = []
                for text in texts:
                    ids = coder.encode(text) + tail
                    parts = []
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at:at + 4 * capacity]
                        row = {"piece": k, "start": at // 4, "length": len(part) // 4, "crc": zlib.crc32(part)}
                        parts.append(row | {"ids": np.frombuffer(part, "<u4").astype(np.int32)} if with_ids else row)
                    out.append(parts)
                yield pd.Series(out, dtype=object)
        finally:
            coder.forget()

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.inline(cut("text")))
    return rows.withColumnRenamed("crc", "ids_crc32")


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: all ids, and for each k those that pieces longer than capacity - k cannot share (waste)."""
    total = sum(length * n for length, n in counts.items())
    best = -(-total // capacity)
    long_first = sorted(counts, reverse=True)
    for k in range(1, capacity // 2 + 1):
        alone = sum(counts[x] for x in long_first if x > capacity - k)
        half = [(x, counts[x]) for x in long_first if capacity / 2 < x <= capacity - k]
        room = sum((capacity - x) * n for x, n in half)
        small = sum(x * n for x, n in counts.items() if k <= x <= capacity / 2)
        best = max(best, alone + sum(n for _, n in half) + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on counts: each length goes to the fullest sequences that have room, as often as it fits."""
    room: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)
    rooms: list[int] = []

    def put(pattern: Pattern, times: int) -> None:
        left = capacity - sum(x * n for x, n in pattern)
        if left not in room:
            insort(rooms, left)
        room[left].append((pattern, times))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                pattern, times, space = (), left, capacity
            else:
                space = rooms[at]
                pattern, times = room[space].pop()
                if not room[space]:
                    del room[space], rooms[at]
            each = space // length
            filled = min(times, left // each)
            left -= filled * each
            if filled:
                put(pattern + ((length, each),), filled)
            if filled < times and left:  # fewer than fill one sequence
                put(pattern + ((length, left),), 1)
                filled, left = filled + 1, 0
            if pattern and filled < times:
                put(pattern, times - filled)
    return [p for group in room.values() for p in group]


def fillings(space: int, lengths: list[int], counts: dict[int, int], waste: int, most: int = 64, depth: int = 6) -> list[tuple[int, Pattern]]:
    """Undominated fillings of `space` that waste at most `waste`, least waste first; `lengths` is sorted upwards.

    A filling is dominated if another one holds, in place of some of its pieces, a piece at least as long as them
    together. Pieces are added from long to short, and the last one is always the longest that fits.
    """
    found: dict[Pattern, int] = {}
    steps = 0

    def add(left: int, chosen: list[int], limit: int) -> None:
        nonlocal steps
        steps += 1
        if len(found) >= most or steps > 40 * most:
            return
        at = bisect_right(lengths, min(left, limit)) - 1
        while at >= 0 and chosen.count(lengths[at]) >= counts[lengths[at]]:
            at -= 1
        if at < 0:
            if left <= waste:
                found.setdefault(tuple((x, chosen.count(x)) for x in dict.fromkeys(chosen)), left)
            return
        if len(chosen) + 1 >= depth:
            if left - lengths[at] <= waste:
                add(left - lengths[at], [*chosen, lengths[at]], lengths[at])
            return
        first = True
        while at >= 0 and len(found) < most and steps <= 40 * most:
            x = lengths[at]
            if chosen.count(x) < counts[x]:
                # a shorter piece than the longest that fits pays only if others fill more beside it
                if first or left - x >= lengths[0]:
                    add(left - x, [*chosen, x], x)
                first = False
            at -= 1

    add(space, [], space)
    ranked = sorted((left, p) for p, left in found.items())
    kept: list[tuple[int, Pattern]] = []
    for left, pattern in ranked:
        longest, size = pattern[0][0] if pattern else 0, sum(x * n for x, n in pattern)
        if not any(size <= p[0][0] and p != pattern for _, p in kept if p) or size == longest:
            kept.append((left, pattern))
    return kept


def complete(counts: dict[int, int], capacity: int, budget: int = BUDGET) -> list[tuple[Pattern, int]]:
    """Patterns and how often each is used: branch and bound over fillings around the longest piece left."""
    counts = {x: n for x, n in counts.items() if n}
    whole = [(((capacity, 1),), counts.pop(capacity))] if capacity in counts else []
    if not counts:
        return whole
    best = best_fit(counts, capacity)
    bins, least = sum(n for _, n in best), lower_bound(counts, capacity)
    total = sum(x * n for x, n in counts.items())
    spent = 0

    def search(left: dict[int, int], lengths: list[int], used: int, wasted: int) -> list[tuple[Pattern, int]] | None:
        nonlocal spent, best, bins
        if not lengths:
            return []
        allowed = (bins - 1) * capacity - total - wasted
        longest = lengths[-1]
        left[longest] -= 1
        options = fillings(capacity - longest, [x for x in lengths if left[x]], left, allowed)
        left[longest] += 1
        for waste, pattern in options:
            spent += 1
            if spent > budget or wasted + waste > (bins - 1) * capacity - total:
                return None
            need = defaultdict(int, pattern)
            need[longest] += 1
            times = min(left[x] // n for x, n in need.items())
            if waste:  # never waste more at once than a better solution may
                times = max(1, min(times, allowed // waste))
            for x, n in need.items():
                left[x] -= n * times
            rest = search(left, [x for x in lengths if left[x]], used + times, wasted + waste * times)
            for x, n in need.items():
                left[x] += n * times
            if rest is not None:
                return [(tuple(sorted(need.items(), reverse=True)), times), *rest]
        return None

    while bins > least and spent <= budget:
        better = _deep(search, dict(counts), sorted(counts))
        if better is None:
            break
        best, bins = better, sum(n for _, n in better)
    return whole + best


def _deep(search, counts, lengths):
    """The search goes as deep as there are patterns."""
    import sys

    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, 20_000))
    try:
        return search(counts, lengths, 0, 0)
    finally:
        sys.setrecursionlimit(before)


def slots(solution: list[tuple[Pattern, int]]) -> Iterator[tuple[int, int, int, int, int]]:
    """length, first rank, pieces per sequence, first sequence, offset: where the pieces of each length go."""
    used, first = defaultdict(int), 0
    for pattern, times in solution:
        offset = 0
        for length, n in pattern:
            yield length, used[length], n, first, offset
            used[length] += n * times
            offset += n * length
        first += times


def place(cut: DataFrame, capacity: int = CAPACITY, budget: int = BUDGET) -> DataFrame:
    """The written pieces with sequence_id and offset."""
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # `capacity` rows at most
    table_rows = sorted(slots(complete(counts, capacity, budget)))
    plan = cut.sparkSession.sparkContext.broadcast(np.array(table_rows or np.zeros((0, 5)), np.int64))
    buckets = max(1, sum(counts.values()) // BUCKET_ROWS)
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_key", "piece"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "text_key", "piece")
    ranked = dealt.withColumn("rank", F.row_number().over(inside) - 1).join(sizes, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("earlier")).drop("bucket", "earlier")

    @F.pandas_udf("sequence_id long, offset long")
    def find(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        rows, length, rank = plan.value, length.to_numpy(), rank.to_numpy()
        order = (rows[:, 0] << 48) + rows[:, 1]
        hit = rows[np.searchsorted(order, (length << 48) + rank, "right") - 1]
        nth = rank - hit[:, 1]
        return pd.DataFrame({"sequence_id": hit[:, 3] + nth // hit[:, 2], "offset": hit[:, 4] + nth % hit[:, 2] * length})

    return ranked.withColumn("at", find("length", "rank")).drop("rank").select("*", "at.*").drop("at")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = False, budget: int = BUDGET) -> DataFrame:
    """One row per piece: doc_id, text_key, piece, start, length, ids_crc32 (, ids), sequence_id, offset."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    return place(keep(pieces(docs, path, capacity, end, with_ids), "pieces"), capacity, budget)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length and ids of every packed sequence (from `pack(..., with_ids=True)`)."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids")).withColumn("length", F.size("ids"))


@register("op1_best_fit_packing")
def op1_best_fit_packing(spark, folder):
    packed = pack(table(spark, folder, "documents").select("doc_id", "text"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
