"""Near duplicates: an exact Jaccard self-join of shingle sets with prefix trees, and the components of its links.

A document's set holds the hashes of its distinct five-word shingles. The global order of shingles is the order of
their hashes. Documents with equal sets form a class; classes are joined as follows.

1. Blocks. A class enters one block for each pair of neighbours among the first PREFIX items of its ordered set. Two
   sets with a likeness of 0.8 have a union in which at most a fifth of the items are not shared, so two shared
   items stand next to each other: for sets of up to PREFIX items always; for longer ones, whose order is random,
   all PREFIX places would have to avoid it, with probability below 1e-11.
2. Stars, in at most STARS rounds, as long as a round links one class in YIELD. A block's head is its class with the
   most and largest blocks, which of independent near copies is the least changed one; from the second round on it is
   taken from a random part of the classes. Each class meets the one that heads most of its blocks, and takes over its label if they link. Groups of copies of any size collapse with a comparison or two per member.
3. Rest. Blocks that still hold several components are searched in full: the members outside the block's largest
   component meet all members of other components whose counts in ranges of hashes do not rule the likeness out;
   before that, only the nearest of each component, as one link is enough to join two components.
Every comparison is a search in a `PrefixTree` of at most SLICE members around one probe. No pair is skipped unless a
bound rules it out or its classes already share a component, so components are those of all links.

Defined results: null, empty and white-space texts have an empty set and are their own component; rows repeated as a
whole, or with equal sets, are one class; rows that share a doc_id but not a text are told apart by the hash of their
text; a null doc_id is never the smallest of a component unless all its ids are null. Extra columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm import words
from leadloom.llm.common import by_group, components, free_name, join_hot, keep, register, table
from leadloom.llm.prefix_tree import PrefixTree

SIZE, PERCENT, PREFIX, SLICE, BLOCK, STARS, YIELD, NEAREST = 5, 80, 41, 512, 2048, 4, 200, 3
#: From the second round of stars on, heads come from one part in so many.
PARTS = 4
#: Documents whose keys are broadcast to fetch their texts (24 bytes each).
FEW = 400_000


def _set(shingles: np.ndarray) -> np.ndarray:
    return np.unique(shingles)


def _node(items: np.ndarray) -> int:
    """64-bit name of a class: equal for equal sets."""
    return int.from_bytes(hashlib.md5(items.tobytes()).digest()[:8], "little", signed=True)


def _ranges(items: np.ndarray) -> bytes:
    """What bounds the likeness of two sets: whether the counts in 512 ranges of hashes are odd, and the counts in 64 ranges."""
    counts = np.bincount((items >> np.uint64(55)).astype(np.int64), minlength=512)
    return np.packbits(counts & 1).tobytes() + np.minimum(counts.reshape(64, 8).sum(axis=1), 65535).astype("<u2").tobytes()


def _bounds(ranges) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(b"".join(ranges), np.uint8).reshape(-1, 192)
    return rows[:, :64].copy().view(np.uint64), rows[:, 64:].copy().view("<u2")


def _neighbours(items: np.ndarray) -> np.ndarray:
    head = items[:PREFIX]
    return words.mix(head[:-1] * np.uint64(0xA24BAED4963EE407) + head[1:]).astype(np.int64)


def sketches(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, text_key, n (set size), node (its class; null for empty sets), blocks and ranges of every document."""
    @F.pandas_udf("n long, node long, blocks array<long>, ranges binary")
    def build(texts: pd.Series) -> pd.DataFrame:
        rows = [(0, None, None, None)] * len(texts)
        for i, w in enumerate(words.of_texts(texts.tolist())):
            if len(w):
                items = _set(words.shingles(w, size))
                rows[i] = len(items), _node(items), _neighbours(items), _ranges(items)
        n, node, blocks, ranges = zip(*rows) if rows else ((), (), (), ())
        return pd.DataFrame({"n": pd.array(n, "int64"), "node": pd.array(node, "Int64"), "blocks": pd.Series(blocks, dtype=object),
                             "ranges": pd.Series(ranges, dtype=object)})

    found = docs.select("doc_id", F.xxhash64("text").alias("text_key"), build("text").alias("found"))
    return found.select("doc_id", "text_key", "found.*")


def _possible(n, m, a, b, percent: int) -> np.ndarray:
    """Whether the bounds leave the likeness possible, row by row; `a` and `b` are pairs of arrays from `_bounds`."""
    return _apart(n, m, a, b, percent) < np.iinfo(np.int64).max


def _apart(n, m, a, b, percent: int) -> np.ndarray:
    """How many items are surely not shared, row by row; the largest number where that rules the likeness out.

    Ranges with odd counts on one side only hold an item that is not shared; so do the differences of counts.
    """
    n, m = np.broadcast_arrays(n, m)
    most = (n + m) - 2 * percent * (n + m) / (100 + percent)  # items that may not be shared
    apart = np.bitwise_count(a[0] ^ b[0]).sum(axis=-1, dtype=np.int64)
    at = np.flatnonzero(apart <= most)
    if len(at):
        x, y = (v[at] if len(v) == len(apart) else v for v in (a[1], b[1]))
        apart[at] = np.maximum(apart[at], np.abs(x.astype(np.int32) - y).sum(axis=-1))
    return np.where(apart <= most, apart, np.iinfo(np.int64).max)


def _shared_blocks(classes: DataFrame) -> DataFrame:
    """node, block and the node's weight (the sum of its blocks' sizes in bits), for the blocks of two classes at least."""
    members = classes.select("node", F.explode("blocks").alias("block"))
    shared_by = keep(members.groupBy("block").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "blocks")
    sized = join_hot(members, shared_by.withColumn("bits", F.length(F.bin("times"))), "block", "times")
    weight = F.sum("bits").over(Window.partitionBy("node"))  # at most PREFIX rows of each node
    return keep(sized.withColumn("weight", weight).drop("bits"), "members")


def _live(members: DataFrame, labels: DataFrame | None, turn: int) -> tuple[DataFrame, DataFrame]:
    """Members with their component; the blocks of several components with their first member in the order of this turn."""
    if labels is None:
        members = members.withColumn("component", F.col("node"))
    else:
        members = members.join(labels.hint("merge"), "node")
    part = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(PARTS if turn else 1))
    order = F.struct(part.alias("part"), (-F.col("weight")).alias("o"), F.col("node"), F.col("component"))
    blocks = members.groupBy("block").agg(F.min(order).alias("head"), F.count(F.lit(1)).alias("times"),
                                          F.min("component").alias("low"), F.max("component").alias("high"))
    return members, keep(blocks.where("low <> high").select("block", "times", "head"), "heads")


def _stars(members: DataFrame, labels: DataFrame | None, turn: int) -> DataFrame:
    """Pairs (node, probe): for each class, of the heads of its blocks that are in another component, the one that heads most of them.

    A passage that many texts share heads few of a class's blocks, its near copies head most. Ties go to the first in the
    order of this turn. A class has at most PREFIX blocks, so the heads counted for it are few.
    """
    members, heads = _live(members, labels, turn)
    met = join_hot(members, heads, "block", "times").where("head.component <> component")
    return met.groupBy("node").agg(F.mode("head", True).alias("head")).select("node", F.col("head.node").alias("probe"))


def _adopted(classes: DataFrame, labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after a round: a class that links takes over its probe's label, and then the label of the class that label names.

    Equal labels mean one component; the reverse holds once `components` has run over all links.
    """
    before = classes.select("node", F.col("node").alias("component")) if labels is None else labels
    named = before.select(F.col("node").alias("b"), F.col("component").alias("taken"))
    taken = links.join(named.hint("merge"), "b").select(F.col("a").alias("node"), "taken")
    step = keep(before.join(taken.hint("merge"), "node", "left").select("node", F.coalesce("taken", "component").alias("component")), "labels")
    again = step.select(F.col("node").alias("component"), F.col("component").alias("next"))
    sizes = keep(step.groupBy("component").agg(F.count(F.lit(1)).alias("times")).join(again.hint("merge"), "component"), "names")
    return keep(join_hot(step, sizes, "component", "times").select("node", F.col("next").alias("component")), "labels")


def _sifted(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs that sizes and ranges leave possible."""
    light = classes.select("node", "n", "ranges")
    probes = light.select(F.col("node").alias("probe"), F.col("n").alias("probe_n"), F.col("ranges").alias("probe_ranges"))
    joined = pairs.join(light.hint("merge"), "node").join(probes.hint("merge"), "probe")

    @F.pandas_udf("boolean")
    def possible(n, m, a, b):
        return pd.Series(_possible(n.to_numpy(), m.to_numpy(), _bounds(a), _bounds(b), percent))

    return joined.where(possible("n", "probe_n", "ranges", "probe_ranges")).select("node", "probe")


def _linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the written pairs (node, probe) that link, as (a, b); each is searched in a tree of at most SLICE members."""
    nodes = pairs.select("node").unionByName(pairs.select(F.col("probe").alias("node"))).distinct()
    wanted = keep(nodes.join(classes.hint("merge"), "node").select("node", "rep", "rep_key"), "wanted")
    # The texts of a few documents are fetched without moving the others; beyond the checked bound, all texts shuffle once.
    wanted = F.broadcast(wanted) if wanted.count() <= FEW else wanted.hint("merge")
    texts = docs.select("doc_id", "text").withColumn("text_key", F.xxhash64("text")).join(
        wanted, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("text_key") == F.col("rep_key"))).select("node", "text")

    def build(batches):
        for batch in batches:
            items = [_set(words.shingles(w, size)).tobytes() for w in words.of_texts(batch.text.tolist())]
            yield pd.DataFrame({"node": batch.node, "items": items})

    sets = keep(texts.mapInPandas(build, "node long, items binary"), "sets")
    probes = keep(pairs.groupBy("probe").agg(F.count(F.lit(1)).alias("times"))
                  .withColumn("slices", F.ceil(F.col("times") / SLICE)), "probes")
    dealt = join_hot(pairs, probes, "probe", "times").withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices")))
    members = dealt.join(sets.hint("merge"), "node").select("probe", "slice", "node", F.lit(False).alias("head"), "items")
    heads = probes.join(sets.hint("merge"), probes["probe"] == sets["node"]).select(
        "probe", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"), "node", F.lit(True).alias("head"), "items")

    def search(group):
        _, first = np.unique(np.where(group["head"], 0, group["node"]), return_index=True)  # rows repeated as a whole come several times
        rest = first[~group["head"][first].astype(bool)]
        probe = group["items"][np.flatnonzero(group["head"])[0]]
        tree = PrefixTree([np.frombuffer(group["items"][i], "<u8") for i in rest])
        a = group["node"][rest[tree.search(np.frombuffer(probe, "<u8"), percent)]]
        return a, np.full(len(a), group["probe"][0])

    return by_group(members.unionByName(heads), ["probe", "slice"], search, "a long, b long")


def _rest(members: DataFrame, labels: DataFrame | None, classes: DataFrame, percent: int, nearest: int | None = None) -> DataFrame:
    """Pairs (node, probe) of different components that share a block and that sizes and ranges leave possible.

    With `nearest`, only the so many nearest members of each component, by the bounds, for each probe and block.

    Of a block's components, the one with the most members is its main one. The others' members meet all members; two
    members of the main component never meet. Large blocks are dealt in slices of either side.
    """
    members = members.withColumn("component", F.col("node")) if labels is None else members.join(labels.hint("merge"), "node")
    members = keep(members.select("node", "block", "component"), "labelled")
    parts = members.groupBy("block", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("block").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("times"), F.count(F.lit(1)).alias("parts"))
    mixed = mixed.where("parts > 1").select(
        "block", "times", F.col("main.component").alias("main"), F.ceil(F.col("times") / BLOCK).cast("int").alias("slices"),
        F.ceil((F.col("times") - F.col("main.n")) / BLOCK).cast("int").alias("few_slices"))
    inside = join_hot(members, keep(mixed, "mixed"), "block", "times")
    few, own = F.col("component") != F.col("main"), F.xxhash64("node")
    spread = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    as_any = inside.select("node", "block", "component", few.alias("few"), F.lit(False).alias("asks"),
                           F.pmod(own, F.col("slices")).cast("int").alias("i"), F.explode(spread("few_slices")).alias("j"))
    asking = inside.where(few).select("node", "block", "component", few.alias("few"), F.lit(True).alias("asks"),
                                      F.explode(spread("slices")).alias("i"), F.pmod(own, F.col("few_slices")).cast("int").alias("j"))
    light = classes.select("node", "n", "ranges")
    met = keep(as_any.unionByName(asking), "inside").join(light.hint("merge"), "node")

    def search(group):
        """Each asking member meets the members whose set size allows the likeness."""
        order = np.argsort(group["n"], kind="stable")
        n, node, part, few, asks = (group[c][order] for c in ("n", "node", "component", "few", "asks"))
        odd, counts = _bounds(group["ranges"][order])
        asks, few = asks.astype(bool), few.astype(bool)
        a, b = [node[:0]], [node[:0]]
        for k in np.flatnonzero(asks):
            near = slice(int(np.searchsorted(n, -(-percent * n[k] // 100))), int(np.searchsorted(n, 100 * n[k] // percent, "right")))
            # two asking members meet twice; one meeting is enough
            at = np.flatnonzero(~asks[near] & (part[near] != part[k]) & (~few[near] | (node[near] < node[k]))) + near.start
            if len(at):
                apart = _apart(n[at], n[k], (odd[at], counts[at]), (odd[k:k + 1], counts[k:k + 1]), percent)
                at, apart = at[apart < np.iinfo(np.int64).max], apart[apart < np.iinfo(np.int64).max]
                if nearest is not None and len(at):
                    order = np.lexsort((node[at], apart, part[at]))
                    first = np.searchsorted(part[at][order], part[at][order])
                    at = at[order[np.arange(len(order)) - first < nearest]]
                a.append(node[at])
                b.append(np.full(len(at), node[k]))
        return np.concatenate(a), np.concatenate(b)

    return by_group(met, ["block", "i", "j"], search, "node long, probe long").distinct()


def near_duplicates(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """`doc_id`, `text_key` (xxhash64 of the text), `n_shingles`, `component_id` and `first` (one row's key per component), per row of `docs`."""
    found = keep(sketches(docs, size), "sketches")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))
    classes = found.where("node IS NOT NULL").groupBy("node").agg(
        least.alias("least"), F.max("n").alias("n"), F.first("blocks").alias("blocks"), F.first("ranges").alias("ranges"), F.count(F.lit(1)).alias("copies"))
    classes = keep(classes.select("node", "n", "blocks", "ranges", "copies", "least", F.col("least.doc_id").alias("rep"), F.col("least.text_key").alias("rep_key")), "classes")
    members, links, labels = _shared_blocks(classes), None, None

    def joined_by(pairs: DataFrame) -> DataFrame | None:
        """The links among the pairs, if any; they also join the links found so far."""
        nonlocal links
        pairs = keep(pairs, "pairs")
        new = None if pairs.isEmpty() else keep(_linked(pairs, docs, classes, size, percent), "links")
        if new is None or new.isEmpty():
            return None
        links = new if links is None else links.unionByName(new)
        return new

    def all_joined() -> DataFrame | None:
        if links is None:
            return None
        return keep(classes.select("node").join(components(links), "node", "left").select("node", F.coalesce("component", "node").alias("component")), "labels")

    enough = classes.count() // YIELD
    for turn in range(STARS):
        new = joined_by(_sifted(_stars(members, labels, turn), classes, percent))
        if new is None:
            break
        labels = _adopted(classes, labels, new)
        if new.count() < enough:  # what is left is found below
            break
    labels = all_joined()
    # First each one's nearest, which join it to most components it links with; then all that is left.
    for nearest in (NEAREST, None):
        if joined_by(_rest(members, labels, classes, percent, nearest)) is not None:
            labels = all_joined()
    whole = classes.withColumn("component", F.col("node")) if labels is None else classes.join(labels, "node")
    whole = whole.select("node", "component", "least", "copies")
    firsts = whole.groupBy("component").agg(F.min("least").alias("first"))
    named = keep(whole.join(firsts, "component").select("node", "copies", "first"), "named")
    empty = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("text_key"))
    joined = join_hot(found.select("doc_id", "text_key", "n", "node"), named, "node", "copies", "left")
    joined = joined.withColumn("first", F.coalesce("first", empty))
    return joined.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"),
                         F.struct(F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key")).alias("first"))


def one_of_each(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs` that are the first of their component (smallest doc_id, then text hash); a row repeated as a whole stays once."""
    found = near_duplicates(docs, size, percent)
    stay = found.select("doc_id", "text_key", "first").where(
        F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))).select(
        F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).distinct()
    stay = keep(stay, "stay")
    key, name = F.xxhash64("text"), free_name(docs.columns, "text_key")
    joined = docs.withColumn(name, key).join(stay.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col(name) == F.col("_key")), "left_semi")
    return joined.dropDuplicates(["doc_id", name]).select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE counted AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM counted WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r USING (doc_id)
"""


@register("op7_jaccard_join", ORACLE)
def op7_jaccard_join(spark, folder):
    found = near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")
