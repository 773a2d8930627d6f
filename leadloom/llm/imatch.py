"""Document fingerprints by I-Match with randomised lexicons, in DataFrame functions only.

Terms are runs of letters and digits, lower-cased. The lexicon keeps those whose inverse document frequency lies in a
band: found in at least LOW and at most HIGH of all documents. A document's distinct lexicon terms, sorted, are hashed
once for the whole lexicon and once for each of several random lexicon subsets of four sizes. Two fingerprints are as
alike as the share of equal signatures among those that are not empty on both sides, for the subset size at which that is
largest: sparse subsets tell for long documents, dense ones for short. The same signatures are taken through a wide lexicon,
of all terms but those that more than WIDE of all documents have. They decide where one of the two documents is thin, that
is has fewer than FEW lexicon terms or fewer than one in THIN of its terms in the lexicon.

Document frequencies count every text, but (near) copies together: a term counts once per group of them, whichever of its
texts it stands in, so a large group's terms stay in the band. Texts are compared if they share a sketch, the SKETCH smallest
term hashes. Only a text that has half of all terms in common with its group's first belongs to the group; any other counts itself.

The band bounds the lexicon: documents hold a limited number of distinct terms, so at most (mean distinct terms)/LOW
terms reach the lower frequency, however many documents there are. It is a constant of the plan, looked up by hash.

Defined results: null and empty texts have no terms; equal texts have equal fingerprints; repeated rows are rows of their
own and follow each other; a null doc_id comes last in the order of descending ids; with a single row the next
document is the row itself; an empty table gives no rows. Extra columns are not used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.common import HOT_SHARE, keep, register, table
from leadloom.llm.suffix_tree import STEP_SETTINGS, _set
from leadloom.session import once

LOW, HIGH = 0.0005, 0.05
#: Bits of a term's hash that must be zero for a subset, and how many subsets there are of that size.
SUBSETS = ((3, 16), (5, 12), (7, 9), (9, 7))
#: The same for the lists that subsets are taken from: a subset whose bits hold one of these is found among the eighth of the terms there.
WITHIN = tuple(((1 << 3) - 1) << (3 * k) for k in range(20))
SLOTS, BUCKET_ROWS, MAX_BUCKETS, FEW = 16_384, 1_000, 65_536, 4
SKETCH, THIN, WIDE = 4, 8, 0.5
#: While a step is written: its shuffle files go at its end, and terms, which recur in many texts, are packed by a dictionary.
PACKED = {**STEP_SETTINGS, "parquet.dictionary.page.size": str(8 << 20)}


def terms(text: Column) -> Column:
    """Distinct terms of a text, as 64-bit hashes."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def _step(df: DataFrame, name: str) -> DataFrame:
    """As `keep`, packed and without the shuffle files."""
    with _set(df.sparkSession, PACKED):
        return keep(df, name)


def _judged(rows: DataFrame, first: Column) -> DataFrame:
    """`like`, whether a text has half of all terms in common with `first` (not if that is null); one that is like it keeps only the terms that `first` lacks."""
    rows = once(rows, common=F.size(F.array_intersect("terms", first)))
    rows = once(rows, like=F.coalesce(F.col("common") * 2 >= F.size("terms") + F.size(first) - F.col("common"), F.lit(False)))
    return rows.select("text_key", "a", "b", "shared", "like", F.when(F.col("like"), F.array_except("terms", first)).otherwise(F.col("terms")).alias("terms"))


def _grouped(rows: DataFrame, key: str, shared: DataFrame | None = None) -> DataFrame:
    """`rows` (text_key, a, b, terms; written) without repeated texts, each judged by the first text with its value of `key`; written once.

    With a table `shared` of values, the column `shared` tells which rows have one of them (all with a hot value do). Values with more than 1/HOT_SHARE of the rows don't meet in one task: their first texts, HOT_SHARE at most, are broadcast.
    """
    total = rows.count()
    hot = [r[0] for r in rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") * HOT_SHARE > total).collect()]
    order = Window.partitionBy(key).orderBy("text_key")
    met = rows.where(~F.col(key).isin(hot)).withColumns({
        "first": F.first("terms").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "before": F.lag("text_key").over(order)})
    met = met.where("before IS NULL OR before <> text_key").withColumn("first", F.when(F.col("before").isNotNull(), F.col("first")))
    if shared is None:
        met = met.withColumn("shared", F.lit(True))
    else:
        met = met.join(shared.select(F.col(key).alias("of"), F.lit(True).alias("shared")).hint("merge"), F.col(key) == F.col("of"), "left")
    done = _judged(met, F.col("first"))
    if hot:
        firsts = rows.where(F.col(key).isin(hot)).groupBy(key).agg(F.min_by(F.struct(*rows.columns), "text_key").alias("first"))
        firsts = _step(firsts.select("first.*"), "firsts")
        others = rows.join(F.broadcast(firsts.select(F.col(key).alias("of"), F.col("text_key").alias("first_key"), F.col("terms").alias("first"))), F.col(key) == F.col("of"))
        others = _judged(others.where("text_key <> first_key").withColumn("shared", F.lit(True)), F.col("first"))
        done = done.unionByName(firsts.withColumns({"shared": F.lit(True), "like": F.lit(False)})).unionByName(
            others.where("like AND size(terms) > 0")).unionByName(others.where("NOT like").dropDuplicates(["text_key"]))
    return _step(done, "grouped")


def unlike(docs: DataFrame) -> DataFrame:
    """`terms` of every text, (near) copies together, and the number of `texts` to count for them: 1, or 0 for terms that only copies have.

    Texts are grouped by a sketch of each of two orders of the terms in turn: a changed word seldom alters a sketch, and
    hardly ever both. Terms are found once and shuffle once; in the second turn only texts meet whose sketches don't belong to each other alone.
    """
    own = once(docs.select("text"), terms=terms(F.col("text")), text_key=F.xxhash64(F.coalesce("text", F.lit("")))).drop("text")
    first = lambda t: F.xxhash64(F.slice(F.sort_array(t), 1, SKETCH))
    own = _step(once(own, a=first(F.col("terms")), b=first(F.transform("terms", lambda h: F.xxhash64(h)))), "terms")
    both = own.select("a", "b").distinct()
    several = lambda key: both.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key)
    shared = _step(both.join(several("b"), "b", "left_semi").select("a").union(several("a")).distinct(), "shared")
    by_a = _grouped(own, "a", shared)
    by_b = _grouped(_step(by_a.where("shared AND NOT like").select(*own.columns), "again"), "b")
    alone = by_a.where("shared IS NULL AND NOT like").unionByName(by_b.where("NOT like")).select("terms", F.lit(1).alias("texts"))
    added = [rows.where("like").select(key, F.explode("terms").alias("term")).distinct() for rows, key in ((by_a, "a"), (by_b, "b"))]
    return reduce(DataFrame.unionByName, [alone, *[x.select(F.array("term").alias("terms"), F.lit(0).alias("texts")) for x in added]])


def _frequencies(docs: DataFrame, low: float, high: float, wide: float = WIDE) -> DataFrame:
    """`term` (hash) of at least the share `low` of all of `docs` (with `terms` and `texts`, or `text`), whether it is `known`, in at most `high`, or `common`, in more than `wide`; written once."""
    rows = docs.agg(F.sum("texts")).first()[0] or 0 if "texts" in docs.columns else docs.count()
    least = max(2, int(-(-low * rows // 1)))
    most = lambda share: max(least, int(share * rows))
    df = docs.select(F.explode(F.col("terms") if "terms" in docs.columns else terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = df.where(F.col("df") >= least).select("term", (F.col("df") <= most(high)).alias("known"), (F.col("df") > most(wide)).alias("common"))
    return _step(df, "lexicon")


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """`term` (hash) of the lexicon, from the document frequencies over all of `docs`; written once."""
    return _frequencies(docs, low, high).where("known").select("term")


def _slots(lexicon: DataFrame) -> Column:
    """The lexicon as one array of SLOTS short arrays, each holding the terms of one remainder."""
    spark = lexicon.sparkSession
    filled = lexicon.groupBy(F.pmod("term", F.lit(SLOTS)).alias("slot")).agg(F.collect_list("term").alias("terms"))
    every = spark.range(SLOTS).join(filled, F.col("id") == F.col("slot"), "left").select("id", F.coalesce("terms", F.array().cast("array<bigint>")).alias("terms"))
    whole = every.groupBy().agg(F.array_sort(F.collect_list(F.struct("id", "terms"))).alias("all"))
    return whole.select(F.transform("all", lambda s: s["terms"]).alias("slots")).scalar()


def _clear(mask: int):
    return lambda h: h.bitwiseAND(F.lit(mask)) == 0


def _masks() -> list[int]:
    return [((1 << bits) - 1) << (k * bits) for bits, many in SUBSETS for k in range(many)]


def _source(mask: int) -> int | None:
    """The list of WITHIN that holds all terms of the mask's subset."""
    return next((w for w in WITHIN if w & mask == w), None)


def within(found: Column) -> Column:
    """The terms of each list of WITHIN that a subset is taken from, for `signatures`."""
    return F.array(*[F.filter(found, _clear(w)) for w in WITHIN if w in set(map(_source, _masks()))])


def signatures(found: Column, lists: Column) -> Column:
    """Hash of the sorted terms for the whole lexicon and each subset; null where there are none. `lists` is `within(found)`, computed once."""
    empty = F.xxhash64(F.array().cast("array<bigint>"))
    used = [w for w in WITHIN if w in set(map(_source, _masks()))]
    parts = [found]
    for mask in _masks():
        source = _source(mask)
        terms = found if source is None else F.element_at(lists, used.index(source) + 1)
        parts.append(terms if source == mask else F.filter(terms, _clear(mask)))
    return F.array(*[F.nullif(F.xxhash64(p), empty) for p in parts])


def fingerprint(signs: Column, rest: Column) -> Column:
    """As text: eight hexadecimal digits per signature, nothing for empty ones, and those of all terms at the end."""
    digits = lambda x: F.lower(F.lpad(F.right(F.hex(x), F.lit(8)), 8, "0"))
    return F.concat_ws(".", F.array_join(F.transform(signs, lambda s: F.coalesce(digits(s), F.lit(""))), "."), digits(rest))


def likeness(a: Column, rest_a: Column, b: Column, rest_b: Column) -> Column:
    """1 for equal fingerprints, else the largest share of equal signatures among the set ones of one subset size, of FEW at least."""
    def share(first: int, many: int) -> Column:
        x, y = F.slice(a, first, many), F.slice(b, first, many)
        either = F.size(F.filter(F.zip_with(x, y, lambda p, q: p.isNotNull() | q.isNotNull()), lambda z: z))
        equal = F.size(F.filter(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), lambda z: z))
        return equal / F.greatest(either, F.lit(FEW))

    starts = [2 + sum(n for _, n in SUBSETS[:k]) for k in range(len(SUBSETS))]
    known = F.exists(a, lambda x: x.isNotNull()) | F.exists(b, lambda x: x.isNotNull())
    return F.when(a.eqNullSafe(b) & (known | (rest_a == rest_b)), 1.0).otherwise(F.greatest(*[share(s, n) for s, (_, n) in zip(starts, SUBSETS)]))


def _buckets(docs: DataFrame, rows: int) -> Column:
    """Number of the id's range, rising with the id, from quantiles of all ids; null ids are in range -1."""
    wanted = max(1, min(MAX_BUCKETS, rows // BUCKET_ROWS))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / wanted for i in range(1, wanted)] or [0.5], F.lit(max(10_000, 10 * wanted)))).first()[0]
    cuts = sorted(set(cuts or []))
    width = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i:i + width] for i in range(0, len(cuts), width)]
    if not groups:
        return F.when(F.col("doc_id").isNull(), -1).otherwise(0)
    numbers = lambda xs: "array(" + ",".join(f"{x}L" for x in xs) + ")"
    group = f"size(filter({numbers(g[0] for g in groups)}, x -> x < doc_id))"
    inside = f"size(filter(element_at(array({','.join(numbers(g) for g in groups)}), {group}), x -> x < doc_id))"
    return F.expr(f"CASE WHEN doc_id IS NULL THEN -1 WHEN {group} = 0 THEN 0 ELSE ({group} - 1) * {width} + {inside} END")


def with_next(docs: DataFrame) -> DataFrame:
    """bucket, place, doc_id, text and next_text, in the order of descending ids; the last row's next is the first.

    Ranges of ids are sorted each on their own, so no task sees all rows. Each range also gets the first row of the range below
    it (at most MAX_BUCKETS rows are copied; `copied` marks them), which closes the chain.
    """
    rows = docs.count()
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = docs.withColumn("bucket", _buckets(docs, rows)).withColumn("text_key", F.xxhash64("text"))
    heads = dealt.groupBy("bucket").agg(F.max(F.struct("doc_id", "text_key")).alias("head"))
    down = Window.orderBy(F.desc("bucket"))
    last = F.last("bucket").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("head.*", F.coalesce(F.lag("bucket").over(down), last).alias("to_bucket"))
    heads = keep(heads, "heads").select(F.col("doc_id").alias("head_id"), F.col("text_key").alias("head_key"), "to_bucket")
    copied = dealt.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("text_key") == F.col("head_key")))
    copied = copied.dropDuplicates(["to_bucket", "text_key"]).select("doc_id", "text", F.col("to_bucket").alias("bucket"), "text_key", F.lit(1).alias("copied"))
    order = Window.partitionBy("bucket").orderBy("copied", F.desc_nulls_last("doc_id"), F.desc("text_key"))
    whole = dealt.select("doc_id", "text", "bucket", "text_key", F.lit(0).alias("copied")).unionByName(copied)
    return whole.select("bucket", F.row_number().over(order).alias("place"), "copied", "doc_id", "text", F.lead("text").over(order).alias("next_text"))


def edited(text: Column, other: Column) -> Column:
    """The last half of the text (rounded down) replaced by as many leading characters of the other."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.left(text, n - half), F.left(F.coalesce(other, F.lit("")), half))


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH, of: DataFrame | None = None, thin: int = 0) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    `of` holds the documents whose frequencies make the lexicons, `docs` if not given; with `thin`, thin documents are
    compared by their terms in the wide lexicon.
    """
    found = _frequencies(docs if of is None else of, low, high)
    slots = _slots(found.where("known").select("term"))
    common = found.where("common").agg(F.collect_list("term").alias("terms")).scalar()
    rows = with_next(docs).withColumn("changed", edited(F.col("text"), F.col("next_text")))
    rows = rows.select("bucket", "place", "copied", "doc_id", F.char_length("text").cast("long").alias("n_chars"),
                       F.sha2(F.encode("changed", "utf-8"), 256).alias("edited_sha256"), terms(F.col("text")).alias("own"), terms(F.col("changed")).alias("other"))
    known = lambda t: F.sort_array(F.filter(t, lambda h: F.array_contains(F.element_at(F.col("slots"), (F.pmod(h, F.lit(SLOTS)) + 1).cast("int")), h)))
    rows = rows.withColumn("slots", slots).withColumn("common", common)
    rows = once(rows, own_known=known(F.col("own")), other_known=known(F.col("other")), own_all=F.sort_array("own"), other_all=F.sort_array("other")).drop("own", "other", "slots")
    wide = lambda c: F.array_except(c, "common") if thin else F.lit(None).cast("array<bigint>")
    rows = once(rows, own_wide=wide("own_all"), other_wide=wide("other_all")).drop("common")
    is_thin = lambda k, t: (F.size(k) < FEW) | (F.size(k) * thin < F.size(t)) if thin else F.lit(False)
    sets = ["own_known", "other_known"] + (["own_wide", "other_wide"] if thin else [])
    rows = once(rows, **{f"{c}_lists": within(F.col(c)) for c in sets})
    signs = lambda c: signatures(F.col(c), F.col(f"{c}_lists"))
    whole = lambda c: signs(c) if thin else F.array().cast("array<bigint>")
    rows = once(rows, signs=signs("own_known"), other_signs=signs("other_known"),
                own_rest=F.xxhash64("own_all"), other_rest=F.xxhash64("other_all"), whole=whole("own_wide"), other_whole=whole("other_wide"),
                thin=is_thin(F.col("own_known"), F.col("own_all")), other_thin=is_thin(F.col("other_known"), F.col("other_all")))
    rows = rows.drop("own_known", "other_known", "own_all", "other_all", "own_wide", "other_wide", *[f"{c}_lists" for c in sets])
    order = Window.partitionBy("bucket").orderBy("place")
    rows = rows.withColumns({f"next_{c}": F.lead(f"own_{c}" if c == "rest" else c).over(order) for c in ("signs", "rest", "whole", "thin")}).where("copied = 0")

    def near(side: str) -> Column:
        by_lexicon = likeness(F.col("signs"), F.col("own_rest"), F.col(f"{side}_signs"), F.col(f"{side}_rest"))
        if not thin:
            return by_lexicon
        by_wide = likeness(F.col("whole"), F.col("own_rest"), F.col(f"{side}_whole"), F.col(f"{side}_rest"))
        return F.when(F.col("thin") | F.col(f"{side}_thin"), by_wide).otherwise(by_lexicon)

    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.concat("signs", "whole"), F.col("own_rest")).alias("fingerprint"),
        fingerprint(F.concat("other_signs", "other_whole"), F.col("other_rest")).alias("edited_fingerprint"),
        near("other").alias("near_edited"), near("next").alias("near_next"))


def op2_imatch(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return fingerprints(docs, of=unlike(docs), thin=THIN)


register("op2_imatch")(op2_imatch)
