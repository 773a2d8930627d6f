"""Hard negatives: for each anchor and positive, the best rows of other labels whose scores lie in a band below the positive's.

Rows with equal vector and label form a class, which is searched once and keeps its smallest ids; no answer needs more.
Centres are fitted on a bounded sample of classes. Anchor classes near the same centre form a cluster and share its lists:
candidate classes lie in blocks by their nearest centre, and the largest score that a cluster can reach in a block follows from
lengths and angles (centre to centre, less the radii of both). A cluster first visits its FIRST best blocks; the scores found
there are floors, and of the other blocks its members visit those whose bound reaches their floor. In a block the candidates are
sorted once for the cluster, by length times the cosine of their angle to the centre less the cluster's radius; every member
walks this list from the top and stops where the bound falls below what it still needs. Stopping is certified, so the answer is
exact whatever the centres are. Positives and negatives are two such walks; the second one knows the bands.

Scores are exact: integer products below 2**53 are computed in doubles, larger ones in 64 bits, and an error is raised beyond.

Defined results: rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part; vectors
meet those of their own length; of rows with the same id the one with the smallest label and vector counts, once; ties go to
the smaller id; with fewer rows than asked for, all are returned; anchors without positives or negatives have no rows; an
empty table gives no rows; extra columns are not used.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.llm.common import keep, register, table
from leadloom.session import lookup

#: Centres: one for PER_CENTRE classes, CENTRES at most, fitted on SAMPLE classes at most of SAMPLE_NUMBERS components at most.
SAMPLE, SAMPLE_NUMBERS, PER_CENTRE, CENTRES, ROUNDS = 16_384, 1 << 22, 2_048, 256, 8
#: Candidates in a block, members that walk together, blocks a cluster visits first, candidates per step of a walk.
BLOCK, GROUP, FIRST, STEP = 8_192, 2_048, 2, 512
_LEAST, _MOST, _SLACK = -(1 << 62), 1 << 62, 1e-7


def usable(rows: DataFrame, scale: float = 1.0) -> DataFrame:
    """vec_id, label and vector (the floor of each component times `scale`) of the rows that take part, each id once."""
    good = rows.select("vec_id", F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector"))
    good = good.where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0")
    good = good.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    far = F.exists("vector", lambda x: F.abs(x * scale) >= 2.0 ** 53)
    whole = F.when(far, F.raise_error(F.lit("a component times the scale needs more than 53 bits"))).otherwise(F.transform("vector", lambda x: F.floor(x * scale)))
    one = good.groupBy("vec_id").agg(F.min(F.struct("label", whole.alias("vector"))).alias("row"))
    return one.select("vec_id", "row.*")


def classes(rows: DataFrame, ids: int) -> DataFrame:
    """first (id), label, vector, dim, ids (the smallest, sorted) of every distinct pair of label and vector."""
    low = Window.partitionBy("label", "vector").orderBy("vec_id")
    few = rows.withColumn("nth", F.row_number().over(low)).where(F.col("nth") <= ids)
    found = few.groupBy("label", "vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return found.select(F.col("ids")[0].alias("first"), "label", "vector", F.size("vector").alias("dim"), "ids")


def _unit(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(size > 0, size, 1)


def fit_centres(found: DataFrame) -> dict[int, np.ndarray]:
    """Unit centres for each vector length, by a few rounds of spherical k-means over the sample with the smallest hashes."""
    about = found.agg(F.count(F.lit(1)).alias("n"), F.max("dim").alias("dim")).first()
    if not about.n:
        return {}
    sample = min(SAMPLE, max(CENTRES, SAMPLE_NUMBERS // about.dim))
    drawn = found.select("dim", "vector").orderBy(F.xxhash64("first"), "first").limit(sample).toPandas()
    out = {}
    for dim, part in drawn.groupby("dim"):
        unit = _unit(np.array(part["vector"].to_list(), float))
        centres = unit[:max(1, min(CENTRES, about.n // PER_CENTRE))].copy()
        for _ in range(ROUNDS):
            near = np.argmax(unit @ centres.T, axis=1)
            total = np.zeros_like(centres)
            np.add.at(total, near, unit)
            size = np.linalg.norm(total, axis=1)
            centres = np.where(size[:, None] > 0, total / np.where(size > 0, size, 1)[:, None], centres)
        out[int(dim)] = centres
    return out


def _of(centres, dim: int) -> np.ndarray:
    """Centres of a vector length; one axis for a length that the sample missed."""
    found = centres.value.get(int(dim))
    return np.eye(1, int(dim)) if found is None else found


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def placed(found: DataFrame, centres) -> DataFrame:
    """`found` with the nearest centre, the angle to it (0 for zero vectors) and the length of the vector."""
    @F.pandas_udf("centre int, angle double, length double")
    def nearest(column: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(column), 3))
        sizes = column.map(len).to_numpy()
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            v = np.stack([column.iloc[i] for i in at]).astype(float)
            cosine, length = _unit(v) @ _of(centres, dim).T, np.linalg.norm(v, axis=1)
            near = np.argmax(cosine, axis=1)
            angle = np.where(length > 0, _angle(cosine[np.arange(len(at)), near]), 0)
            out[at] = np.column_stack([near, angle, length])
        return pd.DataFrame(out, columns=["centre", "angle", "length"]).astype({"centre": np.int32})

    return found.withColumn("at", nearest("vector")).select(*found.columns, "at.*")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of `a` with all rows of `b`."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2.0 ** 53:
        return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most < 2.0 ** 62:
        return a @ b.T
    raise OverflowError("scores need more than 62 bits")


def _table(rows: pd.Series, fill: int) -> np.ndarray:
    """Lists as rows of one length."""
    out = np.full((len(rows), max(map(len, rows))), fill, np.int64)
    for i, row in enumerate(rows):
        out[i, :len(row)] = row
    return out


def _reaches(bound, need):
    """Whether a bound, computed in doubles, may reach what is needed."""
    return bound + _SLACK * (np.abs(bound) + np.abs(need) + 1) >= need


def _top(owner: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k best of each owner, best first."""
    order = np.lexsort((ident, -score, owner))
    first = np.searchsorted(owner[order], owner[order], "left")
    return order[np.arange(len(order)) - first < k]


def walk(bound: np.ndarray, vectors: np.ndarray, labels: np.ndarray, ids: np.ndarray, members: np.ndarray, member_labels: np.ndarray,
         low: np.ndarray, high: np.ndarray, same: bool, k: int, step: int):
    """member, query, candidate and score of the k best candidates of each query, and how many candidates each member met.

    `bound`, for members of length 1, falls along the list. `low` and `high` bound the scores, with one row per member and one
    column per query of that member. Candidates are of the member's label if `same`, else of any other.
    """
    size = np.linalg.norm(members.astype(float), axis=1)
    floor, last = low.copy(), np.full(low.shape, np.iinfo(np.int64).max)  # score and id of the worst answer that still counts
    none = np.zeros(0, np.int64)
    held = [(none, none, none)] * low.shape[1]  # member, candidate, score
    met = np.zeros(len(members), np.int64)
    for at in range(0, len(bound), step):
        need = np.where(low <= high, floor, _MOST).min(axis=1).astype(float)
        active = np.flatnonzero(_reaches(bound[at] * size, need) & (need < _MOST))
        if not len(active):
            break
        part = slice(at, at + step)
        score = products(members[active], vectors[part])
        met[active] += score.shape[1]
        fits = (labels[part] == member_labels[active][:, None]) == same
        for q in range(low.shape[1]):
            worst = floor[active, q][:, None]
            better = (score > worst) | ((score == worst) & (ids[part] <= last[active, q][:, None]))
            m, c = np.nonzero(fits & better & (score <= high[active, q][:, None]))
            if not len(m):
                continue
            member, found, value = (np.concatenate(x) for x in zip(held[q], (active[m], c + at, score[m, c])))
            best = _top(member, value, ids[found], k)
            held[q] = member, found, value = member[best], found[best], value[best]
            full = np.flatnonzero(np.bincount(member, minlength=len(members)) >= k)
            ends = np.searchsorted(member, full, "right") - 1
            floor[full, q], last[full, q] = value[ends], ids[found[ends]]
    member, candidate, score = (np.concatenate(x) for x in zip(*held))
    return member, np.repeat(np.arange(len(held)), [len(h[0]) for h in held]), candidate, score, met


class Lists:
    """Candidate classes in blocks, anchor classes in clusters, and the walks of the ones over the others.

    `found` has the columns of `classes` and `anchor` (whether the class holds an anchor).
    """

    def __init__(self, found: DataFrame):
        self.spark: SparkSession = found.sparkSession
        self.centres = self.spark.sparkContext.broadcast(fit_centres(found))
        near = keep(placed(found, self.centres), "placed")
        # CENTRES rows at most for each vector length
        slices = F.broadcast(near.groupBy("dim", "centre").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("slices")))
        cut = F.pmod(F.xxhash64("first"), F.col("slices")).cast("int")
        self.blocks = keep(near.join(slices, ["dim", "centre"]).withColumn("slice", cut).drop("slices").withColumnRenamed("centre", "cell"), "blocks")
        self.members = keep(near.where("anchor").select("first", "label", "vector", "dim", "centre", "angle", "length"), "members")
        radius = self.members.groupBy("dim", "centre").agg(F.max("angle").alias("radius")).collect()
        self.radius = {(r.dim, r.centre): r.radius for r in radius}
        order = Window.partitionBy("dim", "centre").orderBy(F.desc("bound"), "cell", "slice")
        self.visits = keep(self._bounds().withColumn("nth", F.row_number().over(order)), "visits")
        self.tasks = max(1, self.blocks.select("dim", "cell", "slice").distinct().count())

    def _bounds(self) -> DataFrame:
        """The largest score of a member of length 1, for each cluster (CENTRES at most for a vector length) and block."""
        stats = self.blocks.groupBy("dim", "cell", "slice").agg(F.max("angle").alias("angle"), F.max("length").alias("longest"), F.min("length").alias("shortest"))
        centres, radius = self.centres, self.radius

        def pairs(batches):
            for batch in batches:
                for dim, part in batch.groupby("dim"):
                    own = np.array(sorted(c for d, c in radius if d == dim), int)
                    if not len(own):
                        continue
                    apart = _angle(_of(centres, dim)[part["cell"]] @ _of(centres, dim)[own].T)
                    reach = np.array([radius[int(dim), int(c)] for c in own])
                    cosine = np.cos(np.maximum(apart - reach - part["angle"].to_numpy()[:, None], 0))
                    bound = cosine * np.where(cosine > 0, part["longest"].to_numpy()[:, None], part["shortest"].to_numpy()[:, None])
                    again = {c: np.repeat(part[c].to_numpy(), len(own)) for c in ("dim", "cell", "slice")}
                    yield pd.DataFrame({**again, "centre": np.tile(own, len(part)), "bound": bound.ravel()})

        return stats.mapInPandas(pairs, "dim int, cell int, slice int, centre int, bound double")

    def _visit(self, asked: DataFrame, visits: DataFrame, same: bool, k: int) -> DataFrame:
        """Answers (first, query, score, ids) of the asked members in the blocks to visit."""
        own = F.col("bound") * F.col("length")
        reaches = own + _SLACK * (F.abs(own) + F.abs("need") + 1) >= F.col("need")
        keys = ["dim", "cell", "slice"]
        going = asked.join(visits.select(*keys, "centre", "bound"), ["dim", "centre"]).where(reaches)
        going = going.select(*keys, "centre", "first", "label", "vector", "low", "high")
        blocks = self.blocks.select(*keys, "label", "vector", "ids", "length")
        centres, radius, group, step = self.centres, self.radius, GROUP, STEP
        nothing = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("first", "query", "score")} | {"ids": pd.Series([], dtype=object)})

        def search(found: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
            if not len(found) or not len(members):
                return nothing
            vectors, labels, length = np.stack(found["vector"].to_numpy()), found["label"].to_numpy(), found["length"].to_numpy()
            ids, unit, out = np.array([x[0] for x in found["ids"]]), _unit(vectors.astype(float)), []
            dim = int(found["dim"].iloc[0])
            for centre, mine in members.groupby("centre"):
                angle = np.maximum(_angle(unit @ _of(centres, dim)[int(centre)]) - radius[dim, int(centre)], 0)
                bound = length * np.cos(angle)
                order = np.lexsort((ids, -bound))  # the list that all members of the cluster share
                for at in range(0, len(mine), group):
                    some = mine.iloc[at:at + group]
                    m, q, c, s, _ = walk(
                        bound[order], vectors[order], labels[order], ids[order], np.stack(some["vector"].to_numpy()), some["label"].to_numpy(),
                        _table(some["low"], 1), _table(some["high"], 0), same, k, step)
                    out.append(pd.DataFrame({"first": some["first"].to_numpy()[m], "query": q, "score": s, "ids": found["ids"].to_numpy()[order[c]]}))
            return pd.concat(out)

        left, right = blocks.repartition(self.tasks, *keys), going.repartition(self.tasks, *keys)
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "first long, query int, score long, ids array<long>")

    def best(self, asked: DataFrame, same: bool, k: int) -> DataFrame:
        """first, query and answers (the k best rows as score and vec_id, best first).

        `asked` are members with the arrays `low` and `high`, whose elements bound the scores of one query each.
        """
        def needing(df: DataFrame) -> DataFrame:
            least = F.array_min(F.zip_with("low", "high", lambda a, b: F.when(a <= b, a)))
            return df.withColumn("need", least.cast("double")).where("need IS NOT NULL")

        asked = keep(needing(asked), "asked")
        found = keep(self._visit(asked, self.visits.where(F.col("nth") <= FIRST), same, k), "answers")
        # A later answer needs the k-th score found so far.
        floors = _merged(found, k).where(F.size("answers") >= k).select("first", F.struct("query", F.element_at("answers", -1)["score"].alias("floor")).alias("at"))
        floors = floors.groupBy("first").agg(F.map_from_entries(F.collect_list("at")).alias("floors"))
        raised = F.transform("low", lambda x, q: F.greatest(x, F.coalesce(F.element_at("floors", q), x)))
        known = asked.drop("need").join(floors, "first", "left").withColumn("low", raised).drop("floors")
        return _merged(found.unionByName(self._visit(needing(known), self.visits.where(F.col("nth") > FIRST), same, k)), k)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of every member and query."""
    order = Window.partitionBy("first", "query").orderBy(F.desc("score"), F.col("ids")[0])
    few = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
    rows = few.groupBy("first", "query").agg(F.flatten(F.collect_list(
        F.transform("ids", lambda i: F.struct((-F.col("score")).alias("below"), i.alias("vec_id"))))).alias("rows"))
    best = F.transform(F.slice(F.array_sort("rows"), 1, k), lambda a: F.struct((-a["below"]).alias("score"), a["vec_id"].alias("vec_id")))
    return rows.select("first", "query", best.alias("answers"))


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 1.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    `rows` has vec_id, label and vector. A negative scores between `low` and `high` percent of its positive.
    """
    rows = keep(usable(rows, scale), "rows")
    anchors = rows.where(is_anchor)
    wanted = anchors.select("label", "vector").distinct().withColumn("anchor", F.lit(True))
    found = keep(classes(rows, max(positives + 1, negatives)), "classes")
    lists = Lists(found.join(wanted, ["label", "vector"], "left").select(*found.columns, F.coalesce("anchor", F.lit(False)).alias("anchor")))
    place = ["first", "label", "vector", "dim", "centre", "length"]

    open_ends = {"low": F.array(F.lit(_LEAST)), "high": F.array(F.lit(_MOST - 1))}
    near = lists.best(lists.members.select(*place).withColumns(open_ends), True, positives + 1)  # an anchor may be its own best
    near = keep(near.select("first", F.col("answers").alias("positives"), F.array_distinct(F.transform("answers", lambda p: p["score"])).alias("scores")), "positives")
    percent = lambda share: f"(CAST(p AS DECIMAL(20, 0)) * {share} - pmod(CAST(p AS DECIMAL(20, 0)) * {share}, 100)) div 100"  # noqa: E731  rounded down
    bands = {"low": F.expr(f"transform(scores, p -> -({percent(-low)}))"), "high": F.expr(f"transform(scores, p -> {percent(high)})")}
    far = lists.best(lists.members.select(*place).join(near, "first").withColumns(bands).select(*place, "low", "high"), False, negatives)
    far = far.groupBy("first").agg(F.map_from_entries(F.collect_list(F.struct("query", "answers"))).alias("negatives"))
    known = near.join(far, "first").join(lists.members.select("first", "label", "vector"), "first")
    known = keep(known.select(F.struct("label", "vector").alias("class"), "positives", "scores", "negatives"), "known")

    each = lookup(anchors.select(F.col("vec_id").alias("anchor_id"), F.struct("label", "vector").alias("class")), known, "class")
    others = F.slice(F.filter("positives", lambda p: p["vec_id"] != F.col("anchor_id")), 1, positives)
    each = each.select("anchor_id", "scores", "negatives", F.explode(others).alias("positive"))
    query = (F.array_position("scores", F.col("positive.score")) - 1).cast("int")
    each = each.select("anchor_id", "positive", F.posexplode(F.element_at("negatives", query)).alias("place", "negative"))
    return each.select("anchor_id", F.col("positive.vec_id").alias("positive_id"), (F.col("place") + 1).alias("rank"), F.col("negative.vec_id").alias("negative_id"),
                       F.col("positive.score").alias("positive_score"), F.col("negative.score").alias("negative_score"))


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM (SELECT DISTINCT vec_id, label, embedding FROM embeddings)
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS a, c.vec_id AS c, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id AND len(c.e) = len(a.e)
), p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, c) <= 5)
SELECT p.a AS anchor_id, p.c AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.c ORDER BY s.score DESC, s.c) AS INTEGER) AS rank, s.c AS negative_id,
       p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3
"""


def op13_hard_negatives(spark, folder):
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, folder, "embeddings").select("vec_id", label.alias("label"), F.col("embedding").alias("vector"))
    return mine(rows, F.pmod("vec_id", F.lit(50)) == 0, scale=256.0)


register("op13_hard_negatives", ORACLE)(op13_hard_negatives)
