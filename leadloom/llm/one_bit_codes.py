"""Approximate nearest neighbours by largest inner product, with randomly rotated one-bit codes.

Index: every vector is centred, padded with zeros to a longer one, rotated by a random orthogonal matrix and kept as the signs of
its coordinates, packed to bits, with three scalars: its distance from the centre, its inner product with the centre, and how
well the signs match the rotated direction. The error of an estimate falls with the root of the number of bits. Search: signs and scalars estimate the inner product with a query, and bound the error to
EPSILON deviations. Vectors whose upper bound stays below the query's current k-th exact product are left out; the others are
reranked on the original vectors in double precision. Blocks of vectors meet blocks of queries; a block hands on the k best
of each query, and the best of those are the answer.

Equal vectors are indexed once, with their k + 1 smallest ids: no answer needs more. Rotation and centre are the only
fitted parts; the centre is the mean of all vectors, the rotation comes from a seed.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part; vectors only meet
those of their own length; rows with a query's id are never among its answers; rows repeated as a whole count once; ties
go to the smaller id; with fewer candidates than k all are returned; an empty table gives no rows; extra columns are not used.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.common import keep, register, table

K, EPSILON, SEED = 20, 2.5, 42
VECTOR_BLOCK, QUERY_BLOCK, STEP, MOST_TASKS = 8_192, 1_024, 1_024, 100_000
#: Bits of a code: BITS_PER_NUMBER for each component, from LEAST_BITS to MOST_BITS, and one per component at least. Pairs reranked at a time.
BITS_PER_NUMBER, LEAST_BITS, MOST_BITS, SLICE = 8, 256, 1_024, 32_768


def code_bits(dim: int) -> int:
    return max(dim, min(MOST_BITS, max(LEAST_BITS, BITS_PER_NUMBER * dim)))


@lru_cache(maxsize=4)
def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """`dim` random orthonormal rows of code_bits(dim) numbers, equal on every worker."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((code_bits(dim), dim)))
    return np.ascontiguousarray((q * np.sign(np.diag(r))).T)


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part, each once."""
    v = F.col(column).cast("array<double>")
    rows = vectors.select("vec_id", v.alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("vector", lambda x: x != 0)).dropDuplicates(["vec_id", "vector"])


def index(vectors: DataFrame, k: int = K, seed: int = SEED) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """The written index (one row per distinct vector) and the centre for each vector length."""
    rows = keep(vectors, "vectors")
    low = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.withColumn("nth", F.row_number().over(low)).where(F.col("nth") <= k + 1)
    classes = few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    means = rows.select(F.size("vector").alias("dim"), F.posexplode("vector").alias("at", "x")).groupBy("dim", "at").agg(F.avg("x").alias("x"))
    centres: dict[int, list] = {}
    for r in means.orderBy("dim", "at").collect():  # one number per dimension
        centres.setdefault(r.dim, []).append(r.x)
    centres = {d: np.array(x) for d, x in centres.items()}

    @F.pandas_udf("code binary, distance double, along double, match double")
    def encode(column: pd.Series) -> pd.DataFrame:
        code, scalars = [b""] * len(column), np.zeros((len(column), 3))
        lengths = column.map(len).to_numpy()
        for dim in np.unique(lengths):
            at = np.flatnonzero(lengths == dim)
            v = np.stack([column.iloc[i] for i in at])
            apart = v - centres[dim]
            distance = np.linalg.norm(apart, axis=1)
            turned = apart @ rotation(int(dim), seed) / np.where(distance > 0, distance, 1)[:, None]
            for i, bits in zip(at, np.packbits(turned >= 0, axis=1)):
                code[i] = bits.tobytes()
            scalars[at] = np.column_stack([distance, v @ centres[dim], np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])])
        return pd.DataFrame({"code": code, "distance": scalars[:, 0], "along": scalars[:, 1], "match": scalars[:, 2]})

    coded = classes.withColumn("found", encode("vector")).select("vector", "ids", "found.*")
    return keep(coded, "codes"), centres


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed from the first component to the last."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def _best(query: np.ndarray, score: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k best rows of each query."""
    order = np.lexsort((row, -score, query))
    first = np.searchsorted(query[order], query[order], "left")
    return order[np.arange(len(order)) - first < k]


def search_block(codes: pd.DataFrame, queries: np.ndarray, centre: np.ndarray, k: int, epsilon: float, seed: int, step: int = STEP):
    """query index, row index and exact score of the k best rows for each query; also the share of pairs that were reranked."""
    dim = queries.shape[1]
    apart = queries - centre
    reach = np.linalg.norm(apart, axis=1).astype(np.float32)
    turned = (apart @ rotation(dim, seed)).astype(np.float32)
    length = turned.shape[1]
    vectors = np.stack(codes["vector"].to_numpy())
    bits = np.frombuffer(b"".join(codes["code"]), np.uint8).reshape(len(codes), -1)
    distance, along, match = (codes[c].to_numpy() for c in ("distance", "along", "match"))
    safe = np.where(match > 0, match, 1)
    slope = np.where(match > 0, distance / (safe * np.sqrt(length)), 0).astype(np.float32)
    spread = (epsilon * distance * np.sqrt(np.maximum(1 - match ** 2, 0)) / safe / np.sqrt(max(length - 1, 1))).astype(np.float32)
    offset = ((queries @ centre) - centre @ centre).astype(np.float32)
    none = np.zeros(0)
    best_q, best_r, best_s = none.astype(int), none.astype(int), none
    floor, reranked = np.full(len(queries), -np.inf), 0

    def guess(part) -> np.ndarray:
        signs = np.unpackbits(bits[part], axis=1, count=length).astype(np.float32) * 2 - 1
        return (signs @ turned.T) * slope[part, None] + along[part, None].astype(np.float32) + offset

    def first_floor() -> None:
        """Exact scores of the best guesses of all parts, a few at a time: the k-th is where each query's answers begin."""
        nonlocal floor
        most, rows = np.full((k, len(queries)), -np.inf, np.float32), np.zeros((k, len(queries)), int)
        for at in range(0, len(codes), step):
            part = slice(at, min(at + step, len(codes)))
            every, row = np.vstack([most, guess(part)]), np.vstack([rows, np.broadcast_to(np.arange(at, part.stop)[:, None], (part.stop - at, len(queries)))])
            top = np.argpartition(-every, k - 1, axis=0)[:k]
            most, rows = np.take_along_axis(every, top, 0), np.take_along_axis(row, top, 0)
        low = np.full(len(queries), np.inf)
        for one in rows:
            low = np.minimum(low, _scores(vectors[one], queries))
        floor = low

    if len(codes) > k:
        first_floor()
    for at in range(0, len(codes), step):
        part = slice(at, min(at + step, len(codes)))
        bound = guess(part) + spread[part, None] * reach
        tolerance = 1e-5 * (1 + np.abs(bound))
        r, q = np.nonzero(bound + tolerance >= floor)
        reranked += len(r)
        for cut in range(0, len(r), SLICE):  # no more copies of vectors than a slice has pairs
            rows, asked = r[cut:cut + SLICE] + at, q[cut:cut + SLICE]
            s = _scores(vectors[rows], queries[asked])
            good = s >= floor[asked]
            query, row, score = (np.concatenate(x) for x in ((best_q, asked[good]), (best_r, rows[good]), (best_s, s[good])))
            stay = _best(query, score, row, k)
            best_q, best_r, best_s = query[stay], row[stay], score[stay]
        full = np.bincount(best_q, minlength=len(queries)) >= k
        low = np.full(len(queries), np.inf)
        np.minimum.at(low, best_q, best_s)
        floor = np.where(full, np.maximum(floor, low), floor)
    return best_q, best_r, best_s, reranked / max(1, len(codes) * len(queries))


def nearest(vectors: DataFrame, is_query: Column, k: int = K, epsilon: float = EPSILON, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id and score: the k rows with the largest inner product for every row that `is_query` marks."""
    rows = usable(vectors)
    codes, centres = index(rows, k, seed)
    queries = keep(rows.where(is_query), "queries")
    blocks = max(1, -(-codes.count() // VECTOR_BLOCK))
    parts = max(1, -(-queries.count() // QUERY_BLOCK))
    left = codes.select("*", F.size("vector").alias("dim"), F.pmod(F.xxhash64("vector"), F.lit(blocks)).alias("block"),
                        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    right = queries.select("vec_id", "vector", F.size("vector").alias("dim"), F.pmod(F.xxhash64("vec_id", "vector"), F.lit(parts)).cast("int").alias("part"),
                           F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def search(codes: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(codes) or not len(asked):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "score": np.zeros(0), "ids": pd.Series([], dtype=object)})
        codes = codes.iloc[np.argsort([ids[0] for ids in codes["ids"]], kind="stable")]  # ties go to the smaller id
        given = np.stack(asked["vector"].to_numpy())
        # one more than k: a query's own vector may be among its best
        q, r, s, _ = search_block(codes, given, centres[given.shape[1]], k + 1, epsilon, seed)
        return pd.DataFrame({"query_id": asked["vec_id"].to_numpy()[q], "score": s, "ids": codes["ids"].to_numpy()[r]})

    # One task per pair of blocks: the work is in the products, which the size of the shuffled rows does not show.
    keys, tasks = ["dim", "block", "part"], min(blocks * parts, MOST_TASKS)
    left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys)
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        search, "query_id long, score double, ids array<long>")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("ids")[0])
    found = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
    each = found.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = r"""
WITH v AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]), lambda a, b: a + b) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
)
SELECT query_id, CAST(rank AS BIGINT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""


def op5_one_bit_codes(spark, folder):
    return nearest(table(spark, folder, "embeddings").select("vec_id", "embedding"), F.pmod("vec_id", F.lit(20)) == 0)


register("op5_one_bit_codes", ORACLE)(op5_one_bit_codes)
