"""Shared helpers: column hygiene, lineage cuts, hot-key joins, connected components."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.session import cut_lineage, ship

#: A key is hot when it holds more than 1/HOT_SHARE of all rows, so at most HOT_SHARE keys are hot, at any size.
HOT_SHARE = 256
#: A batch of rows handed to Python holds about so many bytes, however long its texts are.
BATCH_BYTES = 16 << 20

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def prepare(spark: SparkSession) -> None:
    """Ship the package, and bound batches for Python by bytes where the session doesn't yet (no result depends on it)."""
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, str(2 ** 31 - 1), "2147483647b"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def keep(df: DataFrame, name: str = "step") -> DataFrame:
    """Write `df` once to the shared folder and read it back."""
    prepare(df.sparkSession)
    return cut_lineage(df, name)


def register(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, the statement that gives the same rows."""
    def add(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id written as text; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def free_name(columns: list[str], name: str) -> str:
    """`name`, lengthened by underscores until no column clashes with it (column names ignore case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_hot(left: DataFrame, right: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """Join `left` to `right`, which is written, has one row per `key` and in `weight` the number of `left` rows of that key.

    Keys with more than 1/HOT_SHARE of all rows (at most HOT_SHARE of them, whatever the data) are broadcast, so
    their rows never meet in one task. The rest use a shuffle join in which no key has more than that share.
    `left` is read once; rows that found a hot key shuffle under a key of their own.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    extra = [c for c in right.columns if c not in (key, weight)]
    hot = right.where(F.col(weight) * HOT_SHARE > F.lit(total))
    hot = hot.select(F.col(key).alias("_hot_key"), F.struct(*extra).alias("_hot_value"))
    cold = right.where(F.col(weight) * HOT_SHARE <= F.lit(total)).select(F.col(key).alias("_cold_key"), F.struct(*extra).alias("_cold_value"))
    spread = F.xxhash64(*[c for c, kind in left.dtypes if "map<" not in kind])
    found = left.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    found = found.withColumn("_spread", F.when(F.col("_hot_key").isNotNull() | F.col(key).isNull(), spread))
    # A shuffled row carries its key and a spread that is 0 for the rows still to be matched.
    cold = cold.withColumn("_cold_spread", F.lit(0).cast("long")).hint("merge")
    joined = found.join(cold, (F.col(key) == F.col("_cold_key")) & (F.coalesce("_spread", F.lit(0).cast("long")) == F.col("_cold_spread")), "left")
    value = F.coalesce("_hot_value", "_cold_value")
    joined = joined.withColumn("_value", value)
    if how == "inner":
        joined = joined.where(F.col("_value").isNotNull())
    return joined.select(*left.columns, *[F.col(f"_value.{c}").alias(c) for c in extra])


def by_group(df: DataFrame, keys: list[str], function: Callable, schema: str) -> DataFrame:
    """`function` on the columns (as arrays) of each group of rows with equal whole-number keys; it returns arrays in the order of `schema`.

    Like a grouped apply, but rows stream through sorted partitions, so many small groups cost little each. A task holds one
    group and one batch: callers bound their groups.
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        held: list[dict] = []

        def finish():
            if held:
                yield function({c: np.concatenate([h[c] for h in held]) for c in held[0]} if len(held) > 1 else held[0])
                held.clear()

        def parts(batch):
            columns = {c: batch[c].to_numpy() for c in batch.columns}
            key = np.column_stack([columns[k] for k in keys])
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(key)])):
                if not n and held and any(held[-1][k][-1] != columns[k][0] for k in keys) or n:
                    yield from finish()
                held.append({c: v[a:b] for c, v in columns.items()})

        for batch in batches:
            if len(batch):
                found = list(parts(batch))
                if found:
                    yield pd.DataFrame({n: np.concatenate(x) for n, x in zip(names, zip(*found))})
        for found in finish():
            yield pd.DataFrame(dict(zip(names, found)))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest reachable node for every node of `edges` (columns a, b of type long): columns node, component.

    Alternating large-star and small-star steps until every node hangs on one smaller node that hangs on none. A step
    keeps at most as many edges as it got, and their number is logarithmic in the longest path. Each step aggregates
    before it shuffles, and its table is written to the shared folder, so a lost executor costs one step.
    """
    edges = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        if _settled(edges):
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = keep(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
        large = keep(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        down = keep(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(down, "a").select(F.inline(F.array(
            F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))))
        edges = keep(small.where("a <> b").distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component")))


def _settled(edges: DataFrame) -> bool:
    """Whether every upper end has one lower end, and no lower end is an upper end."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")),
                                         F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up + down > 1 AND up > 0").isEmpty()
