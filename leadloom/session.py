"""Session settings, lineage cuts and the skew-safe lookup join shared by the operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A key is hot when it holds more than 1/HOT_SHARE of the rows, so at most HOT_SHARE keys are, at any size.
HOT_SHARE = 256
_written: list[str] = []
_own_folders: dict[str, str] = {}


# Wide projections over text make the optimizer's constraint sets grow exponentially; the filters they would
# infer are written out in the operators.
PLAN_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.constraintPropagation.enabled": "false",
    # The JVM never compiles methods over 8000 bytes; stages that large run faster as smaller functions.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # A lambda that names a column must mean the input column, never a new column of the same select.
    "spark.sql.lateralColumnAlias.enableImplicitResolution": "false",
}


_plan_sessions: dict[int, tuple[SparkSession, SparkSession]] = {}
_shipped: set[str] = set()


def plan_session(spark: SparkSession) -> SparkSession:
    """A session beside `spark`, with its settings, the plan settings and views of its own; `spark` itself stays as it is."""
    known = _plan_sessions.get(id(spark))
    if known is None or known[0] is not spark:
        known = _plan_sessions[id(spark)] = (spark, spark.newSession())
    own, wanted = known[1], {**dict(spark.conf.getAll), **PLAN_SETTINGS}
    for key, value in wanted.items():
        if own.conf.get(key, None) != value and spark.conf.isModifiable(key):
            own.conf.set(key, value)
    return own


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application, so that its functions load wherever Python was started."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        staging = tempfile.mkdtemp(prefix="leadloom-ship-")
        atexit.register(shutil.rmtree, staging, ignore_errors=True)
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        context.addPyFile(shutil.make_archive(os.path.join(staging, "leadloom"), "zip", root, "leadloom"))


def build_session(app: str = "leadloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC clock, AQE and skew-join handling; cluster settings win where given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **PLAN_SETTINGS,
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. Only a local master may lack it: it gets a folder that goes when Python exits."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or _own_folders.get(spark.sparkContext.applicationId)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="leadloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    _own_folders[spark.sparkContext.applicationId] = folder
    return folder


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    _written.append(os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}"))
    return _written[-1]


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables this process has written. Call it once the results that read them are written."""
    while _written:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame, name: str = "step") -> DataFrame:
    """Write `df` once as a table in the shared folder and read it back.

    Unlike an in-memory cut this survives the loss of executors, and the input is computed once.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lookup(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join `left`, which may have hot keys, to `right`, which has one row per key (a second one is an error).

    A count of `left` by key finds the keys with more than 1/HOT_SHARE of its rows: at most HOT_SHARE keys. Their rows
    meet a broadcast of just those keys and take no part in the shuffle join of the rest, in which no key has more than that
    share. Apart from the count, `left` is read once, and every row is kept; only its route differs.
    """
    if how not in ("inner", "left"):
        raise ValueError("lookup supports inner and left joins")
    extra = [c for c in right.columns if c != key]
    counts = left.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_rows"))
    total = counts.agg(F.coalesce(F.sum("_rows"), F.lit(0))).scalar()
    hot = counts.where(F.col("_rows") * HOT_SHARE > total).select("_key")
    value = F.when(F.count(F.lit(1)) == 1, F.first(F.struct(F.lit(True).alias("_found"), *extra))).otherwise(
        F.raise_error(F.lit(f"lookup: {key} is not unique on the right side")))
    single = right.groupBy(F.col(key).alias("_key")).agg(value.alias("_value"))
    on_hot = single.join(F.broadcast(hot), "_key", "left_semi").select(F.col("_key").alias("_hot_key"), F.col("_value").alias("_hot"))
    rest = single.select(F.col("_key").alias("_cold_key"), F.lit(0).cast("long").alias("_cold_spread"), F.col("_value").alias("_cold"))
    # Rows that found a hot key, and those without a key, shuffle under a spread of their own that matches nothing.
    spread = F.xxhash64(*[c for c, kind in left.dtypes if "map<" not in kind and "variant" not in kind])
    met = left.join(F.broadcast(on_hot), F.col(key) == F.col("_hot_key"), "left").withColumn(
        "_spread", F.when(F.col("_hot_key").isNotNull() | F.col(key).isNull(), spread).otherwise(0))
    met = met.join(rest, (F.col(key) == F.col("_cold_key")) & (F.col("_spread") == F.col("_cold_spread")), "left")
    met = met.withColumn("_value", F.coalesce("_hot", "_cold"))
    if how == "inner":
        met = met.where(F.col("_value._found"))
    columns = [key, *[c for c in left.columns if c != key]]
    return met.select(*columns, *[F.col(f"_value.{c}").alias(c) for c in extra])


def compact_codes(*pairs: tuple[Column, str]) -> Column:
    """Array of the codes whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for cond, code in pairs]))


def first_code(*pairs: tuple[Column, str]) -> Column:
    """The code of the first condition that holds, null when none does; later conditions are not evaluated."""
    return F.coalesce(*[F.when(cond, F.lit(code)) for cond, code in pairs])


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row.

    A plain projection would be copied into every filter on its columns; a generated row is not.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def codes_where(rules: Iterable[tuple[str, str]]) -> Column:
    """Like compact_codes for conditions written as SQL text."""
    parts = ", ".join(f"IF({condition}, '{code}', NULL)" for condition, code in rules)
    return F.expr(f"array_compact(array({parts}))")
