"""Structured Streaming jobs over the event log and over new leads.

Each micro-batch appends to a table under its batch id (replacing a repeated attempt) and recomputes only the
leads it touched with the batch operators. Back-filled and void events therefore count exactly as in batch,
and nothing is dropped by a watermark. The log is partitioned by a hash of the lead, so a batch reads back only
the partitions of its own leads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leadloom import model
from leadloom.functions import text as t
from leadloom.operators import dedup, funnel

STATE_DDL = (
    "lead_id string, stage string, contacted boolean, replied boolean, quoted boolean, sampled boolean, ordered boolean, "
    "won boolean, lost boolean, open_follow_ups bigint, overdue_follow_ups bigint, overdue boolean, next_event_id string, "
    "next_due_at timestamp, next_note string, last_activity_at timestamp"
)
REMINDER_DDL = "lead_id string, event_id string, due_at timestamp, note string"
LINK_DDL = "left_id string, right_id string, confidence double, reason string, key string"


BUCKETS = 64


def _batch_path(path: str, batch_id: int) -> str:
    return f"{path}/batch={batch_id}"


def _read(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(f"{ddl}, batch bigint").parquet(path)


def _append(batch: DataFrame, path: str, batch_id: int, key: str) -> list[int]:
    """Store the batch under its id, split by bucket; returns the buckets it touched (at most BUCKETS)."""
    bucketed = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
    bucketed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(_batch_path(path, batch_id))
    return [r.bucket for r in _stored(batch.sparkSession, path, "", batch_id).where(
        F.col("batch") == batch_id).select("bucket").distinct().collect()]


def _stored(spark: SparkSession, path: str, ddl: str, batch_id: int) -> DataFrame:
    """Everything up to this batch; filters on `bucket` and `batch` only open the folders they name."""
    columns = ", ".join(c for c in (ddl, "batch bigint", "bucket int") if c)
    return spark.read.schema(columns).parquet(path).where(F.col("batch") <= batch_id)


def distinct_events(stream: DataFrame) -> DataFrame:
    """Each (lead, event id) once. The seen ids are kept without time limit, as late copies must not count."""
    return stream.dropDuplicates(["lead_id", "event_id"])


def activity_counts(stream: DataFrame, count_path: str, checkpoint: str, width: str = "1 hour") -> StreamingQuery:
    """Count distinct events per time window and type. Late events still count: a batch adds its own counts to the table."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        counted = batch.groupBy(F.window("occurred_at", width).alias("w"), "type").agg(F.count(F.lit(1)).alias("events"))
        counted.select(F.col("w.start").alias("starts_at"), "type", "events").write.mode("overwrite").parquet(_batch_path(count_path, batch_id))

    return _start(distinct_events(stream), handle, checkpoint)


def activity(spark: SparkSession, count_path: str) -> DataFrame:
    rows = _read(spark, count_path, "starts_at timestamp, type string, events bigint")
    return rows.groupBy("starts_at", "type").agg(F.sum("events").alias("events"))


def maintain_states(stream: DataFrame, log_path: str, state_path: str, checkpoint: str, as_of: Column) -> StreamingQuery:
    """Keep the event log and the lead states up to date.

    States are appended per batch; `current_states` reads the newest row of each lead.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        buckets = _append(batch, log_path, batch_id, "lead_id")
        log = _stored(batch.sparkSession, log_path, model.EVENT_DDL, batch_id).where(F.col("bucket").isin(buckets))
        touched = log.where(F.col("batch") == batch_id).select("lead_id").distinct()
        states = funnel.lead_states(log.join(touched, "lead_id", "left_semi").drop("batch", "bucket"), as_of)
        states.write.mode("overwrite").parquet(_batch_path(state_path, batch_id))

    return _start(distinct_events(stream), handle, checkpoint)


def current_states(spark: SparkSession, state_path: str) -> DataFrame:
    rows = _read(spark, state_path, STATE_DDL)
    body = F.struct(*[F.col(c) for c in rows.columns if c not in ("lead_id", "batch")])
    return rows.groupBy("lead_id").agg(F.max_by(body, "batch").alias("s")).select("lead_id", "s.*")


def remind_overdue(stream: DataFrame, log_path: str, reminder_path: str, checkpoint: str) -> StreamingQuery:
    """Write each follow-up once when it becomes overdue; the clock is the newest event time seen so far.

    A follow-up reported by an earlier batch is not repeated. The clock moves for every lead at once, so each
    batch looks at all open follow-ups; only the columns and event types this needs are read.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(_batch_path(log_path, batch_id))
        log = _read(spark, log_path, model.EVENT_DDL).where(F.col("batch") <= batch_id).drop("batch")
        now = log.agg(F.max("occurred_at")).first()[0]
        plans = log.where(F.col("type").isin("follow-up-scheduled", "follow-up-completed", "activity-voided"))
        overdue = funnel.open_follow_ups(plans, F.lit(now)).where("overdue").select("lead_id", "event_id", "due_at", "note")
        if batch_id > 0:
            sent = _read(spark, reminder_path, REMINDER_DDL).where(F.col("batch") < batch_id)
            overdue = overdue.join(sent, ["lead_id", "event_id"], "left_anti")
        overdue.write.mode("overwrite").parquet(_batch_path(reminder_path, batch_id))

    return _start(distinct_events(stream), handle, checkpoint)


def reminders(spark: SparkSession, reminder_path: str) -> DataFrame:
    return _read(spark, reminder_path, REMINDER_DDL).drop("batch")


def link_new_members(stream: DataFrame, member_path: str, link_path: str, checkpoint: str) -> StreamingQuery:
    """Find duplicate candidates of arriving blocking keys (key, account_id, confidence, reason).

    A new account is linked to the first account ever seen under each of its keys. The links of a block
    connect all its accounts, and they grow with the accounts rather than with their pairs.
    """
    ddl = "key string, account_id string, confidence double, reason string"

    def handle(batch: DataFrame, batch_id: int) -> None:
        buckets = _append(batch.select("key", "account_id", "confidence", "reason"), member_path, batch_id, "key")
        members = _stored(batch.sparkSession, member_path, ddl, batch_id).where(F.col("bucket").isin(buckets))
        new = members.where(F.col("batch") == batch_id).drop("batch", "bucket").dropDuplicates(["key", "account_id"])
        heads = members.join(new.select("key").distinct(), "key", "left_semi").groupBy("key").agg(
            F.min_by("account_id", F.struct("batch", "account_id")).alias("head"))
        linked = dedup.lookup(new, heads, "key").where(F.col("head") != F.col("account_id"))
        linked.select(
            F.least("head", "account_id").alias("left_id"), F.greatest("head", "account_id").alias("right_id"),
            "confidence", "reason", "key").write.mode("overwrite").parquet(_batch_path(link_path, batch_id))

    return _start(stream, handle, checkpoint)


def new_links(spark: SparkSession, link_path: str) -> DataFrame:
    rows = _read(spark, link_path, LINK_DDL)
    return rows.groupBy("left_id", "right_id").agg(
        F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("reason")).alias("reasons"))


def _start(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()
