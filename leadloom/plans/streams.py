"""Queries: the streaming jobs, run over the tables until all input is read."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom import model
from leadloom.operators import dedup
from leadloom.plans.base import lead_frame, query, time_text, with_parts
from leadloom.plans.dedup import LEAD_PARTS, FINGERPRINTS, effective
from leadloom.plans.funnel import EVENT_PARTS, as_of, event_frame
from leadloom.session import cut_lineage, work_path
from leadloom.streaming import events as streaming


def _event_files(spark: SparkSession, folder: str, files: int = 2) -> DataFrame:
    """The events in arrival order unrelated to event time, every tenth one delivered twice.

    They arrive in four parts, of which a batch reads `files`. A part is written and read by many tasks, as a file each.
    """
    path = work_path(spark, "arrivals")
    rows = event_frame(spark, folder)
    again = rows.where("seq % 10 = 0")
    each = max(1, spark.sparkContext.defaultParallelism // 4)
    rows.unionByName(again).repartition(4 * each, "seq").write.parquet(path)
    return spark.readStream.schema(model.EVENT_DDL).option("maxFilesPerTrigger", files * each).parquet(path)


@query("stream_states", with_parts(f"""
SELECT lead_id, stage, open_follow_ups, overdue_follow_ups, {time_text('last_activity_at')} AS last_activity_at FROM states""", **EVENT_PARTS))
def stream_states(spark, folder):
    stream, state = _event_files(spark, folder), work_path(spark, "states")
    streaming.maintain_states(stream, work_path(spark, "log"), state, work_path(spark, "checkpoint"), as_of()).awaitTermination()
    return streaming.current_states(spark, state).select("lead_id", "stage", "open_follow_ups", "overdue_follow_ups", "last_activity_at")


@query("stream_stages", with_parts("SELECT stage, count(*) AS leads FROM states GROUP BY stage", **EVENT_PARTS))
def stream_stages(spark, folder):
    """Leads per stage after all batches; voided events count as little as in batch."""
    stream, state = _event_files(spark, folder, 1), work_path(spark, "states")
    streaming.maintain_states(stream, work_path(spark, "log"), state, work_path(spark, "checkpoint"), as_of()).awaitTermination()
    return streaming.current_states(spark, state).groupBy("stage").agg(F.count(F.lit(1)).alias("leads"))


@query("stream_activity", with_parts(f"""
SELECT {time_text("date_trunc('day', occurred_at)")} AS starts_at, type, count(*) AS events FROM clean GROUP BY ALL""", events0=EVENT_PARTS["events0"], clean=EVENT_PARTS["clean"]))
def stream_activity(spark, folder):
    stream, out = _event_files(spark, folder), work_path(spark, "activity")
    streaming.activity_counts(stream, out, work_path(spark, "checkpoint"), "1 day").awaitTermination()
    return streaming.activity(spark, out)


@query("stream_reminders", with_parts(f"""
SELECT lead_id, event_id, {time_text('due_at')} AS due_at FROM follow_ups WHERE due_at < (SELECT max(occurred_at) FROM clean)""", **EVENT_PARTS))
def stream_reminders(spark, folder):
    """All files arrive in one batch here: what is reminded in between would depend on their order."""
    stream, out = _event_files(spark, folder, 1000), work_path(spark, "reminders")
    streaming.remind_overdue(stream, work_path(spark, "log"), out, work_path(spark, "checkpoint")).awaitTermination()
    return streaming.reminders(spark, out).select("lead_id", "event_id", "due_at")


@query("stream_links", with_parts("""
SELECT key, least(head, account_id) AS left_id, greatest(head, account_id) AS right_id, confidence, reason FROM (
  SELECT DISTINCT f.key, f.lead_id AS account_id, f.confidence, f.reason, h.head FROM fingerprints f JOIN (
    SELECT key, arg_min(lead_id, (CAST(substring(lead_id, 2) AS BIGINT) % 4, lead_id)) AS head FROM fingerprints GROUP BY key) h ON h.key = f.key)
WHERE head <> account_id""", **LEAD_PARTS, fingerprints=FINGERPRINTS))
def stream_links(spark, folder):
    """The links found while the accounts arrive in four batches, one after the other."""
    path, members, links, checkpoint = (work_path(spark, n) for n in ("arrivals", "members", "links", "checkpoint"))
    keys = dedup.fingerprints(lead_frame(spark, folder), effective(spark, folder)).withColumnRenamed("lead_id", "account_id")
    keys = cut_lineage(keys.select("key", "account_id", "confidence", "reason"), "keys")
    for turn in range(4):
        keys.where(F.substring("account_id", 2, 9).cast("bigint") % 4 == turn).write.mode("append").parquet(path)
        stream = spark.readStream.schema(keys.schema).parquet(path)
        streaming.link_new_members(stream, members, links, checkpoint).awaitTermination()
    return spark.read.schema(streaming.LINK_DDL).parquet(links).select("key", "left_id", "right_id", "confidence", "reason")
