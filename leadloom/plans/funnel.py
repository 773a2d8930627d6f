"""Queries: development events, stages, follow-ups, conversion."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.operators import funnel, leads as shape, scoring
from leadloom.plans.base import QUALIFIED_PARTS, derive, lead_frame, query, time_text, with_parts
from leadloom.plans.leads import qualified
from leadloom.session import cut_lineage

AS_OF = "2024-01-20 00:00:00"

# Users are leads; every event becomes a development event, some of them plans, completions and corrections.
EVENTS = """
SELECT concat('L', lpad(CAST(user_id AS STRING), 9, '0')) AS lead_id, CAST(event_id AS STRING) AS event_id, event_id AS seq,
  CASE WHEN event_id % 11 = 0 THEN 'reopened' WHEN event_id % 13 = 0 THEN 'follow-up-scheduled' WHEN event_id % 17 = 0 THEN 'activity-voided'
       WHEN event_id % 19 = 0 THEN 'follow-up-completed' WHEN event_id % 23 = 0 THEN 'sample-sent' WHEN event_id % 29 = 0 THEN 'order-received'
       WHEN event_id % 31 = 0 THEN 'unknown-type'
       WHEN event_type = 'view' THEN 'contact-attempted' WHEN event_type = 'click' THEN 'buyer-replied' WHEN event_type = 'signup' THEN 'quote-sent'
       WHEN event_type = 'purchase' THEN CASE WHEN event_id % 7 = 0 THEN 'won' ELSE 'note' END
       ELSE CASE WHEN event_id % 5 = 0 THEN 'lost' ELSE 'note' END END AS type,
  CASE WHEN event_id % 37 <> 0 THEN CAST(ts AS TIMESTAMP) END AS occurred_at,
  CASE WHEN event_id % 13 = 0 AND event_id % 26 <> 0 THEN CAST(ts AS TIMESTAMP) + INTERVAL '5' DAY
       WHEN event_id % 13 = 0 AND event_id % 52 = 0 THEN CAST(ts AS TIMESTAMP) + INTERVAL '20' DAY END AS due_at,
  CASE WHEN event_id % 17 = 0 OR event_id % 19 = 0 THEN CAST(lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS STRING) END AS related,
  event_type AS channel_word, value AS amount_value
FROM events
"""
CLEAN = """
SELECT * FROM events0 WHERE type <> 'unknown-type' AND occurred_at IS NOT NULL AND NOT (type = 'follow-up-scheduled' AND due_at IS NULL)
  AND NOT (type IN ('follow-up-completed', 'activity-voided') AND related IS NULL)
"""
ACTIVE = """
SELECT e.* FROM clean e WHERE type <> 'activity-voided' AND NOT EXISTS (
  SELECT 1 FROM clean v WHERE v.type = 'activity-voided' AND v.lead_id = e.lead_id AND v.related = e.event_id)
"""
FOLLOW_UPS = f"""
SELECT a.lead_id, a.event_id, a.due_at, a.seq, a.due_at < TIMESTAMP '{AS_OF}' AS overdue FROM active a WHERE a.type = 'follow-up-scheduled'
  AND NOT EXISTS (SELECT 1 FROM active c WHERE c.type = 'follow-up-completed' AND c.lead_id = a.lead_id AND c.related = a.event_id)
"""
STATES = """
SELECT lead_id, CASE WHEN terminal IN ('won', 'lost') THEN terminal WHEN ordered THEN 'ordered' WHEN sampled THEN 'sampled'
    WHEN quoted THEN 'quoted' WHEN replied THEN 'replied' WHEN contacted THEN 'contacted' ELSE 'new' END AS stage,
  contacted, replied, quoted, sampled, ordered, coalesce(terminal = 'won', FALSE) AS won, coalesce(terminal = 'lost', FALSE) AS lost,
  coalesce(f.open_n, 0) AS open_follow_ups, coalesce(f.overdue_n, 0)::BIGINT AS overdue_follow_ups, coalesce(f.overdue_n, 0) > 0 AS overdue,
  f.next_event_id, f.next_due_at, last_activity_at
FROM (SELECT lead_id, arg_max(type, (occurred_at, seq)) FILTER (type IN ('won', 'lost', 'reopened')) AS terminal,
    bool_or(type = 'contact-attempted') AS contacted, bool_or(type = 'buyer-replied') AS replied, bool_or(type = 'quote-sent') AS quoted,
    bool_or(type = 'sample-sent') AS sampled, bool_or(type = 'order-received') AS ordered, max(occurred_at) AS last_activity_at
  FROM active GROUP BY lead_id) s
LEFT JOIN (SELECT lead_id AS f_id, count(*) AS open_n, count(*) FILTER (overdue) AS overdue_n, arg_min(event_id, (due_at, seq)) AS next_event_id,
    min(due_at) AS next_due_at FROM follow_ups GROUP BY lead_id) f ON f.f_id = s.lead_id
"""
EVENT_PARTS = {"events0": EVENTS, "clean": CLEAN, "active": ACTIVE, "follow_ups": FOLLOW_UPS, "states": STATES}
# Baselines were frozen for two thirds of the leads.
BASELINES = "SELECT lead_id, grade FROM qualified WHERE CAST(right(lead_id, 9) AS BIGINT) % 3 <> 0"
ACCOUNTS = """
SELECT l.lead_id, l.duplicate_of IS NOT NULL AS duplicate, b.grade AS frozen, s.* EXCLUDE (lead_id)
FROM leads l LEFT JOIN states s ON s.lead_id = l.lead_id LEFT JOIN baselines b ON b.lead_id = l.lead_id
"""
ACCOUNT_PARTS = {**QUALIFIED_PARTS, **EVENT_PARTS, "baselines": BASELINES, "accounts": ACCOUNTS}


def event_frame(spark: SparkSession, folder: str) -> DataFrame:
    rows = derive(spark, folder, EVENTS)
    return shape.normalize_events(rows.select(
        "lead_id", "event_id", "seq", "type", "occurred_at", F.col("channel_word").alias("channel"),
        F.lit("derived note").alias("note"), "due_at", F.col("related").alias("related_event_id"),
        F.col("amount_value").alias("amount"), F.lit("usd").alias("currency"), F.lit(None).cast("string").alias("outcome_reason")))


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def states(spark: SparkSession, folder: str) -> DataFrame:
    return funnel.lead_states(event_frame(spark, folder), as_of())


def baseline_frame(spark: SparkSession, folder: str) -> DataFrame:
    return qualified(spark, folder).where(F.substring("lead_id", 2, 9).cast("bigint") % 3 != 0).select(
        "lead_id", "grade", "score", as_of().alias("captured_at"))


@query("dev_events_clean", with_parts(f"""
SELECT lead_id, event_id, type, {time_text('occurred_at')} AS occurred_at, NULL::VARCHAR AS channel, 'USD' AS currency,
  type <> 'activity-voided' AND EXISTS (SELECT 1 FROM clean v WHERE v.type = 'activity-voided' AND v.lead_id = e.lead_id AND v.related = e.event_id)
    AS voided FROM clean e""", events0=EVENTS, clean=CLEAN))
def dev_events_clean(spark, folder):
    return funnel.event_log(event_frame(spark, folder)).select(
        "lead_id", "event_id", "type", "occurred_at", "channel", "currency", "voided")


@query("dev_state", with_parts(f"""
SELECT * EXCLUDE (next_due_at, last_activity_at), {time_text('next_due_at')} AS next_due_at,
  {time_text('last_activity_at')} AS last_activity_at FROM states""", **EVENT_PARTS))
def dev_state(spark, folder):
    return states(spark, folder).drop("next_note")


@query("dev_followups", with_parts(f"""
SELECT lead_id, event_id, {time_text('due_at')} AS due_at, overdue FROM follow_ups""", **EVENT_PARTS))
def dev_followups(spark, folder):
    return funnel.open_follow_ups(event_frame(spark, folder), as_of()).drop("note").orderBy("due_at", "event_id")


@query("dev_recent_events", with_parts("""
SELECT lead_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY seq DESC) AS rn FROM clean) WHERE rn <= 5""",
    events0=EVENTS, clean=CLEAN))
def dev_recent_events(spark, folder):
    return funnel.recent_events(event_frame(spark, folder), 5).select("lead_id", "event_id")


@query("dev_new_baselines", with_parts("""
SELECT q.lead_id, q.grade, q.score::BIGINT AS score FROM qualified q WHERE q.lead_id NOT IN (SELECT lead_id FROM baselines)
  AND q.lead_id NOT IN (SELECT lead_id FROM clean)""", **ACCOUNT_PARTS))
def dev_new_baselines(spark, folder):
    return funnel.new_baselines(qualified(spark, folder), baseline_frame(spark, folder), event_frame(spark, folder),
                                as_of()).drop("captured_at")


@query("dev_funnel", with_parts("""
SELECT count(*) AS leads, count(*) FILTER (NOT duplicate) AS eligible_leads, count(*) FILTER (duplicate) AS duplicate_records,
  count(*) FILTER (NOT duplicate AND frozen IS NOT NULL) AS baseline_tracked, """ + ", ".join(
    f"count(*) FILTER (NOT duplicate AND {m}) AS {m}" for m in funnel.MILESTONES) + """,
  sum(open_follow_ups) FILTER (NOT duplicate)::BIGINT AS open_follow_ups, sum(overdue_follow_ups) FILTER (NOT duplicate)::BIGINT AS overdue
FROM accounts""", **ACCOUNT_PARTS))
def dev_funnel(spark, folder):
    return funnel.funnel_totals(lead_frame(spark, folder), states(spark, folder), baseline_frame(spark, folder))


_CONVERSION = """
SELECT g.grade, count(a.lead_id) AS leads, """ + ", ".join(f"count(*) FILTER (a.{m}) AS {m}" for m in funnel.MILESTONES) + ", " + ", ".join(
    f"CASE WHEN count(a.lead_id) > 0 THEN floor(count(*) FILTER (a.{m})::DOUBLE * 1000 / count(a.lead_id) + 0.5) / 10 END AS {m}_rate"
    for m in funnel.MILESTONES if m != "lost") + """
FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('HOLD')) g(grade) LEFT JOIN accounts a ON a.frozen = g.grade AND NOT a.duplicate GROUP BY g.grade"""


@query("conversion_by_grade", with_parts(_CONVERSION, **ACCOUNT_PARTS))
def conversion_by_grade(spark, folder):
    return funnel.conversion_by_grade(lead_frame(spark, folder), states(spark, folder), baseline_frame(spark, folder))


@query("conversion_table", with_parts(_CONVERSION + " HAVING count(a.lead_id) > 0", **ACCOUNT_PARTS))
def conversion_table(spark, folder):
    return funnel.conversion_by_grade(lead_frame(spark, folder), states(spark, folder), baseline_frame(spark, folder), True)


_WORK = """
SELECT q.lead_id, q.grade, q.score, coalesce(s.stage, 'new') AS stage, coalesce(s.open_follow_ups, 0) AS open_follow_ups,
  coalesce(s.overdue, FALSE) AS overdue FROM qualified q LEFT JOIN states s ON s.lead_id = q.lead_id"""


@query("work_list", with_parts(_WORK, **QUALIFIED_PARTS, **EVENT_PARTS))
def work_list(spark, folder):
    return scoring.work_list(qualified(spark, folder), states(spark, folder))


@query("work_list_overdue_d", with_parts(_WORK + " WHERE q.grade = 'D' AND s.overdue", **QUALIFIED_PARTS, **EVENT_PARTS))
def work_list_overdue_d(spark, folder):
    return scoring.work_list(qualified(spark, folder), states(spark, folder), "D", "OVERDUE")


# Proposals: every event of the raw log is offered again as a new entry of another type.
PROPOSED = """
SELECT concat('L', lpad(CAST(user_id AS STRING), 9, '0')) AS lead_id, 10000000000 + event_id AS seq,
  CASE event_id % 9 WHEN 0 THEN 'contact-attempted' WHEN 1 THEN 'lost' WHEN 2 THEN 'reopened' WHEN 3 THEN 'follow-up-scheduled'
    WHEN 4 THEN 'activity-voided' WHEN 5 THEN 'quote-sent' WHEN 6 THEN 'follow-up-completed' WHEN 7 THEN 'won' ELSE 'phone-call' END AS type,
  CAST(ts AS TIMESTAMP) AS occurred_at, CASE WHEN event_id % 4 = 0 THEN 'x' ELSE 'noted by hand' END AS note,
  CASE WHEN event_id % 9 = 3 AND event_id % 2 = 0 THEN CAST(ts AS TIMESTAMP) + INTERVAL '3' DAY END AS due_at,
  CASE WHEN event_id % 9 IN (4, 6) THEN CAST(event_id AS STRING) END AS related, CAST(value - 20 AS STRING) AS amount_text
FROM events
"""


def proposal_frame(spark: SparkSession, folder: str) -> DataFrame:
    return derive(spark, folder, PROPOSED).select(
        "lead_id", F.lit(None).cast("string").alias("event_id"), "seq", "type", "occurred_at", F.lit("Email").alias("channel"), "note",
        "due_at", F.col("related").alias("related_event_id"), F.col("amount_text").alias("amount"), F.lit("usd").alias("currency"),
        F.lit(None).cast("string").alias("outcome_reason"))


CHECKS = """SELECT p.lead_id, p.seq, p.type, CASE
  WHEN p.type = 'phone-call' THEN 'unknown-type' WHEN p.type = 'follow-up-scheduled' AND due_at IS NULL THEN 'due-date-missing'
  WHEN p.type IN ('lost', 'reopened', 'note', 'activity-voided') AND length(note) < 3 THEN 'note-too-short'
  WHEN CAST(amount_text AS DECIMAL(18, 2)) < 0 THEN 'bad-amount'
  WHEN outbound AND do_not_contact THEN 'do-not-contact' WHEN outbound AND restricted_market THEN 'restricted-market'
  WHEN outbound AND duplicate_of IS NOT NULL THEN 'duplicate-of-master' WHEN outbound AND q.grade = 'HOLD' THEN 'on-hold' END AS refusal
FROM (SELECT *, type IN ('contact-attempted', 'quote-sent', 'sample-sent', 'follow-up-scheduled') AS outbound FROM proposed) p
JOIN leads l ON l.lead_id = p.lead_id JOIN qualified q ON q.lead_id = p.lead_id
"""


@query("dev_proposal_checks", with_parts(CHECKS, **QUALIFIED_PARTS, proposed=PROPOSED))
def dev_proposal_checks(spark, folder):
    return funnel.check_proposals(lead_frame(spark, folder), qualified(spark, folder), proposal_frame(spark, folder), as_of()).select(
        "lead_id", "seq", "type", "refusal")


# One proposal after the other: each lead's entries so far are a list.
WALK = """
SELECT lead_id, CAST(0 AS BIGINT) AS nth, coalesce(h.entries, []) AS entries, CAST(0 AS HUGEINT) AS seq, '' AS type, '' AS outcome
FROM (SELECT DISTINCT lead_id FROM numbered) l LEFT JOIN history h USING (lead_id)
UNION ALL
SELECT lead_id, nth, CASE WHEN outcome = 'accepted' THEN list_append(entries, p) ELSE entries END, p.seq, p.type, outcome
FROM (SELECT *, CASE WHEN refusal IS NOT NULL THEN refusal
    WHEN p.type = 'activity-voided' AND (target IS NULL OR target = 'activity-voided') THEN 'nothing-to-void'
    WHEN p.type = 'activity-voided' AND list_contains(void, p.rel) THEN 'already-voided'
    WHEN p.type = 'follow-up-scheduled' AND coalesce(mark <> 'reopened', FALSE) THEN 'lead-is-closed'
    WHEN p.type = 'follow-up-completed' AND NOT (coalesce(target = 'follow-up-scheduled', FALSE) AND NOT list_contains(void, p.rel) AND len(list_filter(live, lambda e: e.type = 'follow-up-completed' AND e.rel = p.rel)) = 0) THEN 'no-open-follow-up'
    WHEN p.type = 'reopened' AND NOT coalesce(mark <> 'reopened', FALSE) THEN 'lead-is-not-closed' ELSE 'accepted' END AS outcome
  FROM (SELECT *, list_extract(list_filter(entries, lambda e: e.id = p.rel), 1).type AS target,
      list_extract(list_reverse_sort(list_transform(list_filter(live, lambda e: e.type IN ('won', 'lost', 'reopened')), lambda e: {'at': e.at, 'seq': e.seq, 'id': e.id, 'type': e.type})), 1).type AS mark
    FROM (SELECT *, list_filter(entries, lambda e: NOT list_contains(void, e.id)) AS live
      FROM (SELECT w.lead_id, w.entries, n.nth, n.refusal, n.p, list_transform(list_filter(w.entries, lambda e: e.type = 'activity-voided'), lambda e: e.rel) AS void
        FROM walk w JOIN numbered n ON n.lead_id = w.lead_id AND n.nth = w.nth + 1))))
"""


@query("dev_record_events", with_parts("SELECT lead_id, CAST(seq AS BIGINT) AS seq, type, outcome FROM walk WHERE nth > 0", **QUALIFIED_PARTS, **EVENT_PARTS,
    proposed=PROPOSED, checks=CHECKS,
    history="""SELECT lead_id, list({'id': event_id, 'type': type, 'at': occurred_at, 'seq': CAST(seq AS HUGEINT), 'rel': related} ORDER BY seq) AS entries
      FROM clean GROUP BY lead_id""",
    numbered="""SELECT p.lead_id, row_number() OVER (PARTITION BY p.lead_id ORDER BY p.seq) AS nth, c.refusal,
      {'id': 'p' || p.seq, 'type': p.type, 'at': p.occurred_at, 'seq': CAST(p.seq AS HUGEINT), 'rel': p.related} AS p FROM proposed p JOIN checks c USING (lead_id, seq)""",
    walk=WALK))
def dev_record_events(spark, folder):
    """Judgement of all proposals against each lead's history and the proposals before them."""
    events = cut_lineage(event_frame(spark, folder), "events")
    judged = funnel.record_events(lead_frame(spark, folder), qualified(spark, folder), events, proposal_frame(spark, folder), as_of())
    return judged.select("lead_id", "seq", "type", "outcome")
