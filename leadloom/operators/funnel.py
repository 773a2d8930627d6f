"""Development funnel: stages, milestones and follow-ups from an append-only event log."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom import model
from leadloom.functions import text as t
from leadloom.operators.leads import newest
from leadloom.operators.scoring import grade_table
from leadloom.session import first_code, cut_lineage, lookup

MILESTONES = ("contacted", "replied", "quoted", "sampled", "ordered", "won", "lost")
EVENTS_KEPT = 500  # fixed value: events per lead that count
_EVENT_OF_STAGE = {stage: event for event, stage in model.STAGE_OF_EVENT.items()}


def event_log(events: DataFrame) -> DataFrame:
    """Every event with a `voided` mark; void rows themselves are never void."""
    voids = events.where(F.col("type") == "activity-voided").select(
        "lead_id", F.col("related_event_id").alias("event_id")).distinct().withColumn("_void", F.lit(True))
    marked = events.join(voids, ["lead_id", "event_id"], "left")
    voided = F.col("_void").isNotNull() & (F.col("type") != "activity-voided")
    return marked.withColumn("voided", voided).drop("_void")


def active_events(events: DataFrame) -> DataFrame:
    voids = events.where(F.col("type") == "activity-voided").select(
        "lead_id", F.col("related_event_id").alias("event_id"))
    return events.where(F.col("type") != "activity-voided").join(voids, ["lead_id", "event_id"], "left_anti")


def with_completion(active: DataFrame) -> DataFrame:
    """Active events with an `open` mark on follow-ups no active completion refers to.

    The join keys are those of the void join, so the left side is not shuffled again.
    """
    done = active.where(F.col("type") == "follow-up-completed").select(
        "lead_id", F.col("related_event_id").alias("event_id")).distinct().withColumn("_done", F.lit(True))
    joined = active.join(done, ["lead_id", "event_id"], "left")
    is_open = (F.col("type") == "follow-up-scheduled") & F.col("due_at").isNotNull() & F.col("_done").isNull()
    return joined.withColumn("open", is_open).drop("_done")


def open_follow_ups(events: DataFrame, as_of: Column) -> DataFrame:
    """Open follow-ups with their overdue mark."""
    rows = with_completion(active_events(events)).where("open")
    return rows.select("lead_id", "event_id", "due_at", "note", (F.col("due_at") < as_of).alias("overdue"))


def _state_columns(as_of: Column) -> list[Column]:
    kind = F.col("type")
    rank = F.lit(0)
    for event, stage in model.STAGE_OF_EVENT.items():
        rank = F.when(kind == event, model.STAGES.index(stage)).otherwise(rank)
    code = F.when(kind == "won", 1).when(kind == "lost", 2).otherwise(0)
    marker = t.packed(F.unix_micros("occurred_at"), F.col("seq"), code)
    return [
        F.max(rank).alias("_rank"),
        F.max(F.when(kind.isin("won", "lost", "reopened"), marker)).alias("_terminal"),
        *[F.bool_or(kind == _EVENT_OF_STAGE[s]).alias(s) for s in model.STAGES[1:]],
        F.max("occurred_at").alias("last_activity_at"),
        F.count_if(F.col("open")).alias("open_follow_ups"),
        F.count_if(F.col("open") & (F.col("due_at") < as_of)).alias("overdue_follow_ups"),
    ]


def lead_states(events: DataFrame, as_of: Column) -> DataFrame:
    """Stage, milestones, follow-up counts, next action and last activity per lead with active events.

    The stage is the highest rank reached unless the last of won/lost/reopened (by time, then entry)
    closed the lead. All events go through one hash aggregate with partial results on the map side; only the few
    open follow-ups are read once more for the next action. Both sides are partitioned by lead for the join.
    """
    marked = with_completion(active_events(events))
    numbers = marked.groupBy("lead_id").agg(*_state_columns(as_of))
    upcoming = marked.where("open").groupBy("lead_id").agg(
        F.min_by(F.struct("event_id", "due_at", "note"), F.struct("due_at", "seq")).alias("next_action"))
    grouped = numbers.join(upcoming, "lead_id", "left")
    last = t.packed_code(F.col("_terminal"))
    reached = F.element_at(F.array(*[F.lit(s) for s in model.STAGES]), F.col("_rank") + 1)
    stage = F.when(last == 1, "won").when(last == 2, "lost").otherwise(reached)
    return grouped.select(
        "lead_id", stage.alias("stage"), *model.STAGES[1:],
        (stage == "won").alias("won"), (stage == "lost").alias("lost"),
        "open_follow_ups", "overdue_follow_ups", (F.col("overdue_follow_ups") > 0).alias("overdue"),
        F.col("next_action.event_id").alias("next_event_id"), F.col("next_action.due_at").alias("next_due_at"),
        F.col("next_action.note").alias("next_note"), "last_activity_at",
    )


def recent_events(events: DataFrame, keep: int = EVENTS_KEPT) -> DataFrame:
    """The last `keep` events of each lead by entry order."""
    return newest(events, ["lead_id"], keep)


def new_baselines(qualified: DataFrame, baselines: DataFrame, events: DataFrame, captured_at: Column) -> DataFrame:
    """Grade and score to freeze: leads without a baseline and without any event so far."""
    untouched = qualified.join(baselines, "lead_id", "left_anti").join(
        events.select("lead_id"), "lead_id", "left_anti")
    return untouched.select("lead_id", "grade", F.col("score").cast("int").alias("score"),
                            captured_at.alias("captured_at"))


def _accounts(leads: DataFrame, states: DataFrame, baselines: DataFrame) -> DataFrame:
    base = leads.select("lead_id", F.col("compliance.duplicate_of").isNotNull().alias("duplicate"))
    return base.join(states, "lead_id", "left").join(
        baselines.select("lead_id", F.col("grade").alias("baseline_grade")), "lead_id", "left").fillna(
        False, list(MILESTONES)).fillna(0, ["open_follow_ups", "overdue_follow_ups"])


def funnel_totals(leads: DataFrame, states: DataFrame, baselines: DataFrame) -> DataFrame:
    """One row of totals over accounts; duplicates leave every number but their own count."""
    single = ~F.col("duplicate")
    return _accounts(leads, states, baselines).agg(
        F.count(F.lit(1)).alias("leads"), F.count_if(single).alias("eligible_leads"),
        F.count_if(F.col("duplicate")).alias("duplicate_records"),
        F.count_if(single & F.col("baseline_grade").isNotNull()).alias("baseline_tracked"),
        *[F.count_if(single & F.col(m)).alias(m) for m in MILESTONES],
        F.coalesce(F.sum(F.when(single, F.col("open_follow_ups"))), F.lit(0)).alias("open_follow_ups"),
        F.coalesce(F.sum(F.when(single, F.col("overdue_follow_ups"))), F.lit(0)).alias("overdue"),
    )


def conversion_by_grade(leads: DataFrame, states: DataFrame, baselines: DataFrame,
                        filled_only: bool = False) -> DataFrame:
    """Milestone counts and rates per frozen grade, all five grades present."""
    tracked = _accounts(leads, states, baselines).where(~F.col("duplicate") & F.col("baseline_grade").isNotNull())
    counts = tracked.groupBy(F.col("baseline_grade").alias("grade")).agg(
        F.count(F.lit(1)).alias("leads"), *[F.count_if(F.col(m)).alias(m) for m in MILESTONES])
    # At most one row per grade, hence safe to broadcast.
    every = grade_table(leads.sparkSession).join(F.broadcast(counts), "grade", "left").fillna(0)
    out = every.select(
        "grade", "leads", *MILESTONES,
        *[t.percent(F.col(m), F.col("leads")).alias(f"{m}_rate") for m in MILESTONES if m != "lost"])
    return out.where(F.col("leads") > 0) if filled_only else out


# ---- recording new events ----

def check_proposals(leads: DataFrame, qualified: DataFrame, proposals: DataFrame, recorded_at: Column) -> DataFrame:
    """Proposals with defaults applied and a `refusal` code for everything that needs no history.

    Proposals: the columns of model.EVENT_DDL; `type` activity-voided asks to void `related_event_id`.
    """
    occurred = F.coalesce(F.col("occurred_at"), recorded_at)
    amount = F.col("amount").try_cast("decimal(18,2)")
    currency = F.upper(t.text("currency"))
    typed = proposals.select(
        "lead_id", "seq", "type", occurred.alias("occurred_at"), F.lower(t.text("channel")).alias("channel"),
        t.text("note").alias("note"), "due_at", t.text("related_event_id").alias("related_event_id"),
        amount.alias("amount"), currency.alias("currency"), t.text("outcome_reason").alias("outcome_reason"),
        t.text("event_id").alias("event_id"),
        (F.col("amount").isNotNull() & (amount.isNull() | (amount < 0))).alias("_bad_amount"),
    )
    made = t.content_id("dev", *[F.col(c).cast("string") for c in (
        "lead_id", "seq", "type", "occurred_at", "related_event_id", "note")])
    typed = typed.withColumn("event_id", F.coalesce("event_id", made))
    state = leads.select(
        "lead_id", F.lit(True).alias("_known"), F.col("compliance.do_not_contact").alias("_dnc"),
        F.col("compliance.restricted_market").alias("_restricted"),
        F.col("compliance.duplicate_of").alias("_master"),
    ).join(qualified.select("lead_id", F.col("grade").alias("_grade")), "lead_id", "left")
    joined = lookup(typed, state, "lead_id", "left")
    kind, outbound = F.col("type"), F.col("type").isin(*model.OUTBOUND_TYPES)
    short_note = F.coalesce(F.length("note"), F.lit(0)) < 3
    refusal = first_code(
        (F.col("_known").isNull(), "unknown-lead"),
        (~F.coalesce(kind.isin(*model.EVENT_TYPES), F.lit(False)), "unknown-type"),
        ((kind == "follow-up-scheduled") & F.col("due_at").isNull(), "due-date-missing"),
        (F.coalesce(F.col("due_at") < F.col("occurred_at"), F.lit(False)), "due-before-event"),
        (kind.isin("lost", "reopened", "note", "activity-voided") & short_note, "note-too-short"),
        (F.col("_bad_amount"), "bad-amount"),
        (F.col("currency").isNotNull() & ~F.col("currency").rlike("^[A-Z]{3}$"), "bad-currency"),
        (outbound & F.col("_dnc"), "do-not-contact"),
        (outbound & F.col("_restricted"), "restricted-market"),
        (outbound & F.col("_master").isNotNull(), "duplicate-of-master"),
        (outbound & (F.col("_grade") == "HOLD"), "on-hold"),
    )
    return joined.withColumn("refusal", refusal).drop(
        "_bad_amount", "_known", "_dnc", "_restricted", "_master", "_grade")


def standing(intervals: DataFrame, points: DataFrame, span: int) -> DataFrame:
    """`points` with `top`, the largest `value` of the intervals of their `key` that hold their `place`; null where none does.

    Intervals have key, since, until (excluded) and value; places and starts lie between 0 and `span`. Those that end beyond `span` hold
    all places from their start, so their largest value so far will do (`_so_far`). Any other is cut
    into pieces of sizes 1, 4, 16, ... that start at multiples of their size, three each side and size at most, and a place lies in one piece of
    each size. So pieces meet places by equality, whatever the number of intervals or places of a key.
    """
    levels = 1
    while 4 ** levels <= span:
        levels += 1
    asked = points.select("key", "place").distinct()
    width = F.pow(F.lit(4.0), "level").cast("bigint")
    ending = intervals.where((F.col("since") < F.col("until")) & (F.col("until") <= span))
    cut = ending.select("key", "value", "since", "until", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    cut = cut.withColumns({"low": F.ceil(F.col("since") / width).cast("bigint"), "high": F.floor(F.col("until") / width).cast("bigint")}).where("low < high")
    # The pieces of this size that no larger piece covers: up to the first multiple of four, and from the last one.
    left, right = F.least(F.col("high"), (F.ceil(F.col("low") / 4) * 4).cast("bigint")), F.expr("greatest(low, (high div 4) * 4)")
    places = lambda start, stop: F.when(start < stop, F.sequence(start, stop - 1)).otherwise(F.array().cast("array<bigint>"))
    pieces = F.when(left >= right, places(F.col("low"), F.col("high"))).otherwise(F.concat(places(F.col("low"), left), places(right, F.col("high"))))
    best = cut.select("key", "level", F.explode(pieces).alias("piece"), "value").groupBy("key", "level", "piece").agg(F.max("value").alias("value"))
    # A key without such intervals asks for no pieces; the others do so only up to their last end.
    ends = ending.groupBy("key").agg(F.min("since").alias("_since"), F.max("until").alias("_until"))
    within = asked.join(ends, "key").where((F.col("place") >= F.col("_since")) & (F.col("place") < F.col("_until")))
    within = within.select("key", "place", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    within = within.withColumn("piece", F.floor(F.col("place") / width).cast("bigint"))
    found = within.join(best, ["key", "level", "piece"]).select("key", "place", "value")
    lasting = intervals.where(F.col("until") > span).select("key", F.col("since").alias("place"), "value")
    tops = found.unionByName(_so_far(lasting, asked, span)).groupBy("key", "place").agg(F.max("value").alias("top"))
    return points.join(tops, ["key", "place"], "left")


def _so_far(starts: DataFrame, asked: DataFrame, span: int) -> DataFrame:
    """key, place and value: for each asked place the largest value its key has up to there.

    Places are taken in runs, as many as a run is long: a key's largest values are followed inside each run, and then over its runs, so no
    window is longer than a run has places or a key has runs.
    """
    run = F.floor(F.col("place") / (math.isqrt(span) + 1)).alias("run")
    starts = starts.groupBy("key", "place").agg(F.max("value").alias("value"))
    rows = starts.select("key", run, "place", "value", F.lit(False).alias("asked")).unionByName(
        asked.select("key", run, "place", F.lit(None).cast(starts.schema["value"].dataType).alias("value"), F.lit(True).alias("asked")))
    inside = Window.partitionBy("key", "run").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = rows.withColumn("value", F.max("value").over(inside)).where("asked").select("key", "run", "place", "value")
    before = Window.partitionBy("key").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("key", "run").agg(F.max("value").alias("value")).select("key", "run", F.max("value").over(before).alias("before"))
    met = inside.join(runs, ["key", "run"]).select("key", "place", F.greatest("value", "before").alias("value"))
    return met.where(F.col("value").isNotNull())


def _verdicts(checked: DataFrame, entered: DataFrame, span: int) -> DataFrame:
    """The outcome of every proposal that checks did not refuse, were `entered` (history and accepted proposals, by place) the whole log."""
    by_id = entered.where("event_id IS NOT NULL").groupBy("lead_id", "event_id").agg(
        F.min("place").alias("_first"), F.min_by("type", F.struct("place", "seq")).alias("_type"))
    voids = entered.where("type = 'activity-voided' AND related_event_id IS NOT NULL").groupBy("lead_id", "related_event_id").agg(F.min("place").alias("_void"))
    lasting = entered.where(F.col("type").isin("won", "lost", "reopened", "follow-up-completed")).join(
        voids.withColumnRenamed("related_event_id", "event_id"), ["lead_id", "event_id"], "left")
    mark = F.col("type") != "follow-up-completed"
    # Marks count for their lead, completions for the plan they name; both until they are voided, from the place after their own.
    lasting = lasting.where(mark | F.col("related_event_id").isNotNull()).select(
        F.struct("lead_id", F.when(~mark, F.col("related_event_id")).alias("plan")).alias("key"), (F.col("place") + 1).alias("since"),
        F.when(F.col("_void") < F.col("place"), F.col("place")).otherwise(F.coalesce(F.col("_void") + 1, F.lit(span + 1))).alias("until"),
        F.struct("occurred_at", "seq", "event_id", "type").alias("value"))
    asking = F.col("type").isin("follow-up-scheduled", "reopened", "follow-up-completed")
    points = checked.where(asking).select(
        "lead_id", "seq", F.struct("lead_id", F.when(F.col("type") == "follow-up-completed", F.coalesce("related_event_id", F.lit(""))).alias("plan")).alias("key"), "place")
    tops = standing(lasting, points, span).select("lead_id", "seq", F.col("top.type").alias("_top"))
    joined = checked.join(by_id.select("lead_id", "event_id", F.col("_first").alias("_own")), ["lead_id", "event_id"], "left")
    joined = joined.join(by_id.select("lead_id", F.col("event_id").alias("related_event_id"), "_first", "_type"), ["lead_id", "related_event_id"], "left")
    joined = joined.join(voids, ["lead_id", "related_event_id"], "left").join(tops, ["lead_id", "seq"], "left")
    before = lambda c: F.coalesce(F.col(c) < F.col("place"), F.lit(False))
    target = F.when(before("_first"), F.col("_type"))
    kind, closed = F.col("type"), F.coalesce(F.col("_top") != "reopened", F.lit(False))
    is_open = F.coalesce(target == "follow-up-scheduled", F.lit(False)) & ~before("_void") & F.col("_top").isNull()
    outcome = first_code(
        (before("_own"), "event-id-exists"),
        ((kind == "activity-voided") & (target.isNull() | (target == "activity-voided")), "nothing-to-void"),
        ((kind == "activity-voided") & before("_void"), "already-voided"),
        ((kind == "follow-up-scheduled") & closed, "lead-is-closed"),
        ((kind == "follow-up-completed") & ~is_open, "no-open-follow-up"),
        ((kind == "reopened") & ~closed, "lead-is-not-closed"))
    return joined.select(*checked.columns, F.coalesce(outcome, F.lit("accepted")).alias("outcome"))


def record_events(leads: DataFrame, qualified: DataFrame, events: DataFrame, proposals: DataFrame, recorded_at: Column) -> DataFrame:
    """Judge proposed events; returns them with `outcome` (accepted or a refusal code).

    Each proposal is judged against the whole history including earlier accepted ones. A proposal depends only on earlier ones of its
    lead that name the same event, or on the lead's closing marks, so all are judged at once on the assumption that
    those without a refusal enter, and again with the outcome until it stays: a round settles at least one more level of
    dependencies of every lead. No step gathers a lead.
    """
    checked = check_proposals(leads, qualified, proposals, recorded_at)
    checked = cut_lineage(checked.withColumn("_row", F.monotonically_increasing_id()), "proposals")
    low, high = checked.agg(F.min("seq"), F.max("seq")).first()
    if low is None:
        return checked.drop("refusal", "_row").withColumn("outcome", F.lit(None).cast("string"))
    span, needed = high - low + 2, ["lead_id", "event_id", "seq", "type", "occurred_at", "related_event_id", "place"]
    # Rounds carry what a judgement needs, of the proposals that may enter; all else waits in the written table for the outcome of its row.
    narrow = checked.where(F.col("refusal").isNull()).select("_row", *needed[:-1], (F.col("seq") - low + 1).alias("place"))  # the history stands at 0
    past = cut_lineage(events.withColumn("place", F.lit(0).cast("bigint")).select(*needed), "history")
    judged, settled = narrow.withColumn("outcome", F.lit("accepted")), [checked.where(F.col("refusal").isNotNull()).withColumn("outcome", F.col("refusal"))]
    while True:
        entered = past.unionByName(judged.where("outcome = 'accepted'").select(*needed))
        new = cut_lineage(_verdicts(judged.withColumnRenamed("outcome", "_assumed"), entered, span), "judged")
        changed = (F.col("outcome") == "accepted") != (F.col("_assumed") == "accepted")
        wrong = cut_lineage(new.where(changed).select("lead_id").distinct(), "wrong")
        new = new.drop("_assumed")
        if wrong.isEmpty():
            outcomes = functools.reduce(DataFrame.unionByName, [s.select("_row", "outcome") for s in [*settled, new]])
            return checked.drop("refusal").join(outcomes, "_row").drop("_row")
        # The proposals of a lead without a change stand.
        settled.append(new.join(wrong, "lead_id", "left_anti").select(*new.columns))
        judged = cut_lineage(new.join(wrong, "lead_id", "left_semi").select(*new.columns), "judged")
        past = cut_lineage(past.join(wrong, "lead_id", "left_semi").select(*needed), "history")
