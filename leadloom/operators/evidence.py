"""Evidence: merge into leads, select, and review with field-level rollback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom import model
from leadloom.functions import text as t
from leadloom.session import first_code, cut_lineage, lookup


# Field filled by each kind of a reviewer's selection (the first row of the kind counts).
SELECTED_FIELDS = {
    "organization.name": ("organization-name",),
    "organization.website": ("company-website",),
    "organization.address": ("business-address",),
    "organization.factory_info": ("factory", "manufacturing-capability"),
    "contact.email": ("business-email", "work-email"),
    "contact.phone": ("business-phone",),
    "contact.whatsapp": ("whatsapp",),
}


def field_values(leads: DataFrame) -> DataFrame:
    """(lead_id, path, current) for the fields evidence may fill."""
    entries = F.array(*[F.struct(F.lit(p).alias("path"), F.col(p).alias("current")) for p in model.FIELD_PATHS])
    return leads.select("lead_id", F.inline(entries))


def put_fields(leads: DataFrame, changes: DataFrame) -> DataFrame:
    """Set the fields listed in `changes` (lead_id, path, new_value); others stay as they are."""
    # At most one entry per path and lead, so the map is bounded by the fourteen paths.
    patch = changes.groupBy("lead_id").agg(
        F.map_from_entries(F.collect_list(F.struct("path", "new_value"))).alias("_patch"))
    joined = leads.join(patch, "lead_id", "left")

    def group(name: str, fields: tuple[str, ...]) -> Column:
        def value(field: str) -> Column:
            path = f"{name}.{field}"
            given = F.coalesce(F.map_contains_key("_patch", path), F.lit(False))
            return F.when(given, F.element_at("_patch", F.lit(path))).otherwise(F.col(path))
        return F.struct(*[value(f).alias(f) for f in fields])

    return joined.withColumn("organization", group("organization", model.ORGANIZATION_FIELDS)).withColumn(
        "contact", group("contact", model.CONTACT_FIELDS)).select(*leads.columns)


def merge_evidence(current: DataFrame, added: DataFrame) -> DataFrame:
    """Union by evidence id: the last row wins but keeps the place of the first.

    An aggregate with map-side combine rather than a window, so a lead with very much evidence is no problem.
    """
    columns = [c for c in model_columns() if c not in ("lead_id", "evidence_id", "seq")]
    both = current.select(*model_columns(), F.lit(0).alias("_batch")).unionByName(
        added.select(*model_columns(), F.lit(1).alias("_batch")))
    entered = F.struct("_batch", "seq")
    merged = both.groupBy("lead_id", "evidence_id").agg(
        F.min(entered).alias("_first"), F.max_by(F.struct(*columns), entered).alias("_row"))
    return merged.select("lead_id", "evidence_id", F.col("_first.seq").alias("seq"), "_row.*")


def model_columns() -> list[str]:
    return ["lead_id", "evidence_id", "seq", "kind", "value", "source_ref", "observed_at", "confidence",
            "status", "note"]


def kind_table(spark, mapping: dict[str, tuple[str, ...]] = model.FIELD_KINDS) -> DataFrame:
    return spark.createDataFrame([(p, k) for p, kinds in mapping.items() for k in kinds], "path string, kind string")


def attribute_evidence(patch: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence id for each patched value (lead_id, path, value[, requested_id]).

    The requested row if the lead has it, else the first row of an accepted kind with the same value (for the
    website also the same source). Rows are reduced to one per (lead, path, value) before the join.
    """
    spark = patch.sparkSession
    kinds = F.broadcast(kind_table(spark))  # fixed table of twenty rows
    typed = evidence.join(kinds, "kind")
    by_value = typed.select("lead_id", "path", t.comparable("value").alias("_match"), "evidence_id", "seq")
    by_source = typed.where(F.col("path") == "organization.website").select(
        "lead_id", "path", t.comparable("source_ref").alias("_match"), "evidence_id", "seq")
    first = by_value.unionByName(by_source).groupBy("lead_id", "path", "_match").agg(
        F.min_by("evidence_id", "seq").alias("_found"))
    wanted = patch if "requested_id" in patch.columns else patch.withColumn("requested_id", F.lit(None).cast("string"))
    wanted = wanted.withColumn("_match", t.comparable("value"))
    known = evidence.select("lead_id", F.col("evidence_id").alias("requested_id")).distinct().withColumn(
        "_known", F.lit(True))
    joined = wanted.join(first, ["lead_id", "path", "_match"], "left").join(
        known, ["lead_id", "requested_id"], "left")
    chosen = F.when(F.col("_known"), F.col("requested_id")).otherwise(F.col("_found"))
    return joined.select("lead_id", "path", "value", chosen.alias("evidence_id"))


def fill_empty(leads: DataFrame, evidence: DataFrame, origins: DataFrame, patch: DataFrame,
               applied_at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fill blank lead fields from `patch` (lead_id, path, value[, requested_id]).

    Returns the leads, the origins including the new ones, and the filled fields. A value already present is
    never replaced; an origin is added when the value can be traced to evidence and none is active for it.
    """
    usable = patch.where(t.text("value").isNotNull() & F.col("path").isin(*model.FIELD_PATHS))
    empty = field_values(leads).where(F.coalesce("current", F.lit("")) == "").select("lead_id", "path")
    attributed = attribute_evidence(usable.join(empty, ["lead_id", "path"], "left_semi"), evidence)
    filled = attributed.withColumn("value", t.text("value"))
    active = origins.where("active").select("lead_id", "path", "evidence_id")
    last = origins.groupBy("lead_id").agg(F.max("seq").alias("_last"))
    new = filled.where(F.col("evidence_id").isNotNull()).join(
        active, ["lead_id", "path", "evidence_id"], "left_anti").join(last, "lead_id", "left")
    position = F.array_position(F.array(*[F.lit(p) for p in model.FIELD_PATHS]), F.col("path"))
    none, no_text = F.lit(None).cast("timestamp"), F.lit(None).cast("string")
    added = new.select(
        "lead_id", "path", "evidence_id", F.col("value").alias("applied_value"), applied_at.alias("applied_at"),
        none.alias("updated_at"), F.lit(True).alias("active"), none.alias("ended_at"), no_text.alias("end_reason"),
        (F.coalesce("_last", F.lit(0)) + position).alias("seq"))
    updated = put_fields(leads, filled.select("lead_id", "path", F.col("value").alias("new_value")))
    kept = origins.select(*added.columns).unionByName(added)
    return updated, kept, filled


def attach_evidence(leads: DataFrame, evidence: DataFrame, origins: DataFrame, added: DataFrame, patch: DataFrame,
                    applied_at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merge research into leads: evidence by id, then blank fields; returns (leads, evidence, origins)."""
    merged = merge_evidence(evidence, added)
    updated, kept, _ = fill_empty(leads, merged, origins, patch, applied_at)
    return updated, merged, kept


def select_evidence(evidence: DataFrame, selected: DataFrame, reviewed_at: Column,
                    note: str = "selected by the reviewer") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keep the selected rows (lead_id, evidence_id) and derive the fields they fill.

    Returns (kept evidence, review entries, patch). The status of the rows does not change.
    """
    kept = evidence.join(selected.select("lead_id", "evidence_id").distinct(), ["lead_id", "evidence_id"], "left_semi")
    reviews = kept.select(
        "lead_id", "evidence_id", "seq", F.lit("accepted").alias("action"), F.lit("accepted").alias("decision"),
        reviewed_at.alias("reviewed_at"), F.lit(note).alias("note"),
        F.lit(None).cast("map<string,struct<from:string,to:string>>").alias("changes"))
    kinds = F.broadcast(kind_table(evidence.sparkSession, SELECTED_FIELDS))
    website = F.col("path") == "organization.website"
    value = F.when(website, F.coalesce(F.nullif("value", F.lit("")), "source_ref")).otherwise(F.nullif("value", F.lit("")))
    typed = kept.join(kinds, "kind").withColumn("_value", value).where(F.col("_value").isNotNull())
    patch = typed.groupBy("lead_id", "path").agg(
        F.min_by("_value", "seq").alias("value"), F.min_by("evidence_id", "seq").alias("requested_id"))
    return kept, reviews, patch


# ---- review with rollback ----

# A slice holds at most 2 ** SLICE_BITS actions of one field.
SLICE_BITS = 9


def check_reviews(evidence: DataFrame, reviews: DataFrame, actions: DataFrame) -> DataFrame:
    """Validate review actions and add what changes.

    Actions: lead_id, evidence_id, seq, action (accepted, rejected or revised), note, reviewed_at, value,
    source_ref (the last two for revisions). Revisions are compared with the evidence as it is after the
    earlier actions of this batch.
    """
    base = evidence.select("lead_id", "evidence_id", F.col("value").alias("_value"), F.col("source_ref").alias("_source"))
    before = reviews.groupBy("lead_id", "evidence_id").agg(F.max_by("decision", "seq").alias("_decided"))
    joined = actions.join(base, ["lead_id", "evidence_id"], "left").join(before, ["lead_id", "evidence_id"], "left")
    short = F.coalesce(F.length(t.text("note")), F.lit(0)) < 3
    revised = F.col("action") == "revised"
    # A given but blank text is not the same as no text: it is refused.
    static = first_code(
        (F.col("_value").isNull() & F.col("_source").isNull(), "unknown-evidence"),
        (~F.coalesce(F.col("action").isin(*model.REVIEW_ACTIONS), F.lit(False)), "unknown-action"),
        (short, "note-too-short"),
        (revised & (t.trimmed("value") == ""), "value-missing"),
        (revised & (t.trimmed("source_ref") == ""), "source-missing"),
        (revised & F.col("value").isNull() & F.col("source_ref").isNull(), "nothing-changed"),
    )
    checked = joined.withColumn("_static", static)
    order = Window.partitionBy("lead_id", "evidence_id").orderBy("seq")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    valid = F.col("_static").isNull()

    def last_before(value: Column, fallback: str) -> Column:
        return F.coalesce(F.last(F.when(valid, value), True).over(earlier), F.col(fallback))

    def rejects() -> Column:
        decided = F.last(F.when(valid & F.col("action").isin("accepted", "rejected"), F.col("action")), True).over(earlier)
        return F.coalesce(decided, F.col("_decided"), F.lit("")) == "rejected"

    # A revision of rejected evidence has no effect, so it must not feed later comparisons.
    staged = checked.withColumn("_refused_state", rejects())
    effective = valid & revised & ~F.col("_refused_state")
    staged = staged.withColumn("_new_value", F.when(effective, t.text("value"))).withColumn(
        "_new_source", F.when(effective, t.text("source_ref")))
    staged = staged.withColumn("from_value", last_before(F.col("_new_value"), "_value")).withColumn(
        "from_source", last_before(F.col("_new_source"), "_source"))
    changes_value = F.coalesce(t.comparable("_new_value") != t.comparable("from_value"), F.lit(False)) & F.col(
        "_new_value").isNotNull()
    changes_source = F.col("_new_source").isNotNull() & ~F.col("_new_source").eqNullSafe(F.col("from_source"))
    outcome = (
        F.when(F.col("_static").isNotNull(), F.col("_static"))
        .when(revised & F.col("_refused_state"), "evidence-is-rejected")
        .when(revised & ~changes_value & ~changes_source, "nothing-changed")
        .otherwise("accepted")
    )
    pair = F.map_filter(
        F.create_map(
            F.lit("value"), F.struct(F.col("from_value").alias("from"), F.col("_new_value").alias("to")),
            F.lit("source_ref"), F.struct(F.col("from_source").alias("from"), F.col("_new_source").alias("to"))),
        lambda k, v: F.when(k == "value", changes_value).otherwise(changes_source))
    return staged.select(
        "lead_id", "evidence_id", "seq", "action", t.text("note").alias("note"), "reviewed_at",
        outcome.alias("outcome"), F.when(revised & (F.size(pair) > 0), pair).alias("changes"),
        F.when(changes_value, F.col("_new_value")).alias("to_value"), "from_value",
        F.when(changes_source, F.col("_new_source")).alias("to_source"))


def _step(state: Column, action: Column, origin: Column) -> Column:
    """The field's state after an action met one of its origins."""
    unchanged = t.comparable(state["current"]) == t.comparable(origin["applied_value"])
    kept_or = lambda good, name: F.when(good, name).otherwise("preserved")
    empty = t.comparable(state["current"]) == ""
    revises = origin["active"] & (t.comparable(action["to_value"]) != "") & (t.comparable(origin["applied_value"]) == t.comparable(action["from_value"]))
    result = F.when(origin["evidence_id"] == action["evidence_id"], F.when(
        (action["action"] == "rejected") & origin["active"], kept_or(unchanged, "cleared")).when(
        (action["action"] == "accepted") & ~origin["active"], kept_or(empty | unchanged, "restored")).when(
        (action["action"] == "revised") & revises, kept_or(unchanged, "updated")))

    def after(r: Column) -> Column:
        updated, ends = r == "updated", (r == "cleared") | ((r == "preserved") & (action["action"] != "accepted"))
        is_ = lambda c: F.coalesce(c, F.lit(False))
        next_origin = F.struct(
            origin["evidence_id"].alias("evidence_id"), origin["origin_seq"].alias("origin_seq"),
            F.when(is_(updated), action["to_value"]).otherwise(origin["applied_value"]).alias("applied_value"),
            F.when(is_(updated), action["reviewed_at"]).otherwise(origin["updated_at"]).alias("updated_at"),
            F.when(is_(ends), F.lit(False)).when(is_(r == "restored"), F.lit(True)).otherwise(origin["active"]).alias("active"),
            F.when(is_(ends), action["reviewed_at"]).when(is_(r == "restored"), F.lit(None)).otherwise(origin["ended_at"]).alias("ended_at"),
            F.when(is_(r == "cleared"), F.lit("evidence-rejected")).when(is_(ends), F.lit("field-changed")).when(
                is_(r == "restored"), F.lit(None)).otherwise(origin["end_reason"]).alias("end_reason"))
        sets = is_(r == "cleared") | is_(updated) | (is_(r == "restored") & empty)
        value = F.when(is_(r == "cleared"), F.lit(None)).when(is_(updated), action["to_value"]).when(
            is_(r == "restored") & empty, origin["applied_value"]).otherwise(state["current"])
        done = F.struct(action["seq"].alias("seq"), r.alias("result"))
        return F.struct(value.alias("current"), (state["touched"] | sets).alias("touched"), F.concat(state["origins"], F.array(next_origin)).alias("origins"),
                        F.when(r.isNotNull(), F.concat(state["results"], F.array(done))).otherwise(state["results"]).alias("results"))
    return t.let(result, after)


_ORIGINS = "array<struct<evidence_id:string,origin_seq:bigint,applied_value:string,updated_at:timestamp,active:boolean,ended_at:timestamp,end_reason:string>>"
_RESULTS = "array<struct<seq:bigint,result:string>>"


def _folded(slices: DataFrame) -> DataFrame:
    """`slices` (with `actions` and the state they start from, `before`) with the state after them, `after`, what they did, `results`, and `touched`."""
    start = F.struct(F.col("before.current").alias("current"), F.lit(False).alias("touched"), F.col("before.origins").alias("origins"),
                     F.array().cast(_RESULTS).alias("results"))

    def act(state: Column, action: Column) -> Column:
        none = F.struct(state["current"].alias("current"), state["touched"].alias("touched"), F.array().cast(_ORIGINS).alias("origins"), state["results"].alias("results"))
        return F.aggregate(state["origins"], none, lambda s, o: _step(s, action, o))

    done = slices.withColumn("_done", F.aggregate("actions", start, act))
    return done.select("lead_id", "path", "slice", "actions", "before", F.struct("_done.current", "_done.origins").alias("after"), "_done.touched", "_done.results")


def _field_slices(touching: DataFrame) -> DataFrame:
    """lead_id, path, slice and actions: the actions of each field in order, cut wherever a slice of the sorted table ends.

    The table is sorted in ranges, so neither a sort nor a slice meets all actions of a busy field.
    """
    ordered = touching.repartitionByRange("lead_id", "path", "seq").sortWithinPartitions("lead_id", "path", "seq", "evidence_id")
    numbered = cut_lineage(ordered.withColumn("slice", F.shiftright(F.monotonically_increasing_id(), SLICE_BITS)), "field-actions")
    action = F.struct("seq", "evidence_id", "action", "reviewed_at", "from_value", "to_value")
    return numbered.groupBy("lead_id", "path", "slice").agg(F.sort_array(F.collect_list(action)).alias("actions"))


def fold_fields(slices: DataFrame, start: DataFrame) -> DataFrame:
    """Slices with the state before and after them, their `results`, and whether they `touched` the field's value.

    All slices are folded at once, from the field's first state. Where a slice started from another state than the one
    before it ended in, it is folded again from that; slices soon end in a state that does not depend on where they began.
    Each pass settles one more slice of every field at least.
    """
    done = cut_lineage(_folded(slices.join(start, ["lead_id", "path"])), "folded")
    order = Window.partitionBy("lead_id", "path").orderBy("slice")  # one row for 2 ** SLICE_BITS actions
    while True:
        seen = done.select("lead_id", "path", "slice", F.lag("after").over(order).alias("ended"), F.row_number().over(order).alias("nth"), "before")
        wrong = cut_lineage(seen.where((F.col("nth") > 1) & ~F.col("before").eqNullSafe(F.col("ended"))).select(
            "lead_id", "path", "slice", F.col("ended").alias("before")), "wrong")
        if wrong.isEmpty():
            return done
        again = _folded(done.select("lead_id", "path", "slice", "actions").join(wrong, ["lead_id", "path", "slice"]))
        done = cut_lineage(done.join(wrong, ["lead_id", "path", "slice"], "left_anti").select(*again.columns).unionByName(again), "folded")


def review_evidence(leads: DataFrame, evidence: DataFrame, reviews: DataFrame, origins: DataFrame, actions: DataFrame) -> dict[str, DataFrame]:
    """Apply accept / reject / revise actions with field-level rollback.

    Returns the new `leads`, `evidence`, `reviews` and `origins`, every action with its `outcome`, and the
    `effects` (lead_id, path, seq, result in cleared / restored / updated / preserved).

    A field's state is its value and its origins (one for each evidence that filled it). Its actions are folded in slices of bounded
    length, all slices at once (`fold_fields`).
    """
    checked = cut_lineage(check_reviews(evidence, reviews, actions), "actions")
    accepted = checked.where(F.col("outcome") == "accepted")
    current = origins.withColumnRenamed("seq", "origin_seq")
    wanted = accepted.select("lead_id", "evidence_id", "seq", "action", "reviewed_at", "from_value", "to_value")
    touching = wanted.join(current.select("lead_id", "evidence_id", "path").distinct(), ["lead_id", "evidence_id"])
    slices = _field_slices(touching)
    # Only origins that some action names can change.
    named = current.join(wanted.select("lead_id", "evidence_id").distinct(), ["lead_id", "evidence_id"], "left_semi")
    state = named.groupBy("lead_id", "path").agg(F.sort_array(F.collect_list(F.struct(
        "origin_seq", "evidence_id", "applied_value", "updated_at", "active", "ended_at", "end_reason"))).alias("origins"))
    shaped = F.transform("origins", lambda o: F.struct(*[o[c].alias(c) for c in (
        "evidence_id", "origin_seq", "applied_value", "updated_at", "active", "ended_at", "end_reason")]))
    start = state.join(field_values(leads), ["lead_id", "path"]).select("lead_id", "path", F.struct("current", shaped.alias("origins")).alias("before"))
    folded = fold_fields(slices, start)

    last = folded.groupBy("lead_id", "path").agg(F.max_by("after", "slice").alias("after"), F.bool_or("touched").alias("touched"))
    changes = last.where("touched").select("lead_id", "path", F.col("after.current").alias("new_value"))
    leads = put_fields(leads, changes)
    updates = last.select("lead_id", "path", F.explode("after.origins").alias("_new"))
    updates = updates.select("lead_id", "path", "_new.evidence_id", "_new.origin_seq", "_new")

    def pick(name: str) -> Column:
        return F.when(F.col("_new").isNotNull(), F.col(f"_new.{name}")).otherwise(F.col(name)).alias(name)

    current = current.join(updates, ["lead_id", "path", "evidence_id", "origin_seq"], "left").select(
        "lead_id", "path", "evidence_id", pick("applied_value"), "applied_at", pick("updated_at"), pick("active"), pick("ended_at"),
        pick("end_reason"), "origin_seq")
    effects = folded.select("lead_id", "path", F.inline("results"))

    decided = accepted.join(
        reviews.groupBy("lead_id", "evidence_id").agg(F.max_by("decision", "seq").alias("_before")),
        ["lead_id", "evidence_id"], "left")
    # A revision keeps the standing decision; it only happens while that is not a rejection.
    entries = decided.select(
        "lead_id", "evidence_id", "seq", "action",
        F.when(F.col("action") == "revised", F.lit("accepted")).otherwise(F.col("action")).alias("decision"),
        "reviewed_at", "note", "changes")
    revised = accepted.groupBy("lead_id", "evidence_id").agg(
        F.max_by("to_value", F.when(F.col("to_value").isNotNull(), F.col("seq"))).alias("_value"),
        F.max_by("to_source", F.when(F.col("to_source").isNotNull(), F.col("seq"))).alias("_source"))
    new_evidence = evidence.join(revised, ["lead_id", "evidence_id"], "left").withColumn(
        "value", F.coalesce("_value", "value")).withColumn("source_ref", F.coalesce("_source", "source_ref")).select(
        *evidence.columns)
    return {
        "leads": leads, "evidence": new_evidence,
        "reviews": reviews.select(*entries.columns).unionByName(entries),
        "origins": current.withColumnRenamed("origin_seq", "seq"), "actions": checked, "effects": effects,
    }
