"""Normalisation of leads and their child tables (one projection each)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom import model
from leadloom.functions import text as t


def lead_seed(source: Column, reference: Column, name: Column, email: Column, message: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(t.trimmed(c), F.lit("")) for c in (source, reference, name, email, message)])


def lead_id(source: Column, reference: Column, name: Column, email: Column, message: Column,
            interchange: bool = False) -> Column:
    """Content id of a lead; equal inquiries share it.

    The default is 128 bits of SHA-256: 48 bits, the older form kept under `interchange`, collide within
    some ten million leads.
    """
    if interchange:
        seed = lead_seed(source, reference, name, email, message)
        return F.concat(F.lit("lead_"), F.substring(t.text_digest(seed), 1, 12))
    return t.content_id("lead", source, reference, name, email, message)


def normalize_leads(df: DataFrame, interchange_ids: bool = False) -> DataFrame:
    """Trim, default and type every lead field; derive the id where it is blank.

    Input columns: those of model.LEAD_DDL, where flags and times may still be text.
    """
    def group(name: str, names: tuple[str, ...], lowered: tuple[str, ...] = ()) -> Column:
        def value(n: str) -> Column:
            out = t.text(F.col(f"{name}.{n}"))
            return F.lower(out) if n in lowered else out
        return F.struct(*[value(n).alias(n) for n in names]).alias(name)

    out = df.select(
        t.text("lead_id").alias("lead_id"),
        F.coalesce(t.text("source"), F.lit("manual")).alias("source"),
        t.text("source_reference").alias("source_reference"),
        t.moment_of(df, "received_at").alias("received_at"),
        group("organization", model.ORGANIZATION_FIELDS, ("domain",)),
        group("contact", model.CONTACT_FIELDS, ("email",)),
        group("inquiry", model.INQUIRY_FIELDS),
        F.struct(*[t.flag(F.col(f"signals.{n}")).alias(n) for n in model.SIGNAL_FIELDS]).alias("signals"),
        F.struct(
            t.flag("compliance.do_not_contact").alias("do_not_contact"),
            t.flag("compliance.restricted_market").alias("restricted_market"),
            t.text("compliance.duplicate_of").alias("duplicate_of"),
            F.coalesce(t.text("compliance.consent_status"), F.lit("unknown")).alias("consent_status"),
        ).alias("compliance"),
        t.text("notes").alias("notes"),
        F.col("ordinal").cast("bigint").alias("ordinal"),
    )
    derived = lead_id(F.col("source"), F.col("source_reference"), F.col("organization.name"),
                      F.col("contact.email"), F.col("inquiry.message"), interchange_ids)
    return out.withColumn("lead_id", F.coalesce("lead_id", derived))


def evidence_id(kind: Column, value: Column, source_ref: Column, observed_at: Column) -> Column:
    return t.content_id("ev", kind, value, source_ref, observed_at)


def normalize_evidence(df: DataFrame) -> DataFrame:
    """Type evidence rows: status falls back to candidate, confidence to 1 (verified) or 0.5."""
    status = F.coalesce(t.one_of(F.col("status"), model.EVIDENCE_STATUSES), F.lit("candidate"))
    default = F.when(status == "verified", F.lit(1.0)).otherwise(F.lit(0.5))
    observed = t.moment_of(df, "observed_at")
    return df.select(
        "lead_id",
        F.coalesce(t.text("evidence_id"), evidence_id(
            F.col("kind"), F.col("value"), F.col("source_ref"), F.col("observed_at").cast("string"))).alias("evidence_id"),
        F.col("seq").cast("bigint").alias("seq"),
        F.coalesce(t.text("kind"), F.lit("unknown")).alias("kind"),
        F.col("value").cast("string").alias("value"),
        t.text("source_ref").alias("source_ref"),
        observed.alias("observed_at"),
        t.clamped("confidence", 0, 1, default).alias("confidence"),
        status.alias("status"),
        t.text("note").alias("note"),
    )


def normalize_events(df: DataFrame) -> DataFrame:
    """Drop unusable development events and blank out bad channels, amounts and currencies."""
    occurred, due = t.moment_of(df, "occurred_at"), t.moment_of(df, "due_at")
    related = t.text("related_event_id")
    amount = F.col("amount").try_cast("decimal(18,2)")
    typed = df.select(
        "lead_id", t.text("event_id").alias("event_id"), F.col("seq").cast("bigint").alias("seq"),
        F.col("type"), occurred.alias("occurred_at"),
        t.one_of(F.col("channel"), model.CHANNELS).alias("channel"), t.text("note").alias("note"),
        due.alias("due_at"), related.alias("related_event_id"),
        F.when(amount >= 0, amount).alias("amount"), t.currency("currency").alias("currency"),
        t.text("outcome_reason").alias("outcome_reason"),
    )
    kept = typed.where(
        F.col("type").isin(*model.EVENT_TYPES) & F.col("occurred_at").isNotNull()
        & ~((F.col("type") == "follow-up-scheduled") & F.col("due_at").isNull())
        & ~(F.col("type").isin("follow-up-completed", "activity-voided") & F.col("related_event_id").isNull())
    )
    derived = t.content_id("dev", *[F.col(c).cast("string") for c in (
        "type", "occurred_at", "channel", "due_at", "related_event_id", "note", "amount", "currency")])
    return kept.withColumn("event_id", F.coalesce("event_id", derived))


def normalize_decisions(df: DataFrame, keep: int | None = None) -> DataFrame:
    """Drop duplicate decisions without a valid verdict, other lead or (for `same`) primary; the first `keep` reasons, if given."""
    other, primary = t.text("other_lead_id"), t.text("primary_lead_id")
    reasons = F.array_compact(F.coalesce(F.transform(F.col("reasons"), lambda x: t.text(x)), F.array().cast("array<string>")))
    return df.select(
        t.text("pair_id").alias("pair_id"), "lead_id", other.alias("other_lead_id"), "decision",
        F.when(F.col("decision") == "same", primary).alias("primary_lead_id"),
        t.moment_of(df, "reviewed_at").alias("reviewed_at"), t.text("note").alias("note"),
        t.clamped("confidence", 0, 1, 0.0).alias("confidence"),
        (F.slice(reasons, 1, keep) if keep else reasons).alias("reasons"),
        F.col("seq").cast("bigint").alias("seq"),
    ).where(
        F.col("decision").isin(*model.DUPLICATE_DECISIONS) & F.col("other_lead_id").isNotNull()
        & ~((F.col("decision") == "same") & F.col("primary_lead_id").isNull())
    )


def normalize_origins(df: DataFrame) -> DataFrame:
    """Field origins on known paths with an evidence id."""
    return df.select(
        "lead_id", t.text("path").alias("path"), t.text("evidence_id").alias("evidence_id"),
        t.trimmed("applied_value").alias("applied_value"),
        t.moment_of(df, "applied_at").alias("applied_at"), t.moment_of(df, "updated_at").alias("updated_at"),
        F.coalesce(F.col("active"), F.lit(True)).alias("active"), t.moment_of(df, "ended_at").alias("ended_at"),
        t.text("end_reason").alias("end_reason"), F.col("seq").cast("bigint").alias("seq"),
    ).where(F.col("path").isin(*model.FIELD_PATHS) & F.col("evidence_id").isNotNull())


def normalize_reviews(df: DataFrame, keep: int | None = None) -> DataFrame:
    """Review history: valid actions, only real changes, the newest `keep` per evidence row, if given."""
    changed = F.map_filter("changes", lambda k, v: k.isin("value", "source_ref") & ~v["from"].eqNullSafe(v["to"]))
    typed = df.select(
        "lead_id", "evidence_id", F.col("seq").cast("bigint").alias("seq"), "action",
        F.col("decision"), t.moment_of(df, "reviewed_at").alias("reviewed_at"), t.text("note").alias("note"),
        F.when(F.size(changed) > 0, changed).alias("changes"),
    ).where(F.col("action").isin(*model.REVIEW_ACTIONS))
    return newest(typed, ["lead_id", "evidence_id"], keep) if keep else typed


def normalize_baselines(df: DataFrame) -> DataFrame:
    grade, score, captured = F.upper(t.trimmed("grade")), t.number("score"), t.moment_of(df, "captured_at")
    return df.select(
        "lead_id", grade.alias("grade"),
        F.when(score.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), t.half_up(score)))).cast("int").alias("score"),
        captured.alias("captured_at"),
    ).where(F.col("grade").isin(*model.GRADES) & F.col("score").isNotNull() & F.col("captured_at").isNotNull())


def newest(df: DataFrame, keys: list[str], keep: int) -> DataFrame:
    """The last `keep` rows per key by entry order.

    The rank limit is applied before the shuffle too, so a hot key ships at most `keep` rows per input task.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc("seq"))
    return df.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= keep).drop("_rank")


def distinct_leads(df: DataFrame) -> DataFrame:
    """One row per lead id (the last one read wins) and how often it occurred."""
    body = F.struct(*[F.col(c) for c in df.columns if c != "lead_id"])
    merged = df.groupBy("lead_id").agg(
        F.max_by(body, F.col("ordinal")).alias("lead"), F.count(F.lit(1)).alias("occurrences"))
    return merged.select("lead_id", "lead.*", "occurrences")


def display_name(name: Column, contact: Column, reference: Column, lead: Column) -> Column:
    return F.coalesce(name, contact, reference, lead)
