"""Introduction paths: consent filter, score and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom import model
from leadloom.functions import text as t
from leadloom.session import compact_codes

# ---- fixed values: points of an introduction path ----
STRENGTH_POINTS = 8
RECENCY_POINTS = ((30, 20), (90, 15), (365, 10), (730, 5))
FACT_POINTS = (
    ("known_personally", 15, "known-personally"), ("shared_company", 10, "shared-company"),
    ("shared_industry", 5, "shared-industry"), ("shared_education", 5, "shared-education"),
)
APPROVED_POINTS = 5
CAP_WITHOUT_EVIDENCE = 49
# ---- end of fixed values ----


def normalize_paths(df: DataFrame, keep: int | None = None) -> DataFrame:
    """Type relationship rows; the evidence ids (the first `keep`, if given) may be text with | or ; between them."""
    consent = F.lower(t.text("consent_status"))
    ids = F.col("evidence_ids")
    if dict(df.dtypes)["evidence_ids"] == "string":
        ids = t.split_list("evidence_ids")
    ids = F.array_compact(F.coalesce(ids, F.array().cast("array<string>")))
    return df.select(
        t.text("connector_id").alias("connector_id"), t.text("connector_name").alias("connector_name"),
        t.text("target_id").alias("target_id"), t.text("target_name").alias("target_name"),
        t.clamped("relationship_strength", 0, 5, 0.0).alias("relationship_strength"),
        t.moment_of(df, "last_contact_at").alias("last_contact_at"),
        *[t.flag(name).alias(name) for name, _, _ in FACT_POINTS],
        F.coalesce(t.one_of(consent, model.CONSENT_STATUSES), F.lit("unknown")).alias("consent_status"),
        (F.slice(ids, 1, keep) if keep else ids).alias("evidence_ids"),
    )


def recency_points(days: Column) -> Column:
    out = F.lit(0)
    for limit, points in reversed(RECENCY_POINTS):
        out = F.when(days <= limit, points).otherwise(out)
    return out


def score_paths(paths: DataFrame, as_of: Column) -> DataFrame:
    """Score every path whose connector has not declined; no shuffle."""
    recency = recency_points(t.days_between(as_of, F.col("last_contact_at")))
    approved = F.col("consent_status") == "approved"
    score = F.col("relationship_strength") * STRENGTH_POINTS + recency
    for name, points, _ in FACT_POINTS:
        score = score + F.when(F.col(name), points).otherwise(0)
    score = score + F.when(approved, APPROVED_POINTS).otherwise(0)
    unproven = F.size("evidence_ids") == 0
    capped = F.least(F.when(unproven, F.least(score, F.lit(float(CAP_WITHOUT_EVIDENCE)))).otherwise(score), F.lit(100.0))
    reasons = compact_codes(
        (F.lit(True), "strength"), (recency > 0, "recent-contact"),
        *[(F.col(name), reason) for name, _, reason in FACT_POINTS], (approved, "approved"),
        (unproven, "no-evidence-cap"))
    return paths.where(F.col("consent_status") != "declined").select(
        "connector_id", "connector_name", "target_id", "target_name", capped.alias("score"), "consent_status",
        "evidence_ids", reasons.alias("reasons"),
        F.when(approved, "connector-introduces").otherwise("ask-for-consent").alias("next_action"))


def rank_paths(paths: DataFrame, as_of: Column, per_target: int | None = None) -> DataFrame:
    """Scored paths, best first; with `per_target`, only the best ones of each target."""
    scored = score_paths(paths, as_of)
    order = [F.desc("score"), F.col("target_id"), F.col("connector_id")]
    if per_target:
        best = Window.partitionBy("target_id").orderBy(F.desc("score"), "connector_id")
        scored = scored.withColumn("position", F.row_number().over(best)).where(F.col("position") <= per_target)
    return scored.orderBy(*order)


def path_stats(paths: DataFrame) -> DataFrame:
    return paths.agg(F.count(F.lit(1)).alias("paths"),
                     F.count_if(F.col("consent_status") == "declined").alias("declined"))
