"""Four-dimension lead score, grade, missing evidence and next action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import model
from leadloom.session import codes_where

DIMENSIONS = ("evidence_quality", "demand_clarity", "buying_readiness", "contactability_trust")

# ---- fixed values: evidence kinds, points and grade limits of the score ----
FLAG_KINDS = {
    "site_verified": ("company-website", "organization-domain"),
    "registration_verified": ("business-registration", "business-status"),
    "factory_verified": ("factory", "manufacturing-capability"),
    "email_verified": ("business-email", "work-email"),
    "phone_verified": ("whatsapp", "business-phone"),
}
GRADE_LIMITS = (("A", 75), ("B", 55), ("C", 35))
DIMENSION_CAP = 25
# ---- end of fixed values ----


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """Current verdict per evidence row: the decision of the newest review entry.

    The two verdicts ride on the entry number, so a plain maximum finds the newest without a sort.
    """
    newest = F.max(F.col("seq") * 2 + (F.col("decision") == "rejected").cast("bigint"))
    return reviews.groupBy("lead_id", "evidence_id").agg(newest.alias("_newest")).select(
        "lead_id", "evidence_id", F.when(F.pmod("_newest", F.lit(2)) == 1, "rejected").otherwise("accepted").alias("decision"))


def effective_evidence(evidence: DataFrame, reviews: DataFrame) -> DataFrame:
    """Evidence whose review did not reject it, whatever its status."""
    refused = latest_reviews(reviews).where(F.col("decision") == "rejected")
    return evidence.join(refused, ["lead_id", "evidence_id"], "left_anti")


def evidence_flags(effective: DataFrame) -> DataFrame:
    """Per lead, which kinds of evidence are verified with a source.

    The filter runs before the shuffle and the flags combine on the map side.
    """
    usable = effective.where((F.col("status") == "verified") & (F.coalesce("source_ref", F.lit("")) != ""))
    return usable.groupBy("lead_id").agg(
        *[F.bool_or(F.col("kind").isin(*kinds)).alias(flag) for flag, kinds in FLAG_KINDS.items()])


# The rules are SQL text: each dimension becomes one expression, parsed once.
HOLD_RULES = (
    ("compliance.do_not_contact", "do-not-contact"),
    ("compliance.restricted_market", "restricted-market"),
    ("compliance.duplicate_of IS NOT NULL", "duplicate-of-master"),
    ("coalesce(organization.name, organization.domain, organization.website, source_reference) IS NULL", "no-identity"),
)
# (dimension, condition, points, reason)
POINT_RULES = (
    ("evidence_quality", "source_reference IS NOT NULL", 5, "source-reference"),
    ("evidence_quality", "site_verified", 8, "site-verified"),
    ("evidence_quality", "registration_verified", 7, "registration-verified"),
    ("evidence_quality", "factory_verified", 5, "factory-verified"),
    ("evidence_quality", "NOT factory_verified AND organization.factory_info IS NOT NULL", 2, "factory-claimed"),
    ("demand_clarity", "inquiry.message IS NOT NULL", 4, "message"),
    ("demand_clarity", "inquiry.product IS NOT NULL", 7, "product"),
    ("demand_clarity", "inquiry.quantity IS NOT NULL", 5, "quantity"),
    ("demand_clarity", "inquiry.timeline IS NOT NULL", 5, "timeline"),
    ("demand_clarity", "inquiry.budget IS NOT NULL", 4, "budget"),
    ("buying_readiness", "signals.explicit_inquiry", 6, "explicit-inquiry"),
    ("buying_readiness", "signals.replied", 4, "replied"),
    ("buying_readiness", "signals.requested_quote", 5, "requested-quote"),
    ("buying_readiness", "signals.requested_sample", 6, "requested-sample"),
    ("buying_readiness", "signals.purchase_order", 10, "purchase-order"),
    ("contactability_trust", "email_verified", 8, "email-verified"),
    ("contactability_trust", "NOT email_verified AND contact.email IS NOT NULL", 2, "email-candidate"),
    ("contactability_trust", "phone_verified", 7, "phone-verified"),
    ("contactability_trust", "NOT phone_verified AND coalesce(contact.whatsapp, contact.phone) IS NOT NULL", 2,
     "phone-candidate"),
    ("contactability_trust", "contact.name IS NOT NULL AND contact.role IS NOT NULL", 3, "contact-role"),
    ("contactability_trust", "signals.mutual_introduction", 7, "mutual-introduction"),
    ("contactability_trust", "signals.prior_relationship", 5, "prior-relationship"),
)
MISSING_RULES = (
    ("source_reference IS NULL", "source-reference"),
    ("NOT site_verified", "website-evidence"),
    ("NOT registration_verified", "registration-evidence"),
    ("inquiry.product IS NULL", "product"),
    ("inquiry.quantity IS NULL", "quantity"),
    ("inquiry.timeline IS NULL", "timeline"),
    ("NOT (signals.explicit_inquiry OR signals.replied OR signals.requested_quote OR signals.requested_sample "
     "OR signals.purchase_order)", "purchase-action"),
    ("NOT email_verified AND contact.email IS NOT NULL", "email-verification"),
    ("contact.name IS NULL OR contact.role IS NULL", "contact-role"),
)


def _points(dimension: str) -> Column:
    terms = [f"IF({cond}, {points}, 0)" for name, cond, points, _ in POINT_RULES if name == dimension]
    return F.expr(f"least({DIMENSION_CAP}, {' + '.join(terms)})")


def grade_of(score: Column) -> Column:
    out = F.lit("D")
    for grade, limit in reversed(GRADE_LIMITS):
        out = F.when(score >= limit, grade).otherwise(out)
    return out


def next_action(grade: Column, missing: Column) -> Column:
    first_two = F.array_join(F.slice(missing, 1, 2), ",")
    fill = F.when(first_two != "", first_two).otherwise("timeline,contact-role")
    return (
        F.when(grade == "HOLD", "resolve-hold").when(grade == "A", "review-within-24h")
        .when(grade == "B", F.concat(F.lit("fill-evidence:"), fill)).when(grade == "C", "nurture")
        .otherwise("keep-record")
    )


def qualify(leads: DataFrame, effective: DataFrame) -> DataFrame:
    """Score every lead from its fields and its effective evidence.

    One shuffle for the evidence flags and one join on lead_id; the rest is a projection. Held leads get
    score 0, no dimensions and no missing list.
    """
    flagged = leads.join(evidence_flags(effective), "lead_id", "left").fillna(False, list(FLAG_KINDS))
    held = F.size("_holds") > 0
    scored = flagged.select(
        "lead_id", codes_where(HOLD_RULES).alias("_holds"), *[_points(d).alias(d) for d in DIMENSIONS],
        codes_where([(cond, reason) for _, cond, _, reason in POINT_RULES]).alias("_reasons"),
        codes_where(MISSING_RULES).alias("_missing"),
    )
    total = F.expr(" + ".join(DIMENSIONS))
    none = F.array().cast("array<string>")
    graded = scored.withColumn("score", F.when(held, F.lit(0)).otherwise(total)).withColumn(
        "grade", F.when(held, "HOLD").otherwise(grade_of(F.col("score"))))
    return graded.select(
        "lead_id", "score", "grade",
        *[F.when(~held, F.col(d)).alias(d) for d in DIMENSIONS],
        F.when(held, F.col("_holds")).otherwise(F.col("_reasons")).alias("reasons"),
        F.when(held, none).otherwise(F.col("_missing")).alias("missing"),
        next_action(F.col("grade"), F.col("_missing")).alias("next_action"),
    )


def grade_table(spark) -> DataFrame:
    return spark.createDataFrame([(g, i) for i, g in enumerate(model.GRADES)], "grade string, position int")


def grade_histogram(qualified: DataFrame) -> DataFrame:
    """Lead count per grade, zeros included, plus the total."""
    counts = qualified.groupBy("grade").agg(F.count(F.lit(1)).alias("leads"))
    grades = grade_table(qualified.sparkSession)
    every = grades.join(F.broadcast(counts), "grade", "left").select(
        "grade", F.coalesce("leads", F.lit(0)).alias("leads"))
    total = counts.agg(F.lit("ALL").alias("grade"), F.coalesce(F.sum("leads"), F.lit(0)).alias("leads"))
    return every.unionByName(total)


def work_list(qualified: DataFrame, states: DataFrame, grade: str = "ALL", development: str = "ALL") -> DataFrame:
    """Leads matching the grade and development filter, overdue first, then by score."""
    rows = qualified.join(states, "lead_id", "left").select(
        "lead_id", "grade", "score", F.coalesce("stage", F.lit("new")).alias("stage"),
        F.coalesce("open_follow_ups", F.lit(0)).alias("open_follow_ups"),
        (F.coalesce("overdue_follow_ups", F.lit(0)) > 0).alias("overdue"),
    )
    if grade != "ALL":
        rows = rows.where(F.col("grade") == grade)
    if development == "FOLLOW_UP":
        rows = rows.where(F.col("open_follow_ups") > 0)
    elif development == "OVERDUE":
        rows = rows.where("overdue")
    elif development != "ALL":
        rows = rows.where(F.col("stage") == development)
    return rows.orderBy(F.desc("overdue"), F.desc("score"), "lead_id")
