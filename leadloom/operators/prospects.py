"""Public prospects: search plans, normalisation, score, ranking and conversion to leads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import text as t
from leadloom.functions.web import company_domain, http_url, same_company, site_key, url_part
from leadloom.operators.leads import evidence_id, lead_id
from leadloom.session import compact_codes

# ---- fixed values: score weights, stage limits and search templates ----
WEIGHTS = {"need_signal": 25, "product_fit": 25, "timing": 20, "public_reachability": 15, "evidence_quality": 15}
UNREVIEWED_CAP = 49
DEFAULT_BUYER = "importer distributor wholesaler"
QUERY_TEMPLATES = (
    ("target-buyers", "{context} {buyer} {market}"),
    ("explicit-need", '"looking for supplier" {context} {market}'),
    ("problem-or-substitute", "{context} sourcing challenge shortage alternative {market}"),
    ("recent-change", "{context} launch expansion new range {market} {buyer}"),
    ("industry-channel", "{context} importer distributor wholesale directory {market}"),
)
LENGTH_LIMITS = {"product": 160, "market": 100, "buyer_type": 120, "application": 160}
# ---- end of fixed values ----


def search_plans(campaigns: DataFrame) -> DataFrame:
    """Five search queries per campaign (campaign_id, product, market, buyer_type, application).

    Campaigns outside the length limits come back once with a `refusal` and no query.
    """
    c = campaigns.select(
        "campaign_id", t.trimmed("product").alias("product"), t.trimmed("market").alias("market"),
        F.coalesce(t.text("buyer_type"), F.lit(DEFAULT_BUYER)).alias("buyer_type"),
        F.coalesce(t.trimmed("application"), F.lit("")).alias("application"))
    too_long = reduce(lambda a, b: a | b, [F.length(n) > limit for n, limit in LENGTH_LIMITS.items()])
    refusal = (
        F.when(F.coalesce(F.length("product"), F.lit(0)) < 2, "product-too-short")
        .when(F.coalesce(F.length("market"), F.lit(0)) < 2, "market-too-short").when(too_long, "too-long"))
    context = F.concat_ws(" ", "product", F.nullif("application", F.lit("")))
    names = {"context": context, "buyer": F.col("buyer_type"), "market": F.col("market")}

    def render(template: str) -> Column:
        pieces = []
        for part in template.replace("{", "\0{").replace("}", "\0").split("\0"):
            pieces.append(names[part[1:]] if part.startswith("{") else F.lit(part))
        return F.concat(*pieces)

    queries = F.array(*[F.struct(F.lit(label).alias("label"), render(q).alias("query")) for label, q in QUERY_TEMPLATES])
    refused = F.array(F.struct(F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("query")))
    return c.withColumn("refusal", refusal).select(
        "campaign_id", "refusal",
        F.inline(F.when(F.col("refusal").isNull(), queries).otherwise(refused))).withColumn(
        "query_id", F.concat(F.lit("query_"), t.fnv1a(F.concat_ws("|", "label", "query"))))


def normalize_prospects(df: DataFrame, observed_at: Column, product: str | None = None, market: str | None = None,
                        buyer_type: str | None = None) -> DataFrame:
    """Type prospect rows; missing levels depend on whether the page was reviewed and has a URL.

    Input columns: those of sources.documents.PROSPECT_COLUMNS plus `ordinal`, all text.
    """
    reviewed = t.flag("original_page_reviewed", "已核查")
    url = http_url(F.col("source_url"))
    excerpt = t.text("signal_excerpt")
    typed = df.select(
        "ordinal", F.coalesce(t.text("company_name"), t.text("title")).alias("company_name"),
        t.text("company_domain").alias("company_domain"), t.text("title").alias("title"),
        url.alias("source_url"), t.moment_of(df, "published_at").alias("published_at"),
        F.coalesce(t.moment_of(df, "observed_at"), observed_at).alias("observed_at"),
        excerpt.alias("signal_excerpt"),
        F.coalesce(t.text("signal_type"), F.lit("public-search-result")).alias("signal_type"),
        F.coalesce(t.text("product"), F.lit(product)).alias("product"),
        F.coalesce(t.text("market"), F.lit(market)).alias("market"),
        F.coalesce(t.text("buyer_type"), F.lit(buyer_type)).alias("buyer_type"),
        reviewed.alias("original_page_reviewed"),
        t.clamped("need_signal", 0, 5, F.when(reviewed, 2.0).otherwise(1.0)).alias("need_signal"),
        t.clamped("product_fit", 0, 5, F.when(reviewed, 2.0).otherwise(1.0)).alias("product_fit"),
        t.clamped("timing", 0, 5, 0.0).alias("timing"),
        t.clamped("public_reachability", 0, 5, F.when(url.isNotNull(), 3.0).otherwise(0.0)).alias("public_reachability"),
        t.clamped("evidence_quality", 0, 5, F.when(reviewed, 3.0).when(url.isNotNull(), 1.0).otherwise(0.0)).alias(
            "evidence_quality"),
        t.text("prospect_id").alias("prospect_id"),
    )
    made = t.content_id("prospect", F.col("source_url"), F.col("company_name"), F.col("signal_excerpt"))
    return typed.withColumn("prospect_id", F.coalesce("prospect_id", made))


def prospect_evidence(prospects: DataFrame) -> DataFrame:
    """One candidate evidence row per prospect with a cited signal."""
    reviewed = F.col("original_page_reviewed")
    kind = F.when(reviewed, "public-business-signal").otherwise("search-result-candidate")
    cited = prospects.where(F.col("source_url").isNotNull() & F.col("signal_excerpt").isNotNull())
    return cited.select(
        "prospect_id",
        evidence_id(kind, F.col("signal_excerpt"), F.col("source_url"), F.col("observed_at").cast("string")).alias(
            "evidence_id"),
        kind.alias("kind"), F.col("signal_excerpt").alias("value"), F.col("source_url").alias("source_ref"),
        "observed_at", F.when(reviewed, 0.65).otherwise(0.25).alias("confidence"), F.lit("candidate").alias("status"))


def score_prospects(prospects: DataFrame) -> DataFrame:
    """Weighted score, cap without a cited and reviewed page, stage, missing evidence and next action."""
    raw = reduce(lambda a, b: a + b, [
        t.half_up(F.col(name) / 5 * weight).cast("int") for name, weight in WEIGHTS.items()])
    url, excerpt = F.col("source_url").isNotNull(), F.col("signal_excerpt").isNotNull()
    trusted = url & excerpt & F.col("original_page_reviewed")
    score = F.when(trusted, F.col("raw_score")).otherwise(F.least(F.col("raw_score"), F.lit(UNREVIEWED_CAP)))
    stage = (
        F.when(~trusted, "search-candidate").when(F.col("score") >= 70, "primary")
        .when(F.col("score") >= 50, "shortlist").otherwise("reviewed"))
    action = F.when(F.col("stage") == "search-candidate", "open-original-page").when(
        F.col("stage") == "primary", "prioritise").otherwise("add-evidence")
    missing = compact_codes(
        (~url, "source-url"), (~excerpt, "signal-excerpt"), (~F.col("original_page_reviewed"), "page-review"),
        (F.col("timing") < 2, "recent-signal"), (F.col("product_fit") < 3, "product-fit"))
    return prospects.withColumn("raw_score", raw).withColumn("score", score).withColumn("stage", stage).withColumn(
        "missing", missing).withColumn("next_action", action)


def company_key(prospects: DataFrame) -> Column:
    host = site_key(url_part(F.col("source_url"), 3))
    return F.coalesce(F.when(F.col("source_url").isNotNull(), host), F.lower(t.trimmed("company_name")))


def rank_prospects(scored: DataFrame) -> DataFrame:
    """One prospect per company (the first read), best score first.

    The first row is taken with min_by, which combines on the map side, so a company that owns a large part
    of the rows costs one row per task.
    """
    keyed = scored.withColumn("company_key", company_key(scored)).where(F.coalesce("company_key", F.lit("")) != "")
    first = keyed.groupBy("company_key").agg(F.min_by(F.struct(*[F.col(c) for c in scored.columns]), "ordinal").alias("p"))
    return first.select("company_key", "p.*").orderBy(F.desc("score"), "ordinal")


def prospects_to_leads(prospects: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turn reviewed prospects into leads; returns (leads, refused).

    Reviews: prospect_id, reviewed_page_url, page_reviewed, website (may be null). Refused rows
    carry the reason: page not reviewed, or the page belongs to another company.
    """
    page = http_url(F.col("reviewed_page_url"))
    given = t.text("company_domain")
    known, candidate = company_domain(F.col("company_domain")), company_domain(page)
    joined = prospects.join(reviews, "prospect_id").withColumn("_page", page).withColumn(
        "_refusal",
        F.when(page.isNull() | ~t.flag("page_reviewed"), "page-not-reviewed")
        .when(candidate.isNull(), "bad-page-domain")
        .when(given.isNotNull() & ~F.coalesce(same_company(known, candidate), F.lit(False)), "other-company"))
    refused = joined.where(F.col("_refusal").isNotNull()).select("prospect_id", F.col("_refusal").alias("refusal"))
    ok = joined.where(F.col("_refusal").isNull())
    reference = F.coalesce("source_url", "_page")
    website = http_url(F.col("website"))
    domain = F.coalesce(F.lower(given), site_key(url_part(website, 3)))
    source, nothing = F.lit("Public research"), F.lit(None).cast("string")
    leads = ok.select(
        lead_id(source, reference, F.col("company_name"), nothing, F.col("signal_excerpt")).alias("lead_id"),
        source.alias("source"), reference.alias("source_reference"), F.col("observed_at").alias("received_at"),
        F.struct(
            F.col("company_name").alias("name"), domain.alias("domain"), F.col("website").alias("website"),
            F.col("market").alias("country"), nothing.alias("address"), nothing.alias("industry"),
            nothing.alias("employee_range"), nothing.alias("registration_id"), nothing.alias("factory_info"),
        ).alias("organization"),
        F.struct(*[nothing.alias(n) for n in ("name", "role", "email", "whatsapp", "phone")]).alias("contact"),
        F.struct(
            F.col("signal_excerpt").alias("message"), F.col("product").alias("product"), nothing.alias("quantity"),
            nothing.alias("timeline"), nothing.alias("budget")).alias("inquiry"),
        F.struct(*[F.lit(False).alias(n) for n in (
            "explicit_inquiry", "replied", "requested_quote", "requested_sample", "purchase_order",
            "mutual_introduction", "prior_relationship")]).alias("signals"),
        F.struct(F.lit(False).alias("do_not_contact"), F.lit(False).alias("restricted_market"),
                 nothing.alias("duplicate_of"), F.lit("unknown").alias("consent_status")).alias("compliance"),
        F.lit("Converted from a public prospect; not an inquiry by the customer.").alias("notes"), "ordinal")
    return leads, refused


def append_to_queue(queue: DataFrame, leads: DataFrame) -> DataFrame:
    """The queue and those new leads it does not hold yet; equal new ids count once."""
    new = leads.join(queue.select("lead_id"), "lead_id", "left_anti")
    body = F.struct(*[F.col(c) for c in leads.columns])
    once = new.groupBy("lead_id").agg(F.min_by(body, "ordinal").alias("l")).select("l.*")
    return queue.select(*leads.columns).unionByName(once)
