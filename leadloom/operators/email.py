"""E-mail candidates from names and domains, and their assessment against collected facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import text as t
from leadloom.functions.web import company_domain, same_company
from leadloom.session import compact_codes

CANDIDATES_KEPT = 10  # fixed value
ROLES = (("sales", "sales-team"), ("export", "export-team"), ("info", "general-information"))  # fixed values


def email_candidates(people: DataFrame) -> DataFrame:
    """At most ten address candidates per person (person_id, full_name, domain); no shuffle.

    Rows whose domain is no company domain yield nothing (see `refused_domains`).
    """
    staged = people.select("person_id", company_domain(F.col("domain")).alias("domain"),
                           t.ascii_name_parts("full_name").alias("_parts")).where(
        F.col("domain").isNotNull())
    first = F.coalesce(F.get("_parts", F.lit(0)), F.lit(""))
    last = F.when(F.size("_parts") > 1, F.element_at("_parts", -1)).otherwise("")
    named = staged.withColumn("_first", first).withColumn("_last", last)
    a, z = F.col("_first"), F.col("_last")
    both = (a != "") & (z != "")

    def option(condition: Column, local: Column, kind: str, pattern: str) -> Column:
        return F.when(condition & (local != ""), F.struct(
            local.alias("local_part"), F.lit(kind).alias("type"), F.lit(pattern).alias("pattern")))

    always = F.lit(True)
    options = F.array_compact(F.array(
        option(both, F.concat(a, F.lit("."), z), "person", "first.last"),
        option(both, F.concat(F.substring(a, 1, 1), z), "person", "first-initial+last"),
        option(both, F.concat(a, z), "person", "first+last"),
        option(both, F.concat(a, F.substring(z, 1, 1)), "person", "first+last-initial"),
        option(both, F.concat(z, F.lit("."), a), "person", "last.first"),
        option(always, a, "person", "first"), option(always, z, "person", "last"),
        *[option(always, F.lit(local), "role", pattern) for local, pattern in ROLES]))
    locals_ = F.transform("_options", lambda o: o["local_part"])
    distinct = F.filter("_options", lambda o, i: F.array_position(locals_, o["local_part"]) == i + 1)
    ranked = named.withColumn("_options", options).select(
        "person_id", "domain", F.posexplode(F.slice(distinct, 1, CANDIDATES_KEPT)).alias("position", "o"))
    return ranked.select(
        "person_id", "position", "o.local_part", "o.type", "o.pattern",
        F.concat("o.local_part", F.lit("@"), "domain").alias("email"), "domain", F.lit("candidate").alias("status"))


def refused_domains(people: DataFrame) -> DataFrame:
    return people.where(company_domain(F.col("domain")).isNull()).select("person_id", "domain")


def assess_candidates(candidates: DataFrame, mail_domains: DataFrame, published: DataFrame) -> DataFrame:
    """Judge candidates by their mail domain (domain, domain_status) and published addresses (email)."""
    listed = published.select(F.lower(t.text("email", 320)).alias("email")).where(
        F.col("email").isNotNull()).distinct().withColumn("_listed", F.lit(True))
    joined = candidates.drop("status").join(mail_domains.select("domain", "domain_status"), "domain", "left").join(
        listed, "email", "left")
    status = F.coalesce("domain_status", F.lit("inconclusive"))
    on_site = F.col("_listed").isNotNull()
    return joined.select(
        "person_id", "position", "local_part", "type", "pattern", "email", "domain",
        F.when(status == "no-mail-route", "rejected").when(status == "inconclusive", "inconclusive").otherwise(
            "candidate").alias("status"),
        on_site.alias("listed_on_website"), status.alias("domain_status"),
        compact_codes((on_site, "listed-on-website"), (status == "mx-found", "mx-found"),
                      (status == "address-fallback", "address-fallback"), (status == "no-mail-route", "no-mail-route"),
                      (status == "inconclusive", "dns-inconclusive")).alias("signals"))


def in_display_order(assessed: DataFrame) -> DataFrame:
    return assessed.orderBy("person_id", F.desc("listed_on_website"), "position")


def domain_match(rows: DataFrame, lead_domain: str = "lead_domain", candidate: str = "candidate_domain") -> DataFrame:
    """Adds `allowed` and `match_reason`: a lead without domain accepts any, others only their own company."""
    given, known = t.text(lead_domain), company_domain(F.col(lead_domain))
    wanted = company_domain(F.col(candidate))
    reason = (
        F.when(wanted.isNull(), "bad-candidate-domain").when(given.isNull(), "lead-has-no-domain")
        .when(known.isNull(), "bad-lead-domain").when(same_company(known, wanted), "same-company")
        .otherwise("other-company"))
    return rows.withColumn("match_reason", reason).withColumn(
        "allowed", F.col("match_reason").isin("lead-has-no-domain", "same-company"))
