"""Collected facts from outside: registry records, site extractions, mail checks, DNS answers, fetch logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.functions import text as t
from leadloom.functions import web
from leadloom.operators.leads import evidence_id
from leadloom.session import lookup
from leadloom.sources.json_files import read_json

# ---- legal entity registry ----

_ADDRESS = "struct<addressLines:array<string>,city:string,region:string,postalCode:string,country:string>"
REGISTRY_DDL = (
    "id string, attributes struct<lei:string,"
    f"entity:struct<legalName:struct<name:string>,legalAddress:{_ADDRESS},headquartersAddress:{_ADDRESS},"
    "registeredAt:struct<id:string>,registeredAs:string,jurisdiction:string,status:string,"
    "otherNames:array<struct<name:string>>>,"
    "registration:struct<status:string,corroborationLevel:string,lastUpdateDate:string,"
    "validatedAt:struct<id:string>,validatedAs:string>>"
)
REGISTRY_RECORDS = "https://api.gleif.org/api/v1/lei-records"  # fixed value: public registry


def read_registry(spark: SparkSession, path: str, multiline: bool | None = None) -> DataFrame:
    """Registry bulk file: one record per line, or an array, or {data: [...]}."""
    record = REGISTRY_DDL.replace("id string, attributes ", "id:string,attributes:")
    raw = read_json(spark, path, REGISTRY_DDL + f", data array<struct<{record}>>", multiline)
    return raw.select(F.explode(F.coalesce("data", F.array(F.struct("id", "attributes")))).alias("r")).select("r.*").where(
        F.col("attributes").isNotNull())


def _address(path: str) -> Column:
    lines = F.coalesce(F.col(f"{path}.addressLines"), F.array().cast("array<string>"))
    parts = F.concat(lines, F.array(*[F.col(f"{path}.{p}") for p in ("city", "region", "postalCode", "country")]))
    return F.nullif(F.array_join(F.array_compact(F.transform(parts, lambda x: t.text(x))), ", "), F.lit(""))


def registry_companies(records: DataFrame) -> DataFrame:
    """Flat registry companies with the status and confidence their corroboration gives."""
    e, r = "attributes.entity", "attributes.registration"
    lei = t.text(F.coalesce(F.col("attributes.lei"), F.col("id")))
    corroborated = F.coalesce(F.col(f"{r}.corroborationLevel") == "FULLY_CORROBORATED", F.lit(False))
    issued = F.coalesce(F.col(f"{r}.status") == "ISSUED", F.lit(False))
    names = F.transform(F.coalesce(F.col(f"{e}.otherNames"), F.array().cast("array<struct<name:string>>")),
                        lambda n: t.text(n["name"]))
    return records.select(
        lei.alias("lei"), t.text(f"{e}.legalName.name").alias("legal_name"),
        F.array_compact(names).alias("other_names"), t.text(f"{e}.status").alias("entity_status"),
        t.text(f"{r}.status").alias("registration_status"),
        t.text(f"{r}.corroborationLevel").alias("corroboration_level"),
        t.text(f"{e}.jurisdiction").alias("jurisdiction"),
        t.text(F.coalesce(f"{e}.registeredAt.id", f"{r}.validatedAt.id")).alias("registered_at"),
        t.text(F.coalesce(f"{e}.registeredAs", f"{r}.validatedAs")).alias("registered_as"),
        _address(f"{e}.legalAddress").alias("legal_address"),
        _address(f"{e}.headquartersAddress").alias("headquarters_address"),
        t.text(f"{r}.lastUpdateDate").alias("last_update"),
        F.concat(F.lit(REGISTRY_RECORDS + "/"), t.uri_component(lei)).alias("source_ref"),
        F.when(issued & corroborated, "verified").otherwise("inconclusive").alias("record_status"),
        corroborated.alias("corroborated"))


def registry_evidence(companies: DataFrame, observed_at: Column) -> DataFrame:
    """At most four evidence rows per registry company."""
    sure = F.col("corroborated")
    kinds = (
        ("legal-entity-record", "legal_name", F.when(sure, 0.95).otherwise(0.7)),
        ("business-registration", "registered_as", F.when(sure, 0.95).otherwise(0.7)),
        ("business-status", "entity_status", F.lit(0.9)),
        ("business-address", "legal_address", F.when(sure, 0.9).otherwise(0.65)),
    )
    rows = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(
        F.lit(kind).alias("kind"), F.col(c).alias("value"), confidence.alias("confidence")))
        for kind, c, confidence in kinds]))
    listed = companies.select("lei", "source_ref", "record_status", F.posexplode(rows).alias("seq", "e"))
    return listed.select(
        "lei", F.col("seq").cast("bigint").alias("seq"),
        evidence_id(F.col("e.kind"), F.col("e.value"), F.col("source_ref"), observed_at.cast("string")).alias("evidence_id"),
        "e.kind", "e.value", "source_ref", observed_at.alias("observed_at"), "e.confidence",
        F.col("record_status").alias("status"))


def match_registry(leads: DataFrame, companies: DataFrame, per_lead: int = 10) -> DataFrame:
    """Registry candidates per lead by company name (legal or other), the best `per_lead`.

    Leads: lead_id, name, jurisdiction (null: any). The best companies per name (and jurisdiction) are
    ranked first, with the rank limit applied before the shuffle; a name shared by many leads and many
    companies therefore yields at most `per_lead` rows per lead.
    """
    names = companies.select("lei", "legal_name", "jurisdiction", "record_status", F.explode(F.array_compact(F.concat(
        F.array("legal_name"), "other_names"))).alias("_name"))
    keyed = names.withColumn("name_key", t.name_key("_name")).where(F.col("name_key").isNotNull())
    scoped = keyed.select("lei", "legal_name", "record_status", F.explode(F.array(
        F.concat(F.lit("*|"), "name_key"), F.concat(F.upper("jurisdiction"), F.lit("|"), "name_key"))).alias("match_key")).where(
        F.col("match_key").isNotNull()).dropDuplicates(["match_key", "lei"])
    best = Window.partitionBy("match_key").orderBy(F.desc(F.col("record_status") == "verified"), "lei")
    top = scoped.withColumn("position", F.row_number().over(best)).where(F.col("position") <= per_lead)
    scope = F.coalesce(F.upper(t.text("jurisdiction")), F.lit("*"))
    wanted = leads.where(F.length(t.text("name")) >= 2).select(
        "lead_id", F.concat(scope, F.lit("|"), t.name_key("name")).alias("match_key")).where(
        F.col("match_key").isNotNull())
    # One row per key: its list of at most `per_lead` companies.
    lists = top.groupBy("match_key").agg(F.array_sort(F.collect_list(F.struct("position", "lei", "legal_name", "record_status"))).alias("best"))
    return lookup(wanted, lists, "match_key").select("lead_id", F.inline("best"))


# ---- site extraction and address verification ----

# ---- fixed values ----
EXTRACTION_KINDS = {
    "companyName": "organization-name", "domain": "organization-domain", "address": "business-address",
    "businessStatus": "business-status", "factoryInfo": "factory", "manufacturingCapability": "manufacturing-capability",
}
EXTRACTION_TOP_CONFIDENCE, EXTRACTION_CONFIDENCE = 0.75, 0.65
VERIFIED_WORDS = ("valid", "deliverable", "verified", "ok")
REJECTED_WORDS = ("invalid", "undeliverable", "rejected")
UNCLEAR_WORDS = ("unknown", "catch_all", "catch-all", "timeout", "blocked")
# ---- end of fixed values ----


def extraction_evidence(extractions: DataFrame, observed_at: Column, confidence: float = EXTRACTION_CONFIDENCE) -> DataFrame:
    """Candidate evidence from site extractions (url, content as map or struct of the six known fields)."""
    kind = dict(extractions.dtypes)["content"]

    def value(name: str) -> Column:
        if kind.startswith("map"):
            return F.element_at("content", F.lit(name))
        return F.col(f"content.{name}")

    level = min(EXTRACTION_TOP_CONFIDENCE, max(0.0, confidence))
    rows = F.array_compact(F.array(*[
        F.when(F.nullif(value(f), F.lit("")).isNotNull(), F.struct(F.lit(k).alias("kind"), value(f).alias("value")))
        for f, k in EXTRACTION_KINDS.items()]))
    listed = extractions.where(t.text("url").isNotNull()).select("url", F.posexplode(rows).alias("seq", "e"))
    return listed.select(
        "url", "seq", evidence_id(F.col("e.kind"), F.col("e.value"), F.col("url"), observed_at.cast("string")).alias("evidence_id"),
        "e.kind", "e.value", F.col("url").alias("source_ref"), observed_at.alias("observed_at"),
        F.lit(level).alias("confidence"), F.lit("candidate").alias("status"))


def verification_evidence(results: DataFrame, observed_at: Column, provider: str = "email-sleuth") -> DataFrame:
    """Evidence from address verifications (email, domain, status, confidence)."""
    word = F.lower(F.coalesce(F.col("status"), F.lit("")))
    status = (
        F.when(word.isin(*VERIFIED_WORDS), "verified").when(word.isin(*REJECTED_WORDS), "rejected")
        .when(word.isin(*UNCLEAR_WORDS), "inconclusive").otherwise("candidate"))
    given = t.number("confidence")
    scaled = F.when(given > 1, given / 100).otherwise(given)
    fallback = F.when(status == "verified", 0.8).otherwise(0.5)
    after_at = F.nullif(F.split_part("email", F.lit("@"), F.lit(2)), F.lit(""))
    domain = F.coalesce(F.nullif("domain", F.lit("")), after_at, F.lit("unknown-domain"))
    reference = F.concat(F.lit(f"{provider}:"), domain)
    return results.where(F.coalesce("email", F.lit("")) != "").select(
        evidence_id(F.lit("business-email"), F.lower("email"), reference, observed_at.cast("string")).alias("evidence_id"),
        F.lit("business-email").alias("kind"), F.lower("email").alias("value"), reference.alias("source_ref"),
        observed_at.alias("observed_at"), t.clamped(scaled, 0, 1, fallback).alias("confidence"), status.alias("status"))


# ---- mail domains ----

# A DNS answer has at most 64 KB, an MX record at least 16 bytes: no answer holds more than this.
EXCHANGES_KEPT = 4096


def mail_domains(answers: DataFrame) -> DataFrame:
    """Mail status per domain from collected DNS answers (domain, rrtype, rcode, priority, exchange).

    rcode is NOERROR, NODATA, NXDOMAIN or any failure. MX hosts decide first; without MX data an address
    record leaves the route open; failures leave it unknown. Exchanges come by priority.
    """
    rows = answers.withColumn("domain", web.company_domain(F.col("domain"))).where(F.col("domain").isNotNull())
    mx, ok = F.col("rrtype") == "MX", F.col("rcode") == "NOERROR"
    address = F.col("rrtype").isin("A", "AAAA")
    failed = ~F.col("rcode").isin("NOERROR", "NODATA", "NXDOMAIN")
    real = F.coalesce((F.col("exchange") != "") & (F.col("exchange") != "."), F.lit(False))
    facts = rows.groupBy("domain").agg(
        F.bool_or(mx & ok & real).alias("has_mx"), F.bool_or(mx & ok).alias("mx_answered"),
        F.bool_or(mx & (F.col("rcode") == "NXDOMAIN")).alias("unknown_domain"),
        F.bool_or(mx & (F.col("rcode") == "NODATA")).alias("no_mx"),
        F.count_if(address & ok).alias("addresses"), F.bool_or(address & failed).alias("address_failure"))
    status = (
        F.when(F.col("has_mx"), "mx-found").when(F.col("mx_answered") | F.col("unknown_domain"), "no-mail-route")
        .when(F.col("no_mx") & (F.col("addresses") > 0), "address-fallback")
        .when(F.col("no_mx") & ~F.col("address_failure"), "no-mail-route").otherwise("inconclusive"))
    order = Window.partitionBy("domain").orderBy(F.col("priority"), "exchange")
    hosts = rows.where(mx & ok & real).select("domain", "priority", "exchange").distinct().withColumn(
        "_rank", F.row_number().over(order)).where(F.col("_rank") <= EXCHANGES_KEPT).groupBy("domain").agg(F.transform(
            F.array_sort(F.collect_list(F.struct("priority", "exchange"))),
            lambda x: F.regexp_replace(x["exchange"], r"\.$", "")).alias("exchanges"))
    joined = facts.withColumn("domain_status", status).join(hosts, "domain", "left")
    found, fallback = F.col("domain_status") == "mx-found", F.col("domain_status") == "address-fallback"
    refused, asked_addresses = F.col("domain_status") == "no-mail-route", F.col("no_mx") & ~F.col("mx_answered")
    return joined.select(
        "domain", "domain_status", F.coalesce("exchanges", F.array().cast("array<string>")).alias("exchanges"),
        F.when(asked_addresses & ~found, F.col("addresses")).otherwise(0).alias("address_records"),
        F.concat(F.lit("dns-mx:"), "domain").alias("source_ref"),
        F.when(found, "verified").when(refused, "rejected").otherwise("inconclusive").alias("status"),
        F.when(found, 0.95).when(fallback, 0.55).when(refused & asked_addresses & ~F.col("unknown_domain"), 0.7)
        .when(refused, 0.9).when(asked_addresses, 0.7).otherwise(0.3).alias("confidence"))


# ---- fetch logs ----

# ---- fixed values ----
MAX_REDIRECTS, MAX_PAGE_BYTES = 3, 1_000_000
REDIRECT_CODES = (301, 302, 303, 307, 308)
TEXT_TYPES = r"text/html|application/xhtml\+xml|text/plain"
# ---- end of fixed values ----


def fetch_outcomes(log: DataFrame) -> DataFrame:
    """Outcome per requested URL from its crawl log (requested, hop, url, status, location, content_type, bytes).

    Hops after the first one that ends the fetch do not count. One aggregate per requested URL.
    """
    redirect = F.col("status").isin(*REDIRECT_CODES)
    start = web.site_key(web.url_part(F.col("requested"), 3))
    target = web.site_key(web.url_part(F.col("location"), 3))
    relative = ~F.contains("location", F.lit("://"))
    verdict = (
        F.when(F.col("hop") > MAX_REDIRECTS, "too-many-redirects")
        .when(redirect & F.col("location").isNull(), "redirect-without-target")
        .when(redirect & ~relative & web.url_refusal(F.col("location")).isNotNull(), "refused-target")
        .when(redirect & ~relative & (target != start), "other-site")
        .when(redirect & (F.col("hop") == MAX_REDIRECTS), "too-many-redirects")
        .when(redirect, F.lit(None))
        .when(~F.col("status").between(200, 299), F.concat(F.lit("http-"), F.col("status").cast("string")))
        .when(~F.lower(F.coalesce("content_type", F.lit(""))).rlike(TEXT_TYPES), "not-text")
        .when(F.col("bytes") > MAX_PAGE_BYTES, "too-large").otherwise("read"))
    judged = log.withColumn("_verdict", F.when(web.url_refusal(F.col("requested")).isNotNull(), "refused-url").otherwise(verdict))
    ended = F.when(F.col("_verdict").isNotNull(), F.col("hop"))
    out = judged.groupBy("requested").agg(
        F.min_by(F.struct("_verdict", "url", "hop"), ended).alias("end"), F.max("hop").alias("_last"))
    return out.select(
        "requested", F.coalesce("end._verdict", F.lit("incomplete")).alias("outcome"), F.col("end.url").alias("final_url"),
        F.coalesce("end.hop", "_last").alias("redirects"))
