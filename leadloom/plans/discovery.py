"""Queries: prospects, search plans, introduction paths, e-mail candidates."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.operators import email, prospects, relationships
from leadloom.plans.base import LEADS, derive, lead_frame, query, table, with_parts
from leadloom.plans.evidence import DNS, DOMAINS, now
from leadloom.sources import documents, providers

CAMPAIGNS = """
SELECT p_partkey AS campaign_id, CASE WHEN p_partkey % 50 = 0 THEN 'x' WHEN p_partkey % 51 = 0 THEN repeat('long name ', 20) ELSE concat(' ', p_name) END AS product,
  concat('Nation ', CAST(p_partkey % 25 AS STRING)) AS market, CASE WHEN p_partkey % 2 = 0 THEN 'wholesaler' ELSE '  ' END AS buyer_type,
  CASE WHEN p_partkey % 3 = 0 THEN p_type END AS application FROM part
"""


@query("search_plans", with_parts("""
SELECT campaign_id, refusal, label, query FROM (
  SELECT campaign_id, refusal, each_of('target-buyers', 'explicit-need', 'problem-or-substitute', 'recent-change', 'industry-channel') AS label,
    context, buyer, market FROM cleaned WHERE refusal IS NULL) c, LATERAL (SELECT CASE label
    WHEN 'target-buyers' THEN context || ' ' || buyer || ' ' || market WHEN 'explicit-need' THEN '"looking for supplier" ' || context || ' ' || market
    WHEN 'problem-or-substitute' THEN context || ' sourcing challenge shortage alternative ' || market
    WHEN 'recent-change' THEN context || ' launch expansion new range ' || market || ' ' || buyer
    ELSE context || ' importer distributor wholesale directory ' || market END AS query)
UNION ALL SELECT campaign_id, refusal, NULL, NULL FROM cleaned WHERE refusal IS NOT NULL""", campaigns=CAMPAIGNS, cleaned="""
SELECT campaign_id, market, CASE WHEN trim(buyer_type) = '' THEN 'importer distributor wholesaler' ELSE trim(buyer_type) END AS buyer,
  concat_ws(' ', trim(product), application) AS context,
  CASE WHEN length(trim(product)) < 2 THEN 'product-too-short' WHEN length(trim(product)) > 160 THEN 'too-long' END AS refusal FROM campaigns"""))
def search_plans(spark, folder):
    return prospects.search_plans(derive(spark, folder, CAMPAIGNS)).drop("query_id")


PROSPECT_ROWS = """
SELECT page_id AS ordinal, concat(' Page ', CAST(page_id AS STRING)) AS title, CASE WHEN page_id % 13 = 0 THEN 'ftp://x.example/y' ELSE url END AS source_url,
  CASE WHEN page_id % 17 <> 0 THEN html END AS signal_excerpt, CASE WHEN page_id % 3 = 0 THEN 'yes' ELSE '' END AS reviewed,
  CASE WHEN page_id % 4 <> 0 THEN CAST(page_id % 7 AS STRING) END AS need, CASE WHEN page_id % 5 <> 0 THEN CAST(page_id % 6 AS STRING) ELSE 'many' END AS fit,
  CAST(page_id % 11 / 2.0 AS STRING) AS timing FROM pages
"""
PROSPECTS = """
SELECT *, raw_need + raw_fit + raw_timing + raw_reach + raw_quality AS raw_score FROM (
  SELECT ordinal, trim(title) AS title, url, signal_excerpt IS NOT NULL AS cited, reviewed = 'yes' AS reviewed, timing_v, fit_v,
    floor(need_v / 5 * 25 + 0.5)::BIGINT AS raw_need, floor(fit_v / 5 * 25 + 0.5)::BIGINT AS raw_fit, floor(timing_v / 5 * 20 + 0.5)::BIGINT AS raw_timing,
    floor(CASE WHEN url IS NULL THEN 0.0 ELSE 3.0 END / 5 * 15 + 0.5)::BIGINT AS raw_reach,
    floor(CASE WHEN reviewed = 'yes' THEN 3.0 WHEN url IS NULL THEN 0.0 ELSE 1.0 END / 5 * 15 + 0.5)::BIGINT AS raw_quality
  FROM (SELECT *, CASE WHEN source_url LIKE 'http%' THEN source_url END AS url,
      coalesce(CASE WHEN try_cast(need AS DOUBLE) > 5 THEN 5 ELSE try_cast(need AS DOUBLE) END, CASE WHEN reviewed = 'yes' THEN 2.0 ELSE 1.0 END) AS need_v,
      coalesce(CASE WHEN try_cast(fit AS DOUBLE) > 5 THEN 5 ELSE try_cast(fit AS DOUBLE) END, CASE WHEN reviewed = 'yes' THEN 2.0 ELSE 1.0 END) AS fit_v,
      least(5.0, try_cast(timing AS DOUBLE)) AS timing_v FROM prospect_rows))
"""
SCORED = r"""
SELECT *, CASE WHEN trusted THEN raw_score ELSE least(raw_score, 49) END AS score FROM (
  SELECT *, url IS NOT NULL AND cited AND reviewed AS trusted,
    CASE WHEN url IS NULL THEN lower(title) ELSE regexp_replace(lower(regexp_extract(url, '://([^/?#:]+)', 1)), '^www\.', '') END AS company_key FROM typed)
"""
PROSPECT_PARTS = {"prospect_rows": PROSPECT_ROWS, "typed": PROSPECTS, "scored": SCORED}


def prospect_frame(spark: SparkSession, folder: str) -> DataFrame:
    rows = derive(spark, folder, PROSPECT_ROWS)
    given = {"title": "title", "source_url": "source_url", "signal_excerpt": "signal_excerpt", "original_page_reviewed": "reviewed",
             "need_signal": "need", "product_fit": "fit", "timing": "timing"}
    shaped = rows.select("ordinal", *[
        (F.col(given[c]) if c in given else F.lit(None).cast("string")).alias(c) for c in documents.PROSPECT_COLUMNS])
    return prospects.normalize_prospects(shaped, now(), product="widget", market="Exampleland")


@query("prospect_scores", with_parts("""
SELECT ordinal, raw_score, score, CASE WHEN NOT trusted THEN 'search-candidate' WHEN score >= 70 THEN 'primary' WHEN score >= 50 THEN 'shortlist'
    ELSE 'reviewed' END AS stage,
  concat_ws(',', CASE WHEN url IS NULL THEN 'source-url' END, CASE WHEN NOT cited THEN 'signal-excerpt' END, CASE WHEN NOT reviewed THEN 'page-review' END,
    CASE WHEN timing_v < 2 THEN 'recent-signal' END, CASE WHEN fit_v < 3 THEN 'product-fit' END) AS missing FROM scored""", **PROSPECT_PARTS))
def prospect_scores(spark, folder):
    return prospects.score_prospects(prospect_frame(spark, folder)).select("ordinal", "raw_score", "score", "stage", "missing")


@query("prospect_rank", with_parts("""
SELECT company_key, ordinal, title, score FROM (SELECT *, row_number() OVER (PARTITION BY company_key ORDER BY ordinal) AS rn FROM scored
  WHERE company_key <> '') WHERE rn = 1""", **PROSPECT_PARTS))
def prospect_rank(spark, folder):
    return prospects.rank_prospects(prospects.score_prospects(prospect_frame(spark, folder))).select(
        "company_key", "ordinal", "title", "score")


@query("prospect_evidence", with_parts("""
SELECT CASE WHEN reviewed = 'yes' THEN 'public-business-signal' ELSE 'search-result-candidate' END AS kind, trim(signal_excerpt) AS value,
  CASE WHEN reviewed = 'yes' THEN 0.65 ELSE 0.25 END::DOUBLE AS confidence FROM prospect_rows WHERE source_url LIKE 'http%' AND signal_excerpt IS NOT NULL""",
    prospect_rows=PROSPECT_ROWS))
def prospect_evidence(spark, folder):
    return prospects.prospect_evidence(prospect_frame(spark, folder)).select("kind", "value", "confidence")


CONVERSIONS = """
SELECT c_custkey AS ordinal, concat('P', CAST(c_custkey AS STRING)) AS prospect_id, c_name AS company_name,
  CASE WHEN c_custkey % 6 <> 0 THEN concat('d', CAST(c_custkey AS STRING), '.example') END AS company_domain,
  concat('https://d', CAST(c_custkey AS STRING), '.example/news') AS source_url,
  CASE c_custkey % 5 WHEN 0 THEN 'https://other.example/about' WHEN 1 THEN NULL ELSE concat('https://shop.d', CAST(c_custkey AS STRING), '.example/about') END AS reviewed_page_url,
  CASE WHEN c_custkey % 7 = 0 THEN 'no' ELSE 'yes' END AS page_reviewed, CASE WHEN c_custkey % 2 = 0 THEN concat('https://www.d', CAST(c_custkey AS STRING), '.example/') END AS website
FROM customer
"""
REFUSED = """
SELECT *, CASE WHEN reviewed_page_url IS NULL OR page_reviewed = 'no' THEN 'page-not-reviewed'
  WHEN company_domain IS NOT NULL AND reviewed_page_url LIKE '%other.example%' THEN 'other-company' END AS refusal FROM conversions
"""


def _conversion(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = derive(spark, folder, CONVERSIONS)
    found = rows.select("ordinal", "prospect_id", "company_name", "company_domain", "source_url", F.lit("a signal").alias("signal_excerpt"),
                        F.lit("widget").alias("product"), F.lit("Exampleland").alias("market"), now().alias("observed_at"))
    reviews = rows.select("prospect_id", "reviewed_page_url", "page_reviewed", "website")
    return prospects.prospects_to_leads(found, reviews)


@query("prospect_leads", with_parts("""
SELECT ordinal, source_url AS source_reference, company_name AS name,
  coalesce(company_domain, regexp_extract(website, '://www.([^/]+)', 1)) AS domain, website FROM refused WHERE refusal IS NULL""",
    conversions=CONVERSIONS, refused=REFUSED))
def prospect_leads(spark, folder):
    leads, _ = _conversion(spark, folder)
    return leads.select("ordinal", "source_reference", "organization.name", "organization.domain", "organization.website")


@query("prospect_refusals", with_parts("SELECT prospect_id, refusal FROM refused WHERE refusal IS NOT NULL", conversions=CONVERSIONS, refused=REFUSED))
def prospect_refusals(spark, folder):
    return _conversion(spark, folder)[1]


@query("prospect_queue", with_parts("""
SELECT source_reference FROM leads UNION ALL SELECT source_url FROM refused WHERE refusal IS NULL""",
    leads=LEADS, conversions=CONVERSIONS, refused=REFUSED))
def prospect_queue(spark, folder):
    """Queueing the same prospects twice adds them once."""
    leads, _ = _conversion(spark, folder)
    queue = lead_frame(spark, folder).select(*leads.columns)
    return prospects.append_to_queue(prospects.append_to_queue(queue, leads), leads).select("source_reference")


# Search answers: one envelope per ten pages, a block per page, odd blocks without a usable URL.
ENVELOPES = """
SELECT CAST(floor(page_id / 10) AS BIGINT) AS query_id, page_id, concat('Title: Page ', CAST(page_id AS STRING), CHR(10), 'URL: ',
  CASE WHEN page_id % 9 = 4 THEN 'file:///tmp/x' ELSE concat('https://h', CAST(page_id AS STRING), '.example/n') END, CHR(10), 'Published: ',
  CASE WHEN page_id % 2 = 0 THEN '2024-01-05T00:00:00.000Z' ELSE 'N/A' END, CHR(10), 'Author: N/A', CHR(10), 'Highlights:', CHR(10), 'Seen on page ',
  CAST(page_id AS STRING)) AS block FROM pages
"""


@query("search_results", with_parts("""
SELECT query_id, 'Page ' || page_id AS title, 'https://h' || page_id || '.example/n' AS url, CASE WHEN page_id % 2 = 0 THEN '2024-01-05T00:00:00.000Z' END AS published_at,
  NULL::VARCHAR AS author, 'Seen on page ' || page_id AS highlights FROM envelopes WHERE page_id % 9 <> 4""", envelopes=ENVELOPES))
def search_results(spark, folder):
    blocks = derive(spark, folder, ENVELOPES).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("page_id", "block"))).alias("b"))
    text = F.array_join(F.transform("b", lambda x: x["block"]), "\n\n---\n\n")
    envelopes = blocks.select("query_id", F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).alias(
        "content"))).alias("payload"))
    return documents.parse_search_results(envelopes).drop("position")


@query("search_prospects", with_parts("""
SELECT 'Page ' || page_id AS company_name, CASE WHEN page_id % 2 = 0 THEN 5 + 5 + 4 + 9 + 3 ELSE 5 + 5 + 0 + 9 + 3 END::BIGINT AS score,
  'search-candidate' AS stage FROM envelopes WHERE page_id % 9 <> 4""", envelopes=ENVELOPES))
def search_prospects(spark, folder):
    rows = derive(spark, folder, ENVELOPES)
    envelopes = rows.select("query_id", "page_id", F.to_json(F.struct(F.array(F.struct(
        F.lit("text").alias("type"), F.col("block").alias("text"))).alias("content"))).alias("payload"))
    results = documents.parse_search_results(envelopes.withColumn("query_id", F.col("page_id"))).withColumn("ordinal", F.col("query_id"))
    typed = prospects.normalize_prospects(documents.prospects_from_results(results, product="widget"), now())
    return prospects.score_prospects(typed).select("company_name", "score", "stage")


# ---- introduction paths ----

PATHS = """
SELECT concat('S', CAST(s_suppkey AS STRING)) AS connector_id, s_name AS connector_name, concat('C', CAST(c_custkey AS STRING)) AS target_id, c_name AS target_name,
  CASE WHEN (s_suppkey + c_custkey) % 9 = 8 THEN 'strong' ELSE CAST((s_suppkey + c_custkey) % 8 AS STRING) END AS strength, last_order,
  c_custkey % 2 = 0 AS known, c_custkey % 3 = 0 AS company, c_custkey % 4 = 0 AS industry, c_custkey % 5 = 0 AS education,
  CASE (s_suppkey + c_custkey) % 5 WHEN 0 THEN ' Approved' WHEN 1 THEN 'DECLINED' WHEN 2 THEN 'maybe' ELSE 'unknown' END AS consent,
  CASE WHEN (s_suppkey + c_custkey) % 3 = 0 THEN '' ELSE concat('e', CAST(s_suppkey AS STRING), '| m;；x') END AS ids
FROM (SELECT DISTINCT l.l_suppkey, o.o_custkey FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey) k
JOIN supplier s ON s.s_suppkey = k.l_suppkey JOIN customer c ON c.c_custkey = k.o_custkey
LEFT JOIN (SELECT o_custkey, max(CAST(o_orderdate AS TIMESTAMP)) AS last_order FROM orders GROUP BY o_custkey) t ON t.o_custkey = c.c_custkey
"""
PATH_CLOCK = "1999-03-01 12:00:00"
SCORED_PATHS = f"""
SELECT connector_id, target_id, consent, ids, least(100, CASE WHEN ids = '' THEN least(49, total) ELSE total END)::DOUBLE AS score, consent_s
FROM (SELECT *, least(5, coalesce(try_cast(strength AS DOUBLE), 0)) * 8
    + CASE WHEN days <= 30 THEN 20 WHEN days <= 90 THEN 15 WHEN days <= 365 THEN 10 WHEN days <= 730 THEN 5 ELSE 0 END
    + 15 * known::INT + 10 * company::INT + 5 * industry::INT + 5 * education::INT + CASE WHEN consent_s = 'approved' THEN 5 ELSE 0 END AS total
  FROM (SELECT *, CASE WHEN last_order IS NOT NULL THEN greatest(0.0, date_diff('microsecond', last_order, TIMESTAMP '{PATH_CLOCK}') / 86400e6) END AS days,
      CASE lower(trim(consent)) WHEN 'approved' THEN 'approved' WHEN 'declined' THEN 'declined' ELSE 'unknown' END AS consent_s FROM paths))
WHERE consent_s <> 'declined'
"""


def path_frame(spark: SparkSession, folder: str) -> DataFrame:
    return relationships.normalize_paths(derive(spark, folder, f"""
        SELECT connector_id, connector_name, target_id, target_name, strength AS relationship_strength, last_order AS last_contact_at,
          known AS known_personally, company AS shared_company, industry AS shared_industry, education AS shared_education,
          consent AS consent_status, ids AS evidence_ids FROM ({PATHS})"""))


@query("intro_paths", with_parts("""
SELECT connector_id, target_id, score, consent_s AS consent_status,
  CASE WHEN ids = '' THEN '' ELSE 'e' || substr(connector_id, 2) || ',m,x' END AS evidence_ids FROM scored_paths""",
    paths=PATHS, scored_paths=SCORED_PATHS))
def intro_paths(spark, folder):
    return relationships.rank_paths(path_frame(spark, folder), F.lit(PATH_CLOCK).cast("timestamp")).select(
        "connector_id", "target_id", "score", "consent_status", "evidence_ids")


@query("intro_best_paths", with_parts("""
SELECT connector_id, target_id, score, position FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, connector_id) AS position
  FROM scored_paths) WHERE position <= 3""", paths=PATHS, scored_paths=SCORED_PATHS))
def intro_best_paths(spark, folder):
    return relationships.rank_paths(path_frame(spark, folder), F.lit(PATH_CLOCK).cast("timestamp"), 3).select(
        "connector_id", "target_id", "score", "position")


@query("intro_stats", with_parts("SELECT count(*) AS paths, count(*) FILTER (lower(trim(consent)) = 'declined') AS declined FROM paths", paths=PATHS))
def intro_stats(spark, folder):
    return relationships.path_stats(path_frame(spark, folder))


# ---- e-mail candidates ----

PEOPLE = """
SELECT c_custkey AS person_id, CASE c_custkey % 4 WHEN 0 THEN concat('Anna-', c_mktsegment) WHEN 1 THEN concat('Bo ', CAST(c_custkey AS STRING), ' Lee') WHEN 2 THEN 'Sales' ELSE '' END AS full_name,
  CASE WHEN c_custkey % 11 = 0 THEN '10.0.0.1' WHEN c_custkey % 11 = 1 THEN 'mail.internal' ELSE concat('https://www.D', CAST(c_custkey % 100 AS STRING), '.example/contact') END AS domain
FROM customer
"""
OPTIONS = """
SELECT person_id, domain, rank, local_part FROM (
  SELECT person_id, domain, rank, CASE rank WHEN 1 THEN CASE WHEN b <> '' THEN a || '.' || b END WHEN 2 THEN CASE WHEN b <> '' THEN left(a, 1) || b END
    WHEN 3 THEN CASE WHEN b <> '' THEN a || b END WHEN 4 THEN CASE WHEN b <> '' THEN a || left(b, 1) END WHEN 5 THEN CASE WHEN b <> '' THEN b || '.' || a END
    WHEN 6 THEN a WHEN 7 THEN b WHEN 8 THEN 'sales' WHEN 9 THEN 'export' ELSE 'info' END AS local_part
  FROM (SELECT person_id, 'd' || person_id % 100 || '.example' AS domain, coalesce(parts[1], '') AS a, CASE WHEN len(parts) > 1 THEN parts[-1] ELSE '' END AS b,
      unnest(range(1, 11)) AS rank
    FROM (SELECT *, list_filter(regexp_split_to_array(lower(full_name), '[^a-z0-9]+'), lambda x: x <> '') AS parts FROM people WHERE person_id % 11 > 1)))
WHERE local_part <> ''
"""
CANDIDATES = """
SELECT person_id, domain, local_part, row_number() OVER (PARTITION BY person_id ORDER BY min(rank)) - 1 AS position, local_part || '@' || domain AS email
FROM options GROUP BY person_id, domain, local_part
"""


@query("email_candidates", with_parts("SELECT person_id, position, local_part, email FROM candidates", people=PEOPLE, options=OPTIONS, candidates=CANDIDATES))
def email_candidates(spark, folder):
    return email.email_candidates(derive(spark, folder, PEOPLE)).select("person_id", "position", "local_part", "email")


@query("email_refused_domains", with_parts("SELECT person_id, domain FROM people WHERE person_id % 11 <= 1", people=PEOPLE))
def email_refused_domains(spark, folder):
    return email.refused_domains(derive(spark, folder, PEOPLE))


@query("email_assessment", with_parts("""
SELECT c.person_id, c.email, CASE coalesce(domain_status, 'inconclusive') WHEN 'no-mail-route' THEN 'rejected' WHEN 'inconclusive' THEN 'inconclusive' ELSE 'candidate' END AS status,
  split_part(c.email, '@', 1) = 'sales' AND c.person_id % 100 < 50 AS listed_on_website, coalesce(domain_status, 'inconclusive') AS domain_status
FROM candidates c LEFT JOIN domains d ON d.domain = c.domain""", people=PEOPLE, options=OPTIONS, candidates=CANDIDATES, domains=DOMAINS))
def email_assessment(spark, folder):
    candidates = email.email_candidates(derive(spark, folder, PEOPLE))
    published = table(spark, folder, "customer").where("c_custkey % 100 < 50").select(
        F.concat(F.lit(" Sales@d"), F.col("c_custkey") % 100, F.lit(".example")).alias("email"))
    assessed = email.assess_candidates(candidates, providers.mail_domains(derive(spark, folder, DNS)), published)
    return email.in_display_order(assessed).select("person_id", "email", "status", "listed_on_website", "domain_status")


@query("domain_match", with_parts("""
SELECT lead_id, allowed, CASE WHEN reason IS NOT NULL THEN reason WHEN allowed THEN 'same-company' ELSE 'other-company' END AS match_reason FROM (
  SELECT lead_id, CASE WHEN domain IS NULL THEN 'lead-has-no-domain' END AS reason, domain IS NULL OR plain = target OR ends_with(plain, '.' || target) OR ends_with(target, '.' || plain) AS allowed
  FROM (SELECT lead_id, domain, regexp_replace(domain, '^www\\.', '') AS plain, CASE WHEN ordinal % 2 = 0 THEN 'shop.platform.example'
    ELSE 'd' || floor(ordinal / 4)::BIGINT || '.example' END AS target FROM leads))""", leads=LEADS))
def domain_match(spark, folder):
    leads = lead_frame(spark, folder)
    rows = leads.select("lead_id", F.col("organization.domain").alias("lead_domain"), F.when(
        F.col("ordinal") % 2 == 0, F.lit("https://shop.platform.example/x")).otherwise(
            F.concat(F.lit("D"), F.floor(F.col("ordinal") / 4), F.lit(".example"))).alias("candidate_domain"))
    return email.domain_match(rows).select("lead_id", "allowed", "match_reason")


