"""Queries: merging, selecting and reviewing evidence; registry and provider facts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom import model
from leadloom.operators import evidence as ev, scoring
from leadloom.plans.base import (
    EVIDENCE, LEADS, QUALIFIED, REVIEWS, EFFECTIVE, derive, evidence_frame, lead_frame, query, review_frame, table, with_parts)
from leadloom.session import work_path
from leadloom.sources import providers

NOW = "2024-02-01 00:00:00"

# Second delivery: a third of the website rows again with another status, and new contact rows.
ADDED = """
SELECT concat('L', lpad(CAST(c_custkey AS STRING), 9, '0')) AS lead_id, concat('W', CAST(c_custkey AS STRING)) AS evidence_id,
  CAST(1 AS BIGINT) AS seq, 'company-website' AS kind, concat('https://site', CAST(c_custkey AS STRING), '.example') AS value,
  concat('https://site', CAST(c_custkey AS STRING), '.example/about') AS source_ref, 'verified' AS status FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT concat('L', lpad(CAST(c_custkey AS STRING), 9, '0')), concat('N', CAST(c_custkey AS STRING)), 2, 'contact-name',
  concat('Person ', CAST(c_custkey AS STRING)), 'https://people.example', 'candidate' FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT concat('L', lpad(CAST(c_custkey AS STRING), 9, '0')), concat('X', CAST(c_custkey AS STRING)), 3, 'business-phone',
  concat('+1-555-', CAST(c_custkey AS STRING)), 'https://people.example', 'verified' FROM customer WHERE c_custkey % 5 = 0
"""
# Values offered for blank fields. Some cannot be traced to evidence, some are blank.
PATCH = """
SELECT concat('L', lpad(CAST(c_custkey AS STRING), 9, '0')) AS lead_id, p.path AS path,
  CASE p.path WHEN 'organization.website' THEN concat('HTTPS://site', CAST(c_custkey AS STRING), CASE WHEN c_custkey % 2 = 0 THEN '.example' ELSE '.example/about' END)
    WHEN 'contact.name' THEN concat(' Person ', CAST(CASE WHEN c_custkey % 4 = 0 THEN c_custkey + 1 ELSE c_custkey END AS STRING))
    WHEN 'contact.phone' THEN CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE concat('+1-555-', CAST(c_custkey AS STRING)) END
    ELSE 'Harbor road 1' END AS value
FROM (SELECT c_custkey, each_of('organization.website', 'contact.name', 'contact.phone', 'organization.address') AS path FROM customer) p
"""
MERGED = """
SELECT lead_id, evidence_id, arg_max(kind, (b, seq)) AS kind, arg_max(value, (b, seq)) AS value, arg_max(source_ref, (b, seq)) AS source_ref,
  arg_max(status, (b, seq)) AS status, arg_min(seq, (b, seq)) AS seq
FROM (SELECT *, 0 AS b FROM evidence UNION ALL SELECT lead_id, evidence_id, seq, kind, value, source_ref, status, 1 FROM added) GROUP BY lead_id, evidence_id
"""
FILLED = """
SELECT p.lead_id, p.path, trim(p.value) AS value, (
  SELECT arg_min(m.evidence_id, (m.seq, m.evidence_id)) FROM merged m WHERE m.lead_id = p.lead_id AND (
    (p.path = 'organization.website' AND m.kind = 'company-website'
      AND (lower(trim(m.value)) = lower(trim(p.value)) OR lower(trim(m.source_ref)) = lower(trim(p.value))))
    OR (p.path = 'contact.name' AND m.kind = 'contact-name' AND lower(trim(m.value)) = lower(trim(p.value)))
    OR (p.path = 'contact.phone' AND m.kind = 'business-phone' AND lower(trim(m.value)) = lower(trim(p.value)))
    OR (p.path = 'organization.address' AND m.kind = 'business-address' AND lower(trim(m.value)) = lower(trim(p.value))))) AS evidence_id
FROM patch p JOIN leads l ON l.lead_id = p.lead_id WHERE trim(p.value) <> '' AND CASE p.path WHEN 'organization.website' THEN l.website
  WHEN 'contact.name' THEN l.contact_name WHEN 'contact.phone' THEN l.phone END IS NULL
"""
FILL_PARTS = {"leads": LEADS, "evidence": EVIDENCE, "added": ADDED, "merged": MERGED, "patch": PATCH, "filled": FILLED}


def added_frame(spark: SparkSession, folder: str) -> DataFrame:
    return derive(spark, folder, f"""
        SELECT lead_id, evidence_id, seq, kind, value, source_ref, CAST(NULL AS TIMESTAMP) AS observed_at,
          CAST(0.5 AS DOUBLE) AS confidence, status, CAST(NULL AS STRING) AS note FROM ({ADDED})""")


def empty_origins(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], model.ORIGIN_DDL)


def now():
    return F.lit(NOW).cast("timestamp")


@query("evidence_merge", with_parts("SELECT lead_id, evidence_id, seq, kind, value, source_ref, status FROM merged",
                                    evidence=EVIDENCE, added=ADDED, merged=MERGED))
def evidence_merge(spark, folder):
    merged = ev.merge_evidence(evidence_frame(spark, folder), added_frame(spark, folder))
    return merged.select("lead_id", "evidence_id", "seq", "kind", "value", "source_ref", "status")


@query("evidence_fill", with_parts("SELECT lead_id, path, value, evidence_id FROM filled", **FILL_PARTS))
def evidence_fill(spark, folder):
    merged = ev.merge_evidence(evidence_frame(spark, folder), added_frame(spark, folder))
    _, _, filled = ev.fill_empty(lead_frame(spark, folder), merged, empty_origins(spark), derive(spark, folder, PATCH), now())
    return filled.select("lead_id", "path", "value", "evidence_id")


@query("evidence_attach", with_parts("""
SELECT l.lead_id, coalesce(l.website, max(value) FILTER (path = 'organization.website')) AS website,
  coalesce(l.contact_name, max(value) FILTER (path = 'contact.name')) AS contact_name,
  coalesce(l.phone, max(value) FILTER (path = 'contact.phone')) AS phone, max(value) FILTER (path = 'organization.address') AS address,
  count(evidence_id) AS origins
FROM leads l LEFT JOIN filled f ON f.lead_id = l.lead_id GROUP BY l.lead_id, l.website, l.contact_name, l.phone""", **FILL_PARTS))
def evidence_attach(spark, folder):
    leads, _, origins = ev.attach_evidence(
        lead_frame(spark, folder), evidence_frame(spark, folder), empty_origins(spark), added_frame(spark, folder),
        derive(spark, folder, PATCH), now())
    counts = origins.groupBy("lead_id").agg(F.count(F.lit(1)).alias("origins"))
    return leads.join(counts, "lead_id", "left").select(
        "lead_id", "organization.website", F.col("contact.name").alias("contact_name"), "contact.phone", "organization.address",
        F.coalesce("origins", F.lit(0)).alias("origins"))


@query("evidence_requalified", with_parts("""
SELECT q.lead_id, q.score, q.grade FROM qualified q""",
    leads0=LEADS, evidence0=EVIDENCE, added=ADDED, reviews=REVIEWS, patch=PATCH, merged=MERGED.replace("FROM evidence ", "FROM evidence0 "),
    filled=FILLED.replace("JOIN leads l", "JOIN leads0 l"),
    leads="""SELECT l.* REPLACE (coalesce(l.website, (SELECT max(value) FROM filled f WHERE f.lead_id = l.lead_id AND path = 'organization.website')) AS website,
      coalesce(l.contact_name, (SELECT max(value) FROM filled f WHERE f.lead_id = l.lead_id AND path = 'contact.name')) AS contact_name,
      coalesce(l.phone, (SELECT max(value) FROM filled f WHERE f.lead_id = l.lead_id AND path = 'contact.phone')) AS phone) FROM leads0 l""",
    evidence="SELECT lead_id, evidence_id, seq, kind, value, source_ref, status FROM merged", effective=EFFECTIVE, qualified=QUALIFIED))
def evidence_requalified(spark, folder):
    """Attach research, then score again."""
    leads, merged, _ = ev.attach_evidence(
        lead_frame(spark, folder), evidence_frame(spark, folder), empty_origins(spark), added_frame(spark, folder),
        derive(spark, folder, PATCH), now())
    effective = scoring.effective_evidence(merged, review_frame(spark, folder))
    return scoring.qualify(leads, effective).select("lead_id", "score", "grade")


SELECTED = "SELECT lead_id, evidence_id FROM evidence WHERE CAST(right(lead_id, 9) AS BIGINT) % 2 = 0 AND seq <> 2"


@query("evidence_selection", with_parts("""
SELECT lead_id, path, arg_min(v, seq) AS value, arg_min(evidence_id, seq) AS requested_id FROM (
  SELECT lead_id, seq, evidence_id, CASE kind WHEN 'company-website' THEN 'organization.website' WHEN 'factory' THEN 'organization.factory_info'
    WHEN 'business-email' THEN 'contact.email' WHEN 'business-phone' THEN 'contact.phone' END AS path, value AS v
  FROM evidence JOIN selected USING (lead_id, evidence_id)) GROUP BY lead_id, path""", evidence=EVIDENCE, selected=SELECTED))
def evidence_selection(spark, folder):
    evidence = evidence_frame(spark, folder)
    chosen = evidence.where((F.substring("lead_id", 2, 9).cast("bigint") % 2 == 0) & (F.col("seq") != 2)).select(
        "lead_id", "evidence_id")
    _, _, patch = ev.select_evidence(evidence, chosen, now())
    return patch


# Many leads' e-mails came from their evidence; four actions each reject, restore and revise that evidence.
_MAIL = "concat('Sales@d', CAST(CAST(floor({0} / 3) AS BIGINT) AS STRING), '.example')"
FILLED_LEADS = LEADS.replace(
    "CASE WHEN c.c_custkey % 5 <> 4 THEN", f"CASE WHEN c.c_custkey % 4 <> 0 THEN upper({_MAIL.format('c.c_custkey')}) WHEN c.c_custkey % 5 <> 4 THEN")
ORIGINS = f"""
SELECT concat('L', lpad(CAST(c_custkey AS STRING), 9, '0')) AS lead_id, 'contact.email' AS path, concat('M', CAST(c_custkey AS STRING)) AS evidence_id,
  CASE WHEN c_custkey % 9 = 2 THEN concat('c', CAST(c_custkey AS STRING), '@MAIL.example') ELSE {_MAIL.format('c_custkey')} END AS applied_value,
  c_custkey % 8 <> 2 AS active, CAST(1 AS BIGINT) AS seq FROM customer
"""
ACTIONS = f"""
SELECT concat('L', lpad(CAST(c_custkey AS STRING), 9, '0')) AS lead_id, concat('M', CAST(c_custkey AS STRING)) AS evidence_id, CAST(seq AS BIGINT) AS seq,
  CASE (c_custkey + CAST(floor(c_custkey / 4) AS BIGINT) * seq + seq * seq) % 4 WHEN 0 THEN 'rejected' WHEN 1 THEN 'accepted' ELSE 'revised' END AS action,
  CASE WHEN (c_custkey + seq) % 25 = 0 THEN 'x' ELSE 'looked it up' END AS note,
  CASE WHEN (c_custkey + CAST(floor(c_custkey / 4) AS BIGINT) * seq + seq * seq) % 4 > 1 THEN
    CASE WHEN (c_custkey + seq) % 7 = 0 THEN {_MAIL.format('c_custkey')} ELSE concat('new', CAST(seq AS STRING), 'x', CAST(c_custkey AS STRING), '@mail.example') END END AS value
FROM (SELECT c_custkey, each_of(1, 2, 3, 4) AS seq FROM customer) x
"""
REVIEWED = """
SELECT l.lead_id, CAST(0 AS BIGINT) AS step, l.email, o.active, o.applied_value AS applied, e.value, e.evidence_id IS NOT NULL AS known, coalesce(r.decision, '') AS decided,
  '' AS outcome, CAST(NULL AS VARCHAR) AS result
FROM leads l JOIN origins o USING (lead_id) LEFT JOIN evidence e ON e.lead_id = l.lead_id AND e.evidence_id = o.evidence_id
LEFT JOIN (SELECT lead_id, evidence_id, arg_max(decision, seq) AS decision FROM reviews GROUP BY ALL) r ON r.lead_id = l.lead_id AND r.evidence_id = o.evidence_id
UNION ALL
SELECT lead_id, step + 1,
  CASE WHEN result = 'cleared' THEN NULL WHEN result = 'updated' THEN new_value WHEN result = 'restored' AND email IS NULL THEN applied ELSE email END,
  CASE WHEN result = 'cleared' OR (result = 'preserved' AND action <> 'accepted') THEN FALSE WHEN result = 'restored' THEN TRUE ELSE active END,
  CASE WHEN result = 'updated' THEN new_value ELSE applied END, CASE WHEN outcome = 'accepted' AND action = 'revised' THEN new_value ELSE value END, known,
  CASE WHEN outcome = 'accepted' AND action <> 'revised' THEN action ELSE decided END, outcome, result
FROM (SELECT *, CASE WHEN outcome <> 'accepted' THEN NULL
    WHEN action = 'rejected' AND active THEN CASE WHEN same THEN 'cleared' ELSE 'preserved' END
    WHEN action = 'accepted' AND NOT active THEN CASE WHEN same OR email IS NULL THEN 'restored' ELSE 'preserved' END
    WHEN action = 'revised' AND active AND lower(applied) = lower(value) THEN CASE WHEN same THEN 'updated' ELSE 'preserved' END END AS result
  FROM (SELECT w.* EXCLUDE (outcome, result), a.action, a.value AS new_value, coalesce(lower(w.email) = lower(w.applied), FALSE) AS same,
      CASE WHEN NOT known THEN 'unknown-evidence' WHEN length(a.note) < 3 THEN 'note-too-short' WHEN a.action = 'revised' AND w.decided = 'rejected' THEN 'evidence-is-rejected'
        WHEN a.action = 'revised' AND lower(a.value) = lower(w.value) THEN 'nothing-changed' ELSE 'accepted' END AS outcome
    FROM walk w JOIN actions a ON a.lead_id = w.lead_id AND a.seq = w.step + 1))
"""


@query("evidence_review", with_parts("""
SELECT w.lead_id, w.step AS seq, w.outcome, w.result, f.email, f.applied, f.active
FROM walk w JOIN (SELECT lead_id, email, applied, active FROM walk WHERE step = 4) f USING (lead_id) WHERE step > 0""",
    leads=FILLED_LEADS, evidence=EVIDENCE, reviews=REVIEWS, origins=ORIGINS, actions=ACTIONS, walk=REVIEWED))
def evidence_review(spark, folder):
    """Four actions per field; every result occurs: cleared, restored, updated and preserved."""
    origins = derive(spark, folder, f"""
        SELECT lead_id, path, evidence_id, applied_value, CAST(NULL AS TIMESTAMP) AS applied_at, CAST(NULL AS TIMESTAMP) AS updated_at, active,
          CAST(NULL AS TIMESTAMP) AS ended_at, CAST(NULL AS STRING) AS end_reason, seq FROM ({ORIGINS})""")
    actions = derive(spark, folder, ACTIONS).withColumn("source_ref", F.lit(None).cast("string")).withColumn("reviewed_at", now())
    done = ev.review_evidence(lead_frame(spark, folder, FILLED_LEADS), evidence_frame(spark, folder), review_frame(spark, folder), origins, actions)
    fields = done["leads"].select("lead_id", "contact.email").join(
        done["origins"].select("lead_id", F.col("applied_value").alias("applied"), "active"), "lead_id")
    effects = done["effects"].select("lead_id", "seq", "result")
    return done["actions"].select("lead_id", "seq", "outcome").join(effects, ["lead_id", "seq"], "left").join(fields, "lead_id")


# ---- registry and provider facts ----

REGISTRY = """
SELECT concat('LEI', lpad(CAST(s_suppkey AS STRING), 17, '0')) AS lei, concat('Customer  GROUP-', CAST(s_suppkey AS STRING)) AS legal_name,
  concat('Customer Group ', CAST(s_suppkey + 1 AS STRING)) AS other_name, concat('J', CAST(s_nationkey % 3 AS STRING)) AS jurisdiction,
  CASE WHEN s_suppkey % 4 = 0 THEN 'LAPSED' ELSE 'ISSUED' END AS registration_status,
  CASE WHEN s_suppkey % 3 = 0 THEN 'ENTITY_SUPPLIED_ONLY' ELSE 'FULLY_CORROBORATED' END AS corroboration,
  CASE WHEN s_suppkey % 5 <> 0 THEN concat('RA-', CAST(s_suppkey AS STRING)) END AS registered_as, s_nationkey
FROM supplier
"""
COMPANIES = """
SELECT lei, legal_name, other_name, jurisdiction, registered_as, 'ROAD ' || s_nationkey || ', City, DE' AS legal_address,
  registration_status = 'ISSUED' AND corroboration = 'FULLY_CORROBORATED' AS sure, corroboration = 'FULLY_CORROBORATED' AS corroborated FROM registry
"""


def registry_frame(spark: SparkSession, folder: str) -> DataFrame:
    """Registry records in the nested shape of the bulk file."""
    nested = derive(spark, folder, f"""
        SELECT lei AS id, named_struct('lei', lei, 'entity', named_struct('legalName', named_struct('name', legal_name),
          'legalAddress', named_struct('addressLines', array(concat(' ROAD ', CAST(s_nationkey AS STRING))), 'city', 'City', 'region', '', 'postalCode',
            CAST(NULL AS STRING), 'country', 'DE'),
          'headquartersAddress', named_struct('addressLines', array('HQ'), 'city', 'City', 'region', '', 'postalCode', CAST(NULL AS STRING), 'country', 'DE'),
          'registeredAt', named_struct('id', 'RA1'), 'registeredAs', registered_as, 'jurisdiction', jurisdiction, 'status', 'ACTIVE',
          'otherNames', array(named_struct('name', other_name))),
        'registration', named_struct('status', registration_status, 'corroborationLevel', corroboration, 'lastUpdateDate', '2024-01-01',
          'validatedAt', named_struct('id', 'RA2'), 'validatedAs', CAST(NULL AS STRING))) AS attributes FROM ({REGISTRY})""")
    return nested


@query("registry_file", with_parts("""
SELECT lei, legal_name, jurisdiction, CASE WHEN sure THEN 'verified' ELSE 'inconclusive' END AS record_status, registered_as, legal_address FROM companies""",
    registry=REGISTRY, companies=COMPANIES.replace("legal_name,", "regexp_replace(legal_name, ' +', ' ', 'g') AS legal_name,", 1)))
def registry_file(spark, folder):
    """Round trip through a bulk file that holds one record per line, in several files."""
    path = work_path(spark, "registry")
    registry_frame(spark, folder).select(F.to_json(F.struct("id", "attributes")).alias("value")).repartition(5).write.text(path)
    companies = providers.registry_companies(providers.read_registry(spark, path))
    return companies.select("lei", F.regexp_replace("legal_name", " +", " ").alias("legal_name"), "jurisdiction", "record_status", "registered_as", "legal_address")



@query("registry_companies", with_parts("""
SELECT lei, legal_name, other_name AS other_names, jurisdiction, registered_as, legal_address,
  'https://api.gleif.org/api/v1/lei-records/' || lei AS source_ref, CASE WHEN sure THEN 'verified' ELSE 'inconclusive' END AS record_status FROM companies""",
    registry=REGISTRY, companies=COMPANIES))
def registry_companies(spark, folder):
    return providers.registry_companies(registry_frame(spark, folder)).select(
        "lei", "legal_name", "other_names", "jurisdiction", "registered_as", "legal_address", "source_ref", "record_status")


@query("registry_evidence", with_parts("""
SELECT lei, kind, value, confidence, CASE WHEN sure THEN 'verified' ELSE 'inconclusive' END AS status FROM (
  SELECT lei, sure, 'legal-entity-record' AS kind, legal_name AS value, CASE WHEN corroborated THEN 0.95 ELSE 0.7 END::DOUBLE AS confidence FROM companies
  UNION ALL SELECT lei, sure, 'business-registration', registered_as, CASE WHEN corroborated THEN 0.95 ELSE 0.7 END FROM companies WHERE registered_as IS NOT NULL
  UNION ALL SELECT lei, sure, 'business-status', 'ACTIVE', 0.9 FROM companies
  UNION ALL SELECT lei, sure, 'business-address', legal_address, CASE WHEN corroborated THEN 0.9 ELSE 0.65 END FROM companies)""",
    registry=REGISTRY, companies=COMPANIES))
def registry_evidence(spark, folder):
    return providers.registry_evidence(providers.registry_companies(registry_frame(spark, folder)), now()).select(
        "lei", "kind", "value", "confidence", "status")


@query("registry_match", with_parts("""
, names AS (SELECT DISTINCT lei, legal_name, jurisdiction, sure, regexp_replace(lower(n), '[^a-z0-9]', '', 'g') AS k
  FROM (SELECT *, legal_name AS n FROM companies UNION ALL SELECT *, other_name FROM companies)),
wanted AS (SELECT lead_id, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS k,
  CASE WHEN ordinal % 2 = 0 THEN 'J' || ordinal % 3 END AS j FROM leads WHERE name IS NOT NULL),
hits AS (SELECT w.lead_id, n.lei, n.legal_name, n.sure, row_number() OVER (PARTITION BY w.lead_id ORDER BY n.sure DESC, n.lei) AS position
  FROM wanted w JOIN names n ON n.k = w.k AND (w.j IS NULL OR w.j = n.jurisdiction))
SELECT lead_id, position, lei, legal_name, CASE WHEN sure THEN 'verified' ELSE 'inconclusive' END AS record_status FROM hits WHERE position <= 10""",
    leads=LEADS, registry=REGISTRY, companies=COMPANIES).replace("\n, names", ", names", 1))
def registry_match(spark, folder):
    leads = lead_frame(spark, folder).select(
        "lead_id", "organization.name", F.when(F.col("ordinal") % 2 == 0, F.concat(F.lit("j"), (F.col("ordinal") % 3).cast("string"))).alias(
            "jurisdiction"))
    return providers.match_registry(leads, providers.registry_companies(registry_frame(spark, folder)))


@query("extraction_evidence", """
SELECT url, kind, value, 0.65::DOUBLE AS confidence FROM (
  SELECT 'https://s' || s_suppkey || '.example' AS url, 'organization-name' AS kind, s_name AS value FROM supplier
  UNION ALL SELECT 'https://s' || s_suppkey || '.example', 'business-address', 'Road ' || s_nationkey FROM supplier WHERE s_suppkey % 2 = 0
  UNION ALL SELECT 'https://s' || s_suppkey || '.example', 'manufacturing-capability', 'press line' FROM supplier WHERE s_suppkey % 3 = 0)""")
def extraction_evidence(spark, folder):
    rows = table(spark, folder, "supplier").select(
        F.concat(F.lit("https://s"), "s_suppkey", F.lit(".example")).alias("url"),
        F.create_map(
            F.lit("companyName"), F.col("s_name"),
            F.lit("address"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Road "), "s_nationkey")).otherwise(""),
            F.lit("manufacturingCapability"), F.when(F.col("s_suppkey") % 3 == 0, F.lit("press line")),
            F.lit("note"), F.lit("not a known field")).alias("content"))
    return providers.extraction_evidence(rows, now()).select("url", "kind", "value", "confidence")


@query("verification_evidence", """
SELECT lower('User' || c_custkey || '@d' || c_nationkey || '.example') AS value, 'email-sleuth:d' || c_nationkey || '.example' AS source_ref,
  CASE c_custkey % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'rejected' WHEN 2 THEN 'inconclusive' ELSE 'candidate' END AS status,
  CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 4 = 0 THEN 0.8 ELSE 0.5 END WHEN c_custkey % 3 = 1 THEN 0.72 ELSE 0.25 END::DOUBLE AS confidence
FROM customer""")
def verification_evidence(spark, folder):
    rows = table(spark, folder, "customer").select(
        F.concat(F.lit("User"), "c_custkey", F.lit("@d"), "c_nationkey", F.lit(".example")).alias("email"),
        F.lit(None).cast("string").alias("domain"),
        F.element_at(F.array(*[F.lit(s) for s in ("Deliverable", "invalid", "catch_all", "odd")]), (F.col("c_custkey") % 4 + 1).cast("int")).alias("status"),
        F.when(F.col("c_custkey") % 3 == 1, F.lit("72")).when(F.col("c_custkey") % 3 == 2, F.lit("0.25")).alias("confidence"))
    return providers.verification_evidence(rows, now()).select("value", "source_ref", "status", "confidence")


DNS = """
SELECT concat('d', CAST(s_suppkey AS STRING), '.example') AS domain, rrtype,
  CASE WHEN s_suppkey % 7 = 3 THEN 'NXDOMAIN' WHEN s_suppkey % 7 = 4 AND rrtype <> 'MX' THEN 'SERVFAIL' WHEN s_suppkey % 7 = 5 AND rrtype = 'MX' THEN 'TIMEOUT'
    WHEN rrtype = 'MX' AND s_suppkey % 7 IN (2, 4, 6) THEN 'NODATA' WHEN rrtype <> 'MX' AND s_suppkey % 7 = 6 THEN 'NODATA' ELSE 'NOERROR' END AS rcode,
  priority, CASE WHEN rrtype <> 'MX' THEN NULL WHEN s_suppkey % 7 = 1 THEN '.' ELSE concat('mx', CAST(priority AS STRING), '.example.') END AS exchange
FROM (SELECT s_suppkey, priority, CASE priority WHEN 0 THEN 'A' WHEN 5 THEN 'AAAA' ELSE 'MX' END AS rrtype
  FROM (SELECT s_suppkey, each_of(20, 10, 0, 5) AS priority FROM supplier) x) a
"""
DOMAINS = """
SELECT 'd' || s_suppkey || '.example' AS domain, CASE s_suppkey % 7 WHEN 0 THEN 'mx-found' WHEN 1 THEN 'no-mail-route' WHEN 2 THEN 'address-fallback'
  WHEN 3 THEN 'no-mail-route' WHEN 4 THEN 'inconclusive' WHEN 5 THEN 'inconclusive' ELSE 'no-mail-route' END AS domain_status, s_suppkey FROM supplier
"""


@query("mail_domains", with_parts("""
SELECT domain, domain_status, CASE WHEN s_suppkey % 7 = 0 THEN 'mx10.example,mx20.example' ELSE '' END AS exchanges,
  CASE WHEN s_suppkey % 7 = 2 THEN 2 ELSE 0 END::BIGINT AS address_records, 'dns-mx:' || domain AS source_ref,
  CASE domain_status WHEN 'mx-found' THEN 'verified' WHEN 'no-mail-route' THEN 'rejected' ELSE 'inconclusive' END AS status,
  CASE s_suppkey % 7 WHEN 0 THEN 0.95 WHEN 1 THEN 0.9 WHEN 2 THEN 0.55 WHEN 3 THEN 0.9 WHEN 4 THEN 0.7 WHEN 5 THEN 0.3 ELSE 0.7 END::DOUBLE AS confidence
FROM domains""", domains=DOMAINS))
def mail_domains(spark, folder):
    return providers.mail_domains(derive(spark, folder, DNS))


FETCH_LOG = """
SELECT concat('https://s', CAST(s_suppkey AS STRING), '.example/') AS requested, h.hop AS hop, concat('https://www.s', CAST(s_suppkey AS STRING), '.example/', CAST(h.hop AS STRING)) AS url,
  CASE WHEN s_suppkey % 8 = 1 AND h.hop = 0 THEN 301 WHEN s_suppkey % 8 = 2 THEN 302 WHEN s_suppkey % 8 = 3 THEN 403 WHEN s_suppkey % 8 = 6 THEN 302 ELSE 200 END AS status,
  CASE WHEN s_suppkey % 8 = 1 THEN concat('https://www.s', CAST(s_suppkey AS STRING), '.example/next') WHEN s_suppkey % 8 = 2 THEN 'https://tracker.example.net/x'
    WHEN s_suppkey % 8 = 6 THEN '/again' END AS location,
  CASE WHEN s_suppkey % 8 = 4 THEN 'application/pdf' ELSE 'Text/HTML; charset=utf-8' END AS content_type,
  CASE WHEN s_suppkey % 8 = 5 THEN 1000001 ELSE 5000 END AS bytes
FROM (SELECT s_suppkey, each_of(0, 1, 2, 3) AS hop FROM supplier) h
"""


@query("fetch_outcomes", """
SELECT 'https://s' || s_suppkey || '.example/' AS requested, CASE s_suppkey % 8 WHEN 0 THEN 'read' WHEN 1 THEN 'read' WHEN 2 THEN 'other-site'
  WHEN 3 THEN 'http-403' WHEN 4 THEN 'not-text' WHEN 5 THEN 'too-large' WHEN 6 THEN 'too-many-redirects' ELSE 'read' END AS outcome,
  'https://www.s' || s_suppkey || '.example/' || CASE s_suppkey % 8 WHEN 1 THEN 1 WHEN 6 THEN 3 ELSE 0 END AS final_url,
  CASE s_suppkey % 8 WHEN 1 THEN 1 WHEN 6 THEN 3 ELSE 0 END::BIGINT AS redirects FROM supplier""")
def fetch_outcomes(spark, folder):
    return providers.fetch_outcomes(derive(spark, folder, FETCH_LOG))


