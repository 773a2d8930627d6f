"""Queries: normalisation, score, grades, work list, import profile."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom import model
from leadloom.operators import leads as shape, relationships, scoring
from leadloom.plans.base import (
    LEADS, QUALIFIED_PARTS, derive, evidence_frame, lead_frame, query, review_frame, table, with_parts)
from leadloom.session import work_path
from leadloom.sources import documents, inquiry_csv


def qualified(spark: SparkSession, folder: str) -> DataFrame:
    effective = scoring.effective_evidence(evidence_frame(spark, folder), review_frame(spark, folder))
    return scoring.qualify(lead_frame(spark, folder), effective)


@query("lead_qualification", with_parts("""
SELECT lead_id, score, grade, evidence_quality, demand_clarity, buying_readiness, contactability_trust, reasons, missing,
  CASE grade WHEN 'HOLD' THEN 'resolve-hold' WHEN 'A' THEN 'review-within-24h' WHEN 'C' THEN 'nurture' WHEN 'D' THEN 'keep-record'
    ELSE 'fill-evidence:' || CASE WHEN all_missing = '' THEN 'timeline,contact-role'
      ELSE array_to_string(string_split(all_missing, ',')[1:2], ',') END END AS next_action
FROM qualified""", **QUALIFIED_PARTS))
def lead_qualification(spark, folder):
    return qualified(spark, folder)


@query("grade_histogram", with_parts("""
SELECT g.grade, count(q.lead_id) AS leads FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('HOLD')) g(grade)
LEFT JOIN qualified q ON q.grade = g.grade GROUP BY g.grade UNION ALL SELECT 'ALL', count(*) FROM qualified""",
    **QUALIFIED_PARTS))
def grade_histogram(spark, folder):
    return scoring.grade_histogram(qualified(spark, folder))


@query("effective_evidence", with_parts(
    "SELECT lead_id, evidence_id, kind, status FROM effective", **QUALIFIED_PARTS))
def effective_evidence(spark, folder):
    out = scoring.effective_evidence(evidence_frame(spark, folder), review_frame(spark, folder))
    return out.select("lead_id", "evidence_id", "kind", "status")


RAW_LEADS = """
SELECT doc_id, CAST(doc_id AS STRING) AS ordinal_text, concat('  ', source, '\t') AS raw_source, lang,
  CASE WHEN doc_id % 3 = 0 THEN '   ' ELSE concat(' REF ', CAST(doc_id AS STRING), ' ') END AS reference, text,
  CASE doc_id % 6 WHEN 0 THEN 'TRUE' WHEN 1 THEN ' yes ' WHEN 2 THEN 'no' WHEN 3 THEN '1' WHEN 4 THEN 'Y' ELSE '' END AS replied
FROM documents
"""


@query("lead_normalization", with_parts("""
SELECT doc_id AS ordinal, source, reference, domain, md5(message) AS message_hash, length(message) AS message_length, replied,
  'lead_' || left(sha256(concat_ws('|', source, coalesce(reference, ''), 'Company ' || lang, '', coalesce(message, ''))), 32) AS lead_id
FROM (SELECT *, CASE WHEN trim(raw_source, e' \\t') = '' THEN 'manual' ELSE trim(raw_source, e' \\t') END AS source, nullif(trim(given_reference), '') AS reference,
    lower(trim(raw_source || '.example', e' \\t')) AS domain, nullif(trim(text, e' \\t\\n\\r'), '') AS message, lower(trim(given_reply)) IN ('1', 'true', 'yes', 'y') AS replied
  FROM (SELECT doc_id, raw_source, lang, reference AS given_reference, text, replied AS given_reply FROM raw))""", raw=RAW_LEADS))
def lead_normalization(spark, folder):
    raw = derive(spark, folder, RAW_LEADS)
    nothing = F.lit(None).cast("string")
    given = {"name": F.concat(F.lit("Company "), "lang"), "domain": F.concat("raw_source", F.lit(".example"))}
    shaped = raw.select(
        nothing.alias("lead_id"), F.col("raw_source").alias("source"), F.col("reference").alias("source_reference"),
        nothing.alias("received_at"),
        F.struct(*[given.get(n, nothing).alias(n) for n in model.ORGANIZATION_FIELDS]).alias("organization"),
        F.struct(*[nothing.alias(n) for n in model.CONTACT_FIELDS]).alias("contact"),
        F.struct(*[(F.col("text") if n == "message" else nothing).alias(n) for n in model.INQUIRY_FIELDS]).alias("inquiry"),
        F.struct(*[(F.col("replied") if n == "replied" else nothing).alias(n) for n in model.SIGNAL_FIELDS]).alias("signals"),
        F.struct(*[nothing.alias(n) for n in ("do_not_contact", "restricted_market", "duplicate_of", "consent_status")]).alias(
            "compliance"), nothing.alias("notes"), F.col("doc_id").alias("ordinal"))
    out = shape.normalize_leads(shaped)
    return out.select("ordinal", "source", F.col("source_reference").alias("reference"), "organization.domain", F.md5("inquiry.message").alias("message_hash"),
                      F.length("inquiry.message").alias("message_length"), "signals.replied", "lead_id")


@query("lead_ids_interchange", """
WITH seeds AS (
  SELECT c_custkey, concat_ws('|', 'manual', '', c_name, '', c_mktsegment) AS seed FROM customer),
hashed AS (
  SELECT c_custkey, list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split(seed, ''), lambda x: unicode(x)::UBIGINT)),
      lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS forward,
    list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split(reverse(seed), ''), lambda x: unicode(x)::UBIGINT)),
      lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS backward FROM seeds)
SELECT c_custkey, 'lead_' || left(lower(lpad(to_hex(forward), 8, '0') || lpad(to_hex(backward), 8, '0')), 12) AS lead_id
FROM hashed""")
def lead_ids_interchange(spark, folder):
    empty = F.lit("")
    return table(spark, folder, "customer").select("c_custkey", shape.lead_id(
        F.lit("manual"), empty, F.col("c_name"), empty, F.col("c_mktsegment"), interchange=True).alias("lead_id"))


@query("lead_repeats", """
SELECT 'lead_' || left(sha256(concat_ws('|', source, '', lang, '', text_head)), 32) AS lead_id, count(*) AS occurrences,
  arg_max(doc_id, doc_id) AS last_ordinal
FROM (SELECT source, lang, doc_id, lpad(CAST(n_chars % 10 AS STRING), 2, '0') AS text_head FROM documents) GROUP BY ALL""")
def lead_repeats(spark, folder):
    docs = table(spark, folder, "documents").withColumn("head", F.lpad((F.col("n_chars") % 10).cast("string"), 2, "0"))
    keyed = docs.select(shape.lead_id(F.col("source"), F.lit(""), F.col("lang"), F.lit(""), F.col("head")).alias("lead_id"),
                        F.col("doc_id").alias("ordinal"), "source")
    merged = shape.distinct_leads(keyed)
    return merged.select("lead_id", "occurrences", F.col("ordinal").alias("last_ordinal"))


PROFILE_ROWS = """
SELECT c_custkey AS ordinal, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS c0,
  CASE WHEN c_custkey % 3 = 0 THEN concat('Alt ', c_mktsegment) ELSE '' END AS c1, c_mktsegment AS c2,
  CASE WHEN c_custkey % 5 = 0 THEN concat('R', CAST(c_nationkey AS STRING)) ELSE '' END AS c3, CAST(c_acctbal AS STRING) AS c4
FROM customer
"""
PROFILE_HEADERS = ["Company", "公司名称", "Product Name", "Inquiry No", "Balance"]


@query("import_columns", with_parts("""
, cells AS (
  SELECT 0 AS position, 'Company' AS header, 'company_name' AS field, 'duplicate-target' AS status, ordinal, c0 AS v FROM rows0
  UNION ALL SELECT 1, '公司名称', 'company_name', 'duplicate-target', ordinal, c1 FROM rows0
  UNION ALL SELECT 2, 'Product Name', 'product', 'mapped', ordinal, c2 FROM rows0
  UNION ALL SELECT 3, 'Inquiry No', 'source_reference', 'mapped', ordinal, c3 FROM rows0),
firsts AS (
  SELECT position, v, min(ordinal) AS first_seen FROM cells WHERE v <> '' GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY first_seen) AS rn FROM firsts)
SELECT c.position::BIGINT AS position, c.header, c.field, c.status, count(*) FILTER (v <> '') AS populated_rows,
  (SELECT string_agg(v, ',' ORDER BY first_seen) FROM ranked r WHERE r.position = c.position AND rn <= 2) AS samples
FROM cells c GROUP BY c.position, c.header, c.field, c.status""", rows0=PROFILE_ROWS).replace("\n, cells", ", cells", 1))
def import_columns(spark, folder):
    rows = derive(spark, folder, PROFILE_ROWS).drop("c4")
    review = inquiry_csv.review_import(rows, inquiry_csv.map_headers(PROFILE_HEADERS[:4]))
    return review.columns.drop("explicit")


@query("import_summary", with_parts("""
SELECT count(*) AS row_count, count(*) FILTER (usable) AS usable_rows,
  count(*) FILTER (usable AND c3 = '') AS missing_reference_rows, count(*) FILTER (usable AND c2 = '') AS missing_inquiry_rows,
  count(*) FILTER (usable AND c0 = '' AND c1 = '') AS missing_organization_rows, count(*) FILTER (usable) AS missing_contact_rows,
  'Balance' AS unmapped_headers, 'company_name' AS duplicate_targets, '' AS errors,
  concat_ws(',', 'unmapped-columns', 'duplicate-targets', 'no-source',
    CASE WHEN bool_or(usable AND c3 = '') THEN 'missing-reference' END, CASE WHEN bool_or(usable AND c2 = '') THEN 'missing-inquiry' END,
    CASE WHEN bool_or(usable AND c0 = '' AND c1 = '') THEN 'missing-organization' END, 'missing-contact') AS warnings, TRUE AS can_import
FROM (SELECT *, c0 <> '' OR c1 <> '' OR c2 <> '' OR c3 <> '' AS usable FROM rows0)""", rows0=PROFILE_ROWS))
def import_summary(spark, folder):
    rows = derive(spark, folder, PROFILE_ROWS)
    review = inquiry_csv.review_import(rows, inquiry_csv.map_headers(PROFILE_HEADERS))
    return review.summary.select(
        "row_count", "usable_rows", "missing_reference_rows", "missing_inquiry_rows", "missing_organization_rows",
        "missing_contact_rows", "unmapped_headers", "duplicate_targets", "errors", "warnings", "can_import")


CSV_SOURCE = """
SELECT c_custkey, concat('INQ-', CAST(c_custkey AS STRING)) AS `Inquiry No`, c_name AS `公司名称`,
  CASE WHEN c_custkey % 2 = 0 THEN concat('https://s', CAST(c_custkey AS STRING), '.example') ELSE '' END AS website,
  CASE WHEN c_custkey % 4 = 0 THEN 'verified' ELSE 'candidate' END AS website_status,
  concat('Need "', c_mktsegment, '", soon') AS message
FROM customer
"""


@query("csv_leads", """
SELECT 'INQ-' || c_custkey AS source_reference, 'Alibaba' AS source, c_name AS name, 'Need "' || c_mktsegment || '", soon' AS message,
  TRUE AS explicit_inquiry, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS evidence_rows,
  CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 1 END::BIGINT AS verified_rows FROM customer""")
def csv_leads(spark, folder):
    """Round trip through CSV files: write, read, map headers, build leads and their evidence."""
    path = work_path(spark, "inquiries")
    derive(spark, folder, CSV_SOURCE).drop("c_custkey").write.option("header", True).option("escape", '"').csv(path)
    tables = inquiry_csv.read_leads(spark, path, "alibaba", multiline=False)
    counts = tables.evidence.groupBy("lead_id").agg(
        F.count(F.lit(1)).alias("evidence_rows"), F.count_if(F.col("status") == "verified").alias("verified_rows"))
    return tables.leads.join(counts, "lead_id").select(
        "source_reference", "source", "organization.name", "inquiry.message", "signals.explicit_inquiry", "evidence_rows",
        "verified_rows")


@query("lead_display_names", with_parts("""
SELECT lead_id, coalesce(name, contact_name, source_reference, lead_id) AS display_name FROM leads""", leads=LEADS))
def lead_display_names(spark, folder):
    leads = lead_frame(spark, folder)
    return leads.select("lead_id", shape.display_name(
        F.col("organization.name"), F.col("contact.name"), F.col("source_reference"), F.col("lead_id")).alias("display_name"))


@query("event_labels", """
SELECT event_type, count(*) AS events, CASE event_type WHEN 'view' THEN '已联系客户' WHEN 'click' THEN '收到客户回复'
  WHEN 'signup' THEN '已发送报价' WHEN 'purchase' THEN '确认成交' ELSE '确认流失' END AS label FROM events GROUP BY event_type""")
def event_labels(spark, folder):
    kinds = {"view": "contact-attempted", "click": "buyer-replied", "signup": "quote-sent", "purchase": "won", "error": "lost"}
    labels = model.label_table(spark, {k: model.EVENT_LABELS[v] for k, v in kinds.items()})
    counts = table(spark, folder, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))
    # Five labels.
    return counts.join(F.broadcast(labels), counts.event_type == labels.code).select("event_type", "events", "label")




JSON_LEADS = """
SELECT concat('J', CAST(c_custkey AS STRING)) AS id, CASE WHEN c_custkey % 3 = 0 THEN 'fair' ELSE ' web ' END AS source, c_custkey,
  named_struct('name', c_name, 'domain', concat('D', CAST(c_custkey AS STRING), '.example')) AS organization,
  named_struct('message', concat('Line one of ', c_mktsegment, '\\nand "two"')) AS inquiry,
  named_struct('replied', c_custkey % 2 = 0) AS signals FROM customer
"""


def written_lines(spark, rows, name: str, files: int = 4) -> str:
    """The rows as JSON, one record per line, in several files."""
    path = work_path(spark, name)
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).repartition(files).write.text(path)
    return path


@query("json_leads", """
SELECT 'J' || c_custkey AS lead_id, CASE WHEN c_custkey % 3 = 0 THEN 'fair' ELSE 'web' END AS source, c_name AS name, 'd' || c_custkey || '.example' AS domain,
  md5('Line one of ' || c_mktsegment || chr(10) || 'and "two"') AS message_hash, c_custkey % 2 = 0 AS replied FROM customer""")
def json_leads(spark, folder):
    """Round trip through files that hold one lead per line."""
    rows = derive(spark, folder, JSON_LEADS).drop("c_custkey").withColumn(
        "inquiry", F.struct(F.replace("inquiry.message", F.lit("\\n"), F.lit("\n")).alias("message")))
    leads = documents.read_lead_documents(spark, written_lines(spark, rows, "json-leads")).leads
    return leads.select("lead_id", "source", "organization.name", "organization.domain", F.md5("inquiry.message").alias("message_hash"), "signals.replied")


@query("relationship_files", """
SELECT 'S' || s_suppkey AS connector_id, s_name AS connector_name, s_suppkey % 6 AS strength, CASE WHEN s_suppkey % 2 = 0 THEN 'a,b' ELSE 'm' || s_suppkey END AS evidence_ids FROM supplier""")
def relationship_files(spark, folder):
    """Round trip of relationship rows, half of them through JSON lines and half through CSV files."""
    rows = table(spark, folder, "supplier").select(
        "s_suppkey", F.concat(F.lit("S"), "s_suppkey").alias("connector_id"), F.col("s_name").alias("connector_name"),
        (F.col("s_suppkey") % 6).cast("string").alias("relationship_strength"),
        F.when(F.col("s_suppkey") % 2 == 0, "a|b").otherwise(F.concat(F.lit("m"), "s_suppkey")).alias("evidence_ids"))
    lines = rows.where("s_suppkey % 4 < 2").drop("s_suppkey").withColumnRenamed("evidence_ids", "evidenceIds")
    listed = lines.withColumn("evidenceIds", F.split("evidenceIds", "[|]"))
    path = work_path(spark, "relationships")
    rows.where("s_suppkey % 4 >= 2").drop("s_suppkey").repartition(3).write.option("header", True).csv(path)
    both = documents.read_paths_json(spark, written_lines(spark, listed, "relationships")).unionByName(
        documents.read_paths_csv(spark, path).drop("ordinal"), allowMissingColumns=True)
    paths = relationships.normalize_paths(both)
    return paths.select("connector_id", "connector_name", F.col("relationship_strength").cast("long").alias("strength"), "evidence_ids")
