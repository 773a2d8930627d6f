"""Registry of the queries over the given tables and the inputs they derive from them.

The given tables hold no inquiries, so the lead tables are derived with the SQL below. It runs unchanged in
Spark (as the queries' input) and in DuckDB (as the first step of the comparison SQL).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom import model
from leadloom.session import plan_session, ship

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages",
          "benchmark", "labels", "conversations")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_views: dict[tuple[int, str], str] = {}  # by plan session and table
EACH = re.compile(r"each_of\(([^)]*)\)")  # one row per listed value, in either engine's words


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, the statement its result is compared with."""
    def register(build: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return scalar_columns(build(plan_session(spark), folder))
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return build
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def derive(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """Run derivation SQL over the tables it names, as views of the plan session alone."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql) and _views.get((id(spark), name)) != folder:
            table(spark, folder, name).createOrReplaceTempView(name)
            _views[id(spark), name] = folder
    return spark.sql(EACH.sub(r"explode(array(\1))", sql))


def scalar_columns(df: DataFrame) -> DataFrame:
    """Lists as text, whole numbers as bigint, decimals as double, times as text: easy to compare anywhere."""
    def plain(field: T.StructField):
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.ArrayType):
            return F.array_join(c, ",").alias(field.name)
        if isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            return c.cast("bigint").alias(field.name)
        if isinstance(kind, T.DecimalType):
            return c.cast("double").alias(field.name)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(field.name)
        return c
    return df.select(*[plain(f) for f in df.schema.fields])


def with_parts(body: str, **parts: str) -> str:
    """A statement with the given parts as common table expressions."""
    steps = ",\n".join(f"{name} AS ({sql})" for name, sql in parts.items())
    return EACH.sub(r"unnest([\1])", f"WITH RECURSIVE {steps}\n{body}")


def time_text(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


# ---- derived lead tables ----

def _lead(key: str) -> str:
    return f"concat('L', lpad(CAST({key} AS STRING), 9, '0'))"


LEADS = f"""
SELECT {_lead('c.c_custkey')} AS lead_id, c.c_custkey AS ordinal, c.c_mktsegment AS source,
  CASE WHEN c.c_custkey % 7 <> 0 THEN concat('REF-', CAST(CAST(floor(c.c_custkey / 2) AS BIGINT) AS STRING)) END AS source_reference,
  CASE WHEN c.c_custkey % 41 <> 0 THEN concat('Customer Group ', CAST(CAST(floor(c.c_custkey / 8) AS BIGINT) AS STRING)) END AS name,
  CASE WHEN c.c_custkey % 41 = 0 THEN NULL WHEN c.c_custkey % 3 = 0 THEN 'platform.example'
       WHEN c.c_custkey % 5 <> 0 THEN concat('www.d', CAST(CAST(floor(c.c_custkey / 4) AS BIGINT) AS STRING), '.example') END AS domain,
  CASE WHEN c.c_custkey % 41 <> 0 AND c.c_custkey % 2 = 1
       THEN concat('https://D', CAST(CAST(floor(c.c_custkey / 4) AS BIGINT) AS STRING), '.example/about') END AS website,
  n.n_name AS country,
  CASE WHEN c.c_custkey % 2 = 0 THEN concat('REG-', CAST(CAST(floor(c.c_custkey / 6) AS BIGINT) AS STRING)) END AS registration_id,
  CASE WHEN c.c_custkey % 6 = 1 THEN 'own line' END AS factory_info,
  CASE WHEN c.c_custkey % 3 <> 0 THEN c.c_name END AS contact_name,
  CASE WHEN c.c_custkey % 4 <> 0 THEN 'buyer' END AS contact_role,
  CASE WHEN c.c_custkey % 5 <> 4 THEN concat('c', CAST(c.c_custkey AS STRING), '@mail.example') END AS email,
  CASE WHEN c.c_custkey % 9 = 0 THEN '+1-555-0100' END AS whatsapp,
  CASE WHEN c.c_custkey % 10 = 3 THEN '+1-555-0101' END AS phone,
  CASE WHEN o.n_orders > 0 THEN 'please quote' END AS message,
  CASE WHEN o.n_orders > 2 THEN 'widget' END AS product,
  CASE WHEN o.n_orders > 5 THEN '500' END AS quantity,
  CASE WHEN o.urgent THEN '30 days' END AS timeline,
  CASE WHEN c.c_acctbal > 5000 THEN 'USD 5' END AS budget,
  coalesce(o.n_orders > 8, FALSE) AS explicit_inquiry, coalesce(o.open_order, FALSE) AS replied,
  coalesce(o.urgent AND o.open_order, FALSE) AS requested_quote, c.c_custkey % 8 = 5 AS requested_sample,
  coalesce(o.top_price > 450000, FALSE) AS purchase_order, c.c_custkey % 12 = 1 AS mutual_introduction,
  coalesce(o.n_orders > 14, FALSE) AS prior_relationship,
  c.c_custkey % 53 = 0 AS do_not_contact, c.c_custkey % 59 = 0 AS restricted_market,
  CASE WHEN c.c_custkey % 31 = 0 AND c.c_custkey > 0 THEN {_lead('c.c_custkey - 1')} END AS duplicate_of
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, bool_or(o_orderpriority = '1-URGENT') AS urgent,
             bool_or(o_orderstatus = 'O') AS open_order, max(o_totalprice) AS top_price
           FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey
"""

EVIDENCE = f"""
SELECT {_lead('c_custkey')} AS lead_id, concat(k.prefix, CAST(c_custkey AS STRING)) AS evidence_id, k.seq AS seq, k.kind AS kind,
  CASE WHEN k.kind = 'business-email' THEN concat('Sales@d', CAST(CAST(floor(c_custkey / 3) AS BIGINT) AS STRING), '.example')
       ELSE concat(k.prefix, 'value') END AS value,
  CASE WHEN (c_custkey + k.seq) % 17 <> 0 THEN concat('https://src.example/', CAST(c_custkey AS STRING)) END AS source_ref,
  CASE WHEN (c_custkey + k.seq) % 5 < 3 THEN 'verified' WHEN (c_custkey + k.seq) % 5 = 3 THEN 'candidate' ELSE 'rejected' END AS status
FROM customer JOIN (
  SELECT CAST(1 AS BIGINT) AS seq, 'W' AS prefix, 'company-website' AS kind, 2 AS modulus UNION ALL
  SELECT 2, 'R', 'business-registration', 3 UNION ALL SELECT 3, 'F', 'factory', 4 UNION ALL
  SELECT 4, 'M', 'business-email', 2 UNION ALL SELECT 5, 'P', 'business-phone', 5) k ON (c_custkey + k.seq) % k.modulus = 0
"""

REVIEWS = f"""
SELECT {_lead('c_custkey')} AS lead_id, concat(p.prefix, CAST(c_custkey AS STRING)) AS evidence_id, p.seq AS seq,
  p.decision AS action, p.decision AS decision
FROM customer JOIN (
  SELECT 'W' AS prefix, CAST(1 AS BIGINT) AS seq, 'rejected' AS decision, 10 AS modulus UNION ALL
  SELECT 'W', 2, 'accepted', 20 UNION ALL SELECT 'M', 1, 'rejected', 14) p ON c_custkey % p.modulus = 0
"""

ORDER_DAY = "o_orderdate"


def _group(name: str, fields: tuple[str, ...], columns: dict[str, str]) -> str:
    parts = ", ".join(f"'{f}', {columns.get(f, f)}" for f in fields)
    return f"named_struct({parts}) AS {name}"


NESTED = ", ".join((
    "lead_id, source, source_reference, CAST(NULL AS TIMESTAMP) AS received_at",
    _group("organization", model.ORGANIZATION_FIELDS, {n: "CAST(NULL AS STRING)" for n in (
        "address", "industry", "employee_range")}),
    _group("contact", model.CONTACT_FIELDS, {"name": "contact_name", "role": "contact_role"}),
    _group("inquiry", model.INQUIRY_FIELDS, {}), _group("signals", model.SIGNAL_FIELDS, {}),
    _group("compliance", ("do_not_contact", "restricted_market", "duplicate_of", "consent_status"), {
        "consent_status": "'unknown'"}),
    "CAST(NULL AS STRING) AS notes, ordinal",
))


def lead_frame(spark: SparkSession, folder: str, sql: str = LEADS) -> DataFrame:
    """The derived leads in the nested shape of the data model."""
    return derive(spark, folder, f"SELECT {NESTED} FROM ({sql})")


def evidence_frame(spark: SparkSession, folder: str) -> DataFrame:
    return derive(spark, folder, f"""
        SELECT lead_id, evidence_id, seq, kind, value, source_ref, CAST(NULL AS TIMESTAMP) AS observed_at,
          CAST(0.5 AS DOUBLE) AS confidence, status, CAST(NULL AS STRING) AS note FROM ({EVIDENCE})""")


def review_frame(spark: SparkSession, folder: str) -> DataFrame:
    return derive(spark, folder, f"""
        SELECT lead_id, evidence_id, seq, action, decision, CAST(NULL AS TIMESTAMP) AS reviewed_at, 'derived review' AS note,
          CAST(NULL AS MAP<STRING, STRUCT<`from`: STRING, `to`: STRING>>) AS changes FROM ({REVIEWS})""")


# ---- the same steps for DuckDB ----

EFFECTIVE = """
SELECT e.* FROM evidence e LEFT JOIN (
  SELECT lead_id, evidence_id, arg_max(decision, seq) AS decision FROM reviews GROUP BY ALL) r
USING (lead_id, evidence_id) WHERE r.decision IS DISTINCT FROM 'rejected'
"""

QUALIFIED = """
SELECT lead_id, CASE WHEN holds <> '' THEN 0 ELSE eq + dc + br + ct END AS score,
  CASE WHEN holds <> '' THEN 'HOLD' WHEN eq + dc + br + ct >= 75 THEN 'A' WHEN eq + dc + br + ct >= 55 THEN 'B'
       WHEN eq + dc + br + ct >= 35 THEN 'C' ELSE 'D' END AS grade,
  CASE WHEN holds = '' THEN eq END AS evidence_quality, CASE WHEN holds = '' THEN dc END AS demand_clarity,
  CASE WHEN holds = '' THEN br END AS buying_readiness, CASE WHEN holds = '' THEN ct END AS contactability_trust,
  CASE WHEN holds <> '' THEN holds ELSE reasons END AS reasons, CASE WHEN holds <> '' THEN '' ELSE missing END AS missing,
  missing AS all_missing
FROM (
  SELECT l.lead_id,
    concat_ws(',', CASE WHEN do_not_contact THEN 'do-not-contact' END, CASE WHEN restricted_market THEN 'restricted-market' END,
      CASE WHEN duplicate_of IS NOT NULL THEN 'duplicate-of-master' END,
      CASE WHEN coalesce(name, domain, website, source_reference) IS NULL THEN 'no-identity' END) AS holds,
    least(25, CASE WHEN source_reference IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN site THEN 8 ELSE 0 END
      + CASE WHEN registered THEN 7 ELSE 0 END
      + CASE WHEN plant THEN 5 WHEN factory_info IS NOT NULL THEN 2 ELSE 0 END)::BIGINT AS eq,
    least(25, CASE WHEN message IS NOT NULL THEN 4 ELSE 0 END + CASE WHEN product IS NOT NULL THEN 7 ELSE 0 END
      + CASE WHEN quantity IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN timeline IS NOT NULL THEN 5 ELSE 0 END
      + CASE WHEN budget IS NOT NULL THEN 4 ELSE 0 END)::BIGINT AS dc,
    least(25, 6 * explicit_inquiry::INT + 4 * replied::INT + 5 * requested_quote::INT + 6 * requested_sample::INT
      + 10 * purchase_order::INT)::BIGINT AS br,
    least(25, CASE WHEN mailed THEN 8 WHEN email IS NOT NULL THEN 2 ELSE 0 END
      + CASE WHEN called THEN 7 WHEN coalesce(whatsapp, phone) IS NOT NULL THEN 2 ELSE 0 END
      + CASE WHEN contact_name IS NOT NULL AND contact_role IS NOT NULL THEN 3 ELSE 0 END
      + 7 * mutual_introduction::INT + 5 * prior_relationship::INT)::BIGINT AS ct,
    concat_ws(',', CASE WHEN source_reference IS NOT NULL THEN 'source-reference' END, CASE WHEN site THEN 'site-verified' END,
      CASE WHEN registered THEN 'registration-verified' END, CASE WHEN plant THEN 'factory-verified' END,
      CASE WHEN NOT plant AND factory_info IS NOT NULL THEN 'factory-claimed' END,
      CASE WHEN message IS NOT NULL THEN 'message' END, CASE WHEN product IS NOT NULL THEN 'product' END,
      CASE WHEN quantity IS NOT NULL THEN 'quantity' END, CASE WHEN timeline IS NOT NULL THEN 'timeline' END,
      CASE WHEN budget IS NOT NULL THEN 'budget' END, CASE WHEN explicit_inquiry THEN 'explicit-inquiry' END,
      CASE WHEN replied THEN 'replied' END, CASE WHEN requested_quote THEN 'requested-quote' END,
      CASE WHEN requested_sample THEN 'requested-sample' END, CASE WHEN purchase_order THEN 'purchase-order' END,
      CASE WHEN mailed THEN 'email-verified' END, CASE WHEN NOT mailed AND email IS NOT NULL THEN 'email-candidate' END,
      CASE WHEN called THEN 'phone-verified' END,
      CASE WHEN NOT called AND coalesce(whatsapp, phone) IS NOT NULL THEN 'phone-candidate' END,
      CASE WHEN contact_name IS NOT NULL AND contact_role IS NOT NULL THEN 'contact-role' END,
      CASE WHEN mutual_introduction THEN 'mutual-introduction' END,
      CASE WHEN prior_relationship THEN 'prior-relationship' END) AS reasons,
    concat_ws(',', CASE WHEN source_reference IS NULL THEN 'source-reference' END, CASE WHEN NOT site THEN 'website-evidence' END,
      CASE WHEN NOT registered THEN 'registration-evidence' END, CASE WHEN product IS NULL THEN 'product' END,
      CASE WHEN quantity IS NULL THEN 'quantity' END, CASE WHEN timeline IS NULL THEN 'timeline' END,
      CASE WHEN NOT (explicit_inquiry OR replied OR requested_quote OR requested_sample OR purchase_order)
           THEN 'purchase-action' END,
      CASE WHEN NOT mailed AND email IS NOT NULL THEN 'email-verification' END,
      CASE WHEN contact_name IS NULL OR contact_role IS NULL THEN 'contact-role' END) AS missing
  FROM leads l LEFT JOIN (SELECT lead_id AS flag_id, bool_or(kind IN ('company-website', 'organization-domain')) AS site0,
      bool_or(kind IN ('business-registration', 'business-status')) AS registered0,
      bool_or(kind IN ('factory', 'manufacturing-capability')) AS plant0,
      bool_or(kind IN ('business-email', 'work-email')) AS mailed0, bool_or(kind IN ('whatsapp', 'business-phone')) AS called0
    FROM effective WHERE status = 'verified' AND source_ref IS NOT NULL GROUP BY lead_id) f ON f.flag_id = l.lead_id,
    LATERAL (SELECT coalesce(site0, FALSE) AS site, coalesce(registered0, FALSE) AS registered, coalesce(plant0, FALSE) AS plant,
      coalesce(mailed0, FALSE) AS mailed, coalesce(called0, FALSE) AS called))
"""

QUALIFIED_PARTS = {"leads": LEADS, "evidence": EVIDENCE, "reviews": REVIEWS, "effective": EFFECTIVE, "qualified": QUALIFIED}
