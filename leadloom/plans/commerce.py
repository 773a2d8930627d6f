"""Queries: messages and replies, CRM, trade documents, workspace storage."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.operators import crm, governance, messages, trade
from leadloom.plans.base import QUALIFIED_PARTS, derive, evidence_frame, lead_frame, query, review_frame, table, with_parts
from leadloom.plans.evidence import NOW, now
from leadloom.plans.leads import qualified
from leadloom.operators.scoring import effective_evidence
from leadloom.session import work_path
from leadloom.sources import store

# Common words of the invented texts stand in for the business phrases.
WORDS = {
    "english": ((r"\bthe\b", 3), (r"\band\b", 2), (r"\bof\b", 2)),
    "french": ((r"\ble\b", 3), (r"\bde\b", 3)),
    "german": ((r"\bder\b", 4), (r"\bund\b", 2)),
    "numeric": ((r"\b[0-9]+\b", 1),),
}


def _score(rules) -> str:
    return " + ".join(f"CASE WHEN regexp_matches(body, '(?i){p}') THEN {w} ELSE 0 END" for p, w in rules)


CLASSED = f"""
SELECT conv_id, turn, body, {', '.join(f'{_score(r)} AS s{i}' for i, r in enumerate(WORDS.values()))} FROM (
  SELECT conv_id, turn, trim(text, e' \\t\\n') AS body FROM conversations WHERE role = 'user')
"""


@query("message_class", with_parts("""
SELECT conv_id, turn, CASE WHEN top = 0 OR top = s0 THEN 'english' WHEN top = s1 THEN 'french' WHEN top = s2 THEN 'german' ELSE 'numeric' END AS scenario_id,
  top::BIGINT AS score, round(CASE WHEN body = '' THEN 0 WHEN top = 0 THEN 0.25 ELSE least(0.98, 0.46 + top * 0.06) END, 4)::DOUBLE AS confidence
FROM (SELECT *, greatest(s0, s1, s2, s3) AS top FROM classed)""", classed=CLASSED))
def message_class(spark, folder):
    rows = table(spark, folder, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    return messages.classify_messages(rows, WORDS).select(
        "conv_id", "turn", "scenario_id", "score", F.round("confidence", 4).alias("confidence"))


PHRASES = ("interested in a catalogue", "best price FOB", "two samples please", "too expensive, target price?", "purchase order today", "deposit paid",
           "production ready date", "tracking number and ETA", "damaged and defective", "following up, any update", "hello there")
ANSWERS = ("inquiry", "quotation", "sample", "negotiation", "order", "payment", "production", "shipping", "complaint", "follow-up", "inquiry")
POINTS = (7, 10, 5, 9, 5, 7, 8, 7, 11, 9, 0)


@query("message_scenarios", "SELECT c_custkey, " + "CASE c_custkey % 11 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(ANSWERS))
       + " END AS scenario_id, CASE c_custkey % 11 " + " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(POINTS)) + " END::BIGINT AS score FROM customer")
def message_scenarios(spark, folder):
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col("c_custkey") % 11 + 1).cast("int"))
    rows = table(spark, folder, "customer").select("c_custkey", F.concat(F.lit("Dear team, "), phrase).alias("text"))
    return messages.classify_messages(rows).select("c_custkey", "scenario_id", "score")


def _reply_rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 2 == 0, "sample").otherwise("payment").alias("scenario_id"),
        F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).alias("customer_name"), F.lit(None).cast("string").alias("customer_company"),
        F.lit(" Exampleland ").alias("customer_country"), F.lit("").alias("customer_notes"), F.col("c_mktsegment").alias("text"),
        F.lit("We make  bottles").alias("industry_profile"), F.lit("Private plan").alias("company_profile"),
        F.when(F.col("c_custkey") % 5 == 0, "Sam").alias("signature"), F.when(F.col("c_custkey") % 4 == 0, "industry").otherwise("generic").alias("mode"),
        F.lit("warm").alias("tone"))


_COPY = messages.REPLY_COPY


@query("template_replies", f"""
SELECT c_custkey, concat_ws(e'\\n\\n', CASE WHEN c_custkey % 3 > 0 THEN 'Dear ' || c_name || ',' ELSE 'Hello,' END,
  CASE WHEN c_custkey % 2 = 0 THEN '{_COPY['sample'][0]}' ELSE '{_COPY['payment'][0]}' END, CASE WHEN c_custkey % 4 = 0 THEN 'Relevant background: We make bottles' END,
  CASE WHEN c_custkey % 2 = 0 THEN '{_COPY['sample'][1]}' ELSE '{_COPY['payment'][1]}' END, '{messages.TONE_LINES['warm']}',
  CASE WHEN c_custkey % 5 = 0 THEN e'Best regards,\\nSam' ELSE 'Best regards,' END) AS reply FROM customer""")
def template_replies(spark, folder):
    return messages.template_replies(_reply_rows(spark, folder)).select("c_custkey", "reply")


@query("reply_prompts", """
SELECT c_custkey, concat_ws(e'\\n\\n', CASE WHEN c_custkey % 2 = 0 THEN 'Detected stage: 样品 (sample)' ELSE 'Detected stage: 付款 (payment)' END,
  e'Customer message:\\n' || c_mktsegment, e'Customer profile:\\n' || CASE WHEN c_custkey % 3 > 0 THEN 'Contact: ' || c_name || e'\\n' ELSE '' END || 'Market: Exampleland',
  CASE WHEN c_custkey % 4 = 0 THEN 'Relevant background: We make bottles' ELSE 'No additional business background was selected.' END,
  CASE WHEN c_custkey % 5 = 0 THEN e'Signature:\\nSam' ELSE 'No signature was provided.' END) AS user_message, 2::BIGINT AS parts FROM customer""")
def reply_prompts(spark, folder):
    prompts = messages.reply_prompts(_reply_rows(spark, folder))
    return prompts.select("c_custkey", F.col("messages")[1]["content"].alias("user_message"), F.size("messages").alias("parts"))


@query("completion_texts", """
SELECT conv_id, turn, nullif(trim(text, e' \\t\\n'), '') AS content, CASE WHEN trim(text, e' \\t\\n') = '' THEN 'no-content' END AS refusal FROM conversations WHERE role = 'assistant'""")
def completion_texts(spark, folder):
    rows = table(spark, folder, "conversations").where("role = 'assistant'")
    payload = F.to_json(F.struct(F.array(F.struct(F.struct("role", F.col("text").alias("content")).alias("message"))).alias("choices")))
    return messages.completion_text(rows.select("conv_id", "turn", payload.alias("payload"))).select("conv_id", "turn", "content", "refusal")


# ---- CRM ----

# Customers known before the import: two of three leads. Some were edited by hand after the last import.
KNOWN = """
SELECT concat('L', lpad(CAST(c_custkey AS STRING), 9, '0')) AS customer_id, CASE WHEN c_custkey % 4 = 0 THEN 'Edited name' ELSE 'Old contact' END AS name,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'Old company' END AS company, 'Old country' AS country,
  CASE WHEN c_custkey % 6 = 1 THEN 'manual@x.example' ELSE 'old@x.example' END AS email, '' AS whatsapp,
  CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'old note' END AS notes, c_custkey FROM customer WHERE c_custkey % 3 <> 0
"""


def customer_frame(spark: SparkSession, folder: str) -> DataFrame:
    return derive(spark, folder, f"""
        SELECT customer_id, name, company, country, email, whatsapp, notes, CAST(NULL AS {crm.PROFILE_DDL}) AS profile,
          map('name', 'Old contact', 'company', 'Old company', 'email', 'old@x.example') AS managed,
          TIMESTAMP '2023-01-01 00:00:00' AS created_at, TIMESTAMP '2023-06-01 00:00:00' AS updated_at FROM ({KNOWN})""")


def _incoming(spark: SparkSession, folder: str) -> DataFrame:
    leads, effective = lead_frame(spark, folder), effective_evidence(evidence_frame(spark, folder), review_frame(spark, folder))
    return crm.import_rows(leads, qualified(spark, folder), effective, now())


MERGED = """
SELECT l.lead_id AS customer_id, CASE WHEN k.customer_id IS NULL OR k.name = 'Old contact' THEN coalesce(l.contact_name, '') ELSE k.name END AS name,
  CASE WHEN k.customer_id IS NULL OR k.company IN ('', 'Old company') THEN coalesce(l.name, '') ELSE k.company END AS company,
  CASE WHEN k.customer_id IS NULL THEN l.country ELSE k.country END AS country,
  CASE WHEN k.customer_id IS NULL OR k.email = 'old@x.example' THEN coalesce(l.email, '') ELSE k.email END AS email, coalesce(l.whatsapp, '') AS whatsapp,
  CASE WHEN coalesce(k.notes, '') <> '' THEN k.notes ELSE concat_ws(e'\\n', '产品：' || l.product, '数量：' || l.quantity, '下一步：' || CASE grade WHEN 'HOLD' THEN 'resolve-hold'
    WHEN 'A' THEN 'review-within-24h' WHEN 'C' THEN 'nurture' WHEN 'D' THEN 'keep-record' ELSE 'fill-evidence:' || CASE WHEN all_missing = '' THEN 'timeline,contact-role'
      ELSE array_to_string(string_split(all_missing, ',')[1:2], ',') END END) END AS notes,
  q.grade, q.score::BIGINT AS score, coalesce(n, 0) AS evidence_count, CASE WHEN k.customer_id IS NULL THEN 'imported' ELSE 'updated' END AS change,
  array_to_string(list_filter([CASE WHEN (k.customer_id IS NULL OR k.company IN ('', 'Old company')) AND l.name IS NOT NULL THEN 'company' END,
    CASE WHEN k.customer_id IS NULL THEN 'country' END, CASE WHEN (k.customer_id IS NULL OR k.email = 'old@x.example') AND l.email IS NOT NULL THEN 'email' END,
    CASE WHEN (k.customer_id IS NULL OR k.name = 'Old contact') AND l.contact_name IS NOT NULL THEN 'name' END, CASE WHEN l.whatsapp IS NOT NULL THEN 'whatsapp' END],
    lambda x: x IS NOT NULL), ',') AS managed_fields
FROM leads l JOIN qualified q ON q.lead_id = l.lead_id LEFT JOIN known k ON k.customer_id = l.lead_id
LEFT JOIN (SELECT lead_id, count(*) AS n FROM effective WHERE status <> 'rejected' GROUP BY lead_id) e ON e.lead_id = l.lead_id
"""


@query("crm_merge", with_parts("SELECT * FROM merged", **QUALIFIED_PARTS, known=KNOWN, merged=MERGED))
def crm_merge(spark, folder):
    merged = crm.merge_import(customer_frame(spark, folder), _incoming(spark, folder), now())
    return merged.select("customer_id", "name", "company", "country", "email", "whatsapp", "notes", "profile.grade", "profile.score",
                         "profile.evidence_count", "change", F.array_sort(F.map_keys("managed")).alias("managed_fields"))


@query("crm_import_counts", with_parts("""
SELECT count(*) FILTER (change = 'imported') AS imported, count(*) FILTER (change = 'updated') AS updated FROM merged""",
    **QUALIFIED_PARTS, known=KNOWN, merged=MERGED))
def crm_import_counts(spark, folder):
    incoming = _incoming(spark, folder)
    return crm.import_counts(crm.merge_import(customer_frame(spark, folder), incoming, now()), incoming)


@query("crm_edits", with_parts("""
SELECT customer_id, CASE WHEN c_custkey % 2 = 0 THEN 'Hand ' || c_custkey ELSE name END AS name, email,
  concat_ws(',', CASE WHEN company = 'Old company' OR c_custkey % 2 = 1 THEN 'company' END, 'email', CASE WHEN c_custkey % 2 = 1 THEN 'name' END) AS managed_fields,
  CASE WHEN c_custkey % 2 = 0 THEN '2024-02-01 00:00:00' ELSE '2023-06-01 00:00:00' END AS updated_at FROM known""",
    known=KNOWN).replace("company = 'Old company' OR c_custkey % 2 = 1", "TRUE"))
def crm_edits(spark, folder):
    known = customer_frame(spark, folder)
    number = F.substring("customer_id", 2, 9).cast("bigint")
    edits = known.where(number % 2 == 0).select(
        "customer_id", F.concat(F.lit("Hand "), number).alias("name"), "company", "country", "email", "whatsapp", "notes")
    return crm.edit_customers(known, edits, now()).select(
        "customer_id", "name", "email", F.array_sort(F.map_keys("managed")).alias("managed_fields"), "updated_at")


@query("crm_migration", f"""
SELECT 'C' || c_custkey AS customer_id, left(c_name, 80) AS name, lower(c_mktsegment) || '@x.example' AS email, '' AS notes, 0::BIGINT AS managed_count,
  '{NOW}' AS created_at FROM customer""")
def crm_migration(spark, folder):
    """Rows of an old version: no notes, profile, managed fields or times."""
    old = table(spark, folder, "customer").select(
        F.concat(F.lit(" C"), "c_custkey").alias("customer_id"), F.concat("c_name", F.lit("  ")).alias("name"),
        F.concat("c_mktsegment", F.lit("@X.example")).alias("email"))
    return crm.migrate_customers(old, now()).select("customer_id", "name", "email", "notes", F.size("managed").alias("managed_count"), "created_at")


@query("crm_stats", with_parts("""
SELECT (SELECT count(*) FROM known) + (SELECT count(*) FROM leads WHERE lead_id NOT IN (SELECT customer_id FROM known)) AS customers,
  (SELECT count(*) FROM leads) AS with_profile, (SELECT count(*) FROM conversations WHERE role = 'assistant') AS replies""", **QUALIFIED_PARTS, known=KNOWN))
def crm_stats(spark, folder):
    merged = crm.merge_import(customer_frame(spark, folder), _incoming(spark, folder), now())
    return crm.crm_stats(merged, table(spark, folder, "conversations").where("role = 'assistant'"))


@query("reply_log", f"""
SELECT workspace_id, reply_id, scenario_id, provider FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY created_at DESC, reply_id DESC) AS rn FROM (
  SELECT 'ws_' || user_id % 3 AS workspace_id, 'r' || event_id AS reply_id, ts AS created_at, CASE WHEN event_type = 'view' THEN 'inquiry' ELSE event_type END AS scenario_id,
    CASE WHEN event_type = 'click' THEN 'ai' ELSE 'template' END AS provider, event_id FROM events)) WHERE event_id % 7 <> 0""")
def reply_log(spark, folder):
    events = table(spark, folder, "events")
    rows = events.select(
        F.concat(F.lit("ws_"), F.col("user_id") % 3).alias("workspace_id"), F.concat(F.lit("r"), "event_id").alias("reply_id"),
        F.col("ts").alias("created_at"), F.lit("c1").alias("customer_id"), F.lit("in").alias("inbound"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("scenario_id"), F.lit("out").alias("reply"),
        F.lit("generic").alias("mode"), F.when(F.col("event_type") == "click", "ai").alias("provider"), "event_id")
    columns = [c for c in rows.columns if c != "event_id"]
    kept = crm.append_replies(rows.where("event_id % 2 = 0").select(*columns), rows.where("event_id % 2 = 1").select(*columns))
    removed = rows.where("event_id % 7 = 0").select("reply_id")
    return crm.remove_replies(kept, removed).select("workspace_id", "reply_id", "scenario_id", "provider")


@query("portable_settings", """
SELECT 'ws_' || s_suppkey AS workspace_id, s_name AS signature, CASE WHEN s_suppkey % 2 = 0 THEN 'local' || s_suppkey ELSE '' END AS ai_key, FALSE AS ai_enabled FROM supplier""")
def portable_settings(spark, folder):
    """Export without the key, import into workspaces of which half have a key of their own."""
    there = table(spark, folder, "supplier").select(
        F.concat(F.lit("ws_"), "s_suppkey").alias("workspace_id"), F.col("s_name").alias("signature"), F.lit("sk-remote").alias("ai_key"),
        F.lit(True).alias("ai_enabled"))
    here = there.where(F.substring("workspace_id", 4, 9).cast("int") % 2 == 0).select(
        "workspace_id", F.concat(F.lit("local"), F.substring("workspace_id", 4, 9)).alias("ai_key"))
    return crm.settings_from_import(crm.settings_for_export(there), here)


# ---- trade documents ----

LINES = """
SELECT l_orderkey AS order_id, l_linenumber AS line_no, concat('SKU-', CAST(l_partkey AS STRING)) AS sku, concat('Part ', CAST(l_partkey AS STRING)) AS name,
  CASE WHEN l_returnflag = 'A' THEN 'spec  A' END AS specification, CAST(l_quantity AS STRING) AS quantity, '' AS unit,
  CAST(CAST(CASE WHEN l_orderkey % 40 = 7 THEN 0 ELSE l_extendedprice END AS DECIMAL(12, 2)) AS STRING) AS unit_price, CAST(l_linenumber % 4 AS STRING) AS carton_count,
  CAST(l_linenumber % 3 AS STRING) AS gross_weight_kg, CAST(NULL AS STRING) AS net_weight_kg, l_quantity, l_extendedprice FROM lineitem
"""
HEADERS = """
SELECT o_orderkey AS order_id, 'Maker' AS seller, CASE WHEN o_orderkey % 30 = 3 THEN ' ' ELSE concat('Customer ', CAST(o_custkey AS STRING)) END AS buyer,
  CASE o_orderkey % 3 WHEN 0 THEN 'eur' WHEN 1 THEN '' ELSE 'US1' END AS currency, o_orderpriority AS reference FROM orders
"""
TOTALS = """
SELECT l_orderkey AS order_id, sum(round(l_quantity::DECIMAL(18, 4) * l_extendedprice::DECIMAL(12, 2), 2)) AS amount, sum(CASE WHEN l_linenumber % 4 = 0 THEN 1 ELSE l_linenumber % 4 END) AS cartons,
  round(sum(CASE WHEN l_linenumber % 3 = 0 THEN 0.01 ELSE l_linenumber % 3 END), 2) AS gross, round(count(*) * 0.01, 2) AS net, count(*) AS n FROM lineitem GROUP BY l_orderkey
"""
STATUS = """
SELECT h.*, t.*, CASE WHEN trim(buyer) = '' THEN 'buyer-name-missing' WHEN currency = 'US1' THEN 'bad-currency' WHEN t.n IS NULL THEN 'no-lines'
  WHEN h.order_id % 40 = 7 THEN 'bad-line' END AS refusal FROM headers h LEFT JOIN totals t ON t.order_id = h.order_id
"""
TRADE_PARTS = {"headers": HEADERS, "totals": TOTALS, "status": STATUS.replace("t.*,", "t.amount, t.cartons, t.gross, t.net, t.n,")}


def line_frame(spark: SparkSession, folder: str) -> DataFrame:
    return trade.check_lines(derive(spark, folder, LINES).drop("l_quantity", "l_extendedprice"))


def order_frame(spark: SparkSession, folder: str, lines: DataFrame) -> DataFrame:
    orders = derive(spark, folder, f"""
        SELECT order_id, named_struct('name', seller, 'address', 'Road 1', 'contact', 'Sam') AS supplier,
          named_struct('name', buyer, 'address', 'Street 2', 'contact', 'Kim') AS buyer, currency, '' AS incoterm, '' AS payment_terms,
          '' AS validity_days, '' AS issue_date, reference, CAST(NULL AS STRING) AS notes FROM ({HEADERS})""")
    return trade.check_orders(orders, trade.order_totals(lines), now())


@query("order_totals", with_parts("SELECT order_id, amount::DOUBLE AS amount, cartons::DOUBLE AS cartons, gross::DOUBLE AS gross_weight_kg, net::DOUBLE AS net_weight_kg, n AS lines FROM totals WHERE order_id % 40 <> 7", **TRADE_PARTS))
def order_totals(spark, folder):
    totals = trade.order_totals(line_frame(spark, folder))
    return totals.where(F.col("bad_lines") == 0).drop("bad_lines")


@query("order_refusals", with_parts("SELECT order_id, refusal FROM status WHERE refusal IS NOT NULL", **TRADE_PARTS))
def order_refusals(spark, folder):
    return order_frame(spark, folder, line_frame(spark, folder)).where("refusal IS NOT NULL").select("order_id", "refusal")


DOCUMENT_ROWS = """
SELECT *, each_of('quotation', 'proforma-invoice', 'commercial-invoice', 'packing-list', 'sales-contract', 'product-catalog') AS type FROM status WHERE refusal IS NULL
"""


@query("order_documents", with_parts("""
SELECT order_id, type, reference || '-' || upper(type) AS reference, CASE WHEN type <> 'product-catalog' THEN CASE WHEN currency = 'eur' THEN 'EUR' ELSE 'USD' END END AS currency,
  CASE WHEN type <> 'product-catalog' THEN amount END::DOUBLE AS total_amount, CASE WHEN type = 'packing-list' THEN cartons END::DOUBLE AS total_cartons,
  CASE WHEN type NOT IN ('product-catalog', 'packing-list') THEN 'T/T 30% deposit, 70% before shipment' END AS payment_terms,
  CASE WHEN type = 'quotation' THEN 30 END::BIGINT AS valid_until_days, CASE WHEN type LIKE '%invoice' THEN TRUE END AS not_proof_of_payment FROM document_rows""",
    **TRADE_PARTS, document_rows=DOCUMENT_ROWS))
def order_documents(spark, folder):
    documents = trade.trade_documents(order_frame(spark, folder, line_frame(spark, folder)))
    return documents.select("order_id", "type", "reference", "currency", "total_amount", "total_cartons", "payment_terms", "valid_until_days",
                            "not_proof_of_payment")


def _plain(c: str) -> str:
    return f"regexp_replace(regexp_replace(CAST({c} AS STRING), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"


_TITLES = "CASE type " + " ".join(f"WHEN '{kind}' THEN '{title.upper()}'" for kind, title in trade.DOCUMENT_TITLES.items()) + " END"


@query("order_document_texts", with_parts(f"""
SELECT order_id, type, concat_ws(e'\\n', {_TITLES}, 'DRAFT · ' || reference || '-' || upper(type),
  'Issue date: 2024-02-01', 'Seller: Maker | Road 1 | Sam', CASE WHEN type <> 'product-catalog' THEN 'Buyer: ' || buyer || ' | Street 2 | Kim' END,
  'SKU | Product | Specification | Quantity' || CASE type WHEN 'packing-list' THEN ' | Cartons | Gross weight kg | Net weight kg' WHEN 'product-catalog' THEN ''
    ELSE ' | Unit price | Line total' END, items,
  CASE WHEN type NOT IN ('packing-list', 'product-catalog') THEN 'Total: ' || cur || ' ' || {_plain('amount')} END, CASE WHEN type <> 'product-catalog' THEN 'Incoterm: FOB Shanghai' END,
  CASE WHEN type NOT IN ('packing-list', 'product-catalog') THEN 'Payment terms: T/T 30% deposit, 70% before shipment' END,
  CASE type WHEN 'packing-list' THEN 'Packing: ' || cartons || ' cartons; G.W. ' || {_plain('gross')} || ' kg; N.W. ' || {_plain('net')} || ' kg' END,
  CASE type WHEN 'quotation' THEN 'Validity: 30 days' END, '{trade.STATUS_LINE}') AS text
FROM (SELECT *, CASE WHEN currency = 'eur' THEN 'EUR' ELSE 'USD' END AS cur FROM document_rows) d, LATERAL (
  SELECT string_agg('SKU-' || l_partkey || ' | Part ' || l_partkey || ' | ' || CASE WHEN l_returnflag = 'A' THEN 'spec A' ELSE '-' END || ' | '
    || {_plain('l_quantity::DECIMAL(18, 4)')} || ' pcs' || CASE d.type WHEN 'product-catalog' THEN ''
      WHEN 'packing-list' THEN ' | ' || CASE WHEN l_linenumber % 4 = 0 THEN '1' ELSE CAST(l_linenumber % 4 AS STRING) END || ' | ' || CASE WHEN l_linenumber % 3 = 0 THEN '0.01' ELSE CAST(l_linenumber % 3 AS STRING) END || ' | 0.01'
      ELSE ' | ' || d.cur || ' ' || {_plain('l_extendedprice::DECIMAL(12, 2)')} || ' | ' || d.cur || ' '
        || {_plain('round(l_quantity::DECIMAL(18, 4) * l_extendedprice::DECIMAL(12, 2), 2)')} END,
    e'\\n' ORDER BY l_linenumber, 'SKU-' || l_partkey, l_returnflag = 'A', l_quantity) AS items FROM lineitem WHERE l_orderkey = d.order_id)""", **TRADE_PARTS, document_rows=DOCUMENT_ROWS))
def order_document_texts(spark, folder):
    lines = line_frame(spark, folder)
    return trade.document_texts(trade.trade_documents(order_frame(spark, folder, lines)), lines)


# ---- storage ----


@query("result_store", with_parts("SELECT 'ws_main01' AS workspace_id, t AS \"table\", n AS rows, 4::BIGINT AS schema_version FROM (SELECT 'leads' AS t, count(*) AS n FROM leads UNION ALL SELECT 'qualified', count(*) FROM qualified)",
                                  **QUALIFIED_PARTS))
def result_store(spark, folder):
    manifest = store.write_tables(
        {"leads": lead_frame(spark, folder), "qualified": qualified(spark, folder)}, work_path(spark, "results"), "ws_main01", " Main  space ", now())
    return manifest.select("workspace_id", "table", "rows", "schema_version")


@query("workspace_gate", """
SELECT page_id, CASE WHEN page_id % 4 = 3 THEN 'other-workspace' END AS refusal FROM pages""")
def workspace_gate(spark, folder):
    kind = F.col("page_id") % 4
    references = table(spark, folder, "pages").select(
        "page_id", F.when(kind == 1, "ws_main01").when(kind > 1, "ws_else01").alias("id"),
        F.when(kind == 1, "Renamed").when(kind == 2, " main  SPACE ").when(kind == 3, "Other").alias("name"))
    return store.workspace_refusals(references, "ws_main01", "Main space").select("page_id", "refusal")


@query("pruned_payloads", "SELECT event_id, k, '' AS hidden FROM (SELECT event_id, props->>'k' AS k FROM events)")
def pruned_payloads(spark, folder):
    rows = table(spark, folder, "events").select(
        "event_id", F.lit("secret").alias("api_key"), F.struct(F.get_json_object("props", "$.k").alias("k"), F.lit("x").alias("sessionToken")).alias("body"),
        F.create_map(F.lit("password"), F.lit("p")).alias("extra"))
    kept = governance.without_sensitive(rows)
    hidden = F.array_join(F.map_keys("extra"), ",")
    return kept.select("event_id", "body.*", hidden.alias("hidden"))


