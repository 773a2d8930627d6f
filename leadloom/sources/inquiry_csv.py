"""Inquiry CSV files: header mapping, structural checks, import profile and lead building."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom import model
from leadloom.functions import text as t
from leadloom.operators.leads import evidence_id, lead_id, normalize_leads
from leadloom.session import first_code

# ---- fixed values: header names understood per field, and the fields an import may fill ----
HEADER_ALIASES = {
    "source": ("source", "channel", "platform", "来源", "渠道", "平台"),
    "source_reference": ("source_reference", "inquiry_id", "inquiry_no", "inquiry_number", "inquiry_url", "rfq_id",
                         "询盘编号", "询盘id", "询盘号", "询盘链接", "rfq编号"),
    "received_at": ("received_at", "received_time", "inquiry_time", "created_at", "date", "收到时间", "询盘时间",
                    "创建时间", "日期"),
    "company_name": ("company_name", "company", "buyer_company", "organization", "公司名称", "公司", "买家公司",
                     "企业名称"),
    "domain": ("domain", "company_domain", "域名", "公司域名"),
    "website": ("website", "company_website", "web_site", "官网", "公司网站", "网站"),
    "country": ("country", "country_region", "market", "国家", "国家地区", "市场"),
    "address": ("address", "company_address", "地址", "公司地址"),
    "industry": ("industry", "business_type", "行业", "业务类型"),
    "contact_name": ("contact_name", "buyer_name", "contact", "name", "联系人", "买家姓名", "姓名"),
    "contact_role": ("contact_role", "job_title", "position", "title", "联系人职位", "职务", "职位"),
    "email": ("email", "email_address", "business_email", "邮箱", "电子邮箱", "工作邮箱"),
    "whatsapp": ("whatsapp", "whatsapp_number", "whats_app", "whatsapp号码"),
    "phone": ("phone", "telephone", "mobile", "phone_number", "电话", "手机", "联系电话"),
    "message": ("message", "inquiry_content", "content", "inquiry_message", "description", "询盘内容", "询盘信息",
                "留言", "内容"),
    "product": ("product", "product_name", "subject", "inquiry_title", "产品", "产品名称", "询盘标题"),
    "quantity": ("quantity", "order_quantity", "purchase_quantity", "数量", "采购数量", "订购数量"),
    "timeline": ("timeline", "delivery_time", "purchase_time", "expected_date", "交期", "采购时间", "期望时间"),
    "budget": ("budget", "target_price", "price", "预算", "目标价格", "价格"),
    "notes": ("notes", "remark", "remarks", "备注"),
}
FIELD_LABELS = {
    "source": "渠道来源", "source_reference": "询盘编号或链接", "received_at": "收到时间", "company_name": "企业名称",
    "domain": "企业域名", "website": "企业官网", "country": "国家或地区", "address": "企业地址",
    "industry": "行业或业务类型", "employee_range": "员工规模", "registration_id": "企业登记编号",
    "factory_info": "工厂或产能信息", "contact_name": "联系人姓名", "contact_role": "联系人职位",
    "email": "工作邮箱候选", "whatsapp": "WhatsApp 候选", "phone": "联系电话候选", "message": "原始询盘内容",
    "product": "产品", "quantity": "采购数量", "timeline": "采购或交期", "budget": "预算或目标价格", "notes": "备注",
}
CONTROL_FIELDS = (
    "id", "observed_at", "explicit_inquiry", "replied", "requested_quote", "requested_sample", "purchase_order",
    "mutual_introduction", "prior_relationship", "do_not_contact", "restricted_market", "duplicate_of",
    "consent_status",
)
# Fields that come with evidence: field, evidence kind, lead field.
EVIDENCE_FIELDS = (
    ("website", "company-website", "organization.website"),
    ("registration_id", "business-registration", "organization.registration_id"),
    ("factory_info", "factory", "organization.factory_info"),
    ("email", "business-email", "contact.email"),
    ("whatsapp", "whatsapp", "contact.whatsapp"),
    ("phone", "business-phone", "contact.phone"),
)
MEANINGFUL_FIELDS = ("source_reference", "company_name", "website", "contact_name", "email", "whatsapp", "phone",
                     "message", "product")
CHANNEL_SOURCES = {"alibaba": "Alibaba", "made-in-china": "Made-in-China"}
SAMPLE_LENGTH, SAMPLES_KEPT = 80, 2
# ---- end of fixed values ----

SUPPORTED_FIELDS = frozenset(FIELD_LABELS) | frozenset(CONTROL_FIELDS) | frozenset(
    f"{f}_{suffix}" for f, _, _ in EVIDENCE_FIELDS for suffix in ("status", "confidence"))


@dataclass(frozen=True)
class ColumnMapping:
    """One source column: its place, header and the field it feeds (None: not imported)."""

    position: int
    header: str
    field: str | None
    explicit: bool

    @property
    def column(self) -> str:
        return f"c{self.position}"


def header_key(header: str | None) -> str:
    folded = unicodedata.normalize("NFKC", (header or "").strip(t.SPACES).lower())
    return regex.sub(r"[^\p{L}\p{N}]", "", folded)


_FIELD_OF_HEADER = {header_key(alias): field for field, aliases in HEADER_ALIASES.items() for alias in aliases}


def map_headers(headers: list[str], field_map: dict[str, str] | None = None) -> list[ColumnMapping]:
    """Resolve headers: the explicit map wins ("" leaves the column out), then aliases, then field names."""
    out = []
    for position, header in enumerate(headers):
        explicit = bool(field_map) and header in field_map
        if explicit:
            field = (field_map[header] or "").strip() or None
            if field and field not in SUPPORTED_FIELDS:
                raise ValueError(f"unsupported field: {field}")
        else:
            field = _FIELD_OF_HEADER.get(header_key(header)) or (header if header in SUPPORTED_FIELDS else None)
        out.append(ColumnMapping(position, header, field, explicit))
    return out


# ---- reading ----

def spans_lines(spark: SparkSession, path: str) -> bool:
    """Whether some cell holds a line break: then a line has an odd number of quotes."""
    odd = spark.read.text(path).where(F.regexp_count("value", F.lit('"')) % 2 == 1)
    return not odd.limit(1).isEmpty()


def _check_headers(spark: SparkSession, path: str) -> None:
    """Refuse files whose first lines differ: one header is applied to all."""
    files = spark.read.format("binaryFile").load(path).select("path").limit(2).count()
    if files < 2:
        return
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
                                         F.monotonically_increasing_id().alias("row"), t.trimmed(F.regexp_replace("value", "^\ufeff", "")).alias("line"))
    first = lines.groupBy("file").agg(F.min_by("line", F.struct("at", "row")).alias("line"), F.min("file").alias("name"))
    kinds = first.groupBy("line").agg(F.min("file").alias("file")).limit(2).collect()
    if len(kinds) > 1:
        raise ValueError(f"files with different headers: {kinds[0].file} and {kinds[1].file}; read them one by one")


def _reader(spark: SparkSession, multiline: bool):
    return spark.read.option("multiLine", multiline).option("quote", '"').option("escape", '"').option(
        "mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")


def read_headers(spark: SparkSession, path: str, multiline: bool | None = None) -> list[str]:
    """Header row as it stands in the files, which must agree (Spark would rename duplicate headers)."""
    _check_headers(spark, path)
    row = _reader(spark, spans_lines(spark, path) if multiline is None else multiline).option("header", False).csv(path).first()
    if row is None:
        return []
    cells = [(c or "").strip(t.SPACES) for c in row]
    return cells


def unclosed_quotes(spark: SparkSession, path: str) -> DataFrame:
    """Files whose quotes do not pair up. Counted line by line, so large files are split."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"),
                                         F.regexp_count("value", F.lit('"')).alias("quotes"))
    return lines.groupBy("file").agg(F.sum("quotes").alias("quotes")).where(F.col("quotes") % 2 == 1).select("file")


def read_rows(spark: SparkSession, path: str, headers: list[str], multiline: bool | None = None) -> DataFrame:
    """Data rows as trimmed text columns c0..cn with `ordinal`, `file` and the row's `width`.

    Files without line breaks inside cells are split into many tasks; whether there are any is looked up unless given.
    """
    if multiline is None:
        multiline = spans_lines(spark, path)
    names = [f"c{i}" for i in range(len(headers))]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_corrupt_record"]])
    raw = _reader(spark, multiline).schema(schema).option("header", True).option("enforceSchema", True).csv(path)
    outside = F.regexp_replace("_corrupt_record", '"(?:[^"]|"")*"', "")
    width = F.when(F.col("_corrupt_record").isNull(), len(names)).otherwise(F.regexp_count(outside, F.lit(",")) + 1)
    rows = raw.select(
        F.monotonically_increasing_id().alias("ordinal"), F.col("_metadata.file_path").alias("file"),
        width.alias("width"), *[F.coalesce(t.trimmed(n), F.lit("")).alias(n) for n in names])
    return rows.where(F.concat(*names) != "") if names else rows


def canonical_rows(rows: DataFrame, mappings: list[ColumnMapping], channel: str = "auto") -> DataFrame:
    """One column per field; among several source columns the leftmost that is not blank wins."""
    feeding: dict[str, list[ColumnMapping]] = {}
    for m in mappings:
        if m.field:
            feeding.setdefault(m.field, []).append(m)
    columns = {f: F.coalesce(*[F.nullif(F.col(m.column), F.lit("")) for m in ms]) for f, ms in feeding.items()}
    default = CHANNEL_SOURCES.get(channel)
    if default:
        columns["source"] = F.coalesce(columns.get("source", F.lit(None)), F.lit(default))
    missing = sorted(SUPPORTED_FIELDS - set(columns))
    return rows.select("ordinal", *[c.cast("string").alias(f) for f, c in columns.items()],
                       *[F.lit(None).cast("string").alias(f) for f in missing])


# ---- building leads ----

def leads_from_rows(canonical: DataFrame, interchange_ids: bool = False) -> model.LeadTables:
    """Leads with the evidence and field origins their flat records imply."""
    spark = canonical.sparkSession

    def group(fields: tuple[str, ...], source: dict[str, str] | None = None) -> Column:
        return F.struct(*[F.col((source or {}).get(f, f)).alias(f) for f in fields])

    inquiry_flag = F.when(F.col("explicit_inquiry").isNull(), F.col("message").isNotNull()).otherwise(
        t.flag("explicit_inquiry")).cast("string")
    shaped = canonical.select(
        F.col("id").alias("lead_id"), "source", "source_reference", "received_at",
        group(model.ORGANIZATION_FIELDS, {"name": "company_name"}).alias("organization"),
        group(model.CONTACT_FIELDS, {"name": "contact_name", "role": "contact_role"}).alias("contact"),
        group(model.INQUIRY_FIELDS).alias("inquiry"),
        F.struct(inquiry_flag.alias("explicit_inquiry"), *[F.col(n) for n in model.SIGNAL_FIELDS[1:]]).alias("signals"),
        F.struct("do_not_contact", "restricted_market", "duplicate_of", "consent_status").alias("compliance"),
        "notes", "ordinal")
    leads = normalize_leads(shaped, interchange_ids)
    observed = F.coalesce("observed_at", "received_at")

    def entry(position: int, value: Column, kind: str, path: str | None, status: Column, confidence: Column,
              seen: Column, note: str | None) -> Column:
        return F.when(value.isNotNull(), F.struct(
            F.lit(position).cast("bigint").alias("seq"), F.lit(kind).alias("kind"), value.alias("value"),
            F.lit(path).cast("string").alias("path"), status.alias("status"), confidence.alias("confidence"),
            seen.alias("seen"), F.lit(note).cast("string").alias("note")))

    def field_entry(position: int, field: str, kind: str, path: str) -> Column:
        status = F.coalesce(t.one_of(F.lower(t.trimmed(f"{field}_status")), model.EVIDENCE_STATUSES), F.lit("candidate"))
        fallback = F.when(status == "verified", 1.0).otherwise(0.5)
        return entry(position, F.col(field), kind, path, status, t.clamped(f"{field}_confidence", 0, 1, fallback),
                     observed, "from the import file")

    record = entry(0, F.col("source_reference"), "source-record", None, F.lit("verified"), F.lit(1.0),
                   F.col("received_at"), None)
    entries = F.array_compact(F.array(record, *[
        field_entry(i + 1, f, kind, path) for i, (f, kind, path) in enumerate(EVIDENCE_FIELDS)]))
    # The lead id is an expression of the same row, so no join is needed to get it.
    made = lead_id(F.coalesce(t.text("source"), F.lit("manual")), F.col("source_reference"), F.col("company_name"),
                   F.lower(t.trimmed("email")), F.col("message"), interchange_ids)
    listed = canonical.withColumn("lead_id", F.coalesce(t.text("id"), made)).select(
        "lead_id", F.col("source_reference").alias("source_ref"), F.inline(entries))
    typed = listed.select(
        "lead_id", evidence_id(F.col("kind"), F.col("value"), F.col("source_ref"), F.col("seen")).alias("evidence_id"),
        "seq", "kind", "value", "source_ref", t.moment("seen").alias("observed_at"), "confidence", "status", "note", "path")
    evidence = typed.drop("path")
    nothing, never = F.lit(None).cast("string"), F.lit(None).cast("timestamp")
    origins = typed.where(F.col("path").isNotNull()).select(
        "lead_id", "path", "evidence_id", F.col("value").alias("applied_value"), F.col("observed_at").alias("applied_at"),
        never.alias("updated_at"), F.lit(True).alias("active"), never.alias("ended_at"), nothing.alias("end_reason"), "seq")
    return model.lead_tables(spark, leads, evidence=evidence, origins=origins)


def read_leads(spark: SparkSession, path: str, channel: str = "auto", field_map: dict[str, str] | None = None,
               multiline: bool | None = None, interchange_ids: bool = False) -> model.LeadTables:
    """Read an inquiry CSV file or folder (one header for all files) into lead tables.

    Raises when a file has an unclosed quote, as nothing after it could be trusted.
    """
    broken = unclosed_quotes(spark, path)
    if not broken.isEmpty():
        raise ValueError(f"unclosed quote in {broken.first()['file']}")
    headers = read_headers(spark, path, multiline)
    rows = read_rows(spark, path, headers, multiline)
    return leads_from_rows(canonical_rows(rows, map_headers(headers, field_map), channel), interchange_ids)


# ---- import review ----

@dataclass
class ImportReview:
    """`columns`: one row per source column; `summary`: one row with counters, errors and warnings."""

    columns: DataFrame
    summary: DataFrame


def review_import(rows: DataFrame, mappings: list[ColumnMapping], channel: str = "auto") -> ImportReview:
    """Profile an import before anything is written: two passes of plain aggregates over the rows.

    The first pass counts and finds each column's first value; the second finds its next different value.
    Nothing is grouped by value, so no column is ever collected or shuffled.
    """
    targets: dict[str, int] = {}
    for m in mappings:
        if m.field:
            targets[m.field] = targets.get(m.field, 0) + 1

    def status(m: ColumnMapping) -> str:
        if not m.field:
            return "unmapped"
        return "duplicate-target" if targets[m.field] > 1 else "mapped"

    def sample(m: ColumnMapping) -> Column:
        return t.ellipsis(F.col(m.column), SAMPLE_LENGTH)

    feeding = {f: F.coalesce(*[F.nullif(F.col(m.column), F.lit("")) for m in mappings if m.field == f]) for f in targets}

    def any_of(*fields: str) -> Column:
        present = [feeding[f] for f in fields if f in feeding]
        return F.coalesce(*present).isNotNull() if present else F.lit(False)

    usable = any_of(*MEANINGFUL_FIELDS)
    width = F.col("width") if "width" in rows.columns else F.lit(len(mappings))
    counters = {
        "row_count": F.count(F.lit(1)), "usable_rows": F.count_if(usable),
        "short_rows": F.count_if(width < len(mappings)), "long_rows": F.count_if(width > len(mappings)),
        "missing_reference_rows": F.count_if(usable & ~any_of("source_reference")),
        "missing_inquiry_rows": F.count_if(usable & ~any_of("message", "product")),
        "missing_organization_rows": F.count_if(usable & ~any_of("company_name", "domain", "website")),
        "missing_contact_rows": F.count_if(usable & ~any_of("contact_name", "email", "whatsapp", "phone")),
    }
    first = rows.agg(
        *[c.alias(name) for name, c in counters.items()],
        F.array(*[F.count_if(F.col(m.column) != "") for m in mappings]).alias("populated"),
        F.array(*[F.min_by(sample(m), F.when(sample(m).isNotNull(), F.col("ordinal"))) for m in mappings]).alias("first"),
    ).first()

    def differs(m: ColumnMapping) -> Column:
        return F.when(sample(m) != F.lit(first["first"][m.position]), F.col("ordinal"))

    second = rows.agg(F.array(*[
        F.min_by(sample(m), differs(m)) if first["first"][m.position] is not None else F.lit(None).cast("string")
        for m in mappings]).alias("second")).first()

    spark = rows.sparkSession
    columns = spark.createDataFrame(
        [(m.position, m.header, m.field, m.explicit, status(m), first["populated"][m.position],
          [s for s in (first["first"][m.position], second["second"][m.position]) if s is not None])
         for m in mappings],
        "position int, header string, field string, explicit boolean, status string, populated_rows bigint, "
        "samples array<string>")

    keys = [header_key(m.header) for m in mappings]
    blank = sum(1 for k in keys if not k)
    repeated = sorted({m.header for m, k in zip(mappings, keys) if k and keys.index(k) != m.position})
    unmapped = [m.header for m in mappings if not m.field and first["populated"][m.position]]
    duplicates = sorted(f for f, n in targets.items() if n > 1)
    counts = {name: first[name] for name in counters}
    errors = [code for code, bad in (
        ("no-header", not mappings), ("blank-header", blank > 0), ("duplicate-header", bool(repeated)),
        ("no-rows", counts["row_count"] == 0), ("no-mapped-field", not targets),
        ("no-usable-row", counts["row_count"] > 0 and counts["usable_rows"] == 0)) if bad]
    warnings = [code for code, doubtful in (
        ("unmapped-columns", bool(unmapped)), ("duplicate-targets", bool(duplicates)),
        ("short-rows", counts["short_rows"] > 0), ("long-rows", counts["long_rows"] > 0),
        ("no-source", channel == "auto" and "source" not in targets),
        ("missing-reference", counts["missing_reference_rows"] > 0),
        ("missing-inquiry", counts["missing_inquiry_rows"] > 0),
        ("missing-organization", counts["missing_organization_rows"] > 0),
        ("missing-contact", counts["missing_contact_rows"] > 0)) if doubtful]
    summary = spark.createDataFrame(
        [(channel, *counts.values(), len(targets), blank, repeated, unmapped, duplicates, errors, warnings, not errors)],
        "channel string, " + ", ".join(f"{n} bigint" for n in counters) + ", mapped_fields int, blank_headers int, "
        "duplicate_headers array<string>, unmapped_headers array<string>, duplicate_targets array<string>, "
        "errors array<string>, warnings array<string>, can_import boolean")
    return ImportReview(columns, summary)


def import_audit(review: ImportReview, reviewed_at: Column, import_id: str, first: int | None = None) -> DataFrame:
    """Versioned record of a confirmed import, without sample values; empty when the import failed its checks.

    All columns are audited; `first` keeps only the first ones.
    """
    columns = review.columns.where(F.col("position") < first) if first else review.columns
    columns = columns.agg(F.array_sort(F.collect_list(F.struct("position", "header", "field", "status", "populated_rows"))).alias("mappings"))
    return review.summary.where("can_import").select(
        F.lit(import_id).alias("import_id"), F.lit(1).alias("schema_version"), reviewed_at.alias("reviewed_at"),
        "channel", "row_count", "usable_rows",
        "warnings", columns.scalar().alias("mappings"))


def check_audit(audits: DataFrame, newest_version: int = 1) -> DataFrame:
    """Adds `refusal` to stored audits that this version must not read."""
    return audits.withColumn("refusal", first_code(
        (F.coalesce(F.col("schema_version"), F.lit(0)) < 1, "bad-version"),
        (F.col("schema_version") > newest_version, "newer-version"),
        (F.col("reviewed_at").isNull(), "bad-time")))
