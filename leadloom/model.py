"""Schemas, enumerations and rule tables of the data model."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

SCHEMA_VERSION = 4

# ---- fixed values: enumerations of the data model ----
EVIDENCE_STATUSES = ("candidate", "inconclusive", "verified", "rejected")
REVIEW_ACTIONS = ("accepted", "rejected", "revised")
DUPLICATE_DECISIONS = ("same", "distinct", "reopened")
EVENT_TYPES = (
    "contact-attempted", "buyer-replied", "quote-sent", "sample-sent", "order-received", "won", "lost",
    "reopened", "follow-up-scheduled", "follow-up-completed", "note", "activity-voided",
)
OUTBOUND_TYPES = ("contact-attempted", "quote-sent", "sample-sent", "follow-up-scheduled")
CHANNELS = ("platform", "email", "whatsapp", "phone", "meeting", "other")
GRADES = ("A", "B", "C", "D", "HOLD")
CONSENT_STATUSES = ("unknown", "approved", "declined")

# Lead fields that evidence may fill, with the evidence kinds accepted for each.
FIELD_KINDS = {
    "organization.name": ("organization-name", "legal-entity-record"),
    "organization.domain": ("organization-domain", "company-website", "business-email", "work-email"),
    "organization.website": ("company-website",),
    "organization.country": ("business-country", "legal-jurisdiction"),
    "organization.address": ("business-address",),
    "organization.industry": ("business-industry",),
    "organization.employee_range": ("employee-range",),
    "organization.registration_id": ("business-registration",),
    "organization.factory_info": ("factory", "manufacturing-capability"),
    "contact.name": ("contact-name",),
    "contact.role": ("contact-role",),
    "contact.email": ("business-email", "work-email"),
    "contact.whatsapp": ("whatsapp",),
    "contact.phone": ("business-phone",),
}
FIELD_PATHS = tuple(FIELD_KINDS)

STAGES = ("new", "contacted", "replied", "quoted", "sampled", "ordered")
STAGE_OF_EVENT = {
    "contact-attempted": "contacted",
    "buyer-replied": "replied",
    "quote-sent": "quoted",
    "sample-sent": "sampled",
    "order-received": "ordered",
}

# Display labels.
STAGE_LABELS = {
    "new": "尚未开发", "contacted": "已联系", "replied": "已回复", "quoted": "已报价", "sampled": "已寄样",
    "ordered": "已收到订单", "won": "已成交", "lost": "已流失",
}
EVENT_LABELS = {
    "contact-attempted": "已联系客户", "buyer-replied": "收到客户回复", "quote-sent": "已发送报价",
    "sample-sent": "已寄出样品", "order-received": "已收到订单", "won": "确认成交", "lost": "确认流失",
    "reopened": "重新进入开发", "follow-up-scheduled": "安排下一步", "follow-up-completed": "完成跟进",
    "note": "开发备注", "activity-voided": "撤回错误记录",
}
# ---- end of fixed values ----

ORGANIZATION_FIELDS = tuple(p.split(".")[1] for p in FIELD_PATHS if p.startswith("organization."))
CONTACT_FIELDS = tuple(p.split(".")[1] for p in FIELD_PATHS if p.startswith("contact."))
INQUIRY_FIELDS = ("message", "product", "quantity", "timeline", "budget")
SIGNAL_FIELDS = (
    "explicit_inquiry", "replied", "requested_quote", "requested_sample", "purchase_order",
    "mutual_introduction", "prior_relationship",
)


def _struct(names: tuple[str, ...], kind: str = "string") -> str:
    return "struct<" + ",".join(f"{n}:{kind}" for n in names) + ">"


LEAD_DDL = f"""
    lead_id string, source string, source_reference string, received_at timestamp,
    organization {_struct(ORGANIZATION_FIELDS)}, contact {_struct(CONTACT_FIELDS)},
    inquiry {_struct(INQUIRY_FIELDS)}, signals {_struct(SIGNAL_FIELDS, "boolean")},
    compliance struct<do_not_contact:boolean,restricted_market:boolean,duplicate_of:string,consent_status:string>,
    notes string, ordinal bigint
"""
EVIDENCE_DDL = """
    lead_id string, evidence_id string, seq bigint, kind string, value string, source_ref string,
    observed_at timestamp, confidence double, status string, note string
"""
REVIEW_DDL = """
    lead_id string, evidence_id string, seq bigint, action string, decision string, reviewed_at timestamp,
    note string, changes map<string,struct<from:string,to:string>>
"""
ORIGIN_DDL = """
    lead_id string, path string, evidence_id string, applied_value string, applied_at timestamp,
    updated_at timestamp, active boolean, ended_at timestamp, end_reason string, seq bigint
"""
DECISION_DDL = """
    pair_id string, lead_id string, other_lead_id string, decision string, primary_lead_id string,
    reviewed_at timestamp, note string, confidence double, reasons array<string>, seq bigint
"""
EVENT_DDL = """
    lead_id string, event_id string, seq bigint, type string, occurred_at timestamp, channel string,
    note string, due_at timestamp, related_event_id string, amount decimal(18,2), currency string,
    outcome_reason string
"""
BASELINE_DDL = "lead_id string, grade string, score int, captured_at timestamp"


@dataclass
class LeadTables:
    """A lead collection: the leads and the child tables that hang on `lead_id`."""

    leads: DataFrame
    evidence: DataFrame
    reviews: DataFrame
    origins: DataFrame
    decisions: DataFrame
    events: DataFrame
    baselines: DataFrame

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(f.name, getattr(self, f.name)) for f in fields(self)]


CHILD_DDL = {
    "evidence": EVIDENCE_DDL, "reviews": REVIEW_DDL, "origins": ORIGIN_DDL, "decisions": DECISION_DDL,
    "events": EVENT_DDL, "baselines": BASELINE_DDL,
}


def lead_tables(spark: SparkSession, leads: DataFrame, **children: DataFrame) -> LeadTables:
    """Bundle `leads` with the given child tables; the missing ones are empty."""
    return LeadTables(leads, **{
        name: children.get(name, None) or spark.createDataFrame([], ddl) for name, ddl in CHILD_DDL.items()
    })


def label_table(spark: SparkSession, labels: dict[str, str]) -> DataFrame:
    """Two-column dimension (code, label)."""
    return spark.createDataFrame(list(labels.items()), "code string, label string")
