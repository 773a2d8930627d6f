"""JSON and CSV scans of leads, prospects and relationship paths, and parsed search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom import model
from leadloom.functions import text as t
from leadloom.functions.web import http_url
from leadloom.operators import leads as shape
from leadloom.sources import inquiry_csv
from leadloom.sources.json_files import read_json

# ---- lead documents ----


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.capitalize() for w in rest)


def _struct(names: tuple[str, ...]) -> str:
    return "struct<" + ",".join(f"`{_camel(n)}`:string" for n in names) + ">"


_REVIEW = ("struct<decision:string,reviewedAt:string,note:string,history:array<struct<action:string,reviewedAt:string,"
           "note:string,changes:struct<value:struct<`from`:string,`to`:string>,sourceRef:struct<`from`:string,`to`:string>>>>>")
_LEAD = (
    "id:string,source:string,sourceReference:string,receivedAt:string,"
    f"organization:{_struct(model.ORGANIZATION_FIELDS)},contact:{_struct(model.CONTACT_FIELDS)},"
    f"inquiry:{_struct(model.INQUIRY_FIELDS)},signals:{_struct(model.SIGNAL_FIELDS)},"
    f"evidence:array<struct<id:string,kind:string,value:string,sourceRef:string,observedAt:string,confidence:string,"
    f"status:string,note:string,review:{_REVIEW}>>,"
    "fieldOrigins:array<struct<path:string,evidenceId:string,appliedValue:string,appliedAt:string,updatedAt:string,"
    "active:boolean,endedAt:string,endReason:string>>,"
    "duplicateReviews:array<struct<pairId:string,otherLeadId:string,decision:string,primaryLeadId:string,"
    "reviewedAt:string,note:string,confidence:string,reasons:array<string>>>,"
    "development:struct<qualificationBaseline:struct<grade:string,score:string,capturedAt:string>,"
    "events:array<struct<id:string,type:string,occurredAt:string,channel:string,note:string,dueAt:string,"
    "relatedEventId:string,amount:string,currency:string,outcomeReason:string>>>,"
    f"compliance:{_struct(('do_not_contact', 'restricted_market', 'duplicate_of', 'consent_status'))},notes:string"
)


def _fields(prefix: str, names: tuple[str, ...]) -> Column:
    return F.struct(*[F.col(f"{prefix}.{_camel(n)}").alias(n) for n in names])


def _path(c: Column) -> Column:
    """Stored paths use camel case after the dot."""
    out = c
    for path in model.FIELD_PATHS:
        group, field = path.split(".")
        if "_" in field:
            out = F.when(c == f"{group}.{_camel(field)}", path).otherwise(out)
    return out


def read_lead_documents(spark: SparkSession, path: str, interchange_ids: bool = False, multiline: bool | None = None) -> model.LeadTables:
    """Lead JSON: an array, {leads: [...]}, or an earlier result {results: [{lead}]}; also one lead per line.

    Flags and numbers are read as text, so 1 counts as true and a numeric quantity keeps its digits. All entries are
    read; `leads.newest` keeps the newest per lead where a caller wants a limit.
    """
    own = ", ".join(_split_fields(_LEAD))
    schema = own + f", leads array<struct<{_LEAD}>>, results array<struct<lead:struct<{_LEAD}>>>"
    raw = read_json(spark, path, schema, multiline)
    names = [f.split(" ", 1)[0].strip("`") for f in _split_fields(_LEAD)]
    itself = F.array(F.struct(*[F.col(n) for n in names]))
    docs = raw.select(F.explode(F.coalesce(
        F.col("leads"), F.transform("results", lambda r: r["lead"]), itself)).alias("d")).select("d.*").where(
        F.col("id").isNotNull() | F.col("source").isNotNull() | F.col("organization").isNotNull()
        | F.col("contact").isNotNull() | F.col("inquiry").isNotNull() | F.col("sourceReference").isNotNull())
    docs = docs.withColumn("ordinal", F.monotonically_increasing_id())
    shaped = docs.select(
        F.col("id").alias("lead_id"), "source", F.col("sourceReference").alias("source_reference"),
        F.col("receivedAt").alias("received_at"), _fields("organization", model.ORGANIZATION_FIELDS).alias("organization"),
        _fields("contact", model.CONTACT_FIELDS).alias("contact"), _fields("inquiry", model.INQUIRY_FIELDS).alias("inquiry"),
        _fields("signals", model.SIGNAL_FIELDS).alias("signals"),
        _fields("compliance", ("do_not_contact", "restricted_market", "duplicate_of", "consent_status")).alias("compliance"),
        "notes", "ordinal")
    leads = shape.normalize_leads(shaped, interchange_ids)
    made = shape.lead_id(F.coalesce(t.text("source"), F.lit("manual")), F.col("sourceReference"),
                         F.col("organization.name"), F.lower(t.trimmed("contact.email")), F.col("inquiry.message"),
                         interchange_ids)
    keyed = docs.withColumn("lead_id", F.coalesce(t.text("id"), made))

    facts = keyed.select("lead_id", F.posexplode("evidence").alias("seq", "e"))
    raw_evidence = facts.select(
        "lead_id", F.col("e.id").alias("evidence_id"), "seq", "e.kind", "e.value", F.col("e.sourceRef").alias("source_ref"),
        F.col("e.observedAt").alias("observed_at"), "e.confidence", "e.status", "e.note")
    evidence = shape.normalize_evidence(raw_evidence)
    reviewed = facts.where(F.col("e.review.decision").isin("accepted", "rejected"))
    no_changes = F.lit(None).cast("struct<value:struct<from:string,to:string>,sourceRef:struct<from:string,to:string>>")
    seed = F.array(F.struct(
        F.col("e.review.decision").alias("action"), F.col("e.review.reviewedAt").alias("reviewedAt"),
        F.col("e.review.note").alias("note"), no_changes.alias("changes")))
    history = F.when(F.size("e.review.history") > 0, F.col("e.review.history")).otherwise(seed)
    made_evidence = shape.evidence_id(F.col("e.kind"), F.col("e.value"), F.col("e.sourceRef"), F.col("e.observedAt"))
    entries = reviewed.select("lead_id", F.coalesce(t.text("e.id"), made_evidence).alias("evidence_id"),
                              F.col("e.review.decision").alias("decision"), F.posexplode(history).alias("seq", "h"))
    changes = F.create_map(F.lit("value"), F.col("h.changes.value"), F.lit("source_ref"), F.col("h.changes.sourceRef"))
    reviews = shape.normalize_reviews(entries.select(
        "lead_id", "evidence_id", "seq", "h.action", "decision", F.col("h.reviewedAt").alias("reviewed_at"), "h.note",
        F.map_filter(changes, lambda k, v: v.isNotNull()).alias("changes")))

    listed = keyed.select("lead_id", F.posexplode("fieldOrigins").alias("seq", "o"))
    origins = shape.normalize_origins(listed.select(
        "lead_id", "seq", _path(F.col("o.path")).alias("path"), F.col("o.evidenceId").alias("evidence_id"),
        F.col("o.appliedValue").alias("applied_value"), F.col("o.appliedAt").alias("applied_at"),
        F.col("o.updatedAt").alias("updated_at"), "o.active", F.col("o.endedAt").alias("ended_at"),
        F.col("o.endReason").alias("end_reason")))
    judged = keyed.select("lead_id", F.posexplode("duplicateReviews").alias("seq", "r"))
    decisions = shape.normalize_decisions(judged.select(
        "lead_id", "seq", F.col("r.pairId").alias("pair_id"), F.col("r.otherLeadId").alias("other_lead_id"), "r.decision",
        F.col("r.primaryLeadId").alias("primary_lead_id"), F.col("r.reviewedAt").alias("reviewed_at"), "r.note",
        "r.confidence", "r.reasons"))
    happened = keyed.select("lead_id", F.posexplode("development.events").alias("seq", "v"))
    events = shape.normalize_events(happened.select(
        "lead_id", "seq", F.col("v.id").alias("event_id"), "v.type", F.col("v.occurredAt").alias("occurred_at"),
        "v.channel", "v.note", F.col("v.dueAt").alias("due_at"), F.col("v.relatedEventId").alias("related_event_id"),
        "v.amount", "v.currency", F.col("v.outcomeReason").alias("outcome_reason")))
    base = keyed.select("lead_id", F.col("development.qualificationBaseline").alias("b")).where(F.col("b").isNotNull())
    baselines = shape.normalize_baselines(base.select(
        "lead_id", "b.grade", "b.score", F.col("b.capturedAt").alias("captured_at")))
    return model.LeadTables(leads, evidence, reviews, origins, decisions, events, baselines)


def _split_fields(ddl: str) -> list[str]:
    """Top-level `name:type` parts of a struct body as `name type`."""
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(ddl):
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and depth == 0:
            parts.append(ddl[start:i])
            start = i + 1
    parts.append(ddl[start:])
    return [p.replace(":", " ", 1) for p in parts]


# ---- prospects ----

PROSPECT_COLUMNS = (
    "prospect_id", "company_name", "company_domain", "title", "source_url", "published_at", "observed_at",
    "signal_excerpt", "signal_type", "product", "market", "buyer_type", "original_page_reviewed", "need_signal",
    "product_fit", "timing", "public_reachability", "evidence_quality",
)
# ---- fixed values: column names understood in prospect files ----
PROSPECT_ALIASES = {
    "company_name": ("company_name", "company", "企业名称", "公司名称"),
    "title": ("title", "页面标题"),
    "source_url": ("source_url", "url", "来源链接"),
    "signal_excerpt": ("signal_excerpt", "snippet", "信号摘录"),
    "signal_type": ("signal_type", "信号类型"),
    "published_at": ("published_at", "published_date", "发布日期"),
    "observed_at": ("observed_at", "观察时间"),
    "original_page_reviewed": ("original_page_reviewed", "已核查原页"),
    "product": ("product", "产品"),
    "market": ("market", "市场"),
    "buyer_type": ("buyer_type", "买家类型"),
    "need_signal": ("need_signal", "需求信号"),
    "product_fit": ("product_fit", "产品匹配"),
    "timing": ("timing", "时机信号"),
    "public_reachability": ("public_reachability", "公开可联系性"),
    "evidence_quality": ("evidence_quality", "证据质量"),
}
# ---- end of fixed values ----


def by_alias(rows: DataFrame, headers: list[str], aliases: dict[str, tuple[str, ...]], columns: tuple[str, ...]) -> DataFrame:
    """First non-blank of each column's aliases; missing columns are null."""
    place = {h: f"c{i}" for i, h in enumerate(headers)}

    def value(name: str) -> Column:
        found = [F.nullif(F.col(place[a]), F.lit("")) for a in aliases.get(name, (name,)) if a in place]
        return (F.coalesce(*found) if found else F.lit(None).cast("string")).alias(name)

    return rows.select("ordinal", *[value(c) for c in columns])


def read_prospects_csv(spark: SparkSession, path: str) -> DataFrame:
    headers = inquiry_csv.read_headers(spark, path)
    return by_alias(inquiry_csv.read_rows(spark, path, headers), headers, PROSPECT_ALIASES, PROSPECT_COLUMNS)


_LEVELS = ("need_signal", "product_fit", "timing", "public_reachability", "evidence_quality")
_PROSPECT = (
    "id:string,companyName:string,company_name:string,company:string,organization:string,companyDomain:string,"
    "company_domain:string,title:string,sourceUrl:string,url:string,source_ref:string,publishedAt:string,published:string,"
    "published_date:string,observedAt:string,signalExcerpt:string,snippet:string,highlights:string,signal:string,"
    "signalType:string,signal_type:string,product:string,market:string,buyerType:string,buyer_type:string,"
    "originalPageReviewed:string,original_page_reviewed:string,"
    "scoreInput:struct<needSignal:string,need_signal:string,productFit:string,product_fit:string,timing:string,"
    "publicReachability:string,public_reachability:string,evidenceQuality:string,evidence_quality:string>"
)


def read_prospects_json(spark: SparkSession, path: str, multiline: bool | None = None) -> DataFrame:
    """Prospect JSON: an array, {prospects: [...]} or {results: [...]}; members may be wrapped in {prospect}."""
    member = f"struct<{_PROSPECT},prospect:struct<{_PROSPECT}>>"
    fields = _split_fields(_PROSPECT)
    schema = ", ".join(fields) + f", prospect struct<{_PROSPECT}>, prospects array<{member}>, results array<{member}>"
    raw = read_json(spark, path, schema, multiline)
    names = [f.split(" ", 1)[0] for f in fields]
    itself = F.array(F.struct(*[F.col(n) for n in [*names, "prospect"]]))
    items = raw.select(F.explode(F.coalesce("prospects", "results", itself)).alias("i"))
    inner = F.coalesce(F.col("i.prospect"), F.struct(*[F.col(f"i.{n}") for n in names]))
    docs = items.select(inner.alias("p")).select("p.*").where(F.coalesce(*[n for n in names if n != "scoreInput"]).isNotNull())

    def pick(name: str, *sources: str) -> Column:
        return t.first_text(*sources).alias(name)

    return docs.select(
        F.monotonically_increasing_id().alias("ordinal"), pick("prospect_id", "id"),
        pick("company_name", "companyName", "company_name", "company", "organization"),
        pick("company_domain", "companyDomain", "company_domain"), pick("title", "title"),
        pick("source_url", "sourceUrl", "url", "source_ref"), pick("published_at", "publishedAt", "published", "published_date"),
        pick("observed_at", "observedAt"), pick("signal_excerpt", "signalExcerpt", "snippet", "highlights", "signal"),
        pick("signal_type", "signalType", "signal_type"), pick("product", "product"), pick("market", "market"),
        pick("buyer_type", "buyerType", "buyer_type"),
        pick("original_page_reviewed", "originalPageReviewed", "original_page_reviewed"),
        *[pick(n, *dict.fromkeys((f"scoreInput.{_camel(n)}", f"scoreInput.{n}"))) for n in _LEVELS])


# ---- search results ----

def parse_search_results(envelopes: DataFrame) -> DataFrame:
    """Result blocks of search answers (query_id, payload): title, url, published_at, author, highlights.

    Each payload is a JSON envelope with text parts; blocks are separated by a line of three dashes. Blocks
    without an http(s) URL are dropped. Answers that are no such envelope: see `refused_search_results`.
    """
    parts = F.from_json("payload", "struct<content:array<struct<type:string,text:string>>>")["content"]
    texts = F.array_compact(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: t.text(p["text"])))
    blocks = F.split(F.array_join(texts, "\n\n---\n\n"), r"\n\s*---\s*\n")

    def line(name: str) -> Column:
        return t.text(F.regexp_extract("block", rf"(?im)^{name}:[^\S\n]*(.*)$", 1))

    def known(name: str) -> Column:
        return F.when(line(name) != "N/A", line(name))

    listed = envelopes.select("query_id", F.posexplode(blocks).alias("position", "block"))
    return listed.select(
        "query_id", "position", line("Title").alias("title"), http_url(line("URL")).alias("url"),
        known("Published").alias("published_at"), known("Author").alias("author"),
        t.text(F.regexp_extract("block", r"(?im)^Highlights:\s*$([\s\S]*)", 1)).alias("highlights"),
    ).where(F.col("url").isNotNull())


def refused_search_results(envelopes: DataFrame) -> DataFrame:
    value = F.try_parse_json("payload")
    texts = F.try_variant_get(value, "$.content", "array<struct<type:string,text:string>>")
    usable = F.exists(texts, lambda p: (p["type"] == "text") & t.text(p["text"]).isNotNull())
    refusal = F.when(value.isNull(), "not-json").when(~F.coalesce(usable, F.lit(False)), "no-text")
    return envelopes.select("query_id", refusal.alias("refusal")).where(F.col("refusal").isNotNull())


def prospects_from_results(results: DataFrame, product: str | None = None, market: str | None = None,
                           buyer_type: str | None = None) -> DataFrame:
    """Search results as unreviewed prospects with the fixed levels of a mere search hit."""
    def text(value: str | None, name: str) -> Column:
        return F.lit(value).cast("string").alias(name)

    return results.select(
        F.col("ordinal"), text(None, "prospect_id"), F.col("title").alias("company_name"), text(None, "company_domain"),
        "title", F.col("url").alias("source_url"), "published_at", text(None, "observed_at"),
        F.col("highlights").alias("signal_excerpt"), text("search-result", "signal_type"), text(product, "product"),
        text(market, "market"), text(buyer_type, "buyer_type"), text("false", "original_page_reviewed"),
        text("1", "need_signal"), text("1", "product_fit"),
        F.when(F.col("published_at").isNotNull(), "1").otherwise("0").alias("timing"), text("3", "public_reachability"),
        text("1", "evidence_quality"))


# ---- relationship paths ----

PATH_COLUMNS = (
    "connector_id", "connector_name", "target_id", "target_name", "relationship_strength", "last_contact_at",
    "known_personally", "shared_company", "shared_industry", "shared_education", "consent_status", "evidence_ids",
)


def read_paths_csv(spark: SparkSession, path: str) -> DataFrame:
    headers = inquiry_csv.read_headers(spark, path)
    both = {c: (_camel(c), c) for c in PATH_COLUMNS}
    return by_alias(inquiry_csv.read_rows(spark, path, headers), headers, both, PATH_COLUMNS)


def read_paths_json(spark: SparkSession, path: str, multiline: bool | None = None) -> DataFrame:
    """Relationship JSON: an array or {paths: [...]}; keys in camel or snake case."""
    names = [n for c in PATH_COLUMNS for n in dict.fromkeys((_camel(c), c))]
    body = ",".join(f"{n}:string" for n in names)
    schema = ", ".join(f"{n} string" for n in names) + f", paths array<struct<{body}>>"
    raw = read_json(spark, path, schema, multiline)
    itself = F.array(F.struct(*[F.col(n) for n in names]))
    docs = raw.select(F.explode(F.coalesce("paths", itself)).alias("p")).select("p.*").where(
        F.coalesce(*names).isNotNull())
    # A JSON list of ids arrives as its text; bring it to the form with separators.
    ids = F.coalesce(F.array_join(F.from_json(F.coalesce("evidenceIds", "evidence_ids"), "array<string>"), "|"),
                     F.coalesce("evidenceIds", "evidence_ids"))
    return docs.select(*[F.coalesce(*[F.col(n) for n in dict.fromkeys((_camel(c), c))]).alias(c)
                         for c in PATH_COLUMNS if c != "evidence_ids"], ids.alias("evidence_ids"))
