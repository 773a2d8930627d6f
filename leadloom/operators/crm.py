"""CRM customers: import of qualified leads, manual edits, replies, migration and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom import model
from leadloom.functions import text as t

# ---- fixed values: managed fields, and the limits of the interactive tool ----
MANAGED_FIELDS = ("name", "company", "country", "email", "whatsapp")
#: Characters by field, entries of `missing`, largest `evidence_count`, characters of any other managed value.
TOOL_LIMITS = {"name": 80, "company": 120, "country": 80, "email": 254, "whatsapp": 80, "notes": 1000, "missing": 20, "evidence_count": 999, "managed": 120}
CUSTOMERS_KEPT = 500
LEADS_PER_IMPORT = 500
# ---- end of fixed values ----

PROFILE_DDL = (
    "struct<lead_id:string,grade:string,score:int,source:string,source_reference:string,product:string,"
    "quantity:string,timeline:string,budget:string,inquiry_message:string,next_action:string,"
    "missing:array<string>,evidence_count:int,imported_at:timestamp>"
)
CUSTOMER_DDL = (
    "customer_id string, name string, company string, country string, email string, whatsapp string, notes string, "
    f"profile {PROFILE_DDL}, managed map<string,string>, created_at timestamp, updated_at timestamp"
)


def _cut(c: Column, limit: int | None) -> Column:
    return F.substring(c, 1, limit) if limit else c


def evidence_counts(effective: DataFrame) -> DataFrame:
    """Evidence per lead that neither its status nor its review rejects."""
    return effective.where(F.col("status") != "rejected").groupBy("lead_id").agg(
        F.count(F.lit(1)).alias("evidence_count"))


def import_rows(leads: DataFrame, qualified: DataFrame, effective: DataFrame, imported_at: Column,
                first: int | None = None, limits: dict[str, int] | None = None) -> DataFrame:
    """Qualified leads in the shape of CRM customers; `ordinal` gives the order of the import.

    All leads are imported; `first` (LEADS_PER_IMPORT in the interactive tool) keeps only the first ones.
    Values are whole; `limits` (TOOL_LIMITS in the interactive tool) cuts those it names.
    """
    if first:
        leads = leads.orderBy("ordinal").limit(first)
    joined = leads.join(qualified, "lead_id").join(evidence_counts(effective), "lead_id", "left")
    note = F.concat_ws(
        "\n", F.concat(F.lit("产品："), F.col("inquiry.product")), F.concat(F.lit("数量："), F.col("inquiry.quantity")),
        F.concat(F.lit("下一步："), F.col("next_action")))

    limits = limits or {}

    def short(c: str, name: str) -> Column:
        return F.coalesce(t.text(c, limits.get(name)), F.lit(""))

    count = F.coalesce("evidence_count", F.lit(0))
    if "evidence_count" in limits:
        count = F.least(F.lit(limits["evidence_count"]), count)

    return joined.select(
        F.col("lead_id").alias("customer_id"), "ordinal",
        short("contact.name", "name").alias("name"), short("organization.name", "company").alias("company"),
        short("organization.country", "country").alias("country"), F.lower(short("contact.email", "email")).alias("email"),
        short("contact.whatsapp", "whatsapp").alias("whatsapp"), _cut(note, limits.get("notes")).alias("notes"),
        F.struct(
            "lead_id", F.when(F.col("grade").isin(*model.GRADES), F.col("grade")).otherwise("D").alias("grade"),
            F.greatest(F.lit(0), F.least(F.lit(100), F.col("score"))).cast("int").alias("score"),
            t.text("source").alias("source"), t.text("source_reference").alias("source_reference"),
            t.text("inquiry.product").alias("product"), t.text("inquiry.quantity").alias("quantity"),
            t.text("inquiry.timeline").alias("timeline"), t.text("inquiry.budget").alias("budget"),
            t.text("inquiry.message").alias("inquiry_message"), t.text("next_action").alias("next_action"),
            (F.slice("missing", 1, limits["missing"]) if "missing" in limits else F.col("missing")).alias("missing"),
            count.cast("int").alias("evidence_count"),
            imported_at.alias("imported_at")).cast(PROFILE_DDL).alias("profile"))


def merge_import(customers: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Upsert an import into the customers, with `change` (imported, updated or kept).

    A managed field takes the new value when it is empty or still holds what the last import wrote;
    otherwise the manual value stays and the field is no longer managed. If one lead occurs several times,
    its last row gives the fields and its first non-blank note stays. One full outer join on the id.
    """
    fields = list(MANAGED_FIELDS)
    body = F.struct(*fields, "profile")
    note = F.when(F.col("notes") != "", F.col("ordinal"))
    once = incoming.groupBy("customer_id").agg(
        F.max_by(body, "ordinal").alias("in"), F.min_by("notes", note).alias("in_notes"))
    joined = customers.withColumn("_old", F.lit(True)).join(once, "customer_id", "full")
    has, known = F.col("in").isNotNull(), F.col("_old").isNotNull()

    def owned(f: str) -> Column:
        current = F.coalesce(F.col(f), F.lit(""))
        before = F.coalesce(F.element_at("managed", F.lit(f)), F.lit(""))
        return has & (~known | (current == "") | ((before != "") & (current == before)))

    values = [F.when(owned(f), F.col(f"in.{f}")).otherwise(F.coalesce(F.col(f), F.lit(""))).alias(f) for f in fields]
    entries = F.map_from_entries(F.array_compact(F.array(*[
        F.when(owned(f) & (F.col(f"in.{f}") != ""), F.struct(F.lit(f).alias("k"), F.col(f"in.{f}").alias("v"))) for f in fields])))
    return joined.select(
        "customer_id", *values,
        F.coalesce(F.nullif("notes", F.lit("")), "in_notes", F.lit("")).alias("notes"),
        F.when(has, F.col("in.profile")).otherwise(F.col("profile")).alias("profile"),
        F.when(has, entries).otherwise(F.col("managed")).alias("managed"),
        F.coalesce("created_at", now).alias("created_at"),
        F.when(has, now).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(has & known, "updated").when(has, "imported").otherwise("kept").alias("change"))


def import_counts(merged: DataFrame, incoming: DataFrame) -> DataFrame:
    """How many import rows created a customer and how many updated one."""
    new = merged.where(F.col("change") == "imported").agg(F.count(F.lit(1)).alias("imported"))
    rows = incoming.agg(F.count(F.lit(1)).alias("rows"))
    return rows.select(
        new.select("imported").scalar().alias("imported"),
        (F.col("rows") - new.select("imported").scalar()).alias("updated"))


def edit_customers(customers: DataFrame, edits: DataFrame, now: Column) -> DataFrame:
    """Manual upsert: a changed managed field is no longer managed; the creation time stays."""
    fields = list(MANAGED_FIELDS)
    new = edits.select("customer_id", F.struct(*fields, "notes").alias("new"))
    joined = customers.withColumn("_old", F.lit(True)).join(new, "customer_id", "full")
    edited, known = F.col("new").isNotNull(), F.col("_old").isNotNull()
    unchanged = F.array_compact(F.array(*[F.when(F.col(f).eqNullSafe(F.col(f"new.{f}")), F.lit(f)) for f in fields]))
    joined = joined.withColumn("_unchanged", unchanged)
    still = F.map_filter("managed", lambda k, v: F.array_contains("_unchanged", k))
    empty = F.create_map().cast("map<string,string>")
    return joined.select(
        "customer_id", *[F.when(edited, F.col(f"new.{f}")).otherwise(F.col(f)).alias(f) for f in fields],
        F.when(edited, F.col("new.notes")).otherwise(F.col("notes")).alias("notes"), "profile",
        F.when(~known, empty).when(edited, still).otherwise(F.col("managed")).alias("managed"),
        F.when(known, F.col("created_at")).otherwise(now).alias("created_at"),
        F.when(edited, now).otherwise(F.col("updated_at")).alias("updated_at"))


def first_customers(customers: DataFrame, keep: int = CUSTOMERS_KEPT) -> DataFrame:
    """The newest `keep` customers, as the interactive tool shows them."""
    return customers.orderBy(F.desc("created_at"), "customer_id").limit(keep)


def migrate_customers(rows: DataFrame, now: Column, limits: dict[str, int] | None = None) -> DataFrame:
    """Bring customers of older versions to the current columns and defaults; `limits` as in `import_rows`."""
    limits = limits or {}
    have = set(rows.columns)

    def column(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind)

    def short(name: str) -> Column:
        return F.coalesce(t.text(column(name), limits.get(name)), F.lit(""))

    managed = F.map_filter(
        F.coalesce(column("managed", "map<string,string>"), F.create_map().cast("map<string,string>")),
        lambda k, v: k.isin(*MANAGED_FIELDS) & (F.coalesce(t.trimmed(v), F.lit("")) != ""))
    typed = rows.select(
        t.text(column("customer_id")).alias("customer_id"), short("name").alias("name"),
        short("company").alias("company"), short("country").alias("country"),
        F.lower(short("email")).alias("email"), short("whatsapp").alias("whatsapp"),
        short("notes").alias("notes"), column("profile", PROFILE_DDL).alias("profile"),
        F.transform_values(managed, lambda k, v: F.when(k == "email", F.lower(_cut(t.trimmed(v), limits.get("email")))).otherwise(
            _cut(t.trimmed(v), limits.get("managed")))).alias("managed"),
        F.coalesce(column("created_at", "timestamp"), now).alias("created_at"),
        F.coalesce(column("updated_at", "timestamp"), now).alias("updated_at"))
    made = t.content_id("customer", F.col("name"), F.col("company"), F.col("email"), F.col("whatsapp"))
    return typed.withColumn("customer_id", F.coalesce("customer_id", made))


def append_replies(history: DataFrame, added: DataFrame, keep: int | None = None) -> DataFrame:
    """The replies after an append; the newest `keep` per workspace, if given.

    Columns: workspace_id, reply_id, created_at, customer_id, inbound, scenario_id, reply, mode, provider.
    """
    def typed(rows: DataFrame) -> DataFrame:
        return rows.select(
            "workspace_id", t.text("reply_id").alias("reply_id"), "created_at",
            F.coalesce(t.text("customer_id"), F.lit("")).alias("customer_id"),
            F.coalesce(t.text("inbound"), F.lit("")).alias("inbound"),
            F.coalesce(t.text("scenario_id"), F.lit("inquiry")).alias("scenario_id"),
            F.coalesce(t.text("reply"), F.lit("")).alias("reply"),
            F.coalesce(t.text("mode"), F.lit("generic")).alias("mode"),
            F.when(F.col("provider") == "ai", "ai").otherwise("template").alias("provider"))

    every = typed(history).unionByName(typed(added))
    if keep is None:
        return every
    newest = Window.partitionBy("workspace_id").orderBy(F.desc("created_at"), F.desc("reply_id"))
    return every.withColumn("_rank", F.row_number().over(newest)).where(
        F.col("_rank") <= keep).drop("_rank")


def remove_replies(history: DataFrame, removed: DataFrame) -> DataFrame:
    return history.join(removed.select("reply_id"), "reply_id", "left_anti")


def crm_stats(customers: DataFrame, replies: DataFrame) -> DataFrame:
    base = customers.agg(F.count(F.lit(1)).alias("customers"),
                         F.count_if(F.col("profile").isNotNull()).alias("with_profile"))
    return base.select("customers", "with_profile", replies.agg(F.count(F.lit(1))).scalar().alias("replies"))


def settings_for_export(settings: DataFrame) -> DataFrame:
    """Settings without the key and with remote replies switched off."""
    return settings.withColumn("ai_key", F.lit("")).withColumn("ai_enabled", F.lit(False))


def settings_from_import(imported: DataFrame, current: DataFrame) -> DataFrame:
    """Imported settings keep the key of this workspace and stay switched off."""
    kept = current.select("workspace_id", F.col("ai_key").alias("_key"))
    return imported.join(kept, "workspace_id", "left").withColumn("ai_key", F.coalesce("_key", F.lit(""))).withColumn(
        "ai_enabled", F.lit(False)).drop("_key")


def empty_customers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CUSTOMER_DDL)
