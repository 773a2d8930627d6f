"""Result and snapshot storage: workspace partitions, versioned manifests, export and restore."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom import model
from leadloom.functions import text as t
from leadloom.operators.governance import without_sensitive

# ---- fixed values ----
SNAPSHOT_VERSION = 1
WORKSPACE_ID = r"^ws_[a-zA-Z0-9_-]{4,80}$"
WORKSPACE_NAME_LIMIT = 60
# ---- end of fixed values ----

MANIFEST_DDL = (
    "workspace_id string, workspace_name string, format string, schema_version int, source string, table string, "
    "rows bigint, generated_at timestamp, note string"
)


class WorkspaceError(ValueError):
    """Data of another or invalid workspace, or of a newer version."""


def check_workspace(workspace_id: str, name: str) -> str:
    """The cleaned workspace name; raises on a bad id or name."""
    cleaned = re.sub(r"\s+", " ", name or "").strip()
    if not re.match(WORKSPACE_ID, workspace_id or ""):
        raise WorkspaceError("bad workspace id")
    if not cleaned or len(cleaned) > WORKSPACE_NAME_LIMIT or re.search(r"[\x00-\x1f\x7f]", cleaned):
        raise WorkspaceError("bad workspace name")
    return cleaned


def workspace_refusals(references: DataFrame, workspace_id: str, name: str) -> DataFrame:
    """Adds `refusal` to payload references (id, name): other-workspace when both id and name differ.

    Payloads without a reference are accepted.
    """
    marked = F.col("id").isNotNull() | F.col("name").isNotNull()
    same_id = F.col("id").eqNullSafe(F.lit(workspace_id))
    same_name = F.lower(t.squeezed("name")).eqNullSafe(F.lower(F.lit(check_workspace(workspace_id, name))))
    return references.withColumn("refusal", F.when(marked & ~same_id & ~same_name, "other-workspace"))


def write_tables(tables: dict[str, DataFrame], path: str, workspace_id: str, name: str, generated_at: Column,
                 source: str = "", kind: str = "qualified-leads", note: str = "", fmt: str = "parquet") -> DataFrame:
    """Write each table below `path`, partitioned by workspace, and one manifest row per table.

    Each job replaces only its own workspace's partition, so a repeated run leaves no doubles.
    Returns the manifest.
    """
    cleaned = check_workspace(workspace_id, name)
    spark = next(iter(tables.values())).sparkSession
    manifest = None
    for table, df in tables.items():
        target = f"{path}/{table}/workspace_id={workspace_id}"
        without_sensitive(df).write.mode("overwrite").format(fmt).save(target)
        rows = spark.read.format(fmt).schema(without_sensitive(df).schema).load(target).agg(F.count(F.lit(1)).alias("rows"))
        entry = rows.select(
            F.lit(workspace_id).alias("workspace_id"), F.lit(cleaned).alias("workspace_name"), F.lit(kind).alias("format"),
            F.lit(model.SCHEMA_VERSION).alias("schema_version"), F.lit(source).alias("source"), F.lit(table).alias("table"),
            F.col("rows"), generated_at.alias("generated_at"), F.lit(note).alias("note"))
        manifest = entry if manifest is None else manifest.unionByName(entry)
    manifest.write.mode("overwrite").parquet(f"{path}/manifest/workspace_id={workspace_id}")
    return read_manifest(spark, path, workspace_id)


def read_manifest(spark: SparkSession, path: str, workspace_id: str) -> DataFrame:
    ddl = ", ".join(c for c in MANIFEST_DDL.split(", ") if not c.startswith("workspace_id "))
    stored = spark.read.schema(ddl).parquet(f"{path}/manifest/workspace_id={workspace_id}")
    return stored.withColumn("workspace_id", F.lit(workspace_id))


def read_table(spark: SparkSession, path: str, table: str, workspace_id: str, ddl: str, fmt: str = "parquet") -> DataFrame:
    """One workspace's rows of a table; other workspaces' files are never opened."""
    if not re.match(WORKSPACE_ID, workspace_id):
        raise WorkspaceError("bad workspace id")
    return spark.read.schema(ddl).format(fmt).load(f"{path}/{table}/workspace_id={workspace_id}")


def snapshot(tables: model.LeadTables, path: str, workspace_id: str, name: str, saved_at: Column, label: str) -> DataFrame:
    """Dated copy of a workspace's tables; `label` names the snapshot."""
    return write_tables(dict(tables.items()), f"{path}/snapshot={label}", workspace_id, name, saved_at, kind="snapshot")


def restore(spark: SparkSession, path: str, label: str, workspace_id: str, new_workspace_id: str) -> model.LeadTables:
    """Tables of a snapshot, to be kept under a new workspace; refuses snapshots of a newer version."""
    if new_workspace_id == workspace_id or not re.match(WORKSPACE_ID, new_workspace_id):
        raise WorkspaceError("a snapshot is restored into a new workspace")
    base = f"{path}/snapshot={label}"
    version = read_manifest(spark, base, workspace_id).agg(F.max("schema_version")).first()[0]
    if version is None or version < 1:
        raise WorkspaceError("snapshot without a version")
    if version > model.SCHEMA_VERSION:
        raise WorkspaceError("snapshot of a newer version")
    tables = {"leads": model.LEAD_DDL, **model.CHILD_DDL}
    return model.LeadTables(**{n: read_table(spark, base, n, workspace_id, ddl) for n, ddl in tables.items()})
