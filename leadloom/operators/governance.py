"""Scans for secrets and forbidden terms, and removal of sensitive keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values: what a probable secret or a sensitive key looks like ----
SECRET_RULES = {
    "private-key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "service-key": r"sk-[A-Za-z0-9_-]{20,}",
    "repository-token": r"ghp_[A-Za-z0-9]{30,}",
    "cloud-key": r"\bAIza[0-9A-Za-z_-]{25,}\b",
}
SENSITIVE_KEY = r"(?i)api.?key|secret|token|password|authorization|cookie"
# ---- end of fixed values ----


def rule_hits(rows: DataFrame, column: str, rules: dict[str, str] | None = None) -> DataFrame:
    """(row columns without the text, rule, hits) for every rule found in the text; no shuffle.

    All rules are evaluated in one projection over the whole text.
    """
    rules = rules or SECRET_RULES
    counts = F.array(*[F.struct(F.lit(name).alias("rule"), F.regexp_count(column, F.lit(pattern)).alias("hits"))
                       for name, pattern in rules.items()])
    found = F.filter(counts, lambda c: c["hits"] > 0)
    return rows.select(*[c for c in rows.columns if c != column], F.inline(found))


def without_sensitive(df: DataFrame) -> DataFrame:
    """The same rows without columns, struct fields and map entries whose name looks sensitive."""
    import re

    def sensitive(name: str) -> bool:
        return re.search(SENSITIVE_KEY, name) is not None

    def clean(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            kept = [clean(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields if not sensitive(f.name)]
            return F.when(c.isNotNull(), F.struct(*kept)) if kept else F.lit(None)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: clean(x, kind.elementType))
        if isinstance(kind, T.MapType):
            visible = F.map_filter(c, lambda k, v: ~k.rlike(SENSITIVE_KEY)) if isinstance(kind.keyType, T.StringType) else c
            return F.transform_values(visible, lambda k, v: clean(v, kind.valueType))
        return c

    return df.select(*[clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields
                       if not sensitive(f.name)])
