"""JSON scans that lose no record: one record per line (split into many tasks), or whole documents (one task per file)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CORRUPT = "_unreadable"


def _is_record(line: Column) -> Column:
    """A line that is a whole JSON object or list by itself."""
    return line.rlike(r"^\s*[\[{]") & F.try_parse_json(line).isNotNull()


def in_lines(spark: SparkSession, path: str) -> bool:
    """Whether the first line with content is a record by itself."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    first = lines.select(_is_record(F.col("value")).alias("whole")).first()
    return first is None or bool(first.whole)


def read_json(spark: SparkSession, path: str, schema: str, multiline: bool | None = None) -> DataFrame:
    """Records of the files at `path`; a file of the other form is refused rather than read in part.

    Without `multiline` the form is that of the first line. In line form every line must hold a record or a list of them; in document
    form no file may hold two records one per line.
    """
    if multiline is None:
        multiline = not in_lines(spark, path)
    if multiline:
        lines = spark.read.text(path).select(F.input_file_name().alias("file"), "value").where(F.trim("value") != "")
        alone = lines.groupBy("file").agg(F.count_if(_is_record(F.col("value"))).alias("records"), F.count(F.lit(1)).alias("lines"))
        mixed = alone.where((F.col("records") > 1) & (F.col("records") == F.col("lines"))).select("file").first()
        if mixed:
            raise ValueError(f"{mixed.file} holds one record per line: read it apart from whole documents")
        return spark.read.schema(schema).option("multiLine", True).json(path)
    fields = T.StructType.fromDDL(schema)
    raw = spark.read.schema(T.StructType([*fields.fields, T.StructField(_CORRUPT, T.StringType())])).option(
        "columnNameOfCorruptRecord", _CORRUPT).json(path)
    refused = F.concat(F.lit("a line is no whole JSON record; read documents with multiline=True: "), F.substring(_CORRUPT, 1, 80))
    # The check is part of the scan: a plan that reads any column meets it.
    checked = raw.withColumn("_ok", F.when(F.col(_CORRUPT).isNotNull() & (F.trim(_CORRUPT) != ""), F.raise_error(refused).cast("boolean")).otherwise(True))
    return checked.where("_ok").select(*[f.name for f in fields.fields])
