"""Line dedup on overlapping three-line windows.

A text's lines are what stands between its line feeds; lines without a word (only white space) are not counted. A
window is three counted lines in a row, compared without leading and trailing white space. Of a window that occurs
more than once, over all documents and inside one, the occurrence with the smallest (doc_id, text, position) stays; every line
covered by a later occurrence of any window goes. White-space lines go when the counted line before them goes.

Defined results: null texts stay null; texts with fewer than three counted lines have no window and stay as they are;
rows repeated as a whole count as one row and get the same result; a null doc_id sorts first. A document whose lines
all go keeps its row with an empty text. Extra columns pass through unchanged.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import free_name, join_hot, keep, register, table

LINES = 3
_BLANK = "[\\\\x20\\\\t\\\\r\\\\x0B\\\\x0C]"


def _lines(text: str) -> str:
    """SQL for the text's lines, each trimmed."""
    return f"transform(split({text}, '\\n', -1), x -> regexp_replace(x, '^{_BLANK}+|{_BLANK}+$', ''))"


def windows(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """doc_id, text_key, position (of the window's first counted line) and the window's 128-bit hash; hashes only leave the scan."""
    counted = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.expr(f"filter({_lines('text')}, x -> x <> '')").alias("lines"))
    keys = counted.select("doc_id", "text_key", F.transform("lines", lambda x: F.md5(x)).alias("lines")).where(F.size("lines") >= lines)
    window = F.expr(f"transform(sequence(1, size(lines) - {lines - 1}), i -> md5(array_join(slice(lines, i, {lines}), '')))")
    return keys.select("doc_id", "text_key", F.posexplode(window).alias("position", "window")).withColumn("window", F.unhex("window"))


def covered(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """doc_id, text_key and the sorted positions of the counted lines that later occurrences cover; documents with none are left out."""
    found = keep(windows(docs, lines).distinct(), "windows")
    order = F.struct("doc_id", "text_key", "position")
    repeated = keep(found.groupBy("window").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1"), "repeated")
    later = join_hot(found, repeated, "window", "times").where(order > F.col("first"))
    gone = later.select("doc_id", "text_key", F.explode(F.sequence("position", F.col("position") + (lines - 1))).alias("position"))
    return gone.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("position")).alias("gone"))


def dedup_lines(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """`docs` with the kept text in `text`, and lines_total and lines_removed (counted lines)."""
    gone = covered(docs, lines)
    gone = keep(gone.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), F.col("gone").alias("_gone")), "gone")
    key = F.xxhash64("text")
    joined = docs.join(gone.hint("merge"), docs["doc_id"].eqNullSafe(F.col("_doc")) & (key == F.col("_key")), "left")
    total, removed = free_name(docs.columns, "lines_total"), free_name(docs.columns, "lines_removed")
    counted = F.expr(f"size(filter({_lines('coalesce(text, \"\")')}, x -> x <> ''))")
    return joined.withColumn(total, counted).withColumn(removed, F.coalesce(F.size("_gone"), F.lit(0))).withColumn("text", _kept("_gone")).select(
        *docs.columns, total, removed)


def _kept(gone: str):
    """The text without the lines whose counted position is in `gone`; unchanged where `gone` is null."""
    @F.pandas_udf("string")
    def strip(texts, positions):
        out = []
        for text, drop in zip(texts, positions):
            if drop is None or text is None:
                out.append(text)
                continue
            drop, at, stay, lines = set(drop), -1, True, []
            for line in text.split("\n"):
                if line.strip(" \t\r\x0b\x0c"):
                    at += 1
                    stay = at not in drop
                if stay:
                    lines.append(line)
            out.append("\n".join(lines))
        return pd.Series(out, dtype=object)

    return strip("text", gone)


ORACLE = r"""
WITH split_lines AS (
  SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\x20\t\r\x0B\x0C]+|[\x20\t\r\x0B\x0C]+$', '', 'g')), lambda x: x <> '') AS lines
  FROM documents
), windows AS (
  SELECT DISTINCT doc_id, text, position, lines[position + 1 : position + 3] AS win
  FROM (SELECT doc_id, text, lines, unnest(range(0, len(lines) - 2)) AS position FROM split_lines WHERE len(lines) >= 3)
), firsts AS (
  SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, position) AS nth FROM windows
), gone AS (
  SELECT DISTINCT doc_id, text, position + step AS position FROM firsts, (SELECT unnest([0, 1, 2]) AS step) WHERE nth > 1
), numbered AS (
  SELECT doc_id, text, line, place,
         sum(CASE WHEN regexp_replace(line, '[\x20\t\r\x0B\x0C]+', '', 'g') <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY place) - 1 AS position
  FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents)
), kept AS (
  SELECT n.doc_id, string_agg(n.line, chr(10) ORDER BY n.place) AS text
  FROM numbered n LEFT JOIN gone g ON n.doc_id = g.doc_id AND n.position = g.position
  WHERE g.doc_id IS NULL GROUP BY n.doc_id
)
SELECT d.doc_id, coalesce(k.text, '') AS text, CAST(len(s.lines) AS BIGINT) AS lines_total, CAST(coalesce(r.removed, 0) AS BIGINT) AS lines_removed
FROM documents d JOIN split_lines s ON s.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS removed FROM gone GROUP BY doc_id) r ON r.doc_id = d.doc_id
"""


@register("op6_line_dedup", ORACLE)
def op6_line_dedup(spark, folder):
    out = dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.col("lines_total").cast("long").alias("lines_total"), F.col("lines_removed").cast("long").alias("lines_removed"))
