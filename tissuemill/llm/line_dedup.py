"""Line deduplication by overlapping three-line windows.

Every window of three consecutive lines gets a 128-bit hash. A window that occurs more than once in the
corpus keeps its first occurrence (lowest doc_id, then text hash, then lowest line); all lines covered by a later occurrence
go, overlapping and touching windows being merged first.

Hot windows are counted with map-side combine; the join back to the occurrences is a plain join that adaptive
execution splits. What a document loses is a list of intervals, so the final rewrite is linear in its lines.

Defined edge cases: a null text counts as empty and comes back as ''; a text of fewer than three lines loses
nothing; rows that repeat both doc_id and text are one document given twice and lose the same lines, rows that
share a doc_id, or have none, with different texts are documents of their own; windows
that repeat inside a document count as later occurrences; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WIDTH = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _key() -> Column:
    """With doc_id, what tells documents apart."""
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")


def windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text_key, line (from 0), h1, h2: one row for each window."""
    lines = docs.select("doc_id", _key(), _lines(F.col("text")).alias("lines")).where(F.size("lines") >= width)
    starts = F.sequence(F.lit(0), F.size("lines") - width)

    def both(i: Column) -> Column:
        part = [F.col("lines")[i + k] for k in range(width)]
        return F.struct(i.alias("line"), F.xxhash64(*part).alias("h1"), F.xxhash64(F.lit("second"), *part).alias("h2"))

    return lines.select("doc_id", "text_key", F.inline(F.transform(starts, both)))


def removed_lines(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text_key, starts, ends: merged intervals of lines (inclusive) that later occurrences cover."""
    seen = windows(docs, width)
    first = (
        seen.groupBy("h1", "h2")
        .agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_key", "line")).alias("first"))
        .where("n > 1")
        .select("h1", "h2", F.col("first.doc_id").alias("first_doc"), F.col("first.text_key").alias("first_key"), F.col("first.line").alias("first_line"))
    )
    is_first = F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("text_key") == F.col("first_key")) & (F.col("line") == F.col("first_line"))
    later = seen.join(first, ["h1", "h2"]).where(~is_first)
    per = later.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("line")).alias("at"))
    last = F.size("at") - 1
    opens = F.filter("at", lambda x, i: (i == 0) | (x - F.get("at", i - 1) > width))
    shuts = F.filter("at", lambda x, i: (i == last) | (F.get("at", i + 1) - x > width))
    return per.select("doc_id", "text_key", opens.alias("starts"), F.transform(shuts, lambda x: x + (width - 1)).alias("ends"))


def dedup_lines(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text (what stays), n_lines, n_removed."""
    gone = removed_lines(docs, width).withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    each = docs.select("doc_id", _key(), _lines(F.col("text")).alias("lines"))
    each = each.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")

    def between(k: Column) -> Column:
        begin = F.when(k == 0, F.lit(0)).otherwise(F.get("ends", k - 1) + 1)
        end = F.when(k == F.size("starts"), F.size("lines")).otherwise(F.get("starts", k))
        return F.slice("lines", begin + 1, F.greatest(end - begin, F.lit(0)))

    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("starts")), between))
    each = each.withColumn("kept", F.when(F.col("starts").isNull(), F.col("lines")).otherwise(kept))
    return each.select(
        "doc_id",
        F.array_join("kept", "\n").alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_removed"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


ORACLE = """
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
r AS (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS i FROM l),
w AS (SELECT doc_id, i, line || chr(10) || lead(line, 1) OVER o || chr(10) || lead(line, 2) OVER o AS win
      FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM w WHERE win IS NOT NULL),
c AS (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS i FROM f WHERE k > 1),
k AS (SELECT r.doc_id, count(*) AS n_lines, count(c.i) AS n_removed,
      coalesce(string_agg(r.line, chr(10) ORDER BY r.i) FILTER (WHERE c.i IS NULL), '') AS t
      FROM r LEFT JOIN c ON r.doc_id = c.doc_id AND r.i = c.i GROUP BY r.doc_id)
SELECT doc_id, n_lines, n_removed, CAST(length(t) AS BIGINT) AS kept_chars, sha256(t) AS kept_sha256 FROM k
"""
