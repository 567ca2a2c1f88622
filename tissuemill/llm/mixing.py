"""Mixing sources to target weights by systematic sampling.

Each document expects target / source size copies. Inside a source the expected copies are prefix-summed in
fixed point, one offset is added to the sums, and a document is emitted once for each integer boundary its
own share crosses. The order inside a source runs by size (five leading bits) and then by a hash of the
identifier and the text, so that every stretch of the prefix sum sees documents of like size and the taken words stay near
the target.

The prefix sum is hierarchical: (source, size class, 256 hash slices) groups are summed with map-side
combine, the group totals are prefix-summed per source, and rows are only ordered inside one group. A source
with a third of all rows is therefore spread over thousands of groups.

Defined edge cases: a null text has size 0; a null source is a source of its own, last in order; a null
doc_id takes part like any other; rows with the same doc_id are separate documents, dealt to slices by their texts; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table, word_count

#: Fixed-point bits of an expected number of copies.
BITS = 24
WEIGHTS = (1, 2, 3)
CAP = 3
SEED = "mix-1"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per source (no_source, src): source_size, target.

    The targets share the total size by weight; what exceeds cap times a source's size is shared again. The
    final level is the largest of the levels that come from capping ever more sources in the order of
    cap / weight. One row per source, so its unpartitioned windows hold as many rows as there are sources.
    """
    per = sizes.groupBy("no_source", "src").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy("no_source", "src")) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double"))
    most = (F.col("source_size") * cap).cast("double")
    before = Window.orderBy(most / F.col("weight"), "no_source", "src").rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    level = (F.sum("source_size").over(all_rows) - F.coalesce(F.sum(most).over(before), F.lit(0.0))) / (
        F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    per = per.withColumn("level", level)
    return per.select("no_source", "src", "source_size", F.least(most, F.max("level").over(all_rows) * F.col("weight")).alias("target"))


def _hex(text: Column, at: int, n: int) -> Column:
    return F.conv(F.substring(F.md5(text), at, n), 16, 10).cast("long")


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, copies, taken."""
    return _plan(docs, [], weights, cap, seed)


def _plan(docs: DataFrame, key: list[str], weights: tuple[int, ...], cap: int, seed: str) -> DataFrame:
    """The plan, each row with the columns `key` of its row of docs."""
    sizes = stage(
        docs.select(
            *key,
            "doc_id",
            F.col("source").isNull().cast("int").alias("no_source"),
            F.coalesce("source", F.lit("")).alias("src"),
            word_count(F.col("text")).alias("size"),
            F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))).alias("mixed"),
        )
    )
    bits = F.length(F.bin("size"))
    low = F.greatest(bits - 5, F.lit(0))
    rows = sizes.select(
        "*",
        (bits * 32 + F.floor(F.col("size") / F.pow(F.lit(2.0), low))).cast("int").alias("size_class"),
        F.substring("mixed", 1, 2).alias("part"),
    )
    share = targets(sizes, weights, cap).select(
        "*",
        F.coalesce(F.round(F.try_divide("target", "source_size") * (1 << BITS)), F.lit(0)).cast("long").alias("expected"),
        _hex(F.concat_ws("|", F.lit(seed), "no_source", "src"), 1, BITS // 4).alias("offset"),
    )
    share = stage(share)
    source, group = ["no_source", "src"], ["no_source", "src", "size_class", "part"]
    ahead = Window.partitionBy(*source).orderBy("size_class", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(*group)
        .agg(F.count("*").alias("n"))
        .join(share, source)
        .select(*group, "source_size", "target", "expected", "offset", F.coalesce(F.sum(F.col("n") * F.col("expected")).over(ahead), F.lit(0)).alias("start"))
    )
    inside = Window.partitionBy(*group).orderBy("mixed", "doc_id", "size", *key)
    until = F.col("start") + F.sum("expected").over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col("offset")
    copies = F.shiftright(F.col("until"), BITS) - F.shiftright(F.col("until") - F.col("expected"), BITS)
    return (
        rows.join(starts, group)
        .withColumn("until", until)
        .select(*key, "doc_id", "size", "source_size", "target", copies.alias("copies"))
        .withColumn("taken", F.col("copies") * F.col("size"))
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mixed corpus: rows of docs, each as often as the plan says.

    A row is known by two 64-bit hashes of all its columns. Rows equal in every column stand for each other: one of
    them is emitted as often as the plan says for all of them.
    """
    whole = [x for c in docs.columns for x in (F.col(c), F.col(c).isNull())]
    keyed = docs.withColumn("_h1", F.xxhash64(*whole)).withColumn("_h2", F.xxhash64(F.lit("second"), *whole))
    chosen = _plan(keyed, ["_h1", "_h2"], weights, cap, seed).groupBy("_h1", "_h2").agg(F.sum("copies").cast("int").alias("_copies"), F.count("*").alias("_rows"))
    chosen = stage(chosen.where("_copies > 0"))
    each = keyed.join(chosen.where("_rows = 1").drop("_rows"), ["_h1", "_h2"])
    repeated = chosen.where("_rows > 1").drop("_rows")
    if not repeated.isEmpty():
        each = each.unionByName(keyed.join(repeated, ["_h1", "_h2"]).dropDuplicates(["_h1", "_h2"]))
    return each.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(*docs.columns)


def op7_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, CAST(source IS NULL AS INTEGER) AS no_source, coalesce(source, '') AS src,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS mixed FROM documents),
s AS (SELECT no_source, src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY no_source, src) - 1) % 3 + 1 AS DOUBLE) AS weight,
             CAST(source_size * {CAP} AS DOUBLE) AS most FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s)
        - coalesce(sum(most) OVER (ORDER BY most / weight, no_source, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / ((SELECT sum(weight) FROM w)
        - coalesce(sum(weight) OVER (ORDER BY most / weight, no_source, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
t AS (SELECT no_source, src, source_size, least(most, max(level) OVER () * weight) AS target FROM l),
e AS (SELECT *, CAST(CASE WHEN source_size = 0 THEN 0 ELSE round(target / source_size * {1 << BITS}) END AS BIGINT) AS expected,
      CAST(('0x' || substr(md5('{SEED}|' || no_source || '|' || src), 1, {BITS // 4})) AS BIGINT) AS off FROM t),
o AS (SELECT d.*, e.source_size, e.target, e.expected,
      sum(e.expected) OVER (PARTITION BY d.no_source, d.src
        ORDER BY length(bin(d.size)) * 32 + (d.size >> greatest(length(bin(d.size)) - 5, 0)), d.mixed, d.doc_id, d.size
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + e.off AS until
      FROM d JOIN e USING (no_source, src))
SELECT doc_id, size, source_size, target,
       CAST((until // {1 << BITS}) - ((until - expected) // {1 << BITS}) AS BIGINT) AS copies,
       CAST(((until // {1 << BITS}) - ((until - expected) // {1 << BITS})) * size AS BIGINT) AS taken FROM o
"""
