"""Quality control and cohort summaries over the long tables. Zeros are never stored, so every mean divides by a count of cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERCENTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
UNKNOWN = ("UNK", "UNKNOWN")


def is_mitochondrial(name: Column) -> Column:
    up = F.upper(name)
    return up.startswith("MT-") | up.startswith("MT_")


def cell_qc(expr: DataFrame, genes: DataFrame) -> DataFrame:
    """cell_id, n_genes, total_counts, pct_counts_mt. The gene table is small next to expr and joined as such by the optimizer."""
    marked = expr.join(genes.select("gene", is_mitochondrial(F.col("name")).alias("mt")), "gene")
    total = F.sum("value")
    return marked.groupBy("cell_id").agg(
        F.count_if(F.col("value") != 0).alias("n_genes"),
        total.alias("total_counts"),
        F.coalesce(F.try_divide(F.sum(F.when(F.col("mt"), F.col("value")).otherwise(0.0)) * 100, total), F.lit(0.0)).alias("pct_counts_mt"),
    )


def quantiles(df: DataFrame, by: list[str], column: str, at: tuple[float, ...], buckets: int = 64) -> DataFrame:
    """by, q: exact linear quantiles of each group's values, nulls left out.

    Sketches of bounded size cut each group's values into buckets of about equal count; the bucket counts tell in which
    bucket each order statistic lies, and only the values of those buckets are ranked, each bucket by itself. The cuts
    decide who ranks what, not what is found.
    """
    rows = df.select(*by, F.col(column).cast("double").alias("_v")).where("_v is not null")
    counted = rows.groupBy(*by, "_v").agg(F.count("*").alias("_n"))
    cuts = rows.groupBy(*by).agg(F.percentile_approx("_v", [k / buckets for k in range(1, buckets)], 100 * buckets).alias("_cuts"), F.count("*").alias("_all"))
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    keyed = lambda x: x.withColumnsRenamed({c: f"_by_{c}" for c in by})
    cut = counted.join(keyed(cuts), reduce(Column.__and__, same, F.lit(True))).withColumn("_bucket", F.size(F.filter(F.array_distinct("_cuts"), lambda b: b < F.col("_v"))))
    cut = cut.select(*by, "_v", "_n", "_all", "_bucket")
    held = cut.groupBy(*by, "_bucket").agg(F.sum("_n").alias("_held"), F.max("_all").alias("_all"))
    before = F.coalesce(F.sum("_held").over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = F.array(*(x(F.lit(p) * (F.col("_all") - 1)).cast("long") for p in at for x in (F.floor, F.ceil)))
    asked = held.withColumn("_before", before).withColumn("_ranks", F.filter(F.array_distinct(ranks), lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_held")))).where(F.size("_ranks") > 0)
    asked = keyed(asked.select(*by, F.col("_bucket").alias("_of"), "_before", "_ranks"))
    inside = Window.partitionBy(*by, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = cut.join(asked, reduce(Column.__and__, [*same, F.col("_bucket") == F.col("_of")])).withColumn("_until", F.col("_before") + F.sum("_n").over(inside))
    hit = F.filter("_ranks", lambda r: (r < F.col("_until")) & (r >= F.col("_until") - F.col("_n")))
    found = ranked.select(*by, "_all", "_v", F.explode(hit).alias("_rank")).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"), F.max("_all").alias("_all"))

    def value(p: float) -> Column:
        h = F.lit(p) * (F.col("_all") - 1)
        low, high = (F.element_at("_at", x(h).cast("long")) for x in (F.floor, F.ceil))
        return low + (high - low) * (h - F.floor(h))

    return found.select(*by, F.array(*map(value, at)).alias("q"))


def describe(df: DataFrame, column: str, percentiles: tuple[float, ...] = PERCENTILES, over: tuple[float, ...] = (5.0, 10.0, 20.0)) -> DataFrame:
    """statistic, value: count, mean, std (n - 1), min, max, exact percentiles, share of rows above each bound."""
    c = F.col(column)
    parts = [F.count(c).cast("double").alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")]
    parts += [F.avg((c > b).cast("double")).alias(f"over_{b:g}") for b in over]
    one = df.agg(*parts)
    held = F.explode(F.arrays_zip(F.array(*(F.lit(f"p{round(p * 100)}") for p in percentiles)).alias("statistic"), F.col("q").alias("value")))
    return one.unpivot([], one.columns, "statistic", "value").unionByName(quantiles(df, [], column, percentiles).select(held.alias("x")).select("x.*"))


def filter_cells(expr: DataFrame, min_genes: int) -> DataFrame:
    good = expr.groupBy("cell_id").agg(F.count_if(F.col("value") > 0).alias("n")).where(F.col("n") >= min_genes)
    return expr.join(good.select("cell_id"), "cell_id", "left_semi")


def filter_genes(expr: DataFrame, min_cells: int) -> DataFrame:
    good = expr.groupBy("gene").agg(F.count_if(F.col("value") > 0).alias("n")).where(F.col("n") >= min_cells)
    return expr.join(good.select("gene"), "gene", "left_semi")


def combo(columns: list[str], separator: str = " | ") -> Column:
    """Key of several columns; nulls become "nan". No column: "set"; one: that column."""
    if not columns:
        return F.lit("set")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns]
    return parts[0] if len(parts) == 1 else F.concat_ws(separator, *parts)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """column, n, share; share is rounded to 6 digits."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.select(column, "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


def group_stats(df: DataFrame, by: list[str], column: str) -> DataFrame:
    plain = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(column).alias("mean"))
    middle = quantiles(df, by, column, (0.5,)).select(*(F.col(c).alias(f"_{c}") for c in by), F.col("q")[0].alias("median"))
    return plain.join(middle, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]), "left").select(*by, "n", "median", "mean")


def first_by(df: DataFrame, by: str, columns: list[str], order: str) -> DataFrame:
    """The first row's values of each group, by a stated order."""
    return df.groupBy(by).agg(*(F.min_by(c, order).alias(c) for c in columns))


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Wide counts, absent pairs 0. The values are given, so no pass is spent on finding them."""
    return df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).fillna(0)


def row_shares(counts: DataFrame, row: str, column: str, n: str = "n") -> DataFrame:
    """row, column, n, share of the row's total; 0 where the total is 0."""
    total = F.sum(n).over(Window.partitionBy(row))
    return counts.select(row, column, n, F.coalesce(F.try_divide(F.col(n), total), F.lit(0.0)).alias("share"))


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """bin (1 to bins), n: equal widths between the least and the largest value; the last bin is closed."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(width == 0, 1).otherwise(F.least(F.floor(F.try_divide(F.col(column) - F.col("lo"), width)) + 1, F.lit(bins)))
    return df.join(F.broadcast(ends)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def box_stats(df: DataFrame, by: str, column: str) -> DataFrame:
    ends = df.groupBy(by).agg(F.min(column).alias("low"), F.max(column).alias("high"))
    each = ends.join(quantiles(df, [by], column, (0.25, 0.5, 0.75)).withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by")), "left")
    return each.select(by, "low", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "high")


def stacked_bars(shares: DataFrame, bar: str, part: str, value: str) -> DataFrame:
    """Adds bottom: where each part of a bar begins."""
    before = Window.partitionBy(bar).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return shares.withColumn("bottom", F.coalesce(F.sum(value).over(before), F.lit(0.0)))


def is_unlabelled(label: Column) -> Column:
    plain = F.trim(label)
    return label.isNull() | (plain == "") | (F.lower(plain) == "nan") | F.upper(plain).isin(*UNKNOWN)


def split_masks(df: DataFrame, label: str) -> DataFrame:
    """Adds is_test: whether the label is unknown. Without the column everything is test."""
    return df.withColumn("is_test", is_unlabelled(F.col(label)) if label in df.columns else F.lit(True))


def numeric_features(df: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Numeric columns with more than one value, nulls and NaN as 0. One aggregation looks at all columns."""
    names = [f.name for f in df.schema if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double") and f.name not in exclude]
    if not names:
        raise ValueError("no numeric column")
    kinds = df.agg(*((F.count_distinct(F.col(c)) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in names)).first()
    kept = [c for c in names if (kinds[c] or 0) > 1]
    return df.select(*exclude, *(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in kept))


def lookup(df: DataFrame, key: str, table: DataFrame, value: str, default: str = "UNK") -> DataFrame:
    """df with `value` looked up in table (key, value) by key; the default where the key is absent."""
    named = table.select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    return df.join(named, F.col(key) == F.col("_key"), "left").withColumn(value, F.coalesce("_value", F.lit(default))).drop("_key", "_value")


def known_columns(columns: DataFrame, truth: DataFrame, patient: str = "patient", column: str = "bulk_col") -> DataFrame:
    """The bulk columns whose patient is known and that have a truth."""
    return columns.where(F.upper(F.trim(patient)).isin(*UNKNOWN) == F.lit(False)).join(truth.select(column).distinct(), column, "left_semi")


def with_default(df: DataFrame, column: str, default: Column) -> DataFrame:
    """df with `column`, made from the default if it has none."""
    return df if column in df.columns else df.withColumn(column, default)


def category_codes(labels: DataFrame, label: str, *sides: DataFrame) -> DataFrame:
    """labels with code: the place of the label in the sorted union of the sides' labels; null for what is in none."""
    union = label_union(label, *sides).withColumnRenamed(label, "_label")
    return labels.join(F.broadcast(union), F.col(label) == F.col("_label"), "left").withColumn("code", F.col("place")).drop("_label", "place")


def label_union(label: str, *sides: DataFrame) -> DataFrame:
    """place (from 0), label: every label of the sides once, sorted. There are few different labels, so one task ranks them."""
    every = reduce(DataFrame.union, [s.select(label) for s in sides]).where(F.col(label).isNotNull()).distinct()
    return every.select((F.row_number().over(Window.orderBy(label)) - 1).alias("place"), label)


def union_with_source(parts: dict[str, DataFrame], source: str = "source") -> DataFrame:
    """The rows of all parts, with the name of the part and the columns that all of them have."""
    common = [c for c in next(iter(parts.values())).columns if all(c in p.columns for p in parts.values())]
    return reduce(DataFrame.unionByName, [p.select(*common, F.lit(name).alias(source)) for name, p in parts.items()])


def distinct_joined(df: DataFrame, by: str, column: str, separator: str = ",") -> DataFrame:
    """by, column: the group's different values, sorted and joined."""
    return df.groupBy(by).agg(F.array_join(F.array_sort(F.collect_set(F.col(column).cast("string"))), separator).alias(column))


def thin_ticks(labels: DataFrame, place: str, most: int = 80) -> DataFrame:
    """The labels to be drawn on an axis: every ceil(n / most)-th one, by their place from 1."""
    n = labels.agg(F.count("*").alias("_n"))
    return labels.join(F.broadcast(n)).where((F.col(place) - 1) % F.ceil(F.col("_n") / most) == 0).drop("_n")


def coerce(column: Column) -> Column:
    """A number, or 0 for what is not one."""
    return F.coalesce(F.nanvl(column.try_cast("double"), F.lit(0.0)), F.lit(0.0))
