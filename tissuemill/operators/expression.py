"""Normalisation, pseudobulk and marker ranking on the long expression table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-9


def cp10k(expr: DataFrame, column: str = "cell_id", target: float = 1e4) -> DataFrame:
    """value scaled to `target` per column; an empty column is divided by 1."""
    lib = F.sum("value").over(Window.partitionBy(column))
    return expr.withColumn("value", F.col("value") / F.when(lib == 0, F.lit(1.0)).otherwise(lib) * target)


def log1p(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.log1p("value"))


def asinh(df: DataFrame, c: float = 1.0) -> DataFrame:
    return df.withColumn("value", F.asinh(F.col("value") / c))


def sparse_quantile(expr: DataFrame, by: str, n_all: int | Column, q: float) -> DataFrame:
    """by, up: the linear quantile of each group's values, the absent ones being zeros (values are not negative).

    With z zeros and rank h = q (n - 1), both neighbours of h are looked up among the sorted non-zeros.
    """
    n = n_all if isinstance(n_all, Column) else F.lit(n_all)
    held = expr.groupBy(by).agg(F.array_sort(F.collect_list("value")).alias("v"))
    h = F.lit(q) * (n - 1)
    zeros = n - F.size("v")

    def at(rank: Column) -> Column:
        return F.coalesce(F.get("v", (rank - zeros).cast("int")), F.lit(0.0))

    low, high = at(F.floor(h)), at(F.ceil(h))
    return held.select(by, (low + (high - low) * (h - F.floor(h))).alias("up"))


def winsorise(expr: DataFrame, up: DataFrame, by: str = "gene") -> DataFrame:
    return expr.join(up, by).withColumn("value", F.greatest(F.lit(0.0), F.least("value", "up"))).drop("up")


def pseudobulk(expr: DataFrame, cells: DataFrame, keys: tuple[str, ...] = ("sample", "cell_type")) -> DataFrame:
    """keys, gene, m: mean over all cells of a group, absent values being zeros.

    The sums are combined map-side before the only large shuffle; the grid of groups and genes is small next to them.
    """
    keys = list(keys)
    groups = cells.groupBy(*keys).agg(F.count("*").alias("n"))
    sums = expr.join(cells.select("cell_id", *keys), "cell_id").groupBy(*keys, "gene").agg(F.sum("value").alias("s"))
    grid = groups.crossJoin(expr.select("gene").distinct())
    return grid.join(sums, [*keys, "gene"], "left").select(*keys, "gene", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("m"))


def contrast(pb: DataFrame, digits: int = 6, by: tuple[str, ...] = (), least: float = 1e-12) -> DataFrame:
    """cell_type, gene, score: log2 of a class's mean over the mean of the rest.

    The mean of all is over (sample, class) columns, so classes seen in more samples weigh more. A ratio that is not
    positive has no score. Scores are rounded, so that ties are ties. by: further keys, each group ranked by itself;
    least: lower bound of the number of other classes.
    """
    by = list(by)
    means = pb.groupBy(*by, "cell_type", "gene").agg(F.avg("m").alias("m_ct"))
    overall = pb.groupBy(*by, "gene").agg((F.avg("m") + TINY).alias("m_all"))
    k = F.size(F.collect_set("cell_type").over(Window.partitionBy(*by, "gene")))
    both = means.join(overall, [*by, "gene"]).withColumn("k", k)
    rest = (F.col("m_all") * F.col("k") - F.col("m_ct")) / F.greatest(F.lit(least), F.col("k") - 1.0)
    ratio = F.try_divide(F.col("m_ct") + TINY, rest + TINY)
    return both.select(*by, "cell_type", "gene", F.round(F.when(ratio > 0, F.log2(ratio)), digits).alias("score"))


def scale_moments(expr: DataFrame, n_cells: int | Column) -> DataFrame:
    """gene, mean, sd (n - 1) over all cells, absent values being zeros; a gene that does not vary has sd 1."""
    s = expr.groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    n = (n_cells if isinstance(n_cells, Column) else F.lit(n_cells)).cast("double")
    mean, n = F.col("s") / n, F.greatest(n, F.lit(1.0))
    var = F.greatest((F.col("q") - n * mean * mean) / F.greatest(n - 1, F.lit(1.0)), F.lit(0.0))
    return s.select("gene", mean.alias("mean"), F.when(var <= 1e-24, 1.0).otherwise(F.sqrt(var)).alias("sd"))


def scale_clip(expr: DataFrame, n_cells: int, most: float = 10.0) -> DataFrame:
    """cell_id, gene, value, zero: values scaled to unit variance and cut at `most`; zero is what an absent value becomes."""
    m = scale_moments(expr, n_cells)
    z = lambda v: F.least((v - F.col("mean")) / F.col("sd"), F.lit(most))
    return expr.join(m, "gene").select(*[c for c in expr.columns if c != "value"], z(F.col("value")).alias("value"), z(F.lit(0.0)).alias("zero"))


def pseudobulk_scaled(scaled: DataFrame, cells: DataFrame, keys: tuple[str, ...] = ("sample", "cell_type")) -> DataFrame:
    """pseudobulk of a scaled table (with zero): absent values count as what a zero was scaled to."""
    keys = list(keys)
    groups = cells.groupBy(*keys).agg(F.count("*").alias("n"))
    sums = scaled.join(cells.select("cell_id", *keys), "cell_id").groupBy(*keys, "gene").agg(F.sum("value").alias("s"), F.count("*").alias("k"))
    zeros = scaled.groupBy("gene").agg(F.max("zero").alias("zero"))
    full = groups.crossJoin(zeros).join(sums, [*keys, "gene"], "left")
    return full.select(*keys, "gene", ((F.coalesce("s", F.lit(0.0)) + (F.col("n") - F.coalesce("k", F.lit(0))) * F.col("zero")) / F.col("n")).alias("m"))


def chosen_or_all(chosen: DataFrame, more: DataFrame, every: DataFrame) -> DataFrame:
    """gene: those of either side; all genes if there are none."""
    union = chosen.select("gene").union(more.select("gene")).distinct()
    return every.select("gene").distinct() if union.isEmpty() else union


def markers_or_first(markers: DataFrame, genes: DataFrame, n: int = 200) -> DataFrame:
    """gene: the markers, or without any the first n genes in order."""
    found = markers.select("gene").distinct()
    return genes.select("gene").distinct().orderBy("gene").limit(n) if found.isEmpty() else found


def align_genes(*sides: DataFrame) -> DataFrame:
    """gene: those that all sides have; none in common is an error."""
    both = reduce(DataFrame.intersect, [s.select("gene") for s in sides])
    if both.isEmpty():
        raise ValueError("the tables have no gene in common")
    return both


def standardise(long: DataFrame, by: list[str], value: str) -> DataFrame:
    """long with z: value less its mean over its deviation (n) plus 1e-9, by group. Moments are aggregated and joined."""
    m = long.groupBy(*by).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    return long.join(F.broadcast(m), by).withColumn("z", (F.col(value) - F.col("_mean")) / (F.col("_sd") + 1e-9)).drop("_mean", "_sd")


def split_key(key: Column) -> Column:
    """(sample, cell_type) of a key that joins them by a bar; the first bar parts them."""
    parts = F.split(key, r"\|", 2)
    return F.struct(parts[0].alias("sample"), F.get(parts, F.lit(1)).alias("cell_type"))


def top_k(scores: DataFrame, k: int, by: str | list[str] = "cell_type", item: str = "gene", score: str = "score") -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.col(score).desc_nulls_last(), item)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def unique_markers(tops: DataFrame) -> DataFrame:
    """Markers that only one class has."""
    shared = tops.groupBy("gene").agg(F.count("*").alias("n")).where("n >= 2")
    return tops.join(shared.select("gene"), "gene", "left_anti")


def row_z(df: DataFrame, row: str, value: str, floor: float = 0.0) -> Column:
    """z-score inside a row; a deviation of at most `floor` counts as 1."""
    w = Window.partitionBy(row)
    sd = F.stddev_pop(value).over(w)
    return (F.col(value) - F.avg(value).over(w)) / F.when(sd <= floor, F.lit(1.0)).otherwise(sd)


def heatmap(pb: DataFrame, markers: DataFrame) -> DataFrame:
    """cell_type, gene, row_rank, col_rank, z: rows by class and falling mean, columns by class and sample."""
    marked = markers.select(F.col("cell_type").alias("of"), "gene")
    cells = pb.join(F.broadcast(marked), "gene")
    z = cells.withColumn("z", row_z(cells, "gene", "m")).withColumn("mean", F.round(F.avg("m").over(Window.partitionBy("gene")), 9))
    # Only the different keys are ranked: markers, and pseudobulk columns.
    rows = z.select("of", "gene", "mean").distinct().select("of", "gene", F.row_number().over(Window.orderBy("of", F.col("mean").desc(), "gene")).alias("row_rank"))
    columns = z.select("cell_type", "sample").distinct().select("cell_type", "sample", F.row_number().over(Window.orderBy("cell_type", "sample")).alias("col_rank"))
    return z.join(F.broadcast(rows), ["of", "gene"]).join(F.broadcast(columns), ["cell_type", "sample"]).select("sample", "cell_type", "gene", "of", "row_rank", "col_rank", "z")


def weighted_heatmap(pb: DataFrame, weights: DataFrame, floor: float = 1e-9) -> DataFrame:
    """cell_type, gene, mean (weighted over samples), z. Columns without a weight weigh nothing."""
    both = pb.join(weights, ["sample", "cell_type"], "left").withColumn("w", F.coalesce("w", F.lit(0)))
    means = both.groupBy("cell_type", "gene").agg((F.sum(F.col("w") * F.col("m")) / (F.sum("w") + 1e-12)).alias("mean"))
    w = Window.partitionBy("gene")
    sd = F.stddev_pop("mean").over(w)
    return means.withColumn("z", (F.col("mean") - F.avg("mean").over(w)) / F.when(sd < floor, F.lit(1.0)).otherwise(sd))


def cohens_d(pb: DataFrame, weights: DataFrame, eps: float = 1e-12) -> DataFrame:
    """cell_type, gene, d: weighted Cohen's d of each class against the rest.

    One pass: weighted sums by class and by gene give the rest by subtraction, the variances come from moments about
    the gene's own mean, which keeps them well conditioned.
    """
    both = pb.join(weights, ["sample", "cell_type"]).withColumn("x", F.col("m") - F.avg("m").over(Window.partitionBy("gene")))
    own = both.groupBy("cell_type", "gene").agg(F.sum("w").alias("w1"), F.sum(F.col("w") * F.col("x")).alias("s1"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("q1"))
    all_ = Window.partitionBy("gene")
    d = own.select("*", *((F.sum(f"{c}1").over(all_) - F.col(f"{c}1")).alias(f"{c}0") for c in "wsq"))

    def mean(k: int) -> Column:
        return F.col(f"s{k}") / (F.col(f"w{k}") + eps)

    def variance(k: int) -> Column:
        mu = mean(k)
        return (F.col(f"q{k}") - 2 * mu * F.col(f"s{k}") + mu * mu * F.col(f"w{k}")) / (F.col(f"w{k}") + eps)

    pooled = F.sqrt((variance(1) + variance(0)) / 2 + eps)
    return d.select("cell_type", "gene", ((mean(1) - mean(0)) / pooled).alias("d"))


def batch_robust_contrast(pb: DataFrame) -> DataFrame:
    """cell_type, gene, score: mean of the class minus mean of the rest, after centring each gene inside each sample.

    A sample with one class is left as it is.
    """
    w = Window.partitionBy("sample", "gene")
    centred = pb.withColumn("c", F.when(F.count("*").over(w) > 1, F.col("m") - F.avg("m").over(w)).otherwise(F.col("m")))
    own = centred.groupBy("cell_type", "gene").agg(F.sum("c").alias("s"), F.count("*").alias("n"))
    g = Window.partitionBy("gene")
    rest_s, rest_n = F.sum("s").over(g) - F.col("s"), F.sum("n").over(g) - F.col("n")
    return own.select("cell_type", "gene", (F.col("s") / F.col("n") - F.coalesce(F.try_divide(rest_s, rest_n), F.lit(0.0))).alias("score"))


def rank_norm(df: DataFrame, by: str, value: str, tie: str) -> DataFrame:
    """Adds rank_norm: (rank + 1) / (n + 1) among the positive values of a group, 0 for the others."""
    positive = df.where(F.col(value) > 0)
    w = Window.partitionBy(by)
    ranked = positive.withColumn("rank_norm", F.row_number().over(w.orderBy(value, tie)) / (F.count("*").over(w) + 1.0))
    return ranked.unionByName(df.where(~(F.col(value) > 0) | F.col(value).isNull()).withColumn("rank_norm", F.lit(0.0)))


def sample_of(bulk_col: Column) -> Column:
    """s<k> of a bulk column's name, or the name itself."""
    found = F.regexp_extract(F.lower(bulk_col), r"^(s\d+)", 1)
    return F.when(found == "", bulk_col).otherwise(found)
