"""Classification algebra: weights, neighbours, arbiter features and targets, folds, metrics, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import neighbours as N
from .neighbours import nearest  # noqa: F401  part of this module's interface


def class_weights(df: DataFrame, label: str, alpha: float = 0.0, most: float = 5.0) -> DataFrame:
    """label, weight: min(N / (K (n + alpha)), most)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    everything = Window.partitionBy()
    return counts.select(label, F.least(F.sum("n").over(everything) / (F.count("*").over(everything) * (F.col("n") + alpha)), F.lit(most)).alias("weight"))


def knn(queries: DataFrame, train: DataFrame, k: int = 30, digits: int = 9, metric: str = "cosine", probes: int = N.PROBES, exact: bool = True) -> DataFrame:
    """query, neighbour, label, distance, rank: the k nearest by cosine or euclidean distance, ties by neighbour.

    queries: cell_id, f. train: cell_id, cell_type, f. exact=False looks into the `probes` nearest cells only.
    """
    return N.search(queries, N.build(train, metric), k, probes, exact, digits)


def knn_votes(neighbours: DataFrame, classes: list[int], weighted: bool = False) -> DataFrame:
    """query, label, votes, p: every class, p being the softmax of the raw vote counts, or of the votes weighted by
    1 / (distance + 1e-12)."""
    vote = F.sum(1 / (F.col("distance") + 1e-12)) if weighted else F.count("*")
    counts = neighbours.groupBy("query", "label").agg(vote.alias("votes"))
    spark = neighbours.sparkSession
    grid = neighbours.select("query").distinct().crossJoin(F.broadcast(spark.createDataFrame([(c,) for c in classes], "label int")))
    full = grid.join(counts, ["query", "label"], "left").withColumn("votes", F.coalesce("votes", F.lit(0)))
    w = Window.partitionBy("query")
    e = F.exp(F.col("votes") - F.max("votes").over(w))
    return full.withColumn("e", e).select("query", "label", "votes", (F.col("e") / (F.sum("e").over(w) + 1e-12)).alias("p"))


def meta_features(df: DataFrame, models: list[str], p_positive: str = "p_t") -> DataFrame:
    """Adds, for probability columns `models`: top1, margin, entropy of each, and an agreement flag of each pair."""
    out = {}
    for m in models:
        out |= {f"{m}_top1": V.top1(F.col(m)), f"{m}_margin": V.margin(F.col(m)), f"{m}_entropy": V.entropy(F.col(m))}
    for i, a in enumerate(models):
        for b in models[i + 1 :]:
            out[f"agree_{a}_{b}"] = (V.argmax(F.col(a)) == V.argmax(F.col(b))).cast("int")
    return df.withColumns(out)


def meta_target(truth: Column, predicted: list[Column], margins: list[Column]) -> Column:
    """Which model to trust: of those that are right the one of largest margin, else the largest margin; first wins."""
    right = F.array(*(F.when(p == truth, m) for p, m in zip(predicted, margins, strict=True)))
    best = F.array_max(right)
    return F.when(best.isNotNull(), F.array_position(right, best) - 1).otherwise(V.argmax(F.array(*margins))).cast("int")


def group_folds(groups: DataFrame, group: str, n: str, k: int) -> DataFrame:
    """group, fold: largest group first into the lightest fold, the lowest fold on a tie.

    groups has one row for each group (samples, some thousands at most); the packing is a fold over one sorted array of
    them, since each step depends on the one before.
    """
    packed = groups.agg(F.array_sort(F.collect_list(F.struct((-F.col(n)).alias("m"), F.col(group).alias("g")))).alias("all"))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), k).alias("load"), F.array().cast(f"array<struct<g:{groups.schema[group].dataType.simpleString()},fold:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = F.array_position(acc["load"], F.array_min(acc["load"])).cast("int")
        load = F.transform(acc["load"], lambda v, i: F.when(i + 1 == at, v - x["m"]).otherwise(v))
        return F.struct(load.alias("load"), F.concat(acc["out"], F.array(F.struct(x["g"].alias("g"), (at - 1).alias("fold")))).alias("out"))

    return packed.select(F.inline(F.aggregate("all", start, step, lambda acc: acc["out"]))).select(F.col("g").alias(group), "fold")


def _dealt(df: DataFrame, by: list[str], key: str, k: int) -> DataFrame:
    """Adds fold: the rows of each group dealt in the order of a hash of the key.

    Slices of the hash are ranked each by itself; what comes before a slice is a prefix sum over 4,096 counts of a group.
    """
    hashed = df.withColumn("_hash", F.md5(F.col(key).cast("string"))).withColumn("_slice", F.substring("_hash", 1, 3))
    counts = hashed.groupBy(*by, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_slice").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by, "_slice").orderBy("_hash", key)
    same = F.col("_slice") == F.col("_of")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    placed = hashed.withColumn("_row", F.row_number().over(inside)).join(starts, same)
    return placed.withColumn("fold", ((F.col("_start") + F.col("_row") - 1) % k).cast("int")).select(*df.columns, "fold")


def stratified_folds(df: DataFrame, label: str, key: str, k: int) -> DataFrame:
    """Adds fold: the rows of each class dealt in the order of a hash of the key."""
    return _dealt(df, [label], key, k)


def plain_folds(df: DataFrame, key: str, k: int) -> DataFrame:
    """Adds fold: all rows dealt in the order of a hash of the key."""
    return _dealt(df, [], key, k)


def fold_count(df: DataFrame, mode: str, label: str, group: str, most: int = 5) -> int:
    """How many folds a mode allows: no more than groups, than rows of the rarest class, or than rows."""
    if mode == "group":
        n = df.select(F.coalesce(F.col(group).cast("string"), F.lit("NA"))).distinct().count()
        if n < 2:
            raise ValueError(f"two groups are needed, there are {n}")
        return min(most, n)
    if mode == "stratified":
        return max(2, min(most, df.groupBy(label).count().agg(F.min("count")).first()[0] or 0))
    if mode == "kfold":
        return max(2, min(most, df.count()))
    raise ValueError(f"unknown mode {mode!r}: group, stratified or kfold")


def folds(df: DataFrame, mode: str, label: str, group: str, key: str, most: int = 5) -> DataFrame:
    """df with fold, by one of three splitters; the number of folds adjusts itself."""
    k = fold_count(df, mode, label, group, most)
    if mode == "group":
        named = df.withColumn("_group", F.coalesce(F.col(group).cast("string"), F.lit("NA")))
        packed = group_folds(named.groupBy("_group").agg(F.count("*").alias("n")), "_group", "n", k)
        return named.join(F.broadcast(packed), "_group").drop("_group")
    return stratified_folds(df, label, key, k) if mode == "stratified" else plain_folds(df, key, k)


def mean_probabilities(folds: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """keys, p: each key's probabilities averaged over its rows, one for each fold, class by class."""
    each = folds.select(*keys, F.posexplode(p).alias("_at", "_p")).groupBy(*keys, "_at").agg(F.avg("_p").alias("_p"))
    listed = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", "_p"))).alias("_all"))
    return listed.select(*keys, F.col("_all._p").alias(p))


def lopo_folds(patients: DataFrame, patient: str, most_inner: int = 5) -> DataFrame:
    """outer, inner, patient, role: leave one patient out; the others in min(5, others) inner folds by rank.

    The fold table has patients squared rows by design; there are few patients next to cells.
    """
    everyone = patients.select(F.col(patient).alias("patient")).distinct()
    outer = everyone.select(F.col("patient").alias("outer"))
    others = outer.crossJoin(everyone).where("outer <> patient")
    w = Window.partitionBy("outer")
    k = F.least(F.lit(most_inner), F.greatest(F.lit(1), F.count("*").over(w)))
    dealt = others.withColumn("k", k).withColumn("fold", (F.row_number().over(w.orderBy("patient")) - 1) % F.col("k"))
    inner = dealt.withColumn("inner", F.explode(F.sequence(F.lit(0), (F.col("k") - 1).cast("int"))))
    role = F.when(F.col("fold") == F.col("inner"), "valid").otherwise("train")
    return inner.select("outer", "inner", "patient", role.alias("role"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))


def metrics(cm: DataFrame) -> DataFrame:
    """One row from a confusion table t, p, n: accuracy, balanced accuracy, macro F1, ARI, V-measure, score.

    The table has at most classes squared rows; everything else is closed forms over its margins.
    """
    rows = cm.groupBy(F.col("t").alias("c")).agg(F.sum("n").alias("a"))
    cols = cm.groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("b"))
    diagonal = cm.where("t = p").select(F.col("t").alias("c"), F.col("n").alias("hit"))
    per = rows.join(cols, "c", "full").join(diagonal, "c", "left").fillna(0, ["a", "b", "hit"])
    pairs = lambda x: x * (x - 1) / 2
    f1 = F.coalesce(F.try_divide(2.0 * F.col("hit"), F.col("a") + F.col("b")), F.lit(0.0))
    recall = F.when(F.col("a") > 0, F.col("hit") / F.col("a"))
    xlogx = lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)
    side = per.agg(
        F.sum("a").alias("n_all"), F.sum("hit").alias("hits"), F.avg(recall).alias("balanced_accuracy"), F.avg(f1).alias("macro_f1"),
        F.sum(pairs(F.col("a"))).alias("pa"), F.sum(pairs(F.col("b"))).alias("pb"), F.sum(xlogx(F.col("a").cast("double"))).alias("la"), F.sum(xlogx(F.col("b").cast("double"))).alias("lb"),
    )
    joint = cm.agg(F.sum(pairs(F.col("n"))).alias("pj"), F.sum(xlogx(F.col("n").cast("double"))).alias("lj"))
    n = F.col("n_all").cast("double")
    expected = F.try_divide(F.col("pa") * F.col("pb"), pairs(n))
    ari = F.coalesce(F.try_divide(F.col("pj") - expected, (F.col("pa") + F.col("pb")) / 2 - expected), F.lit(1.0))
    h_t, h_p = F.log(n) - F.col("la") / n, F.log(n) - F.col("lb") / n
    h_tp, h_pt = (F.col("lb") - F.col("lj")) / n, (F.col("la") - F.col("lj")) / n  # of t given p, of p given t
    homogeneity = F.when(h_t <= 1e-15, F.lit(1.0)).otherwise(1 - F.try_divide(h_tp, h_t))
    completeness = F.when(h_p <= 1e-15, F.lit(1.0)).otherwise(1 - F.try_divide(h_pt, h_p))
    v = F.coalesce(F.try_divide(2 * homogeneity * completeness, homogeneity + completeness), F.lit(0.0))
    one = side.crossJoin(joint).select((F.col("hits") / n).alias("accuracy"), "balanced_accuracy", "macro_f1", ari.alias("ari"), v.alias("v_measure"))
    return one.withColumn("score", (F.col("ari") + F.col("v_measure")) / 2)


def vote_three(first: DataFrame, second: DataFrame, third: DataFrame, key: str = "cell_id", label: str = "pred") -> DataFrame:
    """key, pred_1, pred_2, pred_3, final_pred: full outer join of three runs."""
    runs = [df.select(key, F.col(label).alias(f"pred_{i}")) for i, df in enumerate((first, second, third), 1)]
    joined = runs[0].join(runs[1], key, "full").join(runs[2], key, "full")
    return joined.withColumn("final_pred", V.vote3(F.col("pred_1"), F.col("pred_2"), F.col("pred_3")))
