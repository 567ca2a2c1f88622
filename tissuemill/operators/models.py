"""Numeric models: what is fitted on aggregates is fitted in numpy on the driver, what needs rows runs on the rows.

Batches, genes, folds and features are few next to cells, so moments are aggregated in Spark and only matrices of
genes x batches, classes x features or features x features reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import ship
from ..sources.files import staged
from . import classify as C
from . import keyed as K


def ridge(x: np.ndarray, y: np.ndarray, alpha: float, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients features x targets, intercepts): weighted ridge, the intercept free. Few rows are solved in dual form."""
    w = np.ones(len(x)) if weights is None else np.asarray(weights, float)
    mx, my = np.average(x, axis=0, weights=w), np.average(y, axis=0, weights=w)
    s = np.sqrt(w)[:, None]
    xc, yc = (x - mx) * s, (y - my) * s
    if x.shape[0] < x.shape[1]:
        coefficients = xc.T @ np.linalg.solve(xc @ xc.T + alpha * np.eye(len(x)), yc)
    else:
        coefficients = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    return coefficients, my - mx @ coefficients


def ridge_from_moments(n: float, sx: np.ndarray, sy: np.ndarray, xx: np.ndarray, xy: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """The same from weighted sums, for tables whose rows stay where they are."""
    mx, my = sx / n, sy / n
    coefficients = np.linalg.solve(xx - n * np.outer(mx, mx) + alpha * np.eye(len(mx)), xy - n * np.outer(mx, my))
    return coefficients, my - mx @ coefficients


def gram(df: DataFrame, width: int) -> np.ndarray:
    """Sum of w z z' over the rows of df (z array<double> of that width, w).

    Every task multiplies its rows in blocks and emits the rows of its own sum; those are dealt by row number, added up,
    and width^2 numbers reach the driver.
    """
    ship(df.sparkSession)
    schema = "i int, row array<double>"

    def rows_of(total: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(total), 256):
            some = sorted(total)[at : at + 256]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([total[i].tolist() for i in some], pa.list_(pa.float64()))], ["i", "row"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                z = part.column("z").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width)
                total += (z * part.column("w").to_numpy(zero_copy_only=False)[:, None]).T @ z
        yield from rows_of(dict(enumerate(total)))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column("i").to_pylist(), batch.column("row"), strict=True):
                values = row.values.to_numpy(zero_copy_only=False)
                total[i] = total[i] + values if i in total else values
        yield from rows_of(total)

    parts = df.select("z", "w").mapInArrow(partial, schema).repartition("i").mapInArrow(added, schema).collect()
    out = np.zeros((width, width))
    for i, row in parts:
        out[i] = row
    return out


def moments(df: DataFrame, f: str, width: int, target: Column, targets: int, weight: Column) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weighted sums 1, x, y, x x', x y' in one pass."""
    z = F.concat(F.array(F.lit(1.0)), F.col(f), target)
    m = gram(df.select(z.alias("z"), weight.cast("double").alias("w")), 1 + width + targets)
    x, y = slice(1, 1 + width), slice(1 + width, None)
    return m[0, 0], m[0, x], m[0, y], m[x, x], m[x, y]


def linear(f: str, coefficients: np.ndarray, intercepts: np.ndarray) -> Column:
    return F.array(*(V.dot(F.col(f), F.array(*map(F.lit, map(float, c)))) + float(b) for c, b in zip(coefficients.T, intercepts, strict=True)))


def ridge_classifier(train: DataFrame, classes: list[int], width: int, alpha: float = 10.0) -> Column:
    """Probabilities (softmax of ridge scores on +1 / -1 targets, weighted by class) as a column over f."""
    weight = class_weight(train, "cell_type")
    target = F.array(*(F.when(F.col("cell_type") == c, 1.0).otherwise(-1.0) for c in classes))
    return V.softmax(linear("f", *ridge_from_moments(*moments(train, "f", width, target, len(classes), weight), alpha)))


#: Boosted trees of the distributed way: rounds at most, and how they grow.
ROUNDS = 60
TREES = {"maxDepth": 4, "stepSize": 0.15, "subsamplingRate": 0.9, "minInstancesPerNode": 2, "validationTol": 0.001}


def class_weight(df: DataFrame, label: str, most: float = 5.0) -> Column:
    """Balanced weight of each label's rows, at most `most`; there are few labels."""
    weights = C.class_weights(df, label, most=most).collect()
    return F.element_at(F.create_map(*(F.lit(x) for r in weights for x in (r[0], float(r[1])))), F.col(label)) if weights else F.lit(1.0)


def with_valid(train: DataFrame, key: str = "cell_id", share: int = 8) -> DataFrame:
    """train with valid: every share-th row by a hash of its key, on which boosting is stopped early."""
    return train.withColumn("valid", F.pmod(F.xxhash64(key), F.lit(share)) == 0)


def gbt_binary(train: DataFrame, positive: int, rounds: int = ROUNDS, seed: int = 42):
    """Positive class against the rest by distributed boosted trees, classes weighted, stopped early on the rows marked valid."""
    rows = train.withColumn("label", (F.col("cell_type") == positive).cast("double"))
    rows = rows.select(array_to_vector("f").alias("features"), "label", "valid", class_weight(rows, "label").alias("weight")).cache()
    model = GBTClassifier(maxIter=rounds, seed=seed, validationIndicatorCol="valid", weightCol="weight", **TREES).fit(rows)
    rows.unpersist()
    return model


def positive_probability(model, df: DataFrame) -> DataFrame:
    scored = model.transform(df.withColumn("features", array_to_vector("f")))
    return scored.withColumn("p_t", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def arbiter(train: DataFrame, features: list[str], target: str, c: float = 1.0):
    """(scaler, model): standardised features, multinomial logistic regression; a lone target is a constant choice."""
    rows = train.select(array_to_vector(F.array(*(F.col(f).cast("double") for f in features))).alias("raw"), F.col(target).cast("double").alias("label"))
    kinds = [r[0] for r in rows.select("label").distinct().limit(2).collect()]
    if len(kinds) < 2:
        return None, int(kinds[0]) if kinds else 0
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(rows)
    n = rows.count()
    return scaler, LogisticRegression(family="multinomial", regParam=1 / (c * n), standardization=False).fit(scaler.transform(rows))


def arbiter_choice(fitted: tuple, df: DataFrame, features: list[str]) -> DataFrame:
    scaler, model = fitted
    if scaler is None:
        return df.withColumn("choice", F.lit(model))
    raw = df.withColumn("raw", array_to_vector(F.array(*(F.col(f).cast("double") for f in features))))
    return model.transform(scaler.transform(raw)).withColumn("choice", F.col("prediction").cast("int")).drop("raw", "features", "rawPrediction", "probability", "prediction")


def gated_labels(models: list[str], positive: int) -> list[Column]:
    return [V.gate(V.argmax(F.col(m)), F.col("p_t"), positive) for m in models]


def ordered_arbiter(oof: DataFrame, models: list[str], features: list[str], folds: int, positive: int) -> DataFrame:
    """oof (cell_id, cell_type, fold, p_t, probability columns) with the choice and label of an arbiter that knows only
    the folds before.

    The rows of later folds take part in each fit as they stand until their fold is predicted: probabilities 0, no label.
    A lone target leaves nothing to fit; the largest margin then chooses.
    """
    margins = [F.col(f"{m}_margin") for m in models]
    out = None
    for k in range(folds):
        known = F.col("fold") < k
        blank = {m: F.when(known, F.col(m)).otherwise(F.transform(m, lambda _: F.lit(0.0))) for m in models}
        others = oof.where(F.col("fold") != k).withColumns(blank | {"p_t": F.when(known, F.col("p_t")).otherwise(0.0)})
        labels = [F.when(known, label).otherwise(-1) for label in gated_labels(models, positive)]
        target = C.meta_target(F.col("cell_type"), labels, margins)
        fitted = arbiter(C.meta_features(others, models).withColumn("target", target), features, "target")
        rows = C.meta_features(oof.where(F.col("fold") == k), models)
        chosen = rows.withColumn("choice", V.argmax(F.array(*margins))) if fitted[0] is None else arbiter_choice(fitted, rows, features)
        out = chosen if out is None else out.unionByName(chosen)
    return out.withColumn("pred", F.element_at(F.array(*gated_labels(models, positive)), F.col("choice") + 1))


def sparse_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float, l1_ratio: float, tolerance: float = 1e-9, rounds: int = 5_000, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """(coefficients, intercept) of least sum(w loss) + penalty (l1_ratio |b| + (1 - l1_ratio) b b / 2), by coordinate descent.

    A step minimises a quadratic bound of the loss, so none goes up. Only coordinates that are not 0, or whose gradient exceeds
    the l1 penalty, are stepped; all gradients are looked at before every sweep.
    """
    beta, intercept = np.zeros(x.shape[1]) if start is None else start.copy(), 0.0
    f, curve, all_curve = x @ beta, (w[:, None] * x * x).sum(0) / 4, w.sum() / 4
    lasso, square = penalty * l1_ratio, penalty * (1 - l1_ratio)
    columns = np.ascontiguousarray(x.T)

    def rest() -> np.ndarray:
        return w * (y - 1 / (1 + np.exp(-f)))

    for _ in range(rounds):
        step = rest().sum() / all_curve
        intercept += step
        f += step
        largest = abs(step)
        for j in np.flatnonzero((curve > 0) & ((beta != 0) | (np.abs(columns @ rest()) > lasso))):
            pull = curve[j] * beta[j] + columns[j] @ rest()
            new = np.sign(pull) * max(abs(pull) - lasso, 0.0) / (curve[j] + square)
            if new != beta[j]:
                f += columns[j] * (new - beta[j])
                largest = max(largest, abs(new - beta[j]))
                beta[j] = new
        if largest < tolerance:
            break
    return beta, intercept


#: Genes that enter a class's fit in one round.
ENTER = 20_000


def sparse_markers(pb: DataFrame, classes: list[str], c: float = 1.0, l1_ratio: float = 1.0) -> DataFrame:
    """cell_type, gene, coefficient of each class against the rest over standardised pseudobulk columns, all classes in the same jobs.

    l1_ratio 1 is the lasso, below 1 the elastic net; both sides of a class weigh the same; absent genes are 0. A class without
    columns, or alone, has coefficients 0. Genes stay where they are, each with its value in every column (samples x classes).
    In a round every class is fitted by a task over its working set, then all genes' gradients are looked at: those beyond the
    penalty, the ENTER largest at a time, join the set. It ends when no gene outside of a set is beyond, which is the
    condition for the optimum over all genes.
    """
    spark = pb.sparkSession
    ship(spark)
    columns = pb.select("sample", "cell_type").distinct().orderBy("sample", "cell_type").collect()  # samples x classes
    width, kinds = len(columns), np.array([r.cell_type for r in columns])
    place = spark.createDataFrame([(r.sample, r.cell_type, i) for i, r in enumerate(columns)], pb.select("sample", "cell_type").withColumn("at", F.lit(0)).schema)
    values = pb.join(F.broadcast(place), ["sample", "cell_type"]).groupBy(F.col("gene").cast("long").alias("gene")).agg(F.collect_list("at").alias("at"), F.collect_list(F.col("m").cast("double")).alias("m"))

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                x = np.zeros((part.num_rows, width))
                x[np.repeat(np.arange(len(x)), part.column("at").value_lengths().to_numpy()), part.column("at").flatten().to_numpy()] = part.column("m").flatten().to_numpy()
                sd = x.std(1, ddof=1) if width > 1 else np.zeros(len(x))
                z = (x - x.mean(1, keepdims=True)) / np.where(sd > 0, sd, 1.0)[:, None]
                yield pa.RecordBatch.from_arrays([part.column("gene"), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * width, pa.int32()), pa.array(z.ravel()))], ["gene", "z"])

    genes = staged(values.mapInArrow(scale, "gene long, z array<double>"))
    told = {k: ((kinds == k).astype(float), None) for k in classes if 0 < (kinds == k).sum() < width}
    told = {k: (y, np.where(y == 1, width / (2 * y.sum()), width / (2 * (width - y.sum())))) for k, (y, _) in told.items()}
    rest = {k: w * (y - 0.5) for k, (y, w) in told.items()}  # both sides weigh the same
    lasso, names = l1_ratio / c, list(told)

    def fit(t: pa.Table) -> pa.Table:
        t = t.sort_by("gene")
        x, target = t.column("z").combine_chunks().flatten().to_numpy().reshape(-1, width).T, t.column("cell_type")[0].as_py()
        y, w = told[target]
        beta, intercept = sparse_logistic(x, y, w, 1 / c, l1_ratio, start=t.column("coefficient").to_numpy())
        left = w * (y - 1 / (1 + np.exp(-x @ beta - intercept)))
        return pa.table({"cell_type": t.column("cell_type"), "gene": t.column("gene"), "coefficient": beta, "rest": pa.array([left.tolist()] + [None] * (len(beta) - 1), pa.list_(pa.float64()))})

    def beyond(left: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 2048):
                    part = batch.slice(start, 2048)
                    pull = np.abs(part.column("z").flatten().to_numpy().reshape(part.num_rows, width) @ left.T)
                    row, k = np.nonzero(pull > lasso + 1e-6)
                    yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in k], pa.string()), part.column("gene").take(pa.array(row)), pa.array(pull[row, k])], ["cell_type", "gene", "pull"])

        return run

    solved = None
    while names:
        found = genes.mapInArrow(beyond(np.array([rest[k] for k in names])), "cell_type string, gene long, pull double")
        found = found if solved is None else found.join(solved.select("cell_type", "gene"), ["cell_type", "gene"], "left_anti")
        order = Window.partitionBy("cell_type").orderBy(F.col("pull").desc(), "gene")
        new = staged(found.withColumn("_row", F.row_number().over(order)).where(F.col("_row") <= ENTER).select("cell_type", "gene", F.lit(0.0).alias("coefficient")))
        if new.isEmpty():
            break
        work = new if solved is None else new.unionByName(solved.select("cell_type", "gene", "coefficient"))
        solved = staged(work.join(genes, "gene").groupBy("cell_type").applyInArrow(fit, "cell_type string, gene long, coefficient double, rest array<double>"))
        rest |= {r.cell_type: np.array(r.rest) for r in solved.where("rest is not null").select("cell_type", "rest").collect()}
    every = genes.select(F.explode(F.array(*map(F.lit, classes))).alias("cell_type"), "gene")
    if solved is None:
        return every.withColumn("coefficient", F.lit(0.0))
    return every.join(solved.drop("rest"), ["cell_type", "gene"], "left").withColumn("coefficient", F.coalesce("coefficient", F.lit(0.0)))


def batch_scaled(pb: DataFrame) -> DataFrame:
    """pb with mean, sd, z: each gene less its mean over its deviation inside the samples; no deviation counts as 1."""
    by_gene, by_batch = Window.partitionBy("gene"), Window.partitionBy("gene", "sample")
    centred = pb.withColumn("mean", F.avg("m").over(by_gene)).withColumn("residual", F.col("m") - F.avg("m").over(by_batch))
    centred = centred.withColumn("sd", F.sqrt(F.avg(F.col("residual") ** 2).over(by_gene)))
    return centred.withColumn("sd", F.when(F.col("sd") <= 1e-12, 1.0).otherwise(F.col("sd"))).withColumn("z", (F.col("m") - F.col("mean")) / F.col("sd"))


def batch_moments(scaled: DataFrame) -> DataFrame:
    """sample, gene, g, d, n: location and scale of each batch and gene; a batch of one column has no scale."""
    return scaled.groupBy("sample", "gene").agg(F.avg("z").alias("g"), F.var_samp("z").alias("d"), F.count("*").alias("n"))


def shrunk(moments: pa.Table, rounds: int = 200, tolerance: float = 1e-6) -> pa.Table:
    """sample, gene, shift, scale: location and scale of each gene of one batch, drawn to the batch's own priors (normal and
    inverse gamma, by moments over its genes) until they stay. A gene with one column has no variance of its own: scale 1."""
    g, n = moments.column("g").to_numpy(), moments.column("n").to_numpy().astype(float)
    d = moments.column("d").to_numpy()
    d = np.where(np.isnan(d), 1.0, d)
    bar, t2 = g.mean(), max(g.var(ddof=1) if len(g) > 1 else 0.0, 1e-12)
    m, v = d.mean(), max(d.var(ddof=1) if len(d) > 1 else 0.0, 1e-12)
    a, b = (2 * v + m * m) / v, (m * v + m**3) / v
    new_g, new_d = g.copy(), np.maximum(d, 1e-12)
    for _ in range(rounds):
        old_g, old_d = new_g, new_d
        new_g = (n * t2 * g + new_d * bar) / (n * t2 + new_d)
        spread = np.where(n > 1, (n - 1) * d, 0.0) + n * (g - new_g) ** 2
        new_d = np.where(n > 1, (b + spread / 2) / (n / 2 + a - 1), 1.0)
        if max(np.abs(new_g - old_g).max(), np.abs(new_d - old_d).max()) < tolerance:
            break
    return pa.table({"sample": moments.column("sample"), "gene": moments.column("gene"), "shift": new_g, "scale": np.maximum(new_d, 1e-12)})


def combat(pb: DataFrame, rounds: int = 200, tolerance: float = 1e-6) -> DataFrame:
    """pb with each sample's location and scale removed by parametric empirical Bayes.

    Moments come from aggregations; each sample's fixed point is found by a task of its own, over as many rows as there are
    genes. The corrected value is again an expression over the rows.
    """
    ship(pb.sparkSession)
    centred = batch_scaled(pb)
    moments = batch_moments(centred).select(F.col("sample").cast("string").alias("sample"), F.col("gene").cast("long").alias("gene"), "g", "d", "n")
    effects = moments.groupBy("sample").applyInArrow(lambda t: shrunk(t, rounds, tolerance), "sample string, gene long, shift double, scale double")
    fixed = centred.join(effects, ["sample", "gene"])
    return fixed.select("sample", "cell_type", "gene", ((F.col("z") - F.col("shift")) / F.sqrt("scale") * F.col("sd") + F.col("mean")).alias("m"))


def components_of(n: float, s: np.ndarray, xx: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(components k x width, mean) of a covariance matrix given by sums; signs by the largest entry."""
    mean = s / n
    values, vectors = np.linalg.eigh((xx - n * np.outer(mean, mean)) / max(1, n - 1))
    k = min(k, len(s), int(n))
    components = vectors[:, np.argsort(values)[::-1][:k]].T
    return components * np.sign(components[np.arange(k), np.abs(components).argmax(1)])[:, None], mean


#: Columns above which components come from a range finder instead of the sums of all products.
WIDE = 1024


def merged_qr(df: DataFrame, f: str | K.Sparse, change, more: np.ndarray | None = None) -> np.ndarray:
    """R of the QR decomposition of all rows change(f): every task decomposes its own, the triangles are merged in two levels."""
    ship(df.sparkSession)

    def triangle(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(rows):
            r = np.linalg.qr(rows, mode="r")
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([r.shape[1]], pa.int32()), pa.array([r.tobytes()], pa.binary())], ["part", "width", "r"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 0))
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                for _, _, x in K.by_key(part, "_all", f):
                    z = change(x)
                    held = np.linalg.qr(np.vstack((held, z)) if held.size else z, mode="r")
        yield from triangle(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 0))
        for batch in batches:
            for width, raw in zip(batch.column("width").to_pylist(), batch.column("r").to_pylist(), strict=True):
                r = np.frombuffer(raw).reshape(-1, width)
                held = np.linalg.qr(np.vstack((held, r)) if held.size else r, mode="r")
        yield from triangle(held)

    schema = "part int, width int, r binary"
    parts = df.select(F.lit("").alias("_all"), *K.columns_of(f)).mapInArrow(own, schema).withColumn("part", F.spark_partition_id())
    rows = parts.repartition(F.floor(F.sqrt("part"))).mapInArrow(merge, schema).collect()  # about the root of the number of tasks
    return np.linalg.qr(np.vstack([np.frombuffer(r.r).reshape(-1, r.width) for r in rows] + ([] if more is None else [more])), mode="r")


def wide_components(df: DataFrame, f: str | K.Sparse, width: int, k: int, extra: int = 16, rounds: int = 40, tolerance: float = 1e-9, seed: int = 0, zeros: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(components k x width, mean) of wide rows, and of as many rows of zeros beside them, by a randomised range finder with subspace iteration.

    A task emits width x (k + extra) numbers a round, not width^2. Rounds end when the first k directions turn by less than
    `tolerance`. The last pass takes the rotation and the order of the components from the merged QR of the projected rows.
    """
    everything = df.select(*K.columns_of(f)).withColumn("_all", F.lit(""))
    first = K.sums_by(everything, "_all", f, lambda _, w: np.zeros((1, w + 1)), lambda _, x, __: np.append(x.sum(0), len(x))[None])
    if not first:
        return np.zeros((0, width)), np.zeros(width)
    n = first[""][0, -1] + zeros
    mean = first[""][0, :-1] / n
    k = min(k, width, int(n))
    v = np.linalg.qr(np.random.default_rng(seed).normal(0, 1, (width, min(width, k + extra))))[0]
    for _ in range(rounds):

        def product(_: str, x: np.ndarray, __: pa.RecordBatch, v=v) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ v)

        w, values, _ = np.linalg.svd(K.sums_by(everything, "_all", f, lambda _, width, v=v: np.zeros(v.shape), product)[""] + zeros * np.outer(mean, mean @ v), full_matrices=False)
        kept = min(k, int((values > values[0] * 1e-14).sum()) if values[0] > 0 else 0)
        turned = np.linalg.norm(w[:, :kept] - v @ (v.T @ w[:, :kept])) if kept else 0.0
        v = w
        if turned < tolerance:
            break
    _, _, rotation = np.linalg.svd(merged_qr(df, f, lambda x, v=v: (x - mean) @ v, np.sqrt(zeros) * (-mean @ v)[None]))
    components = (v @ rotation.T).T[:k]
    return components * np.sign(components[np.arange(k), np.abs(components).argmax(1)])[:, None], mean


def pca(df: DataFrame, f: str, width: int, k: int) -> tuple[DataFrame, np.ndarray]:
    """(df with its scores in place of f, components k x width): at most k, no more than columns or rows."""
    scored, components, _ = pca_with_zeros(df, f, width, k, 0)
    return scored, components


def pca_with_zeros(df: DataFrame, f: str | K.Sparse, width: int, k: int, zeros: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(scores, components, score of a row of zeros) of the rows of df and as many rows of zeros, which are not in df; sparse
    vectors have the group ""."""
    if width > WIDE:
        components, mean = wide_components(df, f, width, k, zeros=zeros)
    elif isinstance(f, K.Sparse):

        def products(_: str, x: np.ndarray, __: pa.RecordBatch) -> np.ndarray:
            z = np.hstack((np.ones((len(x), 1)), x))
            return (z * np.ones((len(z), 1))).T @ z  # to the bit as gram has it: what is drawn by a hash of the scores stays the same

        m = K.sums_by(df.withColumn("_all", F.lit("")), "_all", f, lambda _, w: np.zeros((w + 1, w + 1)), products)[""]
        components, mean = components_of(m[0, 0] + zeros, m[0, 1:], m[1:, 1:], k)
    else:
        n, s, _, xx, _ = moments(df, f, width, F.array().cast("array<double>"), 0, F.lit(1.0))
        components, mean = components_of(n + zeros, s, xx, k)
    scored = K.mapped(df.withColumn("_all", F.lit("")), "_all", f, lambda _, x, __: (x - mean) @ components.T)
    return scored.drop("_all"), components, -mean @ components.T


def harmony(df: DataFrame, f: str, batch: str, **parameters) -> DataFrame:
    """df with column f corrected for the batch: keyed.harmony_by with all rows as one group."""
    return K.harmony_by(df.withColumn("_all", F.lit("")), "_all", f, batch, **parameters).drop("_all")


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def distances(z: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Twice the cosine distance of rows to centres."""
    return 2 * (1 - unit(z) @ unit(centres).T)


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 25) -> np.ndarray:
    """Centres of unit vectors by Lloyd's rounds, begun at rows drawn far from each other."""
    rng, x = np.random.default_rng(seed), unit(x)
    k = min(k, len(x))
    centres = x[[rng.integers(len(x))]] if len(x) else x
    while len(centres) < k:
        far = np.maximum(distances(x, centres).min(1), 0)
        centres = np.vstack((centres, x[rng.choice(len(x), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(x))]))
    for _ in range(rounds if len(x) else 0):
        own = distances(x, centres).argmin(1)
        centres = np.array([x[own == c].mean(0) if (own == c).any() else centres[c] for c in range(k)])
    return centres


def fuzzy_graph(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """cell_id, neighbour, weight of a neighbour graph (cell_id, neighbour, distance): the fuzzy union of its two directions.

    An edge weighs exp(-(d - nearest) / s), s being chosen by bisection so that a row's edges weigh log2 of their number.
    """
    ship(edges.sparkSession)
    rows = edges.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))).alias("near"))
    rows = rows.select("cell_id", F.col("near.neighbour").alias("neighbour"), F.col("near.distance").alias("distance"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("distance")
            length = lists.value_lengths().to_numpy(zero_copy_only=False)
            held = np.arange(max(length, default=0)) < length[:, None]
            d = np.full(held.shape, np.inf)
            d[held] = lists.flatten().to_numpy()
            least = np.where(d > 0, d, np.inf).min(1, initial=np.inf)
            gap = np.where(held, np.maximum(d - np.where(np.isinf(least), 0, least)[:, None], 0), np.inf)
            low, high, s = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
            wanted = np.log2(np.maximum(2, length))
            for _ in range(rounds):
                over = np.exp(-gap / s[:, None]).sum(1) > wanted
                low, high = np.where(over, low, s), np.where(over, s, high)
                s = np.where(np.isinf(high), s * 2, (low + high) / 2)
            mean = np.where(held, d, 0).sum(1) / np.maximum(length, 1)
            weight = np.exp(-gap / np.maximum(s, 1e-3 * np.maximum(mean, 1e-12))[:, None])[held]
            out = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))), pa.int32()), pa.array(weight))
            yield pa.RecordBatch.from_arrays([batch.column("cell_id"), batch.column("neighbour"), out], ["cell_id", "neighbour", "weight"])

    weighed = rows.mapInArrow(weigh, "cell_id long, neighbour array<long>, weight array<double>")
    one = weighed.select("cell_id", F.explode(F.arrays_zip("neighbour", "weight")).alias("e")).select("cell_id", "e.neighbour", "e.weight")
    back = one.select(F.col("neighbour").alias("cell_id"), F.col("cell_id").alias("neighbour"), F.col("weight").alias("other"))
    a, b = F.coalesce("weight", F.lit(0.0)), F.coalesce("other", F.lit(0.0))
    return one.join(back, ["cell_id", "neighbour"], "full").select("cell_id", "neighbour", (a + b - a * b).alias("weight"))


def gene_moments(expr: DataFrame, cells: DataFrame, batch: str) -> DataFrame:
    """batch, gene, n, mean, var (n - 1): absent values are zeros. There are few batches."""
    sizes = cells.groupBy(batch).agg(F.count("*").alias("n"))
    sums = expr.join(cells.select("cell_id", batch), "cell_id").groupBy(batch, "gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") ** 2).alias("q"))
    mean = F.col("s") / F.col("n")
    return sums.join(F.broadcast(sizes), batch).select(batch, "gene", "n", mean.alias("mean"), ((F.col("q") - F.col("n") * mean * mean) / F.greatest(F.col("n") - 1, F.lit(1))).alias("var"))


def trend(moments: pa.Table, batch: str, span: float) -> pa.Table:
    """batch, gene, mean, sd, n: the deviation that a local quadratic fit of log variance on log mean expects of each gene."""
    mean, var = moments.column("mean").to_numpy(), moments.column("var").to_numpy()
    use, fit = var > 0, np.zeros(len(mean))
    fit[use] = local_quadratic(np.log10(mean[use]), np.log10(var[use]), span)
    return pa.table({batch: moments.column(batch), "gene": moments.column("gene"), "mean": mean, "sd": 10 ** (fit / 2), "n": moments.column("n")})


def hvg_ranks(expr: DataFrame, cells: DataFrame, top: int, batch: str = "split", span: float = 0.3) -> DataFrame:
    """gene, rank (median over batches), batches (in how many it is among the top) of every gene.

    Means and variances count absent values. The trend is fitted by a task for each batch, over its genes; the clipped
    standardised variance is a second aggregation.
    """
    ship(expr.sparkSession)
    joined = expr.join(cells.select("cell_id", batch), "cell_id")
    moments = gene_moments(expr, cells, batch).select(F.col(batch).cast("string").alias(batch), F.col("gene").cast("long").alias("gene"), "n", "mean", "var")
    fitted = moments.groupBy(batch).applyInArrow(lambda t: trend(t, batch, span), f"{batch} string, gene long, mean double, sd double, n long")
    z = F.least((F.col("value") - F.col("mean")) / F.col("sd"), F.sqrt("n"))
    zero = -F.col("mean") / F.col("sd")
    scored = joined.join(fitted, [batch, "gene"]).groupBy(batch, "gene", "mean", "sd", "n").agg(F.sum(z * z).alias("ss"), F.count("*").alias("nnz"))
    scored = scored.withColumn("v", (F.col("ss") + (F.col("n") - F.col("nnz")) * zero * zero) / (F.col("n") - 1))
    rank = F.row_number().over(Window.partitionBy(batch).orderBy(F.round("v", 9).desc(), "gene"))
    return scored.withColumn("r", rank).groupBy("gene").agg(F.median("r").alias("rank"), F.count_if(F.col("r") <= top).alias("batches"))


def hvg(expr: DataFrame, cells: DataFrame, top: int, batch: str = "split", span: float = 0.3) -> DataFrame:
    """The `top` genes of hvg_ranks: variance-stabilised selection."""
    return hvg_ranks(expr, cells, top, batch, span).orderBy(F.col("batches").desc(), "rank", "gene").limit(top)


def local_quadratic(x: np.ndarray, y: np.ndarray, span: float) -> np.ndarray:
    """Loess of degree 2 with tricube weights over the nearest share of points.

    On one side of a point its weight is a polynomial of degree 9 in the distance, so the sums of a fit come from the moments
    of runs of 2^i sorted points, about each run's centre: a point asks for about 4 log2(n) runs, whatever its window holds.
    """
    n = len(x)
    if not n:
        return np.empty(0)
    k = min(n, max(4, int(np.ceil(span * n))))
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    at, same = np.unique(x, return_inverse=True)  # equal points have one fit
    low = nearest_windows(x, at, k)
    width = np.maximum(np.maximum(at - x[low], x[low + k - 1] - at), 1e-12)
    middle = np.clip(np.searchsorted(x, at), low, low + k)
    center = y.mean()
    sums = side_sums(x, y - center, at, width, low, middle, -1.0) + side_sums(x, y - center, at, width, middle, low + k, 1.0)
    a, b = sums[:, [[4, 3, 2], [3, 2, 1], [2, 1, 0]]], sums[:, [7, 6, 5]]
    values, vectors = np.linalg.eigh(a)
    good = values[:, 0] > 1e-9 * values[:, 2]
    fit = np.empty(len(at))
    fit[good] = np.linalg.solve(a[good], b[good][:, :, None])[:, 2, 0] + center
    for i in np.flatnonzero(~good):  # hardly different points in the window
        u, v = x[low[i] : low[i] + k] - at[i], y[low[i] : low[i] + k]
        w = np.sqrt(np.clip(1 - (np.abs(u) / width[i]) ** 3, 0, None) ** 3 + 1e-9)
        fit[i] = np.linalg.lstsq(np.vander(u, 3) * w[:, None], v * w, rcond=None)[0][-1]
    out = np.empty(n)
    out[order] = fit[same]
    return out


def nearest_windows(x: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """First place, in the sorted x, of the k points nearest to each of `at`; of equal ones the first."""
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(x) - k)
    while (low < high).any():  # the first window whose next point on the right is no nearer than its first
        mid = (low + high) // 2
        right = (low < high) & (at - x[mid] > x[np.minimum(mid + k, len(x) - 1)] - at)
        low, high = np.where(right, mid + 1, low), np.where(right, high, np.minimum(high, mid))
    return low


BINOMIAL = np.array([[math.comb(p, q) for q in range(14)] for p in range(14)], float)


def moved(m: np.ndarray, shift: np.ndarray, most: int) -> np.ndarray:
    """Moments (powers x points, 0 .. most) about another centre: sum of (x + shift)^p from sums of x^q."""
    powers = np.ones((most + 1, len(shift)))
    for p in range(1, most + 1):
        powers[p] = powers[p - 1] * shift
    return np.array([sum(BINOMIAL[p, q] * m[q] * powers[p - q] for q in range(p + 1)) for p in range(most + 1)])


def side_sums(x: np.ndarray, y: np.ndarray, at: np.ndarray, width: np.ndarray, first: np.ndarray, end: np.ndarray, sign: float, step: int = 16_384) -> np.ndarray:
    """Sums of w u^0 .. w u^4 and w u^0 y .. w u^2 y over x[first:end] for each of `at`; u = (x - at) / width, on one side of at."""
    total = [np.zeros((14, len(at))), np.zeros((12, len(at)))]
    centre, half = x.copy(), np.zeros(len(x))
    mx, my = np.zeros((14, len(x))), np.zeros((12, len(x)))
    mx[0], my[0] = 1.0, y
    a, b, open_ = first.copy(), end.copy(), np.flatnonzero(first < end)
    while len(open_):
        for move in (0, 1):
            odd = (b if move else a)[open_] % 2 == 1
            ask = open_[odd & (a[open_] < b[open_])]
            node = b[ask] - 1 if move else a[ask]
            for s in range(0, len(ask), step):
                i, c = ask[s : s + step], node[s : s + step]
                scale = half[c] / width[i]
                shift = (centre[c] - at[i]) / width[i]
                for held, m, most in ((total[0], mx, 13), (total[1], my, 11)):
                    held[:, i] += moved(m[:, c] * scale ** np.arange(most + 1)[:, None], shift, most)
            (b if move else a)[ask] += -1 if move else 1
        open_ = open_[a[open_] < b[open_]]
        a[open_] //= 2
        b[open_] //= 2
        pairs = len(centre) // 2  # a last odd run is never part of a whole pair
        left, right = slice(0, 2 * pairs, 2), slice(1, 2 * pairs, 2)
        middle = (centre[left] + centre[right]) / 2
        reach = np.maximum(np.abs(centre[left] - middle) + half[left], np.abs(centre[right] - middle) + half[right])
        over = np.where(reach > 0, reach, 1.0)
        up = []
        for m, most in ((mx, 13), (my, 11)):
            one, two = (moved(m[:, part] * (half[part] / over) ** np.arange(most + 1)[:, None], (centre[part] - middle) / over, most) for part in (left, right))
            up.append(one + two)
        (mx, my), centre, half = up, middle, reach
    out = np.zeros((len(at), 8))
    for j, (m, p) in enumerate([(total[0], p) for p in range(5)] + [(total[1], p) for p in range(3)]):
        out[:, j] = m[p] * (1 + 1e-9) - 3 * sign * m[p + 3] + 3 * m[p + 6] - sign * m[p + 9]
    return out
