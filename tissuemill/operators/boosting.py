"""Gradient-boosted trees over histograms, multiclass or binary, with class weights and early stopping.

Fitted on every training row. Up to IN_TASK rows a model is fitted in numpy by a task of its own, so those of all folds are
fitted side by side; beyond, boosting_passes.fit_passes grows the trees over rows that stay where they are. Scored in Arrow batches
against a broadcast model. Only a caller who gives `most_rows` has models of a sample.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

#: Rows that a task may hold to fit a model.
IN_TASK = 200_000


class Growth(NamedTuple):
    rounds: int = 300
    rate: float = 0.05
    leaves: int = 31
    least_rows: int = 20
    least_hessian: float = 0.0044
    least_gain: float = 0.01
    features: float = 0.6154
    bins: int = 64
    stop: int = 30
    seed: int = 42


class Tree(NamedTuple):
    """Nodes as arrays; feature -1 marks a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any():
                return self.value[at]
            low = x[rows, np.maximum(feature, 0)] <= self.threshold[at]
            at = np.where(inner, np.where(low, self.left[at], self.right[at]), at)


def edges_of(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Upper edges of each column's bins: between different quantiles."""
    out = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > bins:
            values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1), method="nearest"))
        out.append((values[1:] + values[:-1]) / 2)
    return out


def grow(codes: np.ndarray, edges: list[np.ndarray], slope: np.ndarray, curve: np.ndarray, g: Growth, rng: np.random.Generator) -> tuple[Tree, np.ndarray]:
    """(tree, value of every training row): the leaf of largest gain is split until none gains or there are leaves enough."""
    n, d = codes.shape
    chosen = np.sort(rng.choice(d, max(1, int(np.ceil(g.features * d))), replace=False))
    width = g.bins + 1

    def summed(rows: np.ndarray) -> np.ndarray:
        """(rows, slopes, curves) x features x bins."""
        out, a, b = np.empty((3, len(chosen), width)), slope[rows], curve[rows]
        for j, column in enumerate(chosen):
            at = codes[:, column][rows].astype(np.intp)
            out[0, j], out[1, j], out[2, j] = np.bincount(at, minlength=width), np.bincount(at, a, width), np.bincount(at, b, width)
        return out

    def best(rows: np.ndarray, sums: np.ndarray) -> tuple[float, int, int]:
        """(gain, place in chosen, bin) of the best split of a leaf."""
        if len(rows) < 2 * g.least_rows:
            return 0.0, -1, -1
        count, a, b = sums.cumsum(2)[:, :, :-1]
        a_all, b_all = slope[rows].sum(), curve[rows].sum()
        fits = (count >= g.least_rows) & (len(rows) - count >= g.least_rows) & (b >= g.least_hessian) & (b_all - b >= g.least_hessian)
        gain = np.where(fits, a * a / (b + 1e-9) + (a_all - a) ** 2 / (b_all - b + 1e-9) - a_all**2 / (b_all + 1e-9), 0.0)
        at = int(gain.argmax())
        return float(gain.flat[at]), at // (width - 1), at % (width - 1)

    def value(rows: np.ndarray) -> float:
        return float(-g.rate * slope[rows].sum() / (curve[rows].sum() + 1e-9))

    everything = np.arange(n)
    nodes = [[-1, 0.0, -1, -1, value(everything)]]
    sums = summed(everything)
    found = best(everything, sums)
    queue, out = [(-found[0], 0, found, everything, sums)], np.full(n, nodes[0][4])
    leaves = 1
    while queue and leaves < g.leaves:
        loss, node, (_, place, cut), rows, sums = heapq.heappop(queue)
        if -loss <= g.least_gain:
            break
        column = chosen[place]
        low = codes[:, column][rows] <= cut
        sides = (rows[low], rows[~low])
        nodes[node][:4] = [int(column), float(edges[column][cut]), len(nodes), len(nodes) + 1]
        less = int(len(sides[1]) < len(sides[0]))
        held = [None, None]
        if max(map(len, sides)) >= 2 * g.least_rows:  # the larger side is what the smaller one leaves
            held[less] = summed(sides[less])
            held[1 - less] = sums - held[less]
            held[1 - less][1:, held[1 - less][0] == 0] = 0.0
        for side, own in zip(sides, held, strict=True):
            nodes.append([-1, 0.0, -1, -1, value(side)])
            out[side] = nodes[-1][4]
            found = best(side, own)
            heapq.heappush(queue, (-found[0], len(nodes) - 1, found, side, own))
        leaves += 1
    return Tree(*(np.array(c, t) for c, t in zip(zip(*nodes, strict=True), (np.int64, float, np.int64, np.int64, float), strict=True))), out


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


class Boosted:
    """classes, prior scores, and for each round one tree a class (binary: one, for the second class)."""

    def __init__(self, classes: list[int], base: np.ndarray, rounds: list[list[Tree]]):
        self.classes, self.base, self.rounds = classes, base, rounds

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.tile(self.base, (len(x), 1))
        for trees in self.rounds:
            for k, tree in enumerate(trees, len(self.classes) - len(trees)):
                z[:, k] += tree.predict(x)
        return softmax(z)


def fit(x: np.ndarray, y: np.ndarray, classes: Sequence[int], weight: np.ndarray | None = None, valid: np.ndarray | None = None, g: Growth = Growth()) -> Boosted:
    """Trees on softmax gradients; the rows marked valid take no part and tell when to stop."""
    classes = list(classes)
    weight = np.ones(len(y)) if weight is None else weight
    valid = np.zeros(len(y), bool) if valid is None else valid
    one = (np.asarray(y)[:, None] == np.array(classes)).astype(float)
    x, held, w, target = x[~valid], x[valid], weight[~valid], one[~valid]
    share = np.maximum((target * w[:, None]).sum(0), 1e-9)
    base = np.log(share / share.sum())
    if len(x) < 2 or (share > 1e-6).sum() < 2:
        return Boosted(classes, base, [])
    edges = edges_of(x, g.bins)
    codes = np.empty(x.shape, np.uint8 if g.bins < 256 else np.int64, order="F")
    for j, e in enumerate(edges):
        codes[:, j] = np.searchsorted(e, x[:, j], "left")
    del x
    rng, z, z_held, rounds = np.random.default_rng(g.seed), np.tile(base, (len(codes), 1)), np.tile(base, (len(held), 1)), []
    grown = range(1, 2) if len(classes) == 2 else range(len(classes))
    best, best_at = np.inf, 0
    for _ in range(g.rounds):
        p = softmax(z)
        trees = []
        for k in grown:
            tree, step = grow(codes, edges, (p[:, k] - target[:, k]) * w, np.maximum(p[:, k] * (1 - p[:, k]), 1e-9) * w, g, rng)
            z[:, k] += step
            z_held[:, k] += tree.predict(held)
            trees.append(tree)
        rounds.append(trees)
        if len(held):
            loss = float(-(weight[valid] * np.log((softmax(z_held) * one[valid]).sum(1) + 1e-12)).sum() / weight[valid].sum())
            if loss < best - 1e-6:
                best, best_at = loss, len(rounds)
            elif len(rounds) - best_at >= g.stop:
                break
    return Boosted(classes, base, rounds[:best_at] if len(held) else rounds)


def bounded(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The first `most` rows by a hash of their key. Slices of the hash are counted; only the one in which the bound lies is sorted."""
    order = F.xxhash64(key)
    part, left = F.shiftright(order, 52), most
    for r in rows.groupBy(part.alias("part")).count().orderBy("part").collect():  # 4,096 slices at most
        if r["count"] > left:
            return rows.where(part < r.part).unionByName(rows.where(part == r.part).orderBy(order, key).limit(left))
        left -= r["count"]
    return rows


def fit_rows(train: DataFrame, classes: Sequence[int], label: str = "cell_type", key: str = "cell_id", most_rows: int | None = None, valid_share: int = 8, most_weight: float = 5.0, g: Growth = Growth()) -> Boosted:
    """fit on the rows of train (key, f, label), classes weighted; every valid_share-th row by a hash of its key tells when to stop."""
    whole = train.withColumn("fold", F.lit(-1))
    return fit_folds(whole, [0], {"": (classes, label)}, key, most_rows, valid_share, most_weight, g)[0][""]


def fit_folds(
    train: DataFrame, folds: Sequence[int], wanted: dict[str, tuple[Sequence[int], str]], key: str = "cell_id", most_rows: int | None = None, valid_share: int = 8, most_weight: float = 5.0, g: Growth = Growth()
) -> dict[int, dict[str, Boosted]]:
    """fit for each fold, on all rows of train (key, f, fold, labels) of the others, and each of the wanted models (classes,
    label). Every model is fitted by a task that holds its rows, or in passes if some fold leaves more than IN_TASK of them.
    With most_rows, the first by a hash of the key stand for all."""
    spark = train.sparkSession
    if most_rows is None:
        sizes = {r["fold"]: r["count"] for r in train.groupBy("fold").count().collect()}  # folds
        if any(sum(sizes.values()) - sizes.get(k, 0) > IN_TASK for k in folds):
            return fit_folds_in_passes(train, folds, wanted, key, valid_share, most_weight, g)
    ship(spark)
    order = F.xxhash64(key)
    kinds, parts = list(wanted), []
    for k in folds:
        rows = train.where(F.col("fold") != k)
        rows = rows if most_rows is None else bounded(rows, key, most_rows)
        labels = F.array(*(F.struct(F.lit(i).alias("of"), F.col(label).cast("long").alias("y")) for i, (_, label) in enumerate(wanted.values())))
        parts.append(rows.select(F.lit(k).alias("fold"), F.col(key).cast("long").alias("key"), order.alias("order"), "f", F.inline(labels)))
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    tasks = len(folds) * len(kinds)
    place = {k: i for i, k in enumerate(folds)}
    number = F.element_at(F.create_map(*(F.lit(x) for pair in place.items() for x in pair)), F.col("fold")) * len(kinds) + F.col("of")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        order, keys, y = (table.column(c).to_numpy() for c in ("order", "key", "y"))
        of, fold = table.column("of")[0].as_py(), table.column("fold")[0].as_py()
        x = np.vstack([b.column("f").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for b in batches])
        del table, batches
        at = np.lexsort((keys, order))
        x, y, order = x[at], y[at], order[at]
        known, counts = np.unique(y, return_counts=True)
        weight = np.minimum(len(y) / (len(known) * counts), most_weight)[np.searchsorted(known, y)]
        model = fit(x, y, wanted[kinds[of]][0], weight, order % valid_share == 0, g)
        yield pa.RecordBatch.from_arrays([pa.array([fold], pa.int32()), pa.array([of], pa.int32()), pa.array([pickle.dumps(model)], pa.binary())], ["fold", "of", "model"])

    found: dict[int, dict[str, Boosted]] = {k: {name: Boosted(list(classes), np.full(len(classes), -np.log(len(classes))), []) for name, (classes, _) in wanted.items()} for k in folds}
    for r in every.repartitionById(tasks, number.cast("int")).mapInArrow(solve, "fold int, of int, model binary").collect():
        found[r.fold][kinds[r.of]] = pickle.loads(r.model)
    return found


def fit_folds_in_passes(
    train: DataFrame, folds: Sequence[int], wanted: dict[str, tuple[Sequence[int], str]], key: str, valid_share: int, most_weight: float, g: Growth
) -> dict[int, dict[str, Boosted]]:
    """The models of fit_folds, grown over every row by tasks that hold sums only; the folds of a model in the same passes."""
    from .boosting_passes import fit_passes

    numbers = F.create_map(*(F.lit(x) for pair in zip(folds, range(len(folds)), strict=True) for x in pair))
    numbered = train.withColumn("fold", F.coalesce(F.try_element_at(numbers, F.col("fold")), F.lit(len(folds))))  # the last is left out by none
    found: dict[int, dict[str, Boosted]] = {k: {} for k in folds}
    for name, (classes, label) in wanted.items():
        for k, model in zip(folds, fit_passes(numbered, list(classes), label, key, len(folds), valid_share, most_weight, g), strict=True):
            found[k][name] = model
    return found


def with_probabilities(df: DataFrame, models: dict[str, Boosted]) -> DataFrame:
    """df (with f) and a column of class probabilities for each model."""
    ship(df.sparkSession)
    told = df.sparkSession.sparkContext.broadcast(models)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("f").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                more = [pa.array(m.predict(x).tolist(), pa.list_(pa.float64())) for m in told.value.values()]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *told.value])

    fields = [*df.schema.fields, *(T.StructField(name, T.ArrayType(T.DoubleType())) for name in models)]
    return df.mapInArrow(score, T.StructType(fields))
