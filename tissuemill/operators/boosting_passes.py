"""Boosted trees grown in passes over all rows; no row leaves its task.

Rows keep their bin codes and scores in a staged table. In a pass each task routes its rows through the trees as far as
they are grown, and sums gradients by (model, class, node, feature, bin). The sums are shuffled by node and feature,
added up, and the best split of every node reaches the driver: as many numbers as there are nodes, whatever the table.

Trees are those of boosting.fit: the leaf of largest gain is split first. A pass asks for all leaves that are new, and in
advance for the children of the leaves most likely to be split, so a tree takes about as many passes as it is deep. The
trees of all classes, and of all folds of a cross-validation, grow in the same passes.

Rows with null or no label of `classes` take no part. A class without rows keeps its prior. With rows of one class only,
or none, the models have no trees. An empty table gives uniform probabilities.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ..sources.files import staged
from .boosting import Boosted, Growth, Tree, softmax

#: Rounds after which scores are written anew; in between tasks apply the trees since.
REPLAY = 16
#: Features whose sums travel together.
TOGETHER = 16
SUMS = "model int, k int, node long, place int, sums binary"
BEST = "model int, k int, node long, place int, cut int, gain double, rows double, a double, b double, a_left double, b_left double, rows_left double"


def edges_of_rows(rows: DataFrame, bins: int, accuracy: int = 10_000) -> list[np.ndarray]:
    """Upper edges of the bins of each feature, between different quantiles (by sketches that merge)."""
    parts = [i / bins for i in range(bins + 1)]
    found = rows.select(F.posexplode("f").alias("at", "value")).groupBy("at").agg(F.percentile_approx("value", parts, accuracy).alias("q")).orderBy("at").collect()
    quantiles = [np.unique(r.q) for r in found]
    return [(q[1:] + q[:-1]) / 2 for q in quantiles]


class Growing:
    """One tree on its way: what is known of its nodes (1 the root, 2 i and 2 i + 1 the children of i)."""

    def __init__(self, chosen: np.ndarray, g: Growth):
        self.chosen, self.g, self.known = chosen, g, {}

    def replayed(self) -> tuple[list[int], list[int], bool]:
        """(nodes split in their order, nodes to ask for, whether the tree is done)."""
        g, split, heap, unknown = self.g, [], [1], []
        while len(split) + 1 < g.leaves:
            unknown = [n for n in heap if n not in self.known]
            ready = sorted((n for n in heap if n in self.known and self.known[n].gain > g.least_gain), key=lambda n: (-self.known[n].gain, self.place(n, split)))
            if unknown or not ready:
                break
            split.append(ready[0])
            heap.remove(ready[0])
            heap += [2 * ready[0], 2 * ready[0] + 1]
        else:
            return split, [], True
        if not unknown:
            return split, [], True
        ahead = [c for n in ready[: g.leaves - 1 - len(split)] for c in (2 * n, 2 * n + 1) if c not in self.known]
        return split, unknown + ahead, False

    @staticmethod
    def place(node: int, split: list[int]) -> int:
        """The number that the node has in the tree."""
        return 0 if node == 1 else 1 + 2 * split.index(node // 2) + node % 2

    def splits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node, column, cut) of every node known to gain, by node."""
        inner = sorted(n for n, r in self.known.items() if r.gain > self.g.least_gain)
        return np.array(inner, np.int64), self.chosen[[self.known[n].place for n in inner]] if inner else np.zeros(0, np.int64), np.array([self.known[n].cut for n in inner], np.int64)

    def tree(self, edges: list[np.ndarray]) -> Tree:
        split, g = self.replayed()[0], self.g
        nodes = [[-1, 0.0, -1, -1, leaf_value(self.known[1].a, self.known[1].b, g)]]
        for n in split:
            r = self.known[n]
            column = int(self.chosen[r.place])
            nodes[self.place(n, split)][:4] = [column, float(edges[column][r.cut]), len(nodes), len(nodes) + 1]
            for a, b in ((r.a_left, r.b_left), (r.a - r.a_left, r.b - r.b_left)):
                nodes.append([-1, 0.0, -1, -1, leaf_value(a, b, g)])
        return Tree(*(np.array(c, t) for c, t in zip(zip(*nodes, strict=True), (np.int64, float, np.int64, np.int64, float), strict=True)))


def leaf_value(a: float, b: float, g: Growth) -> float:
    return float(-g.rate * a / (b + 1e-9))


def route(codes: np.ndarray, splits: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The node that each row has come to."""
    inner, column, cut = splits
    node, moving = np.ones(len(codes), np.int64), np.arange(len(codes))
    while len(inner) and len(moving):
        at = np.minimum(np.searchsorted(inner, node[moving]), len(inner) - 1)
        go = inner[at] == node[moving]
        moving, at = moving[go], at[go]
        node[moving] = 2 * node[moving] + (codes[moving, column[at]] > cut[at])
    return node


def best_split(cells: np.ndarray, g: Growth) -> tuple[float, int, int]:
    """(gain, feature, bin) from the sums of some features: features x (rows, slopes, curves) x bins."""
    (n, a_all, b_all) = cells[0].sum(1)
    if n < 2 * g.least_rows:
        return 0.0, 0, -1
    count, a, b = cells.cumsum(2)[:, :, :-1].transpose(1, 0, 2)
    fits = (count >= g.least_rows) & (n - count >= g.least_rows) & (b >= g.least_hessian) & (b_all - b >= g.least_hessian)
    gain = np.where(fits, a * a / (b + 1e-9) + (a_all - a) ** 2 / (b_all - b + 1e-9) - a_all**2 / (b_all + 1e-9), 0.0)
    at = int(gain.argmax())
    return float(gain.flat[at]), at // gain.shape[1], at % gain.shape[1]


class Passes:
    """Models over one staged table; model m leaves out the rows of fold m (one model without folds)."""

    def __init__(self, train: DataFrame, classes: Sequence[int], label: str, key: str, folds: int, valid_share: int, most_weight: float, g: Growth, edges: list[np.ndarray] | None):
        ship(train.sparkSession)
        self.classes, self.g, self.models = list(classes), g, max(1, folds)
        fold = F.col("fold") if folds else F.lit(-1)
        place = F.array_position(F.array(*map(F.lit, self.classes)), F.col(label)).cast("int") - 1
        valid = F.pmod(F.xxhash64(key), F.lit(valid_share)) == 0 if valid_share else F.lit(False)
        rows = staged(train.select(place.alias("y"), fold.cast("int").alias("fold"), valid.alias("valid"), "f").where("y >= 0"))
        self.edges = edges_of_rows(rows, g.bins) if edges is None else edges
        self.weight, self.base, self.usable = self._weights(rows, most_weight)
        edges, base = self.edges, self.base

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column("f").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(edges))
                codes = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)]).astype(np.uint8) if batch.num_rows else x
                z = np.tile(base.ravel(), (batch.num_rows, 1))
                yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("fold"), batch.column("valid"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([r.tobytes() for r in z], pa.binary())], ["y", "fold", "valid", "codes", "z"])

        self.rows = staged(rows.mapInArrow(coded, "y int, fold int, valid boolean, codes binary, z binary")) if self.edges else None
        self.since: list[list[list[Tree]]] = []  # rounds, models, classes: not yet in the staged scores

    def _weights(self, rows: DataFrame, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(weight of each class, prior scores, whether there is something to learn) for each model."""
        counts = np.zeros((self.models, 2, len(self.classes)))
        for r in rows.groupBy("fold", "valid", "y").count().collect():  # folds x classes
            for m in range(self.models):
                if r["fold"] != m:
                    counts[m, int(r["valid"]), r["y"]] += r["count"]
        every = counts.sum(1)
        kinds = np.maximum((every > 0).sum(1, keepdims=True), 1)
        weight = np.minimum(every.sum(1, keepdims=True) / (kinds * np.maximum(every, 1)), most)
        share = np.maximum(counts[:, 0] * weight, 1e-9)
        return weight, np.log(share / share.sum(1, keepdims=True)), (counts[:, 0].sum(1) >= 2) & ((share > 1e-6).sum(1) >= 2)

    def _scores(self, codes: np.ndarray, z: np.ndarray, since: list) -> np.ndarray:
        """z (rows, models, classes) with the trees since the last staging; trees know thresholds by bin."""
        for trees in since:
            for m, of_model in enumerate(trees):
                for k, tree in enumerate(of_model, z.shape[2] - len(of_model)):
                    z[:, m, k] += tree.predict(codes)
        return z

    def _read(self, part: pa.RecordBatch, since: list) -> tuple[np.ndarray, ...]:
        n = part.num_rows
        codes, z = (np.frombuffer(b"".join(part.column(c).to_pylist()), t).reshape(n, *shape) for c, t, shape in (("codes", np.uint8, (len(self.edges),)), ("z", float, (self.models, len(self.classes)))))
        y, fold, valid = (part.column(c).to_numpy(zero_copy_only=False) for c in ("y", "fold", "valid"))
        return codes, self._scores(codes, z.copy(), since), y, fold, valid.astype(bool)

    def restage(self) -> None:
        held, since = self._plain(), self.since

        def fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    z = held._read(batch, since)[1]
                    yield batch.set_column(4, "z", pa.array([r.tobytes() for r in z], pa.binary()))

        self.rows, self.since = staged(self.rows.mapInArrow(fresh, self.rows.schema)), []

    def _plain(self) -> Passes:
        """What tasks need of this object."""
        out = object.__new__(Passes)
        out.classes, out.g, out.models, out.edges, out.weight, out.base = self.classes, self.g, self.models, self.edges, self.weight, self.base
        return out

    def asked(self, growing: dict[tuple[int, int], Growing], nodes: dict[tuple[int, int], list[int]], losses: bool) -> list:
        """The best split of every node asked for; with `losses` also (model, -1): loss and weight of the valid rows."""
        held, since, g = self._plain(), self.since, self.g
        plan = {at: (growing[at].chosen, growing[at].splits(), np.array(sorted(ns), np.int64)) for at, ns in nodes.items() if ns}
        width = g.bins + 1

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {at: np.zeros((3, len(ns) * len(chosen) * width)) for at, (chosen, _, ns) in plan.items()}
            loss = np.zeros((held.models, 2))
            for batch in batches:
                for start in range(0, batch.num_rows, 4096):
                    codes, z, y, fold, valid = held._read(batch.slice(start, 4096), since)
                    p = softmax(z.reshape(-1, z.shape[2])).reshape(z.shape)
                    for m in range(held.models):
                        w = held.weight[m][y]
                        seen, mine = np.flatnonzero((fold != m) & valid), np.flatnonzero((fold != m) & ~valid)
                        loss[m] += (-(w[seen] * np.log(p[seen, m, y[seen]] + 1e-12)).sum(), w[seen].sum())
                        for (model, k), (chosen, splits, ns) in plan.items():
                            if model == m:
                                node = route(codes[mine], splits)
                                slot = np.minimum(np.searchsorted(ns, node), len(ns) - 1)
                                here = ns[slot] == node
                                rows, slot = mine[here], slot[here]
                                q, v = p[rows, m, k], w[rows]
                                flat = ((slot[:, None] * len(chosen) + np.arange(len(chosen))) * width + codes[rows][:, chosen]).ravel()
                                for i, part in enumerate((np.ones(len(rows)), (q - (y[rows] == k)) * v, np.maximum(q * (1 - q), 1e-9) * v)):
                                    total[m, k][i] += np.bincount(flat, np.repeat(part, len(chosen)), total[m, k].shape[1])
            for (m, k), held_sums in total.items():
                chosen, _, ns = plan[m, k]
                cells = held_sums.reshape(3, len(ns), len(chosen), width).transpose(1, 2, 0, 3)
                met = [(s, n) for s, n in enumerate(ns.tolist()) if cells[s, 0, 0].any()]
                for s in range(0, len(met), 8):
                    yield batch_of([(m, k, n, j, cells[i, j : j + TOGETHER].tobytes()) for i, n in met[s : s + 8] for j in range(0, len(chosen), TOGETHER)], SUMS)
            if losses and loss.any():
                yield batch_of([(m, -1, 0, 0, loss[m].tobytes()) for m in range(held.models)], SUMS)

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple, np.ndarray] = {}
            for batch in batches:
                for *at, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    total[tuple(at)] = total.get(tuple(at), 0) + np.frombuffer(raw)
            found: dict[tuple, tuple] = {}
            for (m, k, n, j), flat in sorted(total.items()):
                if k < 0:
                    found[m, k, n] = (m, k, n, j, -1, 0.0, 0.0, flat[0], flat[1], 0.0, 0.0, 0.0)
                    continue
                cells = flat.reshape(-1, 3, width)
                gain, at, cut = best_split(cells, g)
                if (m, k, n) not in found or gain > found[m, k, n][5]:
                    left = cells[at][:, : cut + 1].sum(1)
                    found[m, k, n] = (m, k, n, j + at, cut, gain, *cells[at].sum(1).tolist(), left[1], left[2], left[0])
            if found:
                yield batch_of(list(found.values()), BEST)

        rows = self.rows.mapInArrow(sums, SUMS).repartition("model", "k", "node", "place").mapInArrow(best, BEST).collect()
        chosen: dict[tuple, object] = {}
        for r in sorted(rows, key=lambda r: (r.model, r.k, r.node, -r.gain, r.place)):
            chosen.setdefault((r.model, r.k, r.node), r)
        return list(chosen.values())

    def fit(self) -> list[Boosted]:
        g, n_classes = self.g, len(self.classes)
        grown = range(1, 2) if n_classes == 2 else range(n_classes)
        by_bin = [np.arange(len(e)).astype(float) for e in self.edges]
        rounds: list[list[list[Tree]]] = [[] for _ in range(self.models)]
        rngs = [np.random.default_rng(g.seed) for _ in range(self.models)]
        lowest, best_at, active = np.full(self.models, np.inf), np.zeros(self.models, int), self.usable.copy()
        has_valid = np.zeros(self.models, bool)
        for turn in range(g.rounds + 1):
            d = len(self.edges)
            growing = {(m, k): Growing(np.sort(rngs[m].choice(d, max(1, int(np.ceil(g.features * d))), replace=False)), g) for m in range(self.models) if active[m] for k in grown}
            first = True
            while active.any():
                nodes = {at: t.replayed()[1] for at, t in growing.items()}
                if not any(nodes.values()):
                    break
                for r in self.asked(growing, nodes, first):
                    if r.k >= 0:
                        growing[r.model, r.k].known[r.node] = r
                    elif r.b > 0 and active[r.model]:
                        has_valid[r.model] = True
                        if turn and r.a / r.b < lowest[r.model] - 1e-6:
                            lowest[r.model], best_at[r.model] = r.a / r.b, turn
                        elif turn - best_at[r.model] >= g.stop:
                            active[r.model] = False
                growing = {at: t for at, t in growing.items() if active[at[0]]}
                for at, ns in nodes.items():  # nodes without rows gain nothing
                    for n in ns if at in growing else ():
                        growing[at].known.setdefault(n, EMPTY)
                first = False
            if turn == g.rounds or not active.any():
                break
            trees = [[growing[m, k].tree(self.edges) for k in grown] if active[m] else [] for m in range(self.models)]
            for m in range(self.models):
                if active[m]:
                    rounds[m].append(trees[m])
            self.since.append([[growing[m, k].tree(by_bin) for k in grown] if active[m] else [] for m in range(self.models)])
            if len(self.since) >= REPLAY:
                self.restage()
        return [Boosted(self.classes, self.base[m], rounds[m][: best_at[m]] if has_valid[m] else rounds[m]) for m in range(self.models)]


class _Empty:
    gain, place, cut, a, b, a_left, b_left = 0.0, 0, -1, 0.0, 0.0, 0.0, 0.0


EMPTY = _Empty()


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.strip().split(" ") for c in schema.split(",")), strict=True)
    of = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, of[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))


def fit_passes(
    train: DataFrame, classes: Sequence[int], label: str = "cell_type", key: str = "cell_id", folds: int = 0, valid_share: int = 8, most_weight: float = 5.0, g: Growth = Growth(), edges: list[np.ndarray] | None = None
) -> list[Boosted]:
    """Models fitted on every row of train (key, f, label): one, or for `folds` (train has fold) one for each fold, on the
    rows of the others. Every valid_share-th row by a hash of its key tells when to stop (0: none)."""
    if g.bins > 255:
        raise ValueError("255 bins at most")
    passes = Passes(train, classes, label, key, folds, valid_share, most_weight, g, edges)
    if passes.rows is None:
        return [Boosted(list(classes), np.full(len(classes), -np.log(len(classes))), []) for _ in range(passes.models)]
    return passes.fit()
