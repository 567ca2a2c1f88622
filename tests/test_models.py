"""Models against direct numpy derivations."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tissuemill.operators import keyed as K
from tissuemill.operators import models as M


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (80, 4)) @ rng.normal(0, 1, (4, 4))
    return x, spark.createDataFrame([(i, "ab"[i % 2], [float(v) for v in r]) for i, r in enumerate(x)], "cell_id long, batch string, f array<double>")


def closed_form(x, y, alpha, w):
    a = np.column_stack((x, np.ones(len(x))))
    penalty = alpha * np.eye(a.shape[1])
    penalty[-1, -1] = 0
    return np.linalg.solve(a.T @ (w[:, None] * a) + penalty, a.T @ (w[:, None] * y))


@pytest.mark.parametrize("shape", [(30, 5), (6, 20)])
def test_ridge_equals_closed_form(shape):
    rng = np.random.default_rng(2)
    x, y, w = rng.normal(0, 1, shape), rng.normal(0, 1, (shape[0], 3)), rng.uniform(0.5, 2, shape[0])
    coefficients, intercepts = M.ridge(x, y, 0.3, w)
    assert np.allclose(np.vstack((coefficients, intercepts)), closed_form(x, y, 0.3, w), atol=1e-8)


def test_ridge_from_moments_equals_rows(points):
    x, df = points
    y = x[:, :1] * 2 + 1
    target = F.array(F.get("f", F.lit(0)) * 2 + 1)
    got = M.ridge_from_moments(*M.moments(df, "f", 4, target, 1, F.lit(1.0)), 0.5)
    want = M.ridge(x, y, 0.5)
    assert np.allclose(got[0], want[0]) and np.allclose(got[1], want[1])


def test_pca_equals_svd(points):
    x, df = points
    scores, components = M.pca(df, "f", 4, 2)
    got = np.array([r.f for r in scores.orderBy("cell_id").collect()])
    centred = x - x.mean(0)
    v = np.linalg.svd(centred, full_matrices=False)[2][:2]
    assert np.allclose(np.abs(components), np.abs(v)) and np.allclose(np.abs(got), np.abs(centred @ v.T))


def test_harmony_brings_batches_together(points, spark):
    x, _ = points
    moved = [(i, "ab"[i % 2], [float(v) + (3.0 if i % 2 else 0.0) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(moved, "cell_id long, batch string, f array<double>")
    before = np.array([r[2] for r in moved])
    after = np.array([r.f for r in M.harmony(df, "f", "batch", clusters=1, rounds=2).orderBy("cell_id").collect()])
    gap = lambda z: np.linalg.norm(z[::2].mean(0) - z[1::2].mean(0))
    assert gap(after) < 0.2 * gap(before)


def test_components_of_wide_rows_equal_svd(spark):
    """2,000 columns: the subspace of the first components within 1e-6 of the SVD's, in the same order."""
    rng = np.random.default_rng(11)
    x = (rng.normal(0, 1, (300, 40)) * 2.0 ** -(np.arange(40) / 3)) @ rng.normal(0, 1, (40, 2000)) + 0.01 * rng.normal(0, 1, (300, 2000)) + 5
    held = pa.ListArray.from_arrays(pa.array(np.arange(301) * 2000, pa.int32()), pa.array(x.ravel()))
    df = spark.createDataFrame(pa.table({"cell_id": np.arange(300), "f": held})).repartition(5)
    scores, components = M.pca(df, "f", 2000, 10)
    centred = x - x.mean(0)
    v = np.linalg.svd(centred, full_matrices=False)[2][:10]
    assert np.linalg.norm(components - (components @ v.T) @ v, 2) < 1e-6
    assert np.allclose(np.abs((components * v).sum(1)), 1, atol=1e-6)
    got = np.array([r.f for r in scores.orderBy("cell_id").collect()])
    assert np.allclose(np.abs(got), np.abs(centred @ v.T), atol=1e-4)


def reference_combat(y, batch):
    """Columns x genes, parametric empirical Bayes gene by gene (no covariates; pooled deviation over columns)."""
    out, labels = np.empty_like(y), sorted(set(batch))
    batch = np.array(batch)
    mean = y.mean(0)
    sd = np.sqrt(sum(((y[batch == b] - y[batch == b].mean(0)) ** 2).sum(0) for b in labels) / len(y))
    z = (y - mean) / sd
    for b in labels:
        x = z[batch == b]
        n, g, d = len(x), x.mean(0), x.var(0, ddof=1)
        g_bar, t2, m, s2 = g.mean(), g.var(ddof=1), d.mean(), d.var(ddof=1)
        a, rate = (2 * s2 + m**2) / s2, (m * s2 + m**3) / s2
        for j in range(y.shape[1]):
            shift, scale = g[j], d[j]
            for _ in range(500):
                shift = (t2 * n * g[j] + scale * g_bar) / (t2 * n + scale)
                scale = (rate + 0.5 * ((x[:, j] - shift) ** 2).sum()) / (n / 2 + a - 1)
            out[batch == b, j] = (x[:, j] - shift) / np.sqrt(scale) * sd[j] + mean[j]
    return out


def test_combat_equals_empirical_bayes(spark):
    rng = np.random.default_rng(4)
    y = rng.normal(0, 1, (20, 12)) * rng.uniform(0.5, 2, 12) + np.arange(12) + 5 * (np.arange(20) // 5)[:, None]
    rows = [(f"s{i // 5}", f"c{i % 5}", g, float(y[i, g])) for i in range(20) for g in range(12)]
    got = M.combat(spark.createDataFrame(rows, "sample string, cell_type string, gene long, m double"), tolerance=1e-12).collect()
    expected = reference_combat(y, [f"s{i // 5}" for i in range(20)])
    assert len(got) == 240
    assert max(abs(r.m - expected[5 * int(r.sample[1:]) + int(r.cell_type[1:]), r.gene]) for r in got) < 1e-6


def reference_harmony(x, batch, centres, rounds, sigma=0.1, theta=2.0, penalty=1.0):
    """All rows at once: assign, shift, assign anew; returns the corrected rows."""
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    labels = sorted(set(batch))
    phi, z = np.array([[b == label for label in labels] for b in batch], float), x
    weight = np.ones((len(centres), len(labels)))
    for _ in range(rounds):
        d = 2 * (1 - unit(z) @ unit(centres).T)
        r = np.exp(-(d - d.min(1, keepdims=True)) / sigma) * (phi @ weight.T)
        r /= r.sum(1, keepdims=True)
        observed, total = r.T @ phi, np.zeros_like(x)
        for k in range(len(centres)):
            mean = (r[:, k : k + 1] * x).sum(0) / r[:, k].sum()
            for j in range(len(labels)):
                w = r[:, k] * phi[:, j]
                total += w[:, None] * ((w @ (x - mean)) / (w.sum() + penalty))
        expected = np.outer(r.sum(0), phi.mean(0))
        centres, weight, z = unit(r.T @ unit(z)), ((expected + 1) / (observed + 1)) ** theta, x - total
    return z


def test_harmony_equals_all_rows_at_once(spark):
    """More rounds than are replayed; groups of different width and batches, all in one run."""
    rng, data, rows = np.random.default_rng(6), {}, []
    for level, (n, width, batches) in {"p": (90, 3, "ab"), "q": (70, 4, "abc")}.items():
        batch = [batches[i % len(batches)] for i in range(n)]
        x = rng.normal(0, 1, (n, width)) + 3 * (np.arange(n) % 2)[:, None] + np.array([[2.0 * batches.index(b)] * width for b in batch])
        data[level] = x, batch
        rows += [(level, i, b, v.tolist()) for i, (b, v) in enumerate(zip(batch, x, strict=True))]
    df = spark.createDataFrame(rows, "level string, cell_id long, batch string, f array<double>").repartition(3)
    got = {(r.level, r.cell_id): r.f for r in K.harmony_by(df, "level", "f", "batch", clusters=2, rounds=5, tolerance=0.0).collect()}
    order = {(r.level, r.cell_id): r.h for r in df.withColumn("h", F.xxhash64("f")).collect()}
    for level, (x, batch) in data.items():
        drawn = np.array([x[i] for i in sorted(range(len(x)), key=lambda i: order[level, i])][:100])
        expected = reference_harmony(x, batch, M.k_means(drawn, 2, 0), 5)
        assert np.allclose([got[level, i] for i in range(len(x))], expected, atol=1e-8)
        apart = lambda z: np.linalg.norm(z[np.array(batch) == "a"].mean(0) - z[np.array(batch) == "b"].mean(0))
        assert apart(expected) < 0.7 * apart(x)


def test_components_by_group_equal_svd(spark):
    rng, rows, data = np.random.default_rng(7), [], {}
    for level, (n, width) in {"p": (40, 5), "q": (25, 3), "r": (1, 4)}.items():
        data[level] = rng.normal(0, np.arange(1, width + 1), (n, width))
        rows += [(level, i, v.tolist()) for i, v in enumerate(data[level])]
    scores, components = K.pca_by(spark.createDataFrame(rows, "level string, cell_id long, f array<double>").repartition(3), "level", "f", 2)
    got = {(r.level, r.cell_id): r.f for r in scores.collect()}
    for level in "pq":
        x = data[level] - data[level].mean(0)
        v = np.linalg.svd(x, full_matrices=False)[2][:2]
        assert np.allclose(np.abs(components[level]), np.abs(v))
        assert np.allclose(np.abs([got[level, i] for i in range(len(x))]), np.abs(x @ v.T))
    assert np.allclose(got["r", 0], 0) and len(got["r", 0]) == 1


def test_ordered_arbiter_knows_only_the_folds_before(spark):
    """The first fold has no target but 0, so the margin chooses; a later fold's labels change nothing before it."""
    rng = np.random.default_rng(9)
    models, features = ["a", "b"], ["p_t", "a_top1", "a_margin", "a_entropy", "b_top1", "b_margin", "b_entropy", "agree_a_b"]

    def rows(last_label):
        made = np.random.default_rng(9).dirichlet([0.6] * 3, (60, 2))
        return [(i, int(rng.integers(3)) if last_label is None else labels[i] if i % 3 < 2 else last_label, i % 3, float(made[i, 0, 0]), made[i, 0].tolist(), made[i, 1].tolist()) for i in range(60)]

    labels = [r[1] for r in rows(None)]
    schema = "cell_id long, cell_type int, fold int, p_t double, a array<double>, b array<double>"
    runs = [{r.cell_id: r for r in M.ordered_arbiter(spark.createDataFrame(rows(x), schema), models, features, 3, 0).collect()} for x in (1, 2)]
    for i, r in runs[0].items():
        if r.fold < 2:
            assert r.choice == runs[1][i].choice
        if r.fold == 0:
            assert r.choice == int(r.b_margin > r.a_margin)
        label = 0 if r.p_t >= 0.55 else int(np.argmax((r.a, r.b)[r.choice]))
        assert r.pred == label
    assert len(runs[0]) == 60


def test_gram_equals_numpy(spark):
    rng = np.random.default_rng(5)
    z, w = rng.normal(0, 1, (300, 7)), rng.uniform(0, 2, 300)
    df = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(z, w, strict=True)], "z array<double>, w double").repartition(5)
    assert np.allclose(M.gram(df, 7), (z * w[:, None]).T @ z)
    assert np.allclose(M.gram(df.limit(0), 7), 0)


def test_boosted_trees_learn_and_stop():
    from tissuemill.operators import boosting as B

    rng = np.random.default_rng(0)
    centres = rng.normal(size=(5, 12)) * 1.5
    y = rng.integers(0, 5, 900)
    x = centres[y] + rng.normal(size=(900, 12))
    model = B.fit(x[:600], y[:600], range(5), None, np.arange(600) % 6 == 0)
    p = model.predict(x[600:])
    assert np.allclose(p.sum(1), 1) and (p.argmax(1) == y[600:]).mean() > 0.8 and 0 < len(model.rounds) < 300
    binary = B.fit(x[:600], y[:600] == 2, [0, 1], None, np.arange(600) % 6 == 0)
    assert ((binary.predict(x[600:])[:, 1] > 0.5) == (y[600:] == 2)).mean() > 0.9
    alone = B.fit(x[:20], np.zeros(20, int), [0, 1])
    assert alone.rounds == [] and alone.predict(x[:2])[:, 0].min() > 0.9
    tree, values = B.grow(np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(B.edges_of(x, 64), x.T, strict=True)]), B.edges_of(x, 64), y - 2.0, np.ones(900), B.Growth(), rng)
    assert np.allclose(tree.predict(x), values) and (tree.feature >= 0).sum() <= 30


def test_nearest_equals_a_full_sort():
    from tissuemill.operators import classify as C

    rng = np.random.default_rng(3)
    d = rng.integers(0, 6, (40, 50)).astype(float)
    assert (C.nearest(d, 7) == np.argsort(d, axis=1, kind="stable")[:, :7]).all() and C.nearest(d, 90).shape == (40, 50)


def test_fuzzy_graph(spark):
    """Each row's edges weigh log2 of their number before the union, the nearest weighs 1, and the union is symmetric."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(30, 3))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    edges = [(i, int(j), float(d[i, j])) for i in range(30) for j in np.argsort(d[i])[1:7]]
    got = {(r.cell_id, r.neighbour): r.weight for r in M.fuzzy_graph(spark.createDataFrame(edges, "cell_id long, neighbour long, distance double")).collect()}
    assert all(np.isclose(got[a, b], got[b, a]) for a, b in got if (b, a) in got) and max(got.values()) <= 1 + 1e-9
    assert all(np.isclose(got[i, int(np.argsort(d[i])[1])], 1) for i in range(30))


def test_local_quadratic_follows_a_parabola():
    x = np.linspace(-1, 1, 40)
    assert np.allclose(M.local_quadratic(x, 3 * x * x - x + 2, 0.4), 3 * x * x - x + 2, atol=1e-6)


def test_one_vs_rest_trees_take_every_label(spark, data):
    """All labels are learned, and every row of group 0 is predicted."""
    from tissuemill.plans import catalog, studies  # noqa: F401  studies adds the query

    got = {r.cell_id: (r.cell_type, r.yhat) for r in catalog.queries()["gbt_ovr"](spark, data).collect()}
    rows = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "label").collect()
    assert {i: label for i, (label, _) in got.items()} == {r.vec_id: r.label for r in rows if r.vec_id % 7 == 0}
    assert {yhat for _, yhat in got.values()} <= {r.label for r in rows} and max(yhat for _, yhat in got.values()) >= 3


def test_fuzzy_graph_of_uneven_rows(spark):
    """Rows of many lengths in one batch, copies at distance 0: weights as found row by row."""
    lists = {1: [0.0, 0.0, 1.0, 2.5], 2: [0.3], 3: [1.0, 1.5, 1.7, 2.0, 9.0], 4: [0.0, 0.0]}
    edges = spark.createDataFrame([(i, 100 * i + j, d) for i, ds in lists.items() for j, d in enumerate(ds)], "cell_id long, neighbour long, distance double").coalesce(1)
    got = {(r.cell_id, r.neighbour): r.weight for r in M.fuzzy_graph(edges).collect()}
    for i, ds in lists.items():
        d = np.array(ds)
        gap = np.maximum(d - d[d > 0].min() if (d > 0).any() else d, 0)
        low, high, s = 0.0, np.inf, 1.0
        for _ in range(40):
            low, high = (low, s) if np.exp(-gap / s).sum() > np.log2(max(2, len(d))) else (s, high)
            s = s * 2 if high == np.inf else (low + high) / 2
        want = np.exp(-gap / max(s, 1e-3 * max(d.mean(), 1e-12)))
        assert np.allclose([got[i, 100 * i + j] for j in range(len(d))], want, atol=1e-12)


def test_boosted_trees_of_folds_are_fitted_in_tasks(spark):
    """Each fold's model equals a fit on the others' rows in the order of their hashes; the bound keeps the first by hash."""
    from pyspark.sql import functions as F

    from tissuemill.operators import boosting as B

    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] + x[:, 1] > 0).astype(int) + 2 * (x[:, 2] > 0.5)
    df = spark.createDataFrame([(i, i % 3, int(y[i]), [float(v) for v in x[i]]) for i in range(400)], "cell_id long, fold int, cell_type int, f array<double>")
    hashes = {r[0]: r[1] for r in df.select("cell_id", F.xxhash64("cell_id")).collect()}
    g = B.Growth(rounds=6, least_rows=5, stop=3)
    for most in (10_000, 150):
        got = B.fit_folds(df, [0, 2], {"all": (range(4), "cell_type")}, most_rows=most, g=g)
        assert set(got) == {0, 2}
        for k in (0, 2):
            rows = sorted((i for i in range(400) if i % 3 != k), key=lambda i: (hashes[i], i))[:most]
            kinds, counts = np.unique(y[rows], return_counts=True)
            weight = np.minimum(len(rows) / (len(kinds) * counts), 5.0)[np.searchsorted(kinds, y[rows])]
            own = B.fit(x[rows], y[rows], range(4), weight, np.array([hashes[i] % 8 == 0 for i in rows]), g)
            assert len(own.rounds) and np.allclose(got[k]["all"].predict(x), own.predict(x), atol=1e-12)
    assert B.fit_rows(df.where("cell_id < 0"), [0, 1]).predict(x[:1]).tolist() == [[0.5, 0.5]]


def test_larger_leaf_is_what_the_smaller_leaves():
    """Splits from sums by subtraction are those from all rows: bins without rows stay empty."""
    from tissuemill.operators import boosting as B

    rng = np.random.default_rng(1)
    codes = np.asfortranarray(rng.integers(0, 6, (600, 4)) * 10)
    edges = [np.arange(64) + 0.5] * 4
    slope = rng.normal(size=600) + (codes[:, 1] > 20) - 0.5
    tree, values = B.grow(codes, edges, slope, np.ones(600), B.Growth(features=1.0, rate=1.0), np.random.default_rng(0))
    assert (tree.feature >= 0).sum() > 5 and (tree.threshold[tree.feature >= 0] % 10 == 0.5).all()
    leaf = tree._replace(value=np.arange(len(tree.value)).astype(float)).predict(codes)
    assert all(np.isclose(v, -slope[leaf == at].mean()) for at, v in zip(leaf, values, strict=True))


def plain_quadratic(x, y, span):
    n = len(x)
    k = min(n, max(4, int(np.ceil(span * n))))
    out = np.empty(n)
    for i in range(n):
        d = np.abs(x - x[i])
        near = np.argsort(d, kind="stable")[:k]
        width = max(d[near].max(), 1e-12)
        w = np.sqrt(np.clip(1 - (d[near] / width) ** 3, 0, None) ** 3 + 1e-9)
        out[i] = np.linalg.lstsq(np.vander(x[near] - x[i], 3) * w[:, None], y[near] * w, rcond=None)[0][-1]
    return out


def test_local_quadratic_equals_fits_point_by_point():
    """Scattered, clustered, repeated and few points; and 60,000 points, which took minutes one by one."""
    rng = np.random.default_rng(4)
    for x in (rng.normal(size=700), np.concatenate((rng.normal(size=300) * 1e-3, rng.normal(size=301) + 5)), np.repeat(rng.normal(size=40), 17), np.array([1.0, 1.0, 2.0, 2.0, 2.0]), np.ones(9), np.repeat([0.0, 1.0], [30, 5]), np.array([3.0])):
        y = np.sin(3 * x) + rng.normal(size=len(x)) * 0.1
        assert np.allclose(M.local_quadratic(x, y, 0.3), plain_quadratic(x, y, 0.3), atol=1e-7), len(x)
    x = rng.normal(size=60_000)
    assert np.abs(M.local_quadratic(x, np.sin(x), 0.3) - np.sin(x)).mean() < 0.05


def test_components_count_rows_of_zeros_that_are_not_there(spark, monkeypatch):
    """Both ways of finding components, and by group, equal those of the table with its rows of zeros."""
    rng = np.random.default_rng(2)
    x = rng.gamma(2, size=(40, 6))
    rows = [(i, "a", [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "cell_id long, level string, f array<double>").repartition(3)
    full = np.vstack((x, np.zeros((25, 6))))
    _, _, vt = np.linalg.svd(full - full.mean(0), full_matrices=False)
    for wide in (1024, 3):
        monkeypatch.setattr(M, "WIDE", wide)
        _, components, none = M.pca_with_zeros(df, "f", 6, 3, 25)
        assert np.allclose(np.abs((components * vt[:3]).sum(1)), 1, atol=1e-6) and np.allclose(none, -full.mean(0) @ components.T, atol=1e-8)
    _, components, none = K.pca_by_with_zeros(df, "level", "f", 3, {"a": 25})
    assert np.allclose(np.abs((components["a"] * vt[:3]).sum(1)), 1, atol=1e-6) and np.allclose(none["a"], -full.mean(0) @ components["a"].T, atol=1e-8)
