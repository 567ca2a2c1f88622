"""Spectral layout, sparse markers and leave-out folds against numpy, and the ensemble queries that SQL cannot express."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors

import __spark_entry__ as entry
from tissuemill.operators import classify as C
from tissuemill.operators import expression as X
from tissuemill.operators import layout as L
from tissuemill.operators import models as M
from tissuemill.plans import studies as S
from tissuemill.plans.catalog import pb
from tissuemill.plans.views import CLASSES, Tables


def test_leading_eigenvectors(spark):
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(c, 0.6, (40, 3)) for c in ((0, 0, 0), (2, 0, 0), (0, 3, 0))])
    near = np.exp(-((points[:, None] - points[None]) ** 2).sum(-1))
    w = np.where(near > 0.05, near, 0.0)
    np.fill_diagonal(w, 0)
    edges = spark.createDataFrame([(int(i) * 7, int(j) * 7, float(w[i, j])) for i, j in zip(*np.nonzero(w), strict=True)], "cell_id long, neighbour long, weight double")
    held = np.flatnonzero(w.sum(1))
    a = (w / np.sqrt(np.outer(w.sum(1), w.sum(1)) + 1e-300))[np.ix_(held, held)]
    values, vectors = np.linalg.eigh(a)
    found, got_values = L.spectral(edges, 3)
    got = np.array([r.v for r in found.orderBy("cell_id").collect()])
    assert np.allclose(got_values, values[::-1][:3], atol=1e-8) and got.shape == (len(held), 3)
    for k in range(3):
        assert abs(abs(got[:, k] @ vectors[:, ::-1][:, k]) - 1) < 1e-6 and (got[:, k] ** 3).sum() > 0
    assert L.coordinates(edges.where("weight < 0")).collect() == []


def test_layout_of_two_rows(spark):
    rows = L.coordinates(spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.5)], "cell_id long, neighbour long, weight double")).orderBy("cell_id").collect()
    assert [r.cell_id for r in rows] == [1, 2] and np.allclose(sorted(r.x for r in rows), [-10, 10]) and {r.y for r in rows} == {0.0}


@pytest.mark.parametrize("l1_ratio", [1.0, 0.5])
def test_sparse_logistic(spark, l1_ratio):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 20))
    y = (x[:, 0] - x[:, 3] + rng.normal(size=60) > 0.4).astype(float)
    w = np.where(y == 1, 60 / (2 * y.sum()), 60 / (2 * (60 - y.sum())))
    beta, intercept = M.sparse_logistic(x, y, w, 2.0, l1_ratio)
    gradient = x.T @ (w * (y - 1 / (1 + np.exp(-x @ beta - intercept)))) - 2.0 * (1 - l1_ratio) * beta
    assert np.allclose(gradient[beta != 0], 2.0 * l1_ratio * np.sign(beta[beta != 0]), atol=1e-6) and (np.abs(gradient[beta == 0]) <= 2.0 * l1_ratio + 1e-6).all()
    assert 0 < (beta != 0).sum() < 20
    rows = spark.createDataFrame([(Vectors.dense(a), float(b), float(c)) for a, b, c in zip(x, y, w, strict=True)], ["features", "label", "w"])
    want = LogisticRegression(elasticNetParam=l1_ratio, regParam=2.0 / 60, standardization=False, weightCol="w", tol=1e-10, maxIter=500).fit(rows)
    assert np.allclose(beta, want.coefficients.toArray(), atol=1e-4) and np.isclose(intercept, want.intercept, atol=1e-4)


def test_sparse_markers_of_all_classes(spark):
    rng = np.random.default_rng(6)
    rows = [(f"s{s}", "ABC"[k], g, float(rng.gamma(2) + (6 if g == k else 0))) for s in range(6) for k in range(3) for g in range(8) if g != 7 or s]
    got = {(r.cell_type, r.gene): r.coefficient for r in M.sparse_markers(spark.createDataFrame(rows, "sample string, cell_type string, gene long, m double"), ["A", "B", "C", "D"]).collect()}
    x = np.zeros((6, 3, 8))
    for s, k, g, m in rows:
        x[int(s[1:]), "ABC".index(k), g] = m
    x = x.reshape(18, 8)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    for k, c in enumerate("ABC"):
        y = np.tile(np.arange(3) == k, 6).astype(float)
        want, _ = M.sparse_logistic(z, y, np.where(y == 1, 18 / 12, 18 / 24), 1.0, 1.0)
        assert np.allclose([got[c, g] for g in range(8)], want, atol=1e-6) and int(np.argmax(want)) == k
    assert {v for (c, _), v in got.items() if c == "D"} == {0.0} and len(got) == 32


def test_folds_equal_refits(spark, data, monkeypatch):
    """Leave-one-patient-out errors from the whole matrix, one fit after the other; the smallest tables have few genes."""
    monkeypatch.setattr(S, "LEAST_GENES", 3)
    monkeypatch.setattr(S, "LEAST_CELLS", 2)
    t = Tables(spark, data)
    columns, x = S.bulk_matrix(t)
    _, p = S.composition_matrix(t)
    genes = np.array([r[0] for r in t.genes().select("gene").orderBy("gene").collect()])
    cells = t.cells().select("cell_id", "n_nationkey", "patient", "sample").toPandas()
    who = {f"s{n}": q for n, q in cells[["n_nationkey", "patient"]].drop_duplicates().itertuples(index=False)}
    patient = np.array([who.get(c.split("_")[0], "UNK") for c in columns])
    of_sample = dict(cells[["sample", "patient"]].drop_duplicates().itertuples(index=False))
    profile = S.staged(pb(t))
    folds = C.lopo_folds(t.cells(), "patient").where("role = 'train'").toPandas()
    bags = {c: [] for c in columns}
    for (outer, _), fold in folds.groupby(["outer", "inner"]):
        mine = set(fold.patient)
        train = np.flatnonzero(np.isin(patient, list(mine)))
        chosen = X.top_k(X.contrast(profile.where(profile["sample"].isin([s for s, q in of_sample.items() if q in mine]))), S.MARKERS, by=["cell_type"])
        use = np.isin(genes, [r.gene for r in chosen.select("gene").distinct().collect()])
        if cells.patient.isin(mine).sum() < S.LEAST_CELLS or use.sum() < S.LEAST_GENES or len(train) < 2:
            continue
        z = S.np_ilr(p[train])
        xc = x[np.ix_(train, use)] - x[np.ix_(train, use)].mean(0)
        w = xc.T @ np.linalg.solve(xc @ xc.T + 1e-2 * np.eye(len(train)), z - z.mean(0))
        for i in np.flatnonzero(patient == outer):
            bags[columns[i]].append(S.np_ilr_inverse(((x[i, use] - x[np.ix_(train, use)].mean(0)) @ w + z.mean(0))[None])[0])
    assert any(bags.values())
    guess = np.array([np.mean(bags[c], axis=0) if bags[c] else np.full(len(CLASSES), 1 / len(CLASSES)) for c in columns])
    want = np.sqrt(((guess - p) ** 2).mean(0))
    got = {r.cell_type: r.rmse for r in S.deconv_lopo(t).collect()}
    assert np.allclose([got[c] for c in CLASSES], want, atol=2e-6) and np.isclose(got["AVERAGE"], want.mean(), atol=2e-6)


@pytest.mark.parametrize("name", ["layout", "elastic_markers", "scatter", "umap_edges"])
def test_queries_run(spark, data, name):
    df = entry.queries()[name](spark, data).toPandas()
    assert len(df) and not df.isna().any().any()


@pytest.mark.parametrize("l1_ratio", [1.0, 0.5])
def test_genes_enter_the_sparse_fit_in_rounds(spark, monkeypatch, l1_ratio):
    """Three genes a round; the end is the optimum over all genes."""
    monkeypatch.setattr(M, "ENTER", 3)
    rng = np.random.default_rng(3)
    x = rng.gamma(2, size=(30, 25)) + np.where(np.arange(25) < 2, 3.0 * (np.arange(30) % 2)[:, None], 0)
    rows = [(f"s{i // 2}", "AB"[i % 2], g, float(x[i, g])) for i in range(30) for g in range(25)]
    got = {(r.cell_type, r.gene): r.coefficient for r in M.sparse_markers(spark.createDataFrame(rows, "sample string, cell_type string, gene long, m double"), ["A", "B", "C"], l1_ratio=l1_ratio).collect()}
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    want = M.sparse_logistic(z, np.arange(30) % 2 == 1, np.ones(30), 1.0, l1_ratio)[0]
    assert np.allclose([got["B", g] for g in range(25)], want, atol=1e-5) and {got["C", g] for g in range(25)} == {0.0} and (want != 0).sum() > 3


def test_a_product_sends_one_sum_for_each_cell_reached(spark, monkeypatch):
    """A graph in several parts, one cell joined with all: the product is numpy's, and far fewer rows are sent than there are edges."""
    monkeypatch.setattr(L, "LEAST_ROWS", 20)
    monkeypatch.setattr(L, "MOST_EDGES", 300)
    rng = np.random.default_rng(4)
    w = np.where(rng.random((150, 150)) < 0.3, rng.random((150, 150)), 0)
    w[:, 0] = 1
    w[:75, 75:] *= 0.05
    w = np.triu(w.T + w, 1)
    w += w.T
    edges = spark.createDataFrame([(int(i) * 3, int(j) * 3, float(w[i, j])) for i, j in zip(*np.nonzero(w), strict=True)], "cell_id long, neighbour long, weight double")
    a = w / np.sqrt(np.outer(w.sum(1), w.sum(1)))
    cells, n = L.dealt(edges)
    placed = {r.cell_id // 3: (r.part, r.place) for r in cells.collect()}
    held = L.packed(edges, cells)
    start = L.started(cells, 4)
    sent = L.passed(held, start, 4, L.turned(np.eye(4)))
    total = L.product(sent, 4).where(f"kind in ({L.OWN}, {L.BEFORE})").collect()
    own, before = ({r.part: np.reshape(r.x, (-1, 4)) for r in total if r.kind == k} for k in (L.OWN, L.BEFORE))
    rows = lambda found: np.array([found[placed[i][0]][placed[i][1]] for i in range(n)])
    assert n == 150 and len(own) > 4 and np.allclose(rows(own), a @ rows(before), atol=1e-12)
    assert sent.where(f"kind = {L.SENT}").selectExpr("sum(size(cells))").first()[0] < np.count_nonzero(w) / 3


def test_markers_of_folds_from_sums(spark, monkeypatch):
    """Markers of all folds out of patients' sums equal the contrast of each fold's own pseudobulk: absent pairs, a class that one
    sample lacks, a gene without cells and one without counts in a fold."""
    monkeypatch.setattr(S, "MARKERS", 4)
    rng = np.random.default_rng(9)
    cells = [(i, f"n{s}", f"p{s % 3}", k, s) for i, (s, k) in enumerate((s, k) for s in range(6) for k in "ABC" if (s, k) != (4, "C") for _ in range(2 + s % 2))]
    n = {}
    for _, sample, _, k, _ in cells:
        n[sample, k] = n.get((sample, k), 0) + 1
    sums = [(g, s, k, int(s[1:]), float(rng.gamma(2))) for g in range(30) for s, k in n if rng.random() < 0.6 and not (g == 7 and s in ("n0", "n3"))]
    rows = spark.createDataFrame([*sums, (30, None, None, None, 1.0)], "gene long, sample string, cell_type string, n_nationkey int, s double")
    folds = [("p0", 0, ["p1"]), ("p0", 1, ["p2", "p1"]), ("p2", 0, ["p0"])]
    held = spark.createDataFrame(cells, "cell_id long, sample string, patient string, cell_type string, n_nationkey int")
    got = {tuple(r) for r in S.fold_markers(rows, held, folds).collect()}
    value = {(g, s, k): v for g, s, k, _, v in sums}
    dense = [(o, i, s, k, g, value.get((g, s, k), 0.0) / n[s, k]) for o, i, train in folds for s, k in n if f"p{int(s[1:]) % 3}" in train for g in range(31)]
    scores = X.contrast(spark.createDataFrame(dense, "outer string, inner int, sample string, cell_type string, gene long, m double"), by=("outer", "inner"))
    want = {tuple(r) for r in X.top_k(scores, 4, by=["outer", "inner", "cell_type"]).select("outer", "inner", "gene").collect()}
    assert got == want and {r[:2] for r in got} == {f[:2] for f in folds}
