"""The fitted studies on the smallest tables, and what numpy can say about them."""

import numpy as np
import pytest

import __spark_entry__ as entry
from tissuemill.operators import classify as C
from tissuemill.operators import embedding as E
from tissuemill.operators import expression as X
from tissuemill.plans import studies as S
from tissuemill.plans.views import CLASSES, Tables


@pytest.fixture(scope="module")
def tables(spark, data):
    return Tables(spark, data)


def test_a_table_that_is_missing(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="no table cells_of_nobody"):
        Tables(spark, str(tmp_path)).cells_of_nobody


def test_ridge_on_log_ratios(tables):
    columns, x = S.bulk_matrix(tables)
    _, p = S.composition_matrix(tables)
    h = np.array([[1 / np.sqrt(j * (j + 1)) if i < j else -j / np.sqrt(j * (j + 1)) if i == j else 0 for j in range(1, len(CLASSES))] for i in range(len(CLASSES))])
    z = np.log(np.maximum(p, 1e-12)) @ h
    xc = x - x.mean(0)
    w = xc.T @ np.linalg.solve(xc @ xc.T + 1e-2 * np.eye(len(x)), z - z.mean(0))
    e = np.exp((xc @ w + z.mean(0)) @ h.T)
    want = e / e.sum(1, keepdims=True)
    got = {(r.bulk_col, r.cell_type): r.p for r in S.ridge_ilr(tables).collect()}
    assert np.allclose([[got[c, k] for k in CLASSES] for c in columns], want, atol=1e-6)


def test_deconvolution_by_patient(tables):
    rows = {r.cell_type: r.rmse for r in S.deconv_lopo(tables).collect()}
    assert set(rows) == {*CLASSES, "AVERAGE"} and 0 < rows["AVERAGE"] < 0.5 and np.isclose(rows["AVERAGE"], np.mean([rows[c] for c in CLASSES]), atol=1e-5)


@pytest.mark.parametrize("name", ["ridge_classifier", "gbt_ovr", "combat", "hvg", "l1_markers", "pca", "harmony"])
def test_studies_run(spark, data, name):
    df = entry.queries()[name](spark, data).toPandas()
    assert len(df) and not df.isna().any().any()


def study(spark):
    """Forty training and twenty test cells of two classes and samples, one gene for each class, one gene of the test side alone."""
    rng = np.random.default_rng(4)
    cells, expr = [], []
    for i in range(60):
        kind = "AB"[i % 2]
        cells.append((i, "train" if i < 40 else "test", f"s{i % 4 // 2}", kind, f"c{i % 3 % 2}"))
        counts = rng.poisson(4, 9) + np.where(np.arange(9) == (kind == "B"), 40, 0)
        expr += [(i, g, float(v)) for g, v in enumerate(counts) if v and (g < 8 or i >= 40)]
    return spark.createDataFrame(cells, "cell_id long, split string, sample string, cell_type string, chemo string"), spark.createDataFrame(expr, "cell_id long, gene long, value double")


def test_joint_embedding(spark):
    cells, expr = study(spark)
    steps = E.Steps(markers=4, variable=4, components=3, batch=("sample",))
    values = E.prepared(expr.where("gene < 8"), 60, steps).collect()
    x = np.zeros((60, 8))
    for c, g, v in expr.where("gene < 8").collect():
        x[c, g] = v
    x = x / x.sum(1, keepdims=True) * 1e4
    x = np.arcsinh(np.minimum(x, np.quantile(x, 0.995, axis=0)))
    assert np.allclose([v for *_, v in values], [x[c, g] for c, g, _ in values])
    train = cells.where("split = 'train'")
    assert {r.gene for r in E.markers(expr.where("gene < 8"), train, 1, scaled=False).collect()} == {0, 1}
    assert 0 < E.markers(expr.where("gene < 8"), train, 1, scaled=True).count() <= 2  # a ratio of scaled means may have no logarithm
    got = E.joint_embedding(expr, cells, steps).orderBy("cell_id").collect()
    z = np.array([r.z for r in got])
    assert z.shape == (60, 6) and np.allclose(z.mean(0), 0, atol=1e-6) and np.allclose(z.std(0), 1, atol=1e-3)
    assert max(abs(np.mean(z[::2, d]) - np.mean(z[1::2, d])) for d in range(6)) > 1  # the classes part
    with pytest.raises(ValueError, match="in common"):
        E.joint_embedding(expr.where("gene = 8"), cells, steps)
    with pytest.raises(KeyError, match="tumor"):
        E.joint_embedding(expr, cells, E.Steps(batch=("tumor",)))
    with pytest.raises(ValueError, match="quantile"):
        E.prepared(expr, 60, E.Steps(winsor=0.2))


def test_strata_embedding(spark):
    """Each stratum as if it were alone (columns up to sign), and as many jobs for three strata as for one."""
    cells, expr = study(spark)
    steps = E.Steps(markers=2, variable=4, components=2, least_cells=10)
    jobs = []

    def embedded(cells, group):
        spark.sparkContext.setJobGroup(group, group)
        out = {r.cell_id: (r.stratum, np.array(r.z)) for r in E.strata_embedding(expr, cells, ("chemo",), steps).collect()}
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
        return out

    got = embedded(cells, "every stratum")
    assert len(got) == 60 and {len(z) for _, z in got.values()} == {4} and {level for level, _ in got.values()} == {"c0", "c1"}
    for level in ("c0", "c1"):
        alone = embedded(cells.where(cells["chemo"] == level), level)
        z, own = (np.array([x[c][1] for c in sorted(alone)]) for x in (got, alone))
        assert np.allclose(z.mean(0), 0, atol=1e-6) and np.allclose(z, own, atol=1e-6)
    assert max(jobs) - min(jobs) < 12
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_scaled_values_count_zeros(spark):
    _, expr = study(spark)
    x = np.zeros((60, 9))
    for c, g, v in expr.collect():
        x[c, g] = v
    z = np.minimum((x - x.mean(0)) / x.std(0, ddof=1), 2.0)
    for r in X.scale_clip(expr, 60, 2.0).collect():
        assert np.isclose(r.value, z[r.cell_id, r.gene]) and np.isclose(r.zero, min((0 - x[:, r.gene].mean()) / x[:, r.gene].std(ddof=1), 2.0))


def test_ensemble(tables):
    """Three base models, the gate, folds of three kinds; every row predicted by models that did not see it."""
    train, test = S.labelled(tables)
    oof, unseen = S.fold_predictions(train, test, "group", 3)
    rows = oof.collect()
    assert sorted(r.cell_id for r in rows) == sorted(r.cell_id for r in train.collect()) and len({r.fold for r in rows}) == 3
    assert len({(r.grp, r.fold) for r in rows}) == len({r.grp for r in rows})  # a group lies in one fold
    for r in [*rows, *unseen.collect()]:
        assert all(np.isclose(sum(r[m]), 1, atol=1e-6) for m in S.BASE) and 0 <= r.p_t <= 1
    out = S.ensemble(tables, "kfold", 2, ["knn", "ridge"]).collect()
    assert {r.cell_id for r in out} == {r.cell_id for r in test.collect()}
    for r in out:
        assert r.pred_final == (0 if r.p_t >= 0.55 else int(np.argmax(r[["knn", "ridge"][r.choice]])))
    with pytest.raises(ValueError):
        S.fold_predictions(train, test, "stratified", 2, ["forest"])
    with pytest.raises(ValueError):
        C.folds(train, "other", "cell_type", "grp", "cell_id")


def test_embeddings_store_no_row_as_wide_as_the_genes(spark, monkeypatch):
    """What the embeddings write has vectors of components only, and a row for each batch in place of its cells of zeros."""
    from pyspark.sql import functions as F

    cells, expr = study(spark)
    expr = expr.where("cell_id < 30 or gene >= 6")  # half of the cells lack the markers
    steps, plain, widest, heaviest = E.Steps(markers=2, variable=4, components=2, least_cells=10), E.staged, [], []

    def looked_at(df):
        out = plain(df)
        if "f" in out.columns:
            widest.append(out.agg(F.max(F.size("f"))).first()[0])
        if "weight" in out.columns:
            heaviest.append((out.count(), out.agg(F.sum("weight")).first()[0]))
        return out

    monkeypatch.setattr(E, "staged", looked_at)
    z = {r.cell_id: r.z for r in E.joint_embedding(expr, cells, E.Steps(markers=4, variable=4, components=2, batch=("sample",))).collect()}
    assert len(z) == 60 and np.isfinite(np.array(list(z.values()))).all()
    assert len(E.strata_embedding(expr, cells, ("chemo",), steps).collect()) == 60
    assert widest and max(widest) <= 2 and heaviest and {n for _, n in heaviest} == {60} and min(rows for rows, _ in heaviest) < 60
    for embedded in (E.joint_embedding(expr, cells, steps._replace(winsor=0.51)), E.strata_embedding(expr, cells, ("chemo",), steps._replace(winsor=0.51))):
        assert embedded.count() == 60  # the cut leaves zeros in most genes
    assert max(widest) <= 2


def test_a_row_of_a_weight_counts_as_so_many_rows(spark):
    """Sparse vectors, and Harmony on rows with weights, against the rows written out."""
    from pyspark.sql import functions as F

    from tissuemill.operators import keyed as K
    from tissuemill.operators import models as M

    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (40, 3)) + np.repeat([[3, 0, 0], [0, 3, 0]], 20, axis=0)
    rows = [(i, f"b{i % 2}", [float(v) for v in r]) for i, r in enumerate(x)]
    many = [(100 + i, f"b{i % 2}", [1.0, 1.0, 0.0]) for i in range(50)]
    schema = "cell_id long, batch string, f array<double>"
    every = M.harmony(spark.createDataFrame(rows + many, schema), "f", "batch", clusters=2, rounds=3, tolerance=0.0).collect()
    held = [(*r, 1) for r in rows] + [(100 + i, f"b{i}", [1.0, 1.0, 0.0], 25) for i in range(2)]
    got = M.harmony(spark.createDataFrame(held, schema + ", weight long"), "f", "batch", clusters=2, rounds=3, tolerance=0.0, weight="weight").collect()
    want = {r.cell_id: r.f for r in every}
    assert len(got) == 42 and all(np.allclose(r.f, want[r.cell_id], atol=1e-9) for r in got)
    y = x * (rng.random(x.shape) < 0.5)
    listed = spark.createDataFrame([(i, "a", [int(j) for j in np.flatnonzero(r)], [float(v) for v in r[r != 0]], [float(v) for v in r]) for i, r in enumerate(y)], "cell_id long, level string, i array<int>, v array<double>, f array<double>")
    thin, _, none = K.pca_by_with_zeros(listed.drop("f"), "level", K.Sparse({"a": 3}), 2, {"a": 7})
    wide, _, want_none = K.pca_by_with_zeros(listed.drop("i", "v"), "level", "f", 2, {"a": 7})
    assert np.allclose(none["a"], want_none["a"]) and np.allclose(*([r.f for r in d.orderBy("cell_id").select(F.col("f")).collect()] for d in (thin, wide)))


def test_sparse_rows_have_the_components_of_the_written_out_matrix(spark, monkeypatch):
    """Both ways of joint components, by sums and by the range finder, against svd with the rows of zeros."""
    from tissuemill.operators import keyed as K
    from tissuemill.operators import models as M

    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (80, 6)) * [9, 6, 4, 1, 0.5, 0.2] * (rng.random((80, 6)) < 0.7)
    df = spark.createDataFrame([(i, [int(j) for j in np.flatnonzero(r)], [float(v) for v in r[r != 0]]) for i, r in enumerate(x)], "cell_id long, i array<int>, v array<double>").repartition(3)
    whole = np.vstack((x, np.zeros((20, 6))))
    centred = whole - whole.mean(0)
    vt = np.linalg.svd(centred, full_matrices=False)[2][:3]
    vt *= np.sign(vt[np.arange(3), np.abs(vt).argmax(1)])[:, None]
    for wide in (1024, 2):
        monkeypatch.setattr(M, "WIDE", wide)
        scores, components, none = M.pca_with_zeros(df, K.Sparse({"": 6}), 6, 3, 20)
        got = np.array([r.f for r in scores.orderBy("cell_id").collect()])
        assert scores.columns == ["cell_id", "f"] and np.allclose(components, vt, atol=1e-6)
        assert np.allclose(got, centred[:80] @ vt.T, atol=1e-6) and np.allclose(none, centred[-1] @ vt.T, atol=1e-6)
