"""Trees grown in passes over Spark rows against those grown in one matrix."""

import numpy as np
import pytest

from tissuemill.operators import boosting as B
from tissuemill.operators import boosting_passes as P


def table(spark, x, y, fold=None):
    rows = [(i, int(c), [float(v) for v in r], 0 if fold is None else int(fold[i])) for i, (c, r) in enumerate(zip(y, x, strict=True))]
    return spark.createDataFrame(rows, "cell_id long, cell_type int, f array<double>, fold int").repartition(3)


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 20, (900, 6)).astype(float)
    return x, (x[:, 0] > 9).astype(int) + (x[:, 1] + x[:, 2] > 22)


def weights(y):
    kinds, counts = np.unique(y, return_counts=True)
    return np.minimum(len(y) / (len(kinds) * counts), 5.0)[np.searchsorted(kinds, y)]


@pytest.mark.parametrize("classes", [[0, 1, 2], [0, 1]])
def test_trees_equal_those_of_one_matrix(spark, sample, classes, monkeypatch):
    monkeypatch.setattr(P, "REPLAY", 2)
    monkeypatch.setattr(P, "TOGETHER", 2)
    x, y = sample
    x, y = x[np.isin(y, classes)], y[np.isin(y, classes)]
    g = B.Growth(rounds=3, rate=0.2, leaves=9, least_rows=5, bins=32, features=0.7)
    edges = B.edges_of(x, g.bins)
    one = B.fit(x, y, classes, weights(y), None, g)
    two = P.fit_passes(table(spark, x, y), classes, valid_share=0, g=g, edges=edges)[0]
    assert len(one.rounds) == len(two.rounds) == 3
    for a, b in zip(one.rounds, two.rounds, strict=True):
        for s, t in zip(a, b, strict=True):
            assert (s.feature == t.feature).all() and (s.left == t.left).all() and np.allclose(s.threshold, t.threshold) and np.allclose(s.value, t.value)
    assert np.allclose(one.predict(x), two.predict(x))


def test_folds_grow_together(spark, sample):
    """The model of a fold is the one fitted on the rows of the others."""
    x, y = sample
    fold = np.arange(len(y)) % 3
    g = B.Growth(rounds=2, rate=0.3, leaves=5, bins=32, features=1.0)
    edges = B.edges_of(x, g.bins)
    models = P.fit_passes(table(spark, x, y, fold), [0, 1, 2], folds=3, valid_share=0, g=g, edges=edges)
    assert len(models) == 3
    for k, model in enumerate(models):
        alone = P.fit_passes(table(spark, x[fold != k], y[fold != k]), [0, 1, 2], valid_share=0, g=g, edges=edges)[0] if k == 1 else None
        assert (model.predict(x[fold == k]).argmax(1) == y[fold == k]).mean() > 0.6
        assert alone is None or np.allclose(alone.predict(x), model.predict(x))


def test_held_out_accuracy_stops_early_and_edges_from_rows(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 1200)
    x = rng.normal(0, 1, (1200, 5)) + np.column_stack((2.0 * y, y == 1, np.zeros((1200, 3))))
    train = np.arange(1200) < 800
    g = B.Growth(rounds=12, rate=0.3, leaves=6, bins=32, stop=3)
    model = P.fit_passes(table(spark, x[train], y[train]), [0, 1, 2], g=g)[0]
    assert 0 < len(model.rounds) <= 12
    assert (model.predict(x[~train]).argmax(1) == y[~train]).mean() > 0.75
    for own, exact in zip(P.edges_of_rows(table(spark, x, y), 16), B.edges_of(x, 16), strict=True):
        assert np.abs(own - exact).max() < 0.2


def test_lone_class_and_empty_table(spark, sample):
    x, _ = sample
    lone = P.fit_passes(table(spark, x[:50], np.ones(50, int)), [0, 1, 2], valid_share=0)[0]
    assert lone.rounds == [] and lone.predict(x[:2]).argmax(1).tolist() == [1, 1]
    none = P.fit_passes(table(spark, x[:0], []), [0, 1, 2])[0]
    assert np.allclose(none.predict(x[:1]), 1 / 3)


def test_folds_beyond_the_rows_of_a_task_learn_from_every_row(spark, monkeypatch):
    """Models of folds over more rows than a task may hold: the rows that a bound would leave out hold all of two classes."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(B, "IN_TASK", 200)
    rng = np.random.default_rng(2)
    x = rng.integers(0, 20, (900, 4)).astype(float)
    hashed = [r[0] for r in spark.range(900).orderBy("id").select(F.xxhash64("id")).collect()]
    late = np.argsort(np.argsort(hashed)) >= 300
    y = (x[:, 0] > 9) + 2 * late.astype(int)
    x[:, 3] = late * 10.0
    fold = np.arange(900) % 3
    g = B.Growth(rounds=3, rate=0.5, leaves=6, least_rows=5, bins=32, features=1.0)
    df = table(spark, x, y, fold).withColumn("is_late", (F.col("cell_type") >= 2).cast("int"))
    got = B.fit_folds(df, [0, 2], {"all": (range(4), "cell_type"), "late": ([0, 1], "is_late")}, g=g)
    assert set(got) == {0, 2} and set(got[0]) == {"all", "late"}
    for k in (0, 2):
        assert (got[k]["all"].predict(x).argmax(1) == y).all() and (got[k]["late"].predict(x).argmax(1) == late).all()
        kinds, counts = np.unique(y[fold != k], return_counts=True)
        held = np.where(fold != k)[0]
        valid = np.array([hashed[i] % 8 == 0 for i in held])
        weight = np.minimum(len(held) / (4 * counts), 5.0)[np.searchsorted(kinds, y[held])]
        own = B.fit(x[held], y[held], range(4), weight, valid, g)
        assert np.allclose(got[k]["all"].base, own.base) and np.allclose(got[k]["all"].predict(x), own.predict(x), atol=1e-6)
    in_task = B.fit_folds(df.where("cell_id < 150"), [0], {"all": (range(4), "cell_type")}, g=g)[0]["all"]
    assert len(in_task.rounds)
