import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tissuemill.functions import vectors as V
from tissuemill.operators import classify as C
from tissuemill.operators import expression as X
from tissuemill.operators import qc as Q


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    values = [[float(x) for x in rng.normal(0, 1, 5)] for _ in range(60)] + [[0.0] * 5, [1.0, 0.0, 0.0, 0.0, 0.0], [0.2] * 5]
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v array<double>")


def project(v):
    u = np.sort(v)[::-1]
    theta = max((u[: k + 1].sum() - 1) / (k + 1) for k in range(len(u)))
    return np.maximum(v - theta, 0)


def test_simplex_rows_sum_to_one_and_projection_is_idempotent(vectors):
    once = vectors.select("v", V.simplex(F.col("v")).alias("p"))
    for v, p, q in once.select("v", "p", V.simplex(F.col("p")).alias("q")).collect():
        assert np.allclose(p, project(np.array(v))) and np.isclose(sum(p), 1) and min(p) >= 0 and np.allclose(p, q)


def test_helmert_basis_is_orthonormal():
    for k in (2, 5, 9):
        h = V.helmert(k)
        assert np.allclose(h.T @ h, np.eye(k - 1)) and np.allclose(h.sum(0), 0)


def test_ilr_round_trip(vectors):
    p = vectors.select(V.softmax(F.col("v")).alias("p"))
    for a, b in p.select("p", V.ilr_inverse(V.ilr(F.col("p"), 5), 5).alias("q")).collect():
        assert np.allclose(a, b, atol=1e-9) and np.isclose(sum(a), 1)


def test_vote_truth_table(spark):
    labels = ["a", "b", "c", None]
    cases = list(itertools.product(labels, repeat=3))
    got = spark.createDataFrame(cases, "x string, y string, z string").select("x", "y", "z", V.vote3(F.col("x"), F.col("y"), F.col("z")).alias("w")).collect()
    for x, y, z, w in got:
        votes = [v for v in (x, y, z) if v is not None]
        twice = [v for v in votes if votes.count(v) >= 2]
        assert w == (twice[0] if twice else x)


@pytest.mark.parametrize("q", [0.0, 0.25, 0.9, 0.995, 1.0])
def test_sparse_quantile_counts_the_zeros(spark, q):
    rng = np.random.default_rng(5)
    dense = np.where(rng.random((20, 37)) < 0.4, rng.integers(1, 50, (20, 37)), 0).astype(float)
    long = [(g, float(v)) for g in range(20) for v in dense[g] if v]
    up = dict(X.sparse_quantile(spark.createDataFrame(long, "gene long, value double"), "gene", 37, q).collect())
    for g, u in up.items():
        assert np.isclose(u, np.quantile(dense[g], q))


def test_metrics_of_equal_labels(spark):
    one = C.metrics(C.confusion(spark.createDataFrame([(i % 3, i % 3) for i in range(30)], "t int, p int"), "t", "p")).first()
    assert all(np.isclose(v, 1) for v in one)


def test_split_masks_and_coerce(spark):
    df = spark.createDataFrame([("UNK",), (" unknown ",), ("",), ("nan",), (None,), ("T",)], "label string")
    assert [r.is_test for r in Q.split_masks(df, "label").collect()] == [True] * 5 + [False]
    assert all(r.is_test for r in Q.split_masks(df, "absent").collect())
    assert [r[0] for r in spark.createDataFrame([("1.5",), ("x",), (None,), ("NaN",)], "v string").select(Q.coerce(F.col("v"))).collect()] == [1.5, 0, 0, 0]


def test_batch_robust_leaves_a_lone_class(spark):
    pb = spark.createDataFrame([("s1", "a", 1, 2.0), ("s2", "a", 1, 1.0), ("s2", "b", 1, 3.0)], "sample string, cell_type string, gene long, m double")
    got = {r.cell_type: r.score for r in X.batch_robust_contrast(pb).collect()}
    assert np.isclose(got["a"], (2.0 - 1.0) / 2 - 1.0) and np.isclose(got["b"], 1.0 - 0.5)


def test_numeric_features_needs_a_number(spark):
    with pytest.raises(ValueError):
        Q.numeric_features(spark.createDataFrame([("a",)], "x string"))
