"""The inverted file against all pairs."""

import numpy as np
import pytest

from tissuemill.operators import neighbours as N


def frame(spark, x, start=0):
    return spark.createDataFrame([(start + i, i % 3, [float(v) for v in r]) for i, r in enumerate(x)], "cell_id long, cell_type int, f array<double>").repartition(3)


def brute(q, x, k, metric, q_start=0):
    out = set()
    for i, v in enumerate(q):
        if metric == "cosine":
            n = np.linalg.norm(x, axis=1) * np.linalg.norm(v)
            d = np.round(1 - np.where(n > 0, x @ v / np.where(n > 0, n, 1), 0), 6)
        else:
            d = np.round(np.sqrt(((x - v) ** 2).sum(1)), 6)
        for rank, at in enumerate(np.lexsort((np.arange(len(x)), d))[:k], 1):
            out.add((q_start + i, int(at), int(at) % 3, float(d[at]), rank))
    return out


def rows(found):
    return {(r["query"], r["neighbour"], r["label"], round(r["distance"], 6), r["rank"]) for r in found.collect()}


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_exact_search_equals_all_pairs(spark, monkeypatch, metric):
    """Cells in parts, asked by several tasks, zero vectors and repeated rows."""
    monkeypatch.setattr(N, "CELL_ROWS", 25)
    monkeypatch.setattr(N, "ASKED_ROWS", 10)
    rng = np.random.default_rng(8)
    x = np.round(np.vstack((rng.normal(0, 1, (120, 4)), rng.normal(6, 0.3, (120, 4)), np.zeros((3, 4)), np.ones((40, 4)))), 3)
    q = np.vstack((x[::9], rng.normal(3, 2, (20, 4)), np.zeros((1, 4))))
    index = N.build(frame(spark, x), metric)
    for probes in (1, 4):
        assert rows(N.search(frame(spark, q, 1000), index, 7, probes, digits=6)) == brute(q, x, 7, metric, 1000)


def test_few_rows_and_empty_sides(spark):
    x = np.eye(3)
    assert rows(N.search(frame(spark, x), N.build(frame(spark, x), "euclidean"), 10, digits=6)) == brute(x, x, 10, "euclidean")
    none = frame(spark, x).where("cell_id < 0")
    assert N.search(frame(spark, x), N.build(none), 3).count() == 0
    assert N.search(none, N.build(frame(spark, x)), 3).count() == 0


def test_recall_of_the_nearest_cells(spark):
    """Queries with an id divisible by 50, 16 of 63 cells: recall of the 15 nearest at least 0.9."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (40, 16))
    x = centres[rng.integers(0, 40, 4000)] + rng.normal(0, 0.35, (4000, 16))
    index = N.build(frame(spark, x), "euclidean")
    got = {(a, b) for a, b, *_ in rows(N.search(frame(spark, x).where("cell_id % 50 = 0"), index, 16, 16, exact=False, digits=6))}
    expected = {(50 * a, b) for a, b, *_ in brute(x[::50], x, 16, "euclidean")}
    assert len(got & expected) / len(expected) >= 0.9


def test_exact_search_by_blocks(spark, monkeypatch):
    """Several blocks and copies, a large group of copies far from the origin; memory of a task does not grow with cells asked."""
    monkeypatch.setattr(N, "SCAN_ROWS", 60)
    monkeypatch.setattr(N, "SCAN_COLUMNS", 16)
    monkeypatch.setattr(N, "SCAN_BATCH", 8)
    rng = np.random.default_rng(2)
    x = np.round(np.vstack((rng.normal(0, 1, (150, 8)), np.full((90, 8), 1000.5))), 3)
    for metric in ("cosine", "euclidean"):
        got = N.search(frame(spark, x[::3], 1000), N.build(frame(spark, x), metric), 7, 2, digits=6)
        assert rows(got) == brute(x[::3], x, 7, metric, 1000)


def test_equal_rows_have_distance_zero():
    """By the expanded square two equal rows far from the origin lie about 1e-6 apart."""
    x = np.array([[12345.678, 9876.543, 1111.111]])
    row, column, d = N.within(x, np.array([np.inf]), np.vstack((x, x + 1)), 2, "euclidean", 9)
    assert d[0] == 0 and column.tolist() == [0, 1]


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("scale,single", [(1.0, True), (1e-3, True), (1e25, False)])
def test_products_of_single_precision_lose_no_pair(metric, scale, single):
    """Near ties, which single precision cannot order, around the k-th distance; far from the origin double precision is used."""
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (900, 16))
    x = np.vstack((x, x[:300] + rng.normal(0, 1e-8, (300, 16)), x[:300])) * (scale if metric == "euclidean" and scale < 1e9 else 1.0)
    if scale > 1e9:
        x = x * 1e-3 + 100
    q, v = (N.prepared(a, metric, side) for side, a in ((1, x[::7]), (0, x)))
    exact = np.array([N.pair_distances(np.tile(row, (len(v), 1)), v, metric, 9) for row in q])
    reach = np.sort(exact, axis=1)[:, 9] + 1e-6
    if scale != 1e-3:
        assert N.single_precision(q, N.block_of(v, metric), reach, metric)[0] == single
    for limit in (reach, np.where(np.arange(len(q)) % 3, reach, np.inf)):
        row, column, d = N.within(q, limit, v, 7, metric, 9)
        want = N.nearest(exact, 7)
        assert (column.reshape(len(q), 7) == want).all() and (d.reshape(len(q), 7) == np.take_along_axis(exact, want, 1)).all()
