"""Every query against its SQL on the smallest tables."""

import math

import pandas as pd
import pytest

import __spark_entry__ as entry
from tissuemill.plans import catalog


def canonical(value):
    if value is None or value is pd.NA or isinstance(value, float) and math.isnan(value):
        return None
    if hasattr(value, "tolist"):
        value = value.tolist()
    return round(float(value), 5) + 0.0 if isinstance(value, (int, float)) and not isinstance(value, bool) else value


def rows(df):
    names = sorted(df.columns)
    return sorted((tuple(canonical(v) for v in r) for r in df[names].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(name, spark, duck, data):
    got = catalog.queries()[name](spark, data).toPandas()
    expected = duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    a, b = rows(got), rows(expected)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            assert u == v or isinstance(u, float) and isinstance(v, float) and abs(u - v) <= 2e-5


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_chosen_genes_are_found_once(spark, data):
    """Markers and variable genes are not computed anew for each question about them."""
    import __spark_entry__ as entry

    union, first = (entry.queries()[name](spark, data) for name in ("hvg_union", "first_genes"))
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (union, first)]
    assert all("Window" not in plan for plan in plans) and union.count() and {r[0] for r in first.select("chosen").distinct().collect()} == {"markers", "first"}
