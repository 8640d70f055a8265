"""Every registered query with SQL gives DuckDB's rows on the smallest tables; the others run."""

import os

import duckdb
import pandas as pd
import pytest

from recfeat.plans import registry

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item") and getattr(v, "ndim", 0) == 0:
        v = v.item()
    if isinstance(v, (int, float)):
        return round(float(v), 6)
    return str(v)


def compare(spark, run, sql, folder):
    with duckdb.connect() as db:
        for t in TABLES:
            p = f"{folder}/{t}.parquet"
            db.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
        want = db.execute(sql).df()
    got = run(spark, folder).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    got, want = (sorted((tuple(map(plain, r)) for r in d[sorted(d.columns)].itertuples(index=False)), key=repr) for d in (got, want))
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == b


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    compare(spark, registry.queries()[name], registry.oracle_sql()[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SMALL).count() > 0
