"""Every registered query against its DuckDB counterpart on the smallest tables."""

import math
import os

import duckdb
import pytest

from kgloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(df):
    def plain(v):
        if v is None or str(v) == "<NA>" or v != v:
            return None
        v = v.item() if hasattr(v, "item") else v
        return round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_oracle(name, spark, sf_dir, duck):
    got, want = catalog.queries()[name](spark, sf_dir).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert all(all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, abs_tol=1e-9) for x, y in zip(p, q)) for p, q in zip(a, b))


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["precision", "recall", "f1", "tp", "fp", "fn"]
