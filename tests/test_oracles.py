"""Every core query that SQL can express agrees with DuckDB."""

import duckdb
import pandas as pd
import pytest

from larkspur.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _rows(df):
    def plain(v):
        return None if pd.isna(v) else str(v)[:19] if hasattr(v, "year") else v

    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, sf_dir, name):
    ours, theirs = registry.queries()[name](spark, sf_dir).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    for a, b in zip(_rows(ours), _rows(theirs), strict=True):
        assert a == pytest.approx(b, abs=2e-6) if all(isinstance(v, int | float) for v in (*a, *b)) else a == b
