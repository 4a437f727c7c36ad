"""Every query with SQL gives the same rows as DuckDB; the others give rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from habitat_spark import queries as own

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def rows(values, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    plain = lambda v: v if v is None or isinstance(v, (str, bool)) else float(v) + 0.0
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(own.ORACLE))
def test_same_as_sql(spark, duck, name):
    df = own.QUERIES[name](spark, SMALL)
    want = duck.sql(own.ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", ["fit_glm", "fit_rf", "fit_gam", "bootstrap_evaluation", "boxcox", "yeojohnson", "ftle", "fsle", "project_months", "fit_cauchit", "fit_log_link", "smooth_terms", "smooth_terms_reml", "pipeline_run"])
def test_rows(spark, name):
    assert own.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
