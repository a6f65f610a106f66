import duckdb
import numpy as np
import pytest

import __spark_entry__
from pointweave import queries

SF = "/root/testdata/sf0.001"
TABLES = "embeddings events lineitem".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_like_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns and len(got) == len(want)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    for c in columns:
        assert np.array_equal(a[c].to_numpy(), b[c].to_numpy()), c


@pytest.mark.parametrize("name", [q for q in queries.QUERIES if q not in queries.ORACLES])
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 500
    found = __spark_entry__.queries()
    assert set(queries.QUERIES) <= set(found) and set(__spark_entry__.oracle_sql()) <= set(found)


def test_known_energies(spark):
    """Values found by an independent reckoning."""
    row = queries.QUERIES["energy_hoppe"](spark, "/root/testdata/sf0.01").first()
    assert row.edges == 1705 and row.energy == pytest.approx(277.250024, abs=1e-6)
    row = queries.QUERIES["energy_hoppe"](spark, "/root/testdata/sf0.1").first()
    assert row.edges == 7285 and row.energy == pytest.approx(1479.437723, abs=1e-6)
