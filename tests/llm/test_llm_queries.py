import duckdb
import numpy as np
import pytest

from pointweave.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_like_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns and len(got) == len(want)
    a, b = (x[columns].astype(object).where(x[columns].notna(), None).sort_values(columns[:3]).reset_index(drop=True) for x in (got, want))
    by = next(([c] for c in ("page_id", "doc_id") if c in columns), columns)
    a, b = a.sort_values(by).reset_index(drop=True), b.sort_values(by).reset_index(drop=True)
    for c in columns:
        assert np.array_equal(a[c].to_numpy(), b[c].to_numpy()), c
