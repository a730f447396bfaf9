"""Every bar query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tidemark.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for t in ("lineitem", "events"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), db.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    frames = []
    for df in (got, want):
        df = df[sorted(df.columns)].copy()
        for c in df.columns:
            if c == "date" or c.endswith("_date"):
                df[c] = pd.to_datetime(df[c]).astype("datetime64[ns]")
        frames.append(df.sort_values([c for c in df.columns if df[c].dtype.kind != "f"]).reset_index(drop=True))
    pd.testing.assert_frame_equal(*frames, check_dtype=False, atol=2e-6, rtol=1e-9)
