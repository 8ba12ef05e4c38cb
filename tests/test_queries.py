import os

import duckdb
import pandas as pd
import pytest

from siftstone.plans import queries as q

#: Queries that take seconds are left to the driver's comparison.
SLOW = set("pattern_catalogue sample_datasets silhouette_interval metric_s_dbw gmm_step kmeans_inertia perturb_gaussian perturb_laplace outliers_clip impute_knn stability_radar".split())
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def tidy(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    rows = [tuple(None if v is None or v != v else round(float(v), 5) + 0.0 if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False)]
    return sorted(rows, key=str)


@pytest.mark.parametrize("name", sorted(set(q.SQL) - SLOW))
def test_query_matches_sql(spark, sf, duck, name):
    got, want = q.QUERIES[name](spark, sf).toPandas(), duck.sql(q.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert tidy(got) == tidy(want)
