import duckdb
import pandas as pd
import pytest

from siftstone.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries.queries()[name](spark, sf).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    names = sorted(want.columns)
    assert sorted(got.columns) == names

    def rows(df):
        return sorted((tuple(None if pd.isna(v) else str(v) for v in r) for r in df[names].astype(object).itertuples(index=False)), key=str)

    assert rows(got) == rows(want)
