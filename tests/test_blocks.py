"""Pairwise operators give the same rows by blocks as by a broadcast reference."""

import numpy as np
import pandas as pd
import pytest

from siftstone.operators import clustering, distances, metrics, preprocess

XY = ["x", "y"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    y = np.arange(150) % 3
    x = np.array([[0, 0], [6, 0], [0, 6]])[y] + rng.normal(0, 1, (150, 2))
    return spark.createDataFrame(pd.DataFrame({"row_id": range(150), "x": x[:, 0], "y": x[:, 1], "label": y.astype("int32")})).persist()


def _gaps(rows):
    return rows.selectExpr("row_id", "IF(row_id % 7 = 0, NULL, x) AS x", "IF(row_id % 11 = 3, NULL, y) AS y", "x + y AS z")


CASES = {
    "silhouette_samples": lambda r: metrics.silhouette_samples(r, "row_id", "label", XY),
    "silhouette": lambda r: metrics.silhouette(r, "row_id", "label", XY),
    "dunn": lambda r: metrics.dunn(r, "row_id", "label", XY),
    "dbcv": lambda r: metrics.dbcv(r, "row_id", "label", XY),
    "kernel_density": lambda r: clustering.kernel_density(r, "row_id", XY, 0.5),
    "denclue": lambda r: clustering.denclue(r, "row_id", XY, h=0.8),
    "knn": lambda r: distances.knn(r, "row_id", XY, 4),
    "impute_knn": lambda r: preprocess.impute_knn(_gaps(r), "row_id", ["x", "y", "z"]),
}


@pytest.mark.parametrize("name", CASES)
def test_blocks_match_broadcast(rows, monkeypatch, name):
    whole = CASES[name](rows).toPandas()
    monkeypatch.setattr(distances, "MAX_REFERENCE", 40)
    monkeypatch.setattr(distances, "BLOCK", 40)
    parts = CASES[name](rows).toPandas()
    by = list(whole.columns)[:2]
    whole, parts = (t.sort_values(by, ignore_index=True) for t in (whole, parts))
    pd.testing.assert_frame_equal(whole, parts, check_exact=False, rtol=1e-9)
    assert not whole.isna().any().any()
