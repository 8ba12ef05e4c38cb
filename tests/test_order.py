"""Row numbers, running sums and quantiles without one task; joins by distance in cells."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftstone.operators import clustering, distances, order, preprocess


def test_numbers_and_running_sums(spark):
    rng = np.random.default_rng(0)
    rows = pd.DataFrame({"id": range(500), "k": rng.integers(0, 3, 500), "v": rng.integers(0, 50, 500)})
    df = spark.createDataFrame(rows).repartition(7)
    got = order.numbered(df, [F.desc("v"), "id"], "r").toPandas().sort_values("r")
    want = rows.sort_values(["v", "id"], ascending=[False, True])
    assert got.id.tolist() == want.id.tolist() and got.r.tolist() == list(range(1, 501))
    summed = order.running_sum(df, ["k"], ["v", "id"], F.col("v"), "s").toPandas().set_index("id").s
    want = rows.sort_values(["v", "id"]).groupby("k").v.cumsum()
    assert (summed.loc[rows.id].to_numpy() == want.sort_index().to_numpy()).all()
    assert order.numbered(df.limit(0), ["id"]).count() == 0


@pytest.mark.parametrize("fetch", [100_000, 20])
def test_quantiles_match_numpy(spark, monkeypatch, fetch):
    monkeypatch.setattr(order, "FETCH", fetch)
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"a": rng.normal(size=900), "b": rng.integers(0, 4, 900).astype(float), "c": np.exp(12 * rng.normal(size=900)), "d": [None] * 900, "e": [1.5] * 900})
    rows.loc[::7, "a"] = np.nan
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    at = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = order.quantiles(df, list("abcde"), at)
    for c in "abce":
        assert got[c] == pytest.approx(np.nanquantile(rows[c].to_numpy(float), at).tolist())
    assert got["d"] == [None] * len(at)


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 10)) + 6 * rng.integers(0, 2, (400, 1))
    x[300:320] = x[:20]  # repeated rows
    f = [f"f{i}" for i in range(10)]
    return spark.createDataFrame(pd.DataFrame(x, columns=f).reset_index(names="row_id")).persist(), f, x


@pytest.fixture
def cells(monkeypatch):
    monkeypatch.setattr(distances, "MAX_REFERENCE", 60)
    monkeypatch.setattr(distances, "BLOCK", 40)


def test_distances_are_exact_for_equal_and_near_rows():
    x = np.random.default_rng(3).normal(size=(50, 12)) + 1e4
    x[1] = x[0]
    x[2] = x[0] + 1e-7
    want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    got = distances.pairwise(x, x)
    assert got[0, 1] == 0 and got[0, 2] == pytest.approx(want[0, 2], rel=1e-9) and np.allclose(got, want, rtol=1e-9)


def test_neighbours_in_cells_match_all_pairs(wide, cells):
    df, f, x = wide
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    want = {i: sorted((d[i, j], j) for j in range(400) if j != i)[:5] for i in range(400)}
    got = {}
    for r in distances.knn(df, "row_id", f, 5).collect():
        got.setdefault(r.id, []).append((r.distance, r.neighbour, r["rank"]))
    for i, near in want.items():
        assert [v[1] for v in sorted(got[i], key=lambda v: v[2])] == [j for _, j in near]


def test_radius_and_density_in_cells_match_all_pairs(wide, cells):
    df, f, x = wide
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    pairs = {(r.id, r.neighbour) for r in distances.radius_pairs(df, "row_id", f, 2.5).collect()}
    assert pairs == {(i, j) for i, j in zip(*np.nonzero(d <= 2.5), strict=True) if i != j}
    core = (d <= 2.5).sum(axis=1) >= 6
    comp = np.arange(400)
    while True:
        new = np.array([min(comp[j] for j in range(400) if core[j] and d[i, j] <= 2.5) if core[i] else comp[i] for i in range(400)])
        if (new == comp).all():
            break
        comp = new
    first = [comp[i] if core[i] else min((comp[j] for j in range(400) if core[j] and d[i, j] <= 2.5), default=-1) for i in range(400)]
    names = {v: k for k, v in enumerate(sorted({v for v in first if v >= 0}))}
    got = {r.id: r.label for r in clustering.dbscan(df, "row_id", f, 2.5, 6).collect()}
    assert [got[i] for i in range(400)] == [names.get(v, -1) for v in first]


def test_inferred_preprocessing_of_a_table_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(distances, "MAX_REFERENCE", 200)
    monkeypatch.setattr(distances, "BLOCK", 100)
    df = spark.range(500).select(F.col("id").alias("row_id"), F.when(F.col("id") % 5 > 0, F.col("id") % 37).cast("double").alias("a"), F.when(F.col("id") % 7 > 0, F.col("id") % 11).cast("double").alias("b"))
    pre = preprocess.Preprocessor.inferred(df, ["a", "b"])
    assert pre.impute == "knn" and pre.most_correlation == 0.90
    out, features = pre.run(df, "row_id")
    assert out.count() == 500 and out.where(" OR ".join(f"{f} IS NULL" for f in features)).count() == 0
