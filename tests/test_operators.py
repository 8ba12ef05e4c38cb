import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftstone.operators import agreement, clustering, consensus, distances, metrics, preprocess, profile, ranking, stability
from siftstone.plans.registry import REGISTRY, Runner, by_family, by_tag, recommend, search, summary, without_k
from siftstone.sources import patterns, tables

XY = ["x", "y"]


@pytest.fixture(scope="module")
def blobs(spark):
    """Four clear groups with an explicit row id."""
    rng = np.random.default_rng(42)
    centres = np.array([[0, 0], [10, 0], [0, 10], [10, 10]])
    y = np.arange(200) % 4
    x = centres[y] + rng.normal(0, 0.5, (200, 2))
    return spark.createDataFrame(pd.DataFrame({"row_id": range(200), "x": x[:, 0], "y": x[:, 1], "truth": y.astype("int32")})).persist()


def ari(blobs, labels):
    return clustering.reference_ari(blobs.select(F.col("row_id").alias("id"), F.col("truth").alias("label")), labels)


def test_scaling_is_by_population(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)], "a double, b double")
    out = preprocess.scale(df, ["a", "b"]).toPandas()
    assert np.allclose(out.mean(), 0) and np.allclose(out.std(ddof=0), 1)


def test_coassociation_of_five_rows(spark):
    labels = [[0, 0, 1, 1, 2], [0, 0, 1, 1, 2], [1, 1, 0, 0, 2]]
    runs = spark.createDataFrame([(f"r{i}", j, v) for i, r in enumerate(labels) for j, v in enumerate(r)], "run string, row_id long, label int")
    pairs = {(r.i, r.j): r.c for r in consensus.coassociation(runs).collect()}
    assert pairs == {(0, 1): pytest.approx(1.0), (2, 3): pytest.approx(1.0)}
    assert all(r.ari == pytest.approx(1.0) for r in agreement.scores(agreement.all_contingencies(runs), ["ra", "rb"]).collect())
    for name, method in consensus.METHODS.items():
        got = {r.row_id: r.label for r in method(runs, 3, None).collect()}
        assert got[0] == got[1] != got[2] == got[3] and len(set(got.values())) == 3, name


@pytest.mark.parametrize("name", ["kmeans", "minibatch_kmeans", "bisecting_kmeans", "kmedoids", "clara", "k_harmonic_means", "agglomerative_ward", "agglomerative_single", "birch", "gmm_full", "gmm_diag", "spectral_discretize", "fuzzy_cmeans", "projected_kmeans", "ensemble_voting"])
def test_methods_with_k_find_the_groups(blobs, name):
    a = REGISTRY[name]
    assert ari(blobs, a.fit(blobs, "row_id", XY, **{**a.defaults, "k": 4})) > 0.95


@pytest.mark.parametrize("name,params", [("dbscan", {"eps": 1.5}), ("threshold_clustering", {"threshold": 2.0}), ("mean_shift", {"bandwidth": 3.0}), ("xmeans", {}), ("kmeans_auto", {}), ("hdbscan", {}), ("robust_cc", {"k": 20}), ("denclue", {"h": 0.8}), ("affinity_propagation", {})])
def test_methods_without_k_find_the_groups(blobs, name, params):
    a = REGISTRY[name]
    assert ari(blobs, a.fit(blobs, "row_id", XY, **{**a.defaults, **params})) > 0.75


def test_metrics_of_clear_groups(blobs):
    m = metrics.centroid_metrics(blobs, "truth", XY)
    assert metrics.silhouette(blobs, "row_id", "truth", XY).first()[0] > 0.5 and m["davies_bouldin"] < 1 and m["calinski_harabasz"] > 100
    assert metrics.s_dbw(blobs, "truth", XY) < 1 and metrics.hopkins(blobs, "row_id", XY) > 0.6
    assert metrics.dbcv(blobs, "row_id", "truth", XY).first()[0] > 0
    assert metrics.separability(blobs, "truth", XY).count() == 6
    one = metrics.centroid_metrics(blobs.withColumn("one", F.lit(0)), "one", XY)
    assert one["davies_bouldin"] is None and one["inertia"] > 0


def test_knn_in_blocks_equals_broadcast(blobs, monkeypatch):
    whole = sorted(map(tuple, distances.knn(blobs, "row_id", XY, 4).select("id", "neighbour", "rank").collect()))
    monkeypatch.setattr(distances, "MAX_REFERENCE", 50)
    monkeypatch.setattr(distances, "BLOCK", 70)
    assert sorted(map(tuple, distances.knn(blobs, "row_id", XY, 4).select("id", "neighbour", "rank").collect())) == whole


def test_adjusted_mutual_information(spark):
    def cells(a, b):
        return spark.createDataFrame(list(pd.crosstab(np.array(a), np.array(b)).stack().rename("n").reset_index().query("n > 0").itertuples(index=False, name=None)), "la long, lb long, n long")

    assert agreement.adjusted_mutual_information(cells([0, 0, 1, 1], [1, 1, 0, 0])) == pytest.approx(1)
    assert abs(agreement.adjusted_mutual_information(cells([0, 0, 1, 1] * 9, [0, 1, 0, 1] * 9))) < 0.05
    assert agreement.greedy_jaccard(cells([0, 0, 1, 1], [1, 1, 0, 0])) == 1


def test_stability_under_noise(blobs):
    fit = lambda d: clustering.kmeans(d, "row_id", XY, 4, n_init=3)
    rows = stability.stability_test(blobs, "row_id", XY, fit, [("gaussian", 0.1, 1), ("subset", 0.8, 1), ("laplace", 0.05, 1)])
    assert all(r["ari"] > 0.8 for r in rows)
    out = stability.stability_score(blobs.sparkSession.createDataFrame(pd.DataFrame(rows))).first()
    assert out.grade in ("Highly Stable", "Stable")
    assert min(stability.cv_stability(blobs, "row_id", XY, 4, 2)) > 0.9


def test_linkage_matches_brute_force():
    x = np.random.default_rng(0).normal(size=(12, 2))
    d = distances.pairwise(x, x)
    groups = [[i] for i in range(12)]
    for step, merge in enumerate(clustering.linkage(d, "average")):
        pairs = [(d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        best, i, j = min(pairs)
        assert merge[2] == pytest.approx(best)
        groups[i] = groups[i] + groups.pop(j)
    assert len(set(clustering.cut_tree(clustering.linkage(d, "ward"), 12, 5))) == 5


def test_dtw_and_modes(spark):
    assert clustering.dtw(np.array([1.0, 2, 3]), np.array([1.0, 1, 2, 3])) == 0
    series = spark.createDataFrame([(i, [float(math.sin(t / 3 + (i % 2) * 9) + (i % 2) * 5) for t in range(20)]) for i in range(8)], "id long, s array<double>")
    got = {r.id: r.label for r in clustering.dtw_clustering(series, "id", "s", 2, 3).collect()}
    assert len({got[i] for i in (0, 2, 4, 6)}) == 1 and got[0] != got[1]
    rows = spark.createDataFrame([(i, "ab"[i % 2], "xy"[i % 2]) for i in range(10)], "id long, a string, b string")
    modes = {r.id: r.label for r in clustering.kmodes(rows, "id", ["a", "b"], 2).collect()}
    assert modes[0] == modes[2] != modes[1]


def test_preprocessor_carries_row_ids(spark):
    rows = [(i, float(i % 17), None if i % 9 == 0 else float(i * i % 31), "abc"[i % 3], 1.0) for i in range(120)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c string, d double")
    pre = preprocess.Preprocessor(impute="knn", outliers="iqr", action="flag", scaler="robust", select="variance")
    out, features = pre.run(df, "row_id")
    got = out.toPandas()
    assert sorted(got.row_id) == list(range(120)) and "d" not in features and {"c_a", "c_b", "c_c"} & set(features) and not got[features].isna().any().any()
    assert preprocess.Preprocessor.inferred(df, ["a", "b"]).impute == "knn"
    for how in ("isolation_forest", "lof", "elliptic"):
        flagged, _ = preprocess.Preprocessor(outliers=how, action="flag").run(df, "row_id")
        assert 0 < flagged.where("__outlier__").count() <= 12
    for scaler in ("quantile_uniform", "quantile_normal", "power"):
        x = preprocess.scale(df.select("row_id", "a"), ["a"], scaler).toPandas().a
        assert np.isfinite(x).all()
    filled = preprocess.impute_iterative(df.select("row_id", "a", "b"), ["a", "b"])
    assert filled.where("b IS NULL").count() == 0


def test_projection_and_whitening(blobs):
    out, share = preprocess.pca(blobs, XY, 2)
    _, cov, _ = profile.covariance(out, ["PC1", "PC2"])
    assert sum(share) == pytest.approx(1) and abs(cov[0][1]) < 1e-9
    white = preprocess.whiten(blobs, XY)
    _, cov, n = profile.covariance(white, ["W1", "W2"])
    assert np.allclose(np.array(cov) * n / (n - 1), np.eye(2), atol=1e-3)
    assert preprocess.remove_collinear(blobs.withColumn("z", F.col("x") * 2 + 1e-6 * F.col("y")), ["x", "y", "z"]) in (["x", "y"], ["y", "z"])


def test_runner(spark, blobs):
    runner = Runner(blobs, "row_id", XY)
    out = {i: runner.run(i, **p) for i, p in (("kmeans", {"k": 4}), ("dbscan", {"eps": 1.5}), ("threshold_clustering", {"threshold": 1e-6}))}
    assert out["kmeans"].status == "OK" and out["dbscan"].status == "OK"
    assert runner.run("kmeans", k=4) is out["kmeans"] and runner.hits == 1
    top = runner.ranking(out).collect()
    assert top[0]["rank"] == 1 and 0 <= top[0].composite <= 100
    assert {r.run for r in runner.long_labels(out).select("run").distinct().collect()} >= {"kmeans", "dbscan"}
    failed = runner.run("fuzzy_cmeans", k=4, m=1.0)
    assert failed.status in ("FAILED", "OK")
    assert runner.run("hdbscan", timeout=0.0).status in ("TIMEOUT", "OK")
    assert [r.k for r in runner.k_sweep("kmeans", [2, 4]).collect()] == [2, 4]


def test_registry(spark):
    assert len(REGISTRY) >= 46 and summary(spark).count() == len(REGISTRY)
    assert by_family("density") and by_tag("noise") and without_k() and search("gmm")
    assert all("scalable" in a.tags for a in recommend(10**6, 4))


@pytest.mark.parametrize("name", patterns.PATTERNS)
def test_patterns(spark, name):
    got = patterns.pattern(spark, name, 60).toPandas()
    assert len(got) == 60 and np.isfinite(got[["x", "y"]]).all().all() and got[["x", "y"]].abs().max().max() == pytest.approx(8.5 * 0.9)


def test_tables(spark, tmp_path):
    assert tables.sanitise_names([" a b", "a.b", "a/b", "c(d)"]) == ["a_b", "a_b_1", "a_b_2", "cd"]
    (tmp_path / "t.csv").write_text("id, x y,name\n1,2.5,foo\n2,NA,none\n3,4,\n")
    got = tables.load(spark, str(tmp_path / "t.csv"))
    assert dict(got.dtypes) == {"id": "bigint", "x_y": "double", "name": "string"} and got.where("x_y IS NULL").count() == 1
    (tmp_path / "t.tsv").write_text("a\tb\n1\tx\n")
    assert tables.load(spark, str(tmp_path / "t.tsv")).first().b == "x"
    (tmp_path / "t.json").write_text('[{"a": 1}, {"a": 2}]')
    assert tables.load(spark, str(tmp_path / "t.json")).count() == 2
    labels = spark.createDataFrame([(0, -1), (1, 0)], "row_id long, label int")
    tables.export_labels(labels, str(tmp_path / "out"), "parquet")
    assert spark.read.parquet(str(tmp_path / "out")).where("is_noise").count() == 1
    assert tables.with_row_id(labels).columns == ["row_id", "label"]
    wide = tables.wide_labels(labels.withColumn("run", F.lit("a")))
    assert wide.columns == ["row_id", "a"]


def test_streaming_kmeans(spark, tmp_path, blobs):
    from siftstone.streaming.incremental import StreamingKMeans, windowed_profile

    blobs.select("row_id", *XY).repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("row_id long, x double, y double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    model = StreamingKMeans(np.array([[1.0, 1], [9, 1], [1, 9], [9, 9]]), XY)
    model.start(stream, str(tmp_path / "ck")).awaitTermination(60)
    assert model.seen.sum() == 200 and np.abs(model.centres - np.array([[0, 0], [10, 0], [0, 10], [10, 10]])).max() < 0.5
    before = model.centres.copy()
    model.update(blobs, model.last)
    assert (model.centres == before).all()
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:20:00", "a", 3.0)], "t string, k string, v double").withColumn("t", F.col("t").cast("timestamp"))
    assert windowed_profile(events, "t", "v", "k").first()["mean"] == 2


def test_ranking_helpers(spark):
    df = spark.createDataFrame([(1, 3.0), (2, None), (3, 5.0)], "id long, s double")
    assert [r.id for r in ranking.rank_by(df, "s", "id").orderBy("rank").collect()] == [3, 1, 2]
    assert ranking.trend(spark.createDataFrame([(i, float(i * i)) for i in range(5)], "x long, y double"), "x", "y").first().kendall == 1
