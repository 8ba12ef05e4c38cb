"""Runner services, streams that restart, and clustering methods with parts of their own."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftstone.operators import clustering, consensus, metrics, preprocess, stability
from siftstone.plans import registry
from siftstone.plans.registry import Algorithm, History, IncrementalRunner, REGISTRY, Runner

XY = ["x", "y"]


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(42)
    centres = np.array([[0, 0], [10, 0], [0, 10], [10, 10]])
    y = np.arange(160) % 4
    x = centres[y] + rng.normal(0, 0.5, (160, 2))
    return spark.createDataFrame(pd.DataFrame({"row_id": range(160), "x": x[:, 0], "y": x[:, 1], "truth": y.astype("int32")})).persist()


def ari(blobs, labels):
    return clustering.reference_ari(blobs.select(F.col("row_id").alias("id"), F.col("truth").alias("label")), labels)


@pytest.mark.parametrize("name", ["spectral_cluster_qr", "repeated_bisecting", "online_gmm", "som_clustering"])
def test_methods_find_the_groups(blobs, name):
    a = REGISTRY[name]
    params = {**a.defaults, "rows": 2, "cols": 2} if name == "som_clustering" else {**a.defaults, "k": 4}
    assert ari(blobs, a.fit(blobs, "row_id", XY, **params)) > 0.9


def test_bayesian_mixture(blobs):
    """Components without rows get next to no weight; those that rows keep may still split a group."""
    w = clustering._stick_weights(np.array([100.0, 0.0, 50.0, 0.0]), 0.1)
    assert w[0] > w[2] > 0.2 and w[1] < 1e-3 and w[3] < w[1]
    labels = clustering.bayesian_gmm(blobs, "row_id", XY, k=4)
    assert ari(blobs, labels) > 0.9


def test_biclustering_of_a_checkerboard(spark):
    rng = np.random.default_rng(0)
    rows, columns = np.arange(90) % 3, np.arange(12) % 2
    x = np.array([[9.0, 1.0], [1.0, 9.0], [5.0, 5.0]])[rows][:, columns] + rng.normal(0, 0.2, (90, 12))
    f = [f"f{i}" for i in range(12)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=f).assign(row_id=range(90), truth=rows.astype("int32")))
    for method in ("bistochastic", "scale", "log"):
        assert ari(df, clustering.spectral_biclustering(df, "row_id", f, k=3, method=method)) > 0.9


def test_clique_finds_clusters_in_a_subspace(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 10, (400, 4))
    x[:120, 1], x[:120, 3] = rng.uniform(2.4, 2.6, 120), rng.uniform(7.4, 7.6, 120)
    x[120:240, 1], x[120:240, 3] = rng.uniform(8.4, 8.6, 120), rng.uniform(1.4, 1.6, 120)
    f = [f"f{i}" for i in range(4)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=f).reset_index(names="row_id"))
    got = {r.id: r.label for r in clustering.clique(df, "row_id", f, cells=10, share=0.1).collect()}
    assert len({got[i] for i in range(120)}) == len({got[i] for i in range(120, 240)}) == 1 and got[0] != got[120] and -1 not in (got[0], got[120])
    assert sum(got[i] == -1 for i in range(240, 400)) > 100


def test_sweeps_and_traces(blobs):
    df = blobs.drop("truth")
    runner = Runner(df, "row_id", XY)
    sweep = runner.k_sweep("kmeans", [2, 4, 6]).toPandas()
    assert sweep[sweep.best].k.tolist() == [4] and sweep.composite.between(0, 100).all()
    assert 4 in {r.k for r in runner.sweep_front("kmeans", [2, 4, 6]).collect()}
    out = {i: runner.run(i, **p) for i, p in (("kmeans", {"k": 4}), ("dbscan", {"eps": 1.5}))}
    assert runner.best(out)[1] > 0.8
    assert {r.algorithm_id for r in runner.interpret(out).collect()} == {"kmeans", "dbscan"}
    trace = runner.convergence(4).toPandas()
    assert (trace.inertia.diff().dropna() <= 1e-6).all() and trace.changes.iloc[0] == 160 and trace.drift.iloc[-1] < 1e-9
    assert runner.multi_init(4, 3).where("best").count() == 1
    assert runner.estimate("kmeans", (40, 80), k=3).count() == 1
    assert runner.consensus(["kmeans", "agglomerative_ward"], 4, k=4).select("label").distinct().count() == 4


def test_size_classes_and_memory():
    assert [registry.size_class(n) for n in (10, 600, 6000, 50_000, 10**6)] == ["tiny", "small", "medium", "large", "xlarge"]
    good, gone = registry.allowed(30_000)
    assert "kmeans" in good and "spectral_kmeans" in gone
    light, heavy = registry.by_memory(["kmeans", "agglomerative_ward", "gmm_full"], 50_000, 10, 1000)
    assert light[0] == "kmeans" and heavy == ["agglomerative_ward"]


def test_timeout_does_not_wait(blobs, monkeypatch):
    monkeypatch.setitem(REGISTRY, "sleepy", Algorithm("sleepy", "test", lambda *a, **k: time.sleep(8), False))
    began = time.time()
    assert Runner(blobs, "row_id", XY).run("sleepy", timeout=0.5).status == "TIMEOUT"
    assert time.time() - began < 6


def test_history_and_increments(spark, blobs, tmp_path):
    runner = Runner(blobs, "row_id", XY)
    history = History(spark, str(tmp_path / "history"))
    assert history.table().count() == 0
    for tag in ("one", "two"):
        history.record({"kmeans": runner.run("kmeans", k=4)}, tag)
    assert [r.tag for r in history.compare().collect()] == ["one", "two"] and history.compare([2]).count() == 1
    more = IncrementalRunner("row_id", XY)
    first = more.update(blobs, ["minibatch_kmeans", "kmeans"], k=4)
    assert more.update(blobs, ["minibatch_kmeans", "kmeans"], k=4)["kmeans"] is first["kmeans"]
    moved = more.update(blobs.withColumn("x", F.col("x") + 0.1), ["minibatch_kmeans"], k=4)
    assert ari(blobs, moved["minibatch_kmeans"].labels) > 0.95


def test_stream_goes_on_after_a_restart(spark, blobs, tmp_path):
    from siftstone.streaming.incremental import StreamingKMeans

    start = np.array([[1.0, 1], [9, 1], [1, 9], [9, 9]])
    parts = [blobs.where(F.col("row_id") % 2 == i).select("row_id", *XY).coalesce(1) for i in (0, 1)]

    def go(folder):
        stream = spark.readStream.schema("row_id long, x double, y double").parquet(str(tmp_path / folder))
        model = StreamingKMeans(start, XY)
        model.start(stream, str(tmp_path / f"{folder}-ck")).awaitTermination(60)
        return model

    parts[0].write.parquet(str(tmp_path / "a"))
    once = go("a")
    parts[1].write.mode("append").parquet(str(tmp_path / "a"))
    again = go("a")  # a new object, as after a restart
    assert again.last == 1 and again.seen.sum() == 160 and once.seen.sum() == 80
    whole = StreamingKMeans(start, XY)
    for i, p in enumerate(parts):
        whole.update(p, i)
    assert np.allclose(whole.centres, again.centres) and np.allclose(whole.seen, again.seen)


def test_stability_tables(spark, blobs):
    fit = lambda d, k=4: clustering.kmeans(d, "row_id", XY, k, n_init=2)
    runs = stability.compare(blobs, "row_id", XY, {"a": fit, "b": lambda d: fit(d, 2)}, (("gaussian", 0.05, 1), ("subset", 0.8, 1), ("gaussian", 0.4, 1)))
    assert {k: len(v) for k, v in stability.report(runs).items()}["scorecard"] == 2 and stability.leaderboard(runs, 1).count() == 1
    curve = spark.createDataFrame([(x / 10, 0.7 * float(np.exp(-4 * x / 10)) + 0.2) for x in range(8)], "level double, ari double")
    t = stability.trajectory(curve)
    assert t["plateau_ari"] == pytest.approx(0.2, abs=0.02) and t["half_life"] == pytest.approx(np.log(2) / 4, rel=0.1)
    found = stability.sensitivity_test(blobs, fit, {"k": [4, 2]}).toPandas()
    assert found.ari.iloc[0] > 0.95 > found.ari.iloc[1]
    assert stability.preset("quick") and len(stability.preset("standard")) == len(stability.SCHEDULE)


def test_consensus_beyond_the_dense_limit(spark, monkeypatch):
    rows = [(f"r{j}", i, int((i % 3 + (i % 50 == 7) * (j == 2)) % 3)) for j in range(4) for i in range(150)]
    runs = spark.createDataFrame(rows, "run string, row_id long, label int")
    coph = consensus.cophenetic_correlation(runs)
    whole = {n: {r.row_id: r.label for r in consensus.METHODS[n](runs, 3, None).collect()} for n in ("eac_average", "cspa", "meta")}
    monkeypatch.setattr(consensus, "DENSE", 20)
    for n, want in whole.items():
        got = {r.row_id: r.label for r in consensus.METHODS[n](runs, 3, None).collect()}
        assert len(set(zip(want.values(), (got[i] for i in want), strict=True))) == 3
    assert consensus.cophenetic_correlation(runs) == pytest.approx(coph)
    best = {r.k for r in consensus.estimate_k(runs, range(2, 6)).where("best").collect()}
    assert best == {3}
    assert consensus.multi_resolution_pac({2: runs, 3: runs}).where("best").count() == 1


def test_projection_benchmark_and_power(spark, blobs):
    got = {r.method: r for r in preprocess.reduction_benchmark(blobs, "row_id", XY, 2).collect()}
    assert got["pca"].trustworthiness == pytest.approx(1) and got["pca"].reconstruction_error == pytest.approx(0, abs=1e-12) and got["ica"].trustworthiness > 0.9
    x = spark.createDataFrame([(float(np.exp(v)),) for v in np.random.default_rng(0).normal(size=300)], "a double")
    out = preprocess.scale(x, ["a"], "box_cox").toPandas().a
    assert abs(out.skew()) < 0.3 and out.std(ddof=0) == pytest.approx(1)
    away = preprocess.robust_mahalanobis(blobs.unionByName(blobs.limit(8).selectExpr("row_id + 1000 AS row_id", "x + 90 AS x", "y - 60 AS y", "truth")), XY)
    top = away.orderBy(F.desc("mahalanobis")).limit(8).collect()
    assert all(r.row_id >= 1000 for r in top)


def test_gap_and_clusterability(blobs):
    df = blobs.drop("truth")
    curve = metrics.gap_statistic(df, "row_id", XY, range(1, 6), 3)
    assert metrics.gap_best_k(curve).first().best_k == 4
    row = metrics.clusterability(df, "row_id", XY).first()
    assert row.is_clusterable and row.n_features == 2 and row.dims_90 in (1, 2)
