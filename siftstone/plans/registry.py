"""The catalogue of clustering algorithms and how they are run."""

from __future__ import annotations

import itertools
import time
from collections import OrderedDict
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clustering as c
from ..operators import metrics, profile


@dataclass(frozen=True)
class Algorithm:
    id: str
    family: str
    fit: Callable[..., DataFrame]
    needs_k: bool = True
    defaults: dict = field(default_factory=dict)
    tags: tuple[str, ...] = ()


def _catalogue() -> list[Algorithm]:
    a = Algorithm
    out = [
        a("kmeans", "partition", c.kmeans, tags=("scalable",)),
        a("kmeans_pp", "partition", partial(c.kmeans, n_init=20), tags=("scalable",)),
        a("minibatch_kmeans", "partition", c.minibatch_kmeans, defaults={"batch": 1024}, tags=("scalable",)),
        a("bisecting_kmeans", "partition", c.bisecting_kmeans, tags=("scalable",)),
        a("repeated_bisecting", "partition", partial(c.bisecting_kmeans, repeats=3), tags=("scalable",)),
        a("kmedoids", "partition", c.kmedoids),
        a("kmeans_auto", "partition", c.kmeans_auto, False, {"k_max": 15}),
        a("xmeans", "partition", c.xmeans, False, {"k_max": 15}),
        a("gmeans", "partition", c.gmeans, False),
        a("dip_means", "partition", c.dip_means, False),
        a("clara", "partition", c.clara, defaults={"trials": 5}, tags=("scalable",)),
        a("k_harmonic_means", "partition", c.k_harmonic_means, defaults={"p": 3.5}, tags=("scalable",)),
        *[a(f"agglomerative_{m}", "hierarchical", partial(c.agglomerative, linkage_method=m)) for m in ("ward", "complete", "average", "single")],
        a("birch", "hierarchical", c.birch, defaults={"threshold": 0.5}, tags=("scalable",)),
        a("diana_divisive", "hierarchical", partial(c.agglomerative, linkage_method="average")),
        a("dbscan", "density", c.dbscan, False, {"eps": 0.5, "min_samples": 5}, ("scalable", "noise")),
        a("optics", "density", c.optics, False, {"min_samples": 5, "xi": 0.05}, ("noise",)),
        a("hdbscan", "density", c.hdbscan, False, {"min_cluster_size": 15, "min_samples": 5}, ("noise",)),
        a("mean_shift", "density", c.mean_shift, False, {"bandwidth": 0.0}),
        a("denclue", "density", c.denclue, False, {"h": 0.5, "threshold": 0.001}, ("noise",)),
        a("robust_cc", "density", c.robust_cc, False, {"k": 10, "min_samples": 5}, ("noise",)),
        a("threshold_clustering", "graph", c.threshold_clustering, False, {"threshold": 1.0}, ("scalable",)),
        *[a(f"gmm_{m}", "model", partial(c.gmm, covariance=m), tags=("scalable",)) for m in ("full", "tied", "diag", "spherical")],
        a("bgmm", "model", partial(c.bayesian_gmm), defaults={"k": 20}, needs_k=False),
        a("online_gmm", "model", c.online_gmm, defaults={"batch": 500, "epochs": 5}, tags=("scalable",)),
        a("spectral_kmeans", "graph", partial(c.spectral, affinity="rbf")),
        a("spectral_discretize", "graph", partial(c.spectral, affinity="rbf", assign="discretize")),
        a("spectral_cluster_qr", "graph", partial(c.spectral, affinity="rbf", assign="cluster_qr")),
        a("sparse_spectral", "graph", partial(c.spectral, affinity="knn", neighbours=15)),
        a("spectral_biclustering", "graph", c.spectral_biclustering, defaults={"method": "bistochastic"}),
        a("spectral_coclustering", "graph", c.spectral_coclustering),
        a("affinity_propagation", "graph", c.affinity_propagation, False, {"damping": 0.9, "preference": -50.0}),
        a("autoencoder_kmeans", "embedding", c.projected_kmeans, defaults={"components_kept": 16}),
        a("projected_kmeans", "embedding", c.projected_kmeans, defaults={"components_kept": 10}),
        a("som_clustering", "embedding", c.som, False, {"rows": 5, "cols": 5}),
        a("isomap_kmeans", "embedding", partial(c.embedded_kmeans, method="isomap")),
        a("lle_kmeans", "embedding", partial(c.embedded_kmeans, method="lle")),
        a("umap_hdbscan", "embedding", c.embedded_hdbscan, False),
        a("clique_subspace", "grid", c.clique, False, {"cells": 10, "share": 0.1}, ("scalable", "noise")),
        a("sting_grid", "grid", c.grid_clustering, False, {"cells": 20, "share": 0.05}, ("scalable", "noise")),
        a("fuzzy_cmeans", "fuzzy", c.fuzzy_cmeans, defaults={"m": 2.0}, tags=("scalable",)),
        a("possibilistic_cmeans", "fuzzy", c.possibilistic_cmeans, defaults={"m": 2.0}),
        a("ensemble_voting", "ensemble", c.ensemble_voting, defaults={"members": 10}),
        a("random_subspace_ensemble", "ensemble", partial(c.ensemble_voting, share=0.5)),
    ]
    return out


REGISTRY: dict[str, Algorithm] = {a.id: a for a in _catalogue()}


def register(algorithm: Algorithm) -> None:
    """Add an algorithm of one's own: any ``fit(df, id column, features, **params)`` that returns (id, label)."""
    if algorithm.id in REGISTRY:
        raise ValueError(f"{algorithm.id} is registered already")
    REGISTRY[algorithm.id] = algorithm


def get(id_: str) -> Algorithm:
    return REGISTRY[id_]


def by_family(family: str) -> list[Algorithm]:
    return [a for a in REGISTRY.values() if a.family == family]


def by_tag(tag: str) -> list[Algorithm]:
    return [a for a in REGISTRY.values() if tag in a.tags]


def without_k() -> list[Algorithm]:
    return [a for a in REGISTRY.values() if not a.needs_k]


def families() -> list[str]:
    return sorted({a.family for a in REGISTRY.values()})


def search(text: str) -> list[Algorithm]:
    return [a for a in REGISTRY.values() if text.lower() in a.id or text.lower() in a.family]


#: Sizes of tables, and the algorithms that are too slow for each: fixed values.
SIZE_CLASSES = (("tiny", 500), ("small", 5_000), ("medium", 20_000), ("large", 100_000), ("xlarge", None))
TOO_SLOW = {
    "medium": "affinity_propagation diana_divisive spectral_biclustering spectral_coclustering kmedoids".split(),
    "large": (
        "affinity_propagation diana_divisive spectral_kmeans spectral_discretize spectral_cluster_qr spectral_biclustering spectral_coclustering kmedoids denclue possibilistic_cmeans mean_shift isomap_kmeans lle_kmeans "
        "random_subspace_ensemble ensemble_voting agglomerative_ward agglomerative_complete agglomerative_average agglomerative_single"
    ).split(),
    "xlarge": (
        "affinity_propagation diana_divisive denclue possibilistic_cmeans spectral_kmeans spectral_discretize spectral_cluster_qr spectral_biclustering spectral_coclustering kmedoids mean_shift isomap_kmeans lle_kmeans "
        "random_subspace_ensemble ensemble_voting agglomerative_ward agglomerative_complete agglomerative_average agglomerative_single gmm_full gmm_tied bgmm fuzzy_cmeans clique_subspace som_clustering"
    ).split(),
}


def size_class(n_rows: int) -> str:
    return next(name for name, below in SIZE_CLASSES if below is None or n_rows < below)


def allowed(n_rows: int, ids: list[str] | None = None) -> tuple[list[str], list[str]]:
    """The ids that suit a table of that many rows, and those that are too slow for it."""
    gone = set(TOO_SLOW.get(size_class(n_rows), ()))
    ids = list(REGISTRY) if ids is None else ids
    return [i for i in ids if i not in gone], [i for i in ids if i in gone]


def memory_mb(id_: str, n: int, d: int) -> float:
    """Rough peak of a fit on one machine: its passes over the table, a matrix of all pairs, or a covariance for each row."""
    a = REGISTRY.get(id_)
    passes = 1 if a is not None and "scalable" in a.tags else 4
    size = passes * n * d * 8
    if id_.startswith(("agglomerative", "spectral")):
        size += n * n * 4
    if "gmm" in id_:
        size += n * d * d * 8
    return size / 1e6


def by_memory(ids: list[str], n: int, d: int, available_mb: float, share: float = 0.6) -> tuple[list[str], list[str]]:
    """The ids whose estimate fits into a share of the memory, the lightest first, and those that don't."""
    need = {i: memory_mb(i, n, d) for i in ids}
    return sorted((i for i in ids if need[i] <= available_mb * share), key=need.get), [i for i in ids if need[i] > available_mb * share]


def growth(times: DataFrame, n_rows: int) -> DataFrame:
    """From (n, seconds): the power b of seconds = a n^b by least squares of logarithms, its class, and the seconds for ``n_rows``."""
    x, y = F.log("n"), F.log("seconds")
    fit = times.where("n > 0 AND seconds > 1e-5").agg(F.regr_slope(y, x).alias("exponent"), F.regr_intercept(y, x).alias("_a"))
    kind = F.when(F.col("exponent") < 1.3, "linear").when(F.col("exponent") < 1.6, "n log n").when(F.col("exponent") < 2.3, "quadratic").when(F.col("exponent") < 2.8, "above quadratic").otherwise("steeper")
    return fit.select("exponent", F.when(F.col("exponent").isNotNull(), kind).otherwise("unknown").alias("complexity"), F.exp(F.col("_a") + F.col("exponent") * F.log(F.lit(float(n_rows)))).alias("predicted_seconds"))


def recommend(n_rows: int, n_features: int) -> list[Algorithm]:
    """Algorithms that suit the size; only scalable ones beyond 100,000 rows, no grids beyond 10 features."""
    out = by_tag("scalable") if n_rows > 100_000 else list(REGISTRY.values())
    return [a for a in out if not (a.family == "grid" and n_features > 10)]


def summary(spark: SparkSession) -> DataFrame:
    rows = [(a.id, a.family, a.needs_k, ",".join(a.tags)) for a in REGISTRY.values()]
    return spark.createDataFrame(rows, "algorithm_id string, family string, needs_k boolean, tags string")


@dataclass
class RunResult:
    algorithm_id: str
    status: str
    labels: DataFrame | None
    seconds: float
    k: int = 0
    noise: float = 0.0
    error: str = ""
    params: dict = field(default_factory=dict)


class Runner:
    """Runs algorithms on one feature table, with a cache by content and parameters and a real timeout."""

    def __init__(self, df: DataFrame, id_col: str, features: list[str], cache_size: int = 200):
        self.df, self.id_col, self.features = df, id_col, features
        self.n = df.count()
        self.hash = profile.content_hash(df.select(id_col, *features))
        self.cache: OrderedDict[tuple, RunResult] = OrderedDict()
        self.cache_size, self.hits = cache_size, 0

    def tuned(self, a: Algorithm, params: dict) -> dict:
        """Defaults, then the caller's parameters; k within [2, min(n - 1, 50)], eps from the data where it is the default."""
        out = {**a.defaults, **params}
        if a.needs_k or "k" in out:
            out["k"] = max(2, min(int(out.get("k", 8)), self.n - 1, 50))
        if a.id == "dbscan" and out.get("eps") == 0.5:
            out["eps"] = max(c.auto_eps(self.df, self.id_col, self.features, out.get("min_samples", 5)), 1e-9)
        return out

    def run(self, id_: str, timeout: float | None = 120.0, **params) -> RunResult:
        a = REGISTRY[id_]
        params = self.tuned(a, params)
        key = (self.hash, id_, tuple(sorted(params.items())))
        if key in self.cache:
            self.hits += 1
            self.cache.move_to_end(key)
            return self.cache[key]
        began, sc, tag = time.time(), self.df.sparkSession.sparkContext, f"run-{id_}-{time.time_ns()}"

        def work() -> RunResult:
            sc.addJobTag(tag)
            try:
                labels = a.fit(self.df, self.id_col, self.features, **params).persist()
                s = metrics.size_stats(labels, "label").first()
                k, noise = int(s.k or 0), float(s.noise_ratio or 0)
                status = "FAILED" if k < 2 or noise > 0.8 else "OK"
                return RunResult(id_, status, labels, time.time() - began, k, noise, "" if status == "OK" else "fewer than two clusters or too much noise", params)
            except Exception as e:  # one algorithm's failure is a row of the batch, not its end
                return RunResult(id_, "FAILED", None, time.time() - began, error=f"{type(e).__name__}: {e}"[:300], params=params)
            finally:
                sc.removeJobTag(tag)

        # Not waited for beyond the timeout: its Spark jobs are cancelled, what it computes on the driver ends by itself.
        pool = ThreadPoolExecutor(1)
        job = pool.submit(work)
        try:
            result = job.result(timeout)
        except TimeoutError:
            sc.cancelJobsWithTag(tag)
            job.add_done_callback(lambda j: j.result().labels.unpersist() if not j.cancelled() and j.exception() is None and j.result().labels is not None else None)
            result = RunResult(id_, "TIMEOUT", None, time.time() - began, params=params)
        finally:
            pool.shutdown(wait=False)
        if result.status == "OK":
            self.cache[key] = result
            while len(self.cache) > self.cache_size:
                _, old = self.cache.popitem(last=False)
                if old.labels is not None:
                    old.labels.unpersist()
        return result

    def batch(self, ids: list[str], threads: int = 4, **params) -> dict[str, RunResult]:
        with ThreadPoolExecutor(threads if self.n >= 5_000 else 1) as pool:
            return dict(zip(ids, pool.map(lambda i: self.run(i, **params), ids), strict=True))

    def grid(self, id_: str, options: dict[str, list], most: int = 100) -> list[RunResult]:
        combos = itertools.islice(itertools.product(*options.values()), most)
        return [self.run(id_, **dict(zip(options, v, strict=True))) for v in combos]

    def k_sweep(self, id_: str, ks: list[int]) -> DataFrame:
        """k, silhouette, Davies-Bouldin, Calinski-Harabasz, inertia, composite and whether the silhouette is the best, of each k that gives clusters."""
        rows = []
        for k in ks:
            r = self.run(id_, k=k)
            if r.status == "OK":
                m = self.metrics_of(r)
                score = metrics.composite(self._long([(id_, n, float(v)) for n, v in m.items() if v is not None])).first()
                rows.append((k, m["silhouette"], m["davies_bouldin"], m["calinski_harabasz"], m["inertia"], float(score.composite)))
        best = max((r for r in rows if r[1] is not None), key=lambda r: (r[1], -r[0]), default=(None,))[0]
        kinds = "k int, silhouette double, davies_bouldin double, calinski_harabasz double, inertia double, composite double, best boolean"
        return self.df.sparkSession.createDataFrame([(*r, r[0] == best) for r in rows], kinds)

    def sweep_front(self, id_: str, ks: list[int]) -> DataFrame:
        """The k of a sweep that no other k beats in silhouette, Davies-Bouldin and Calinski-Harabasz at once."""
        return metrics.pareto(self.k_sweep(id_, ks), "k", ["silhouette", "calinski_harabasz"], ["davies_bouldin"])

    def best(self, results: dict[str, RunResult]) -> tuple[str | None, float | None]:
        """The id of the best silhouette among the results with two clusters and more."""
        got = {i: self.metrics_of(r)["silhouette"] for i, r in results.items() if r.status == "OK" and r.k >= 2}
        top = max((i for i, v in got.items() if v is not None), key=lambda i: (got[i], i), default=None)
        return top, got.get(top)

    def estimate(self, id_: str, sizes: tuple[int, ...] = (200, 500, 1000, 2000), **params) -> DataFrame:
        """How the seconds of an algorithm grow, from runs on samples of some sizes below the table's."""
        from ..operators.sampling import uniform_sample

        times = []
        for m in (v for v in sizes if v < self.n):
            part = Runner(uniform_sample(self.df, self.id_col, m).persist(), self.id_col, self.features)
            r = part.run(id_, **params)
            if r.status == "OK":
                times.append((m, r.seconds))
            part.df.unpersist()
        return growth(self.df.sparkSession.createDataFrame(times, "n long, seconds double"), self.n)

    def multi_init(self, k: int, inits: int = 10, seed: int = 42) -> DataFrame:
        """seed, inertia and whether it is the best, of k-means from several seeds."""
        got = [(seed + i, float(c.kmeans_fit(self.df, self.id_col, self.features, k, seed + i, 1)[1])) for i in range(inits)]
        best = min(got, key=lambda r: (r[1], r[0]))[0]
        return self.df.sparkSession.createDataFrame([(s, v, s == best) for s, v in got], "seed int, inertia double, best boolean")

    def convergence(self, k: int, rounds: int = 100, seed: int = 42) -> DataFrame:
        """round, inertia, drift and changed labels of k-means, round by round."""
        return self.df.sparkSession.createDataFrame(c.lloyd_trace(self.df, self.id_col, self.features, k, rounds, seed), "round int, inertia double, drift double, changes long")

    def consensus(self, ids: list[str], clusters: int, method: str = "eac_average", **params) -> DataFrame:
        """One clustering from those of several algorithms (``consensus.METHODS``)."""
        from ..operators import consensus

        return consensus.METHODS[method](self.long_labels(self.batch(ids, **params)), clusters, None)

    def _long(self, rows: list[tuple]) -> DataFrame:
        return self.df.sparkSession.createDataFrame(rows, "algorithm_id string, metric string, value double")

    def metrics_of(self, r: RunResult) -> dict[str, float | None]:
        """All metrics of one result; those of pairs over all rows."""
        labelled = self.df.drop("label").join(r.labels.withColumnRenamed("id", self.id_col), self.id_col).persist()
        values = metrics.centroid_metrics(labelled, "label", self.features)
        s = metrics.size_stats(labelled, "label").first()
        values |= {"noise_ratio": s.noise_ratio, "cluster_balance": s.balance, "size_entropy": s.entropy_nats}
        values["silhouette"] = metrics.silhouette(labelled, self.id_col, "label", self.features).first()[0]
        values["avg_intra_dist"] = metrics.avg_intra_distance(labelled, self.id_col, "label", self.features).first()[0]
        labelled.unpersist()
        return values

    def long_labels(self, results: dict[str, RunResult]) -> DataFrame:
        """(run, row_id, label) of all results that succeeded."""
        out = None
        for id_, r in results.items():
            if r.labels is not None:
                one = r.labels.select(F.lit(id_).alias("run"), F.col("id").alias("row_id"), "label")
                out = one if out is None else out.unionByName(one)
        if out is None:
            return self.df.sparkSession.createDataFrame([], "run string, row_id long, label int")
        return out

    def evaluate(self, results: dict[str, RunResult]) -> DataFrame:
        """(algorithm_id, metric, value) of each result."""
        return self._long([(i, m, float(v)) for i, r in results.items() if r.labels is not None for m, v in self.metrics_of(r).items() if v is not None])

    def interpret(self, results: dict[str, RunResult]) -> DataFrame:
        """algorithm_id and a text on each result."""
        long = self.evaluate(results)
        names = ["silhouette", "davies_bouldin", "noise_ratio", "cluster_balance"]
        wide = long.groupBy("algorithm_id").agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in names]).join(metrics.composite(long), "algorithm_id")
        ks = self.df.sparkSession.createDataFrame([(i, r.k) for i, r in results.items()], "algorithm_id string, k int")
        return wide.join(ks, "algorithm_id").select("algorithm_id", metrics.interpretation().alias("text"))

    def ranking(self, results: dict[str, RunResult]) -> DataFrame:
        from ..operators.ranking import rank_by

        return rank_by(metrics.composite(self.evaluate(results)), "composite", "algorithm_id")


class History:
    """All runs of a session as rows that are appended to a table of the shared folder."""

    SCHEMA = "run_id long, tag string, algorithm_id string, status string, k int, noise double, seconds double, params string, error string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def record(self, results: dict[str, RunResult], tag: str = "") -> int:
        run = (self.table().agg(F.max("run_id")).first()[0] or 0) + 1
        rows = [(run, tag, i, r.status, r.k, r.noise, r.seconds, str(sorted(r.params.items())), r.error) for i, r in results.items()]
        self.spark.createDataFrame(rows, self.SCHEMA).write.mode("append").parquet(self.path)
        return run

    def table(self) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def compare(self, runs: list[int] | None = None) -> DataFrame:
        t = self.table()
        return (t if runs is None else t.where(F.col("run_id").isin(runs))).orderBy("run_id", "algorithm_id")


class IncrementalRunner:
    """Reruns what changed: nothing if the table is the same; k-means moves on from its last centres, others fit anew."""

    WARM = ("minibatch_kmeans",)

    def __init__(self, id_col: str, features: list[str]):
        self.id_col, self.features = id_col, features
        self.hash: int | None = None
        self.results: dict[str, RunResult] = {}
        self.models: dict[str, object] = {}

    def update(self, df: DataFrame, ids: list[str], **params) -> dict[str, RunResult]:
        from ..streaming.incremental import StreamingKMeans

        runner = Runner(df, self.id_col, self.features)
        if runner.hash == self.hash and set(ids) <= set(self.results):
            return {i: self.results[i] for i in ids}
        for i in ids:
            if i not in self.WARM:
                self.results[i] = runner.run(i, **params)
                continue
            began = time.time()
            if i not in self.models:
                centres, _cost = c.kmeans_fit(df, self.id_col, self.features, runner.tuned(REGISTRY[i], params)["k"])
                self.models[i] = StreamingKMeans(centres, self.features)
            model = self.models[i]
            model.update(df, model.last + 1)
            labels = c._assign(df, self.id_col, self.features, model.centres).persist()
            s = metrics.size_stats(labels, "label").first()
            self.results[i] = RunResult(i, "OK", labels, time.time() - began, int(s.k or 0), float(s.noise_ratio or 0), params=params)
        self.hash = runner.hash
        return {i: self.results[i] for i in ids}
