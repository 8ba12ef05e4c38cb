"""Queries of fits whose result SQL gives too: rounds from fixed starts, density and grids, streams."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..operators import clustering, distances
from ..operators.graph import shared_folder
from .frames import CENTRES, DIST, FEATURES, POINTS, every, noisy, points, read, rounded
from .queries import _centre_frame, _r, query

_MEANS = every("avg({f}) AS {f}") + f", [{every('avg({f})')}] AS e"
_SEEDS = f"c0 AS (SELECT row_number() OVER (ORDER BY row_id) - 1 AS label, e FROM p ORDER BY row_id LIMIT 5)"


def _round(i: int) -> str:
    """Assignment to the centres c<i>, and the means of what each gets."""
    return f"a{i} AS (SELECT a.*, b.label AS cluster, {DIST} AS d, row_number() OVER (PARTITION BY a.row_id ORDER BY {DIST}, b.label) AS r FROM p a CROSS JOIN c{i} b), c{i + 1} AS (SELECT cluster AS label, {_MEANS} FROM a{i} WHERE r = 1 GROUP BY cluster)"


def _seeds(spark, d) -> np.ndarray:
    rows = points(spark, d).orderBy("row_id").limit(5).collect()
    return np.array([[r[f] for f in FEATURES] for r in rows])


def _rounds(spark, d, n: int) -> tuple[np.ndarray, float]:
    p, centres, cost = points(spark, d), _seeds(spark, d), 0.0
    for _ in range(n):
        centres, cost = clustering.lloyd_step(p, FEATURES, centres)
    return centres, cost


_THREE = ", ".join(_round(i) for i in range(3))
_ROUNDED = every("round({f}, 6) + 0.0 AS {f}")


@query(f"WITH {POINTS}, {_SEEDS}, {_THREE} SELECT CAST(label AS INTEGER) AS label, {_ROUNDED} FROM c3")
def kmeans_rounds(spark, d):
    return rounded(_centre_frame(spark, range(5), _rounds(spark, d, 3)[0]))


@query(f"WITH {POINTS}, {_SEEDS}, {_THREE} SELECT {_r('sum(d ** 2)', 5)} AS inertia FROM a2 WHERE r = 1")
def kmeans_inertia(spark, d):
    return rounded(spark.createDataFrame([(_rounds(spark, d, 3)[1],)], "inertia double"), 5)


@query("SELECT count(*) AS n, 0::BIGINT AS n_moved FROM embeddings")
def kmeans_fixed_point(spark, d):
    """After k-means has converged, no row is nearer to the mean of another cluster than to its own's."""
    p = points(spark, d)
    centres = clustering.kmeans_settled(p, "row_id", FEATURES, 5, rounds=200, tol=0.0)
    labels = clustering._assign(p, "row_id", FEATURES, centres).withColumnRenamed("id", "row_id")
    means = distances.centroid_array(p.drop("label").join(labels, "row_id"), "label", FEATURES)
    near = distances.nearest_centroid(p.drop("label").join(labels, "row_id"), means, FEATURES)
    return near.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("cluster") != F.col("label")).alias("n_moved"))


def _of_labels(spark, d) -> tuple[list, np.ndarray]:
    centres = distances.centroid_array(noisy(spark, d), "label", FEATURES)
    return [k for k, _ in centres], np.array([c for _, c in centres])


_WEIGHTED = every("round(sum(w * {f}) / sum(w), 6) + 0.0 AS {f}")
_MET = f"m AS (SELECT a.* EXCLUDE (label), b.label, {DIST} AS d FROM p a CROSS JOIN c b)"


@query(f"WITH {CENTRES}, {_MET}, w AS (SELECT *, d ** -5.5 / (sum(d ** -3.5) OVER (PARTITION BY row_id)) ** 2 AS w FROM m) SELECT label, {_WEIGHTED} FROM w GROUP BY label")
def harmonic_step(spark, d):
    names, centres = _of_labels(spark, d)
    return rounded(_centre_frame(spark, names, clustering.harmonic_step(points(spark, d), FEATURES, centres)))


@query(f"WITH {CENTRES}, {_MET}, w AS (SELECT *, (1 / (1 + d ** 2 / avg(d ** 2) OVER (PARTITION BY label))) ** 2 AS w FROM m) SELECT label, {_WEIGHTED} FROM w GROUP BY label")
def possibilistic_step(spark, d):
    names, centres = _of_labels(spark, d)
    return rounded(_centre_frame(spark, names, clustering.possibilistic_step(points(spark, d), FEATURES, centres)))


@query(
    f"""WITH {POINTS}, {_SEEDS}, b0 AS (SELECT a.*, b.label AS unit, row_number() OVER (PARTITION BY a.row_id ORDER BY {DIST}, b.label) AS r FROM p a CROSS JOIN c0 b),
    w AS (SELECT b0.*, CAST(u.label AS INTEGER) AS label_, exp(-1 * (u.label - b0.unit) ** 2 / 2.0) AS w FROM b0 CROSS JOIN c0 u WHERE r = 1) SELECT label_ AS label, {_WEIGHTED} FROM w GROUP BY label_"""
)
def som_step(spark, d):
    grid = np.array([[i, 0] for i in range(5)], float)
    return rounded(_centre_frame(spark, range(5), clustering.som_step(points(spark, d), FEATURES, _seeds(spark, d), grid, 1.0)))


_SQUARES = "list_sum(list_transform(list_zip(a.e, b.e, b.v), lambda x: (x[1] - x[2]) ** 2 / x[3] + ln(x[3])))"


@query(
    f"""WITH {CENTRES}, g AS (SELECT label, count(*) AS n, [{every('avg({f})')}] AS e, [{every('var_pop({f}) + 1e-6')}] AS v FROM q WHERE label <> -1 GROUP BY label),
    l AS (SELECT a.* EXCLUDE (label), b.label, ln(b.n / (SELECT sum(n) FROM g)) - 0.5 * {_SQUARES} AS l FROM p a CROSS JOIN g b), w AS (SELECT *, exp(l - max(l) OVER (PARTITION BY row_id)) AS x FROM l), r AS (SELECT *, x / sum(x) OVER (PARTITION BY row_id) AS w FROM w)
    SELECT label, {_WEIGHTED} FROM r GROUP BY label"""
)
def gmm_step(spark, d):
    """One round of expectation and maximisation of diagonal components from the labels."""
    rows = noisy(spark, d).where("label <> -1")
    got = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f) for f in FEATURES], *[F.var_pop(f).alias(f"v{f}") for f in FEATURES]).orderBy("label").collect()
    pi = np.array([r.n for r in got], float)
    start = pi / pi.sum(), np.array([[r[f] for f in FEATURES] for r in got]), np.array([np.diag([r[f"v{f}"] + 1e-6 for f in FEATURES]) for r in got])
    _pi, mu, _cov = clustering.gmm_fit(points(spark, d), "row_id", FEATURES, covariance="diag", rounds=1, start=start)
    return rounded(_centre_frame(spark, [r.label for r in got], mu))


@query(
    f"""WITH RECURSIVE {POINTS}, b AS (SELECT min(f1) AS a1, max(f1) AS z1, min(f2) AS a2, max(f2) AS z2, count(*) AS n FROM p), g AS (SELECT row_id, least(floor((f1 - a1) / (z1 - a1) * 8), 7) AS x, least(floor((f2 - a2) / (z2 - a2) * 8), 7) AS y, n FROM p, b),
    u AS (SELECT x, y, x * 100 + y AS c FROM g GROUP BY x, y HAVING count(*) >= 0.02 * any_value(n)), e AS (SELECT s.c AS i, t.c AS j FROM u s JOIN u t ON (s.x - t.x) ** 2 + (s.y - t.y) ** 2 <= 2.25),
    reach(i, c) AS (SELECT c, c FROM u UNION SELECT e.j, reach.c FROM reach JOIN e ON e.i = reach.i), comp AS (SELECT i, min(c) AS c FROM reach GROUP BY 1)
    SELECT count(*) AS n_dense, count(DISTINCT c.c) AS n_clusters FROM g JOIN comp c ON c.i = g.x * 100 + g.y"""
)
def grid_clusters(spark, d):
    labels = clustering.grid_clustering(points(spark, d), "row_id", ["f1", "f2"], cells=8, share=0.02)
    return labels.where("label <> -1").agg(F.count(F.lit(1)).alias("n_dense"), F.count_distinct("label").alias("n_clusters"))


@query()
def fit_kmodes(spark, d):
    rows = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return clustering.kmodes(rows, "o_orderkey", ["o_orderstatus", "o_orderpriority"], 3)


@query()
def fit_dtw(spark, d):
    """All users' values in order of time as series."""
    series = read(spark, d, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))), lambda r: r["value"]).alias("s"))
    return clustering.dtw_clustering(series, "user_id", "s", 3, window=3, limit=2_000)


# Streams

_START = (1.0, 5.0, 20.0)


@query(
    "WITH a AS (SELECT value, CASE WHEN abs(value - 1) <= abs(value - 5) AND abs(value - 1) <= abs(value - 20) THEN 0 WHEN abs(value - 5) <= abs(value - 20) THEN 1 ELSE 2 END AS label FROM events) SELECT label, count(*)::DOUBLE AS n, round(avg(value), 6) + 0.0 AS centre FROM a GROUP BY label"
)
def streaming_kmeans(spark, d):
    """One micro-batch moves the centres to the means of what each attracts."""
    from ..streaming.incremental import StreamingKMeans

    model = StreamingKMeans(np.array([[v] for v in _START]), ["value"])
    schema = read(spark, d, "events").schema
    # Streams read folders; the glob finds the one file.
    stream = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet").select("value")
    model.start(stream, f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}").awaitTermination()
    return rounded(spark.createDataFrame([(i, float(n), float(c[0])) for i, (n, c) in enumerate(zip(model.seen, model.centres, strict=True))], "label int, n double, centre double"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 6) + 0.0 AS std FROM events GROUP BY ALL")
def streaming_profile(spark, d):
    from ..streaming.incremental import windowed_profile

    schema = read(spark, d, "events").schema
    name = f"profile_{uuid.uuid4().hex}"
    stream = windowed_profile(spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet"), "ts", "value", "event_type")
    stream.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{shared_folder(spark)}/{name}").trigger(availableNow=True).start().awaitTermination()
    return rounded(spark.table(name).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "mean", "std"))
