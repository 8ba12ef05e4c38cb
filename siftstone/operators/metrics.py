"""Internal validity metrics. Noise (-1) never takes part.

Metrics of centroids are two aggregates. Metrics of point pairs (silhouette,
Dunn, connectivity) run in blocks of distances whose partial results combine.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import squared_distance, vector
from . import distances

#: Weight of each metric in the composite score; what isn't listed weighs 1. Fixed values.
WEIGHTS = {"silhouette": 3.0, "davies_bouldin": 2.0, "calinski_harabasz": 2.0, "dunn": 2.0, "xie_beni": 1.5, "noise_ratio": 1.5, "cluster_balance": 1.0, "avg_intra_dist": 1.0, "avg_inter_dist": 1.0}


def clean(df: DataFrame, label: str) -> DataFrame:
    return df.where(F.col(label) != -1)


def silhouette_samples(df: DataFrame, id_col: str, label: str, features: list[str]) -> DataFrame:
    """id, label, a (mean distance in the own cluster), b (to the nearest other one), silhouette."""
    rows = clean(df, label)
    kind = df.schema[id_col].dataType.simpleString()

    def fn(d: np.ndarray, q: pd.DataFrame, ref: pd.DataFrame) -> pd.DataFrame:
        names, code = np.unique(ref[label].to_numpy(), return_inverse=True)
        size = np.bincount(code, minlength=len(names))
        sums = np.stack([d[:, code == k].sum(axis=1) for k in range(len(names))], axis=1)
        per = {"id": np.repeat(q[id_col].to_numpy(), len(names)), "label": np.repeat(q[label].to_numpy(), len(names))}
        return pd.DataFrame({**per, "other": np.tile(names, len(q)), "s": sums.reshape(-1), "n": np.tile(size, len(q))})

    parts = distances.per_point(rows, rows, id_col, features, fn, f"id {kind}, label int, other int, s double, n long", [label])
    means = parts.groupBy("id", "label", "other").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    own = F.col("other") == F.col("label")
    per = means.groupBy("id", "label").agg(
        F.max(F.when(own, F.col("n"))).alias("_n"),
        F.max(F.when(own, F.col("s") / F.greatest(F.col("n") - 1, F.lit(1)))).alias("a"),
        F.coalesce(F.min(F.when(~own, F.col("s") / F.col("n"))), F.lit(float("inf"))).alias("b"),
    )
    s = (F.col("b") - F.col("a")) / F.greatest("a", "b", F.lit(1e-300))
    return per.select("id", "label", "a", "b", F.when((F.col("_n") > 1) & (F.col("b") < float("inf")), s).otherwise(F.lit(0.0)).alias("silhouette"))


def avg_intra_distance(df: DataFrame, id_col: str, label: str, features: list[str]) -> DataFrame:
    """One row, avg_intra_dist: the mean over clusters of two rows and more of the mean distance of all their ordered pairs, a row with itself included."""
    rows = clean(df, label)

    def fn(d: np.ndarray, q: pd.DataFrame, ref: pd.DataFrame) -> pd.DataFrame:
        own = q[label].to_numpy()
        same = own[:, None] == ref[label].to_numpy()[None, :]
        return pd.DataFrame({"label": own, "s": np.where(same, d, 0).sum(axis=1), "n": same.sum(axis=1)}).groupby("label", as_index=False).sum()

    per = distances.per_point(rows, rows, id_col, features, fn, "label int, s double, n long", [label]).groupBy("label").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return per.where("n > 1").agg(F.avg(F.col("s") / F.col("n")).alias("avg_intra_dist"))


def silhouette(df: DataFrame, id_col: str, label: str, features: list[str]) -> DataFrame:
    return silhouette_samples(df, id_col, label, features).agg(F.avg("silhouette").alias("silhouette"))


def with_centroid(df: DataFrame, label: str, features: list[str]) -> tuple[DataFrame, list[tuple[int, list[float]]]]:
    """Rows with ``_d2``, the squared distance to their own centroid, which is a literal (k rows)."""
    centres = distances.centroid_array(df, label, features)
    if not centres:
        return clean(df, label).withColumn("_d2", F.lit(0.0)), []
    table = F.create_map(*[v for k, c in centres for v in (F.lit(k), F.array(*[F.lit(float(x)) for x in c]))])
    return clean(df, label).withColumn("_d2", squared_distance(vector(features), table[F.col(label)])), centres


def scatter(df: DataFrame, label: str, features: list[str]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Per cluster: size, summed squared and mean distance to the centroid; the centroids; the total mean."""
    rows, centres = with_centroid(df, label, features)
    per = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.sum("_d2").alias("wcss"), F.avg(F.sqrt("_d2")).alias("radius")).toPandas().sort_values(label, ignore_index=True)
    c = np.array([c for _, c in centres]).reshape(len(centres), len(features))
    n = per.n.to_numpy(float)
    return per, c, (c * n[:, None]).sum(axis=0) / max(n.sum(), 1)


def centroid_metrics(df: DataFrame, label: str, features: list[str]) -> dict[str, float | None]:
    """davies_bouldin, calinski_harabasz, xie_beni, inertia, from two aggregates; None with fewer than two clusters."""
    per, c, mean = scatter(df, label, features)
    k, n = len(per), int(per.n.sum()) if len(per) else 0
    wcss = float(per.wcss.sum()) if k else None
    if k < 2:
        return {"davies_bouldin": None, "calinski_harabasz": None, "xie_beni": None, "inertia": wcss, "inertia_ratio": None, "avg_inter_dist": None}
    gap = distances.pairwise(c, c)
    apart = gap[gap > 0]
    r = per.radius.to_numpy()
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = (r[:, None] + r[None, :]) / gap
    np.fill_diagonal(ratio, -np.inf)
    between = float((per.n.to_numpy() * ((c - mean) ** 2).sum(axis=1)).sum())
    np.fill_diagonal(gap, np.inf)
    return {
        "davies_bouldin": float(ratio.max(axis=1).mean()),
        "calinski_harabasz": (between / (k - 1)) / (wcss / (n - k)) if wcss and n > k else None,
        "xie_beni": wcss / (n * float(gap.min()) ** 2) if gap.min() > 0 else None,
        "inertia": wcss,
        "inertia_ratio": wcss / (wcss + between) if wcss + between > 0 else None,
        "avg_inter_dist": float(apart.mean()) if len(apart) else None,
    }


def dunn(df: DataFrame, id_col: str, label: str, features: list[str]) -> DataFrame:
    """Least distance between clusters over the largest diameter."""
    rows = clean(df, label)

    def fn(d: np.ndarray, q: pd.DataFrame, ref: pd.DataFrame) -> pd.DataFrame:
        same = q[label].to_numpy()[:, None] == ref[label].to_numpy()[None, :]
        return pd.DataFrame({"gap": np.where(same, np.inf, d).min(axis=1), "width": np.where(same, d, 0).max(axis=1)})

    return distances.per_point(rows, rows, id_col, features, fn, "gap double, width double", [label]).agg((F.min("gap") / F.max("width")).alias("dunn"))


def connectivity(df: DataFrame, id_col: str, label: str, features: list[str], k: int = 10) -> DataFrame:
    """Sum of 1/rank over the k nearest rows (the row itself is rank 1) that belong to another cluster."""
    near = distances.knn(clean(df, label), id_col, features, k - 1).withColumn("rank", F.col("rank") + 1)
    a, b = (df.select(F.col(id_col).alias(i), F.col(label).alias(n)) for i, n in (("id", "la"), ("neighbour", "lb")))
    return near.join(a, "id").join(b, "neighbour").agg(F.sum(F.when(F.col("la") != F.col("lb"), 1 / F.col("rank")).otherwise(0.0)).alias("connectivity"))


def s_dbw(df: DataFrame, label: str, features: list[str]) -> float:
    """Scatter plus density between clusters."""
    rows = clean(df, label)
    total = rows.agg(*[F.var_pop(f) for f in features]).first()
    per = rows.groupBy(label).agg(*[F.var_pop(f).alias(f) for f in features]).orderBy(label).collect()
    if len(per) < 2:
        return float("inf")
    norms = np.array([np.linalg.norm([r[f] or 0 for f in features]) for r in per])
    scat = float(norms.mean() / max(np.linalg.norm([v or 0 for v in total]), 1e-300))
    sigma = float(np.sqrt(norms.sum()) / len(per))
    centres = distances.centroid_array(df, label, features)
    points = [(i, i, c) for i, (_, c) in enumerate(centres)]
    points += [(i, j, [(x + y) / 2 for x, y in zip(centres[i][1], centres[j][1], strict=True)]) for i in range(len(centres)) for j in range(i + 1, len(centres))]
    names = [k for k, _ in centres]
    x = vector(features)
    counts = rows.agg(
        *[F.count_if((F.col(label).isin(names[i], names[j])) & (F.sqrt(squared_distance(x, F.array(*[F.lit(float(v)) for v in c]))) <= sigma)) for i, j, c in points]
    ).first()
    dens = {(i, j): counts[k] for k, (i, j, _) in enumerate(points)}
    k = len(centres)
    ratios = [dens[i, j] / max(dens[i, i], dens[j, j], 1e-300) if max(dens[i, i], dens[j, j]) else 0.0 for i in range(k) for j in range(i + 1, k)]
    return scat + float(np.mean(ratios))


def size_stats(df: DataFrame, label: str) -> DataFrame:
    """One row: k, n, n_noise, noise_ratio, min/max/mean/std size, balance, entropy (log2 and ln)."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    real = F.when(F.col(label) != -1, F.col("n"))
    noise = F.coalesce(F.sum(F.when(F.col(label) == -1, F.col("n"))), F.lit(0))
    total = F.sum(real)
    # -sum p log p = log N - sum n log n / N
    nln = F.sum(F.when(F.col(label) != -1, F.col("n") * F.log("n")))
    ln = F.log(total) - nln / total
    return sizes.agg(
        F.count(real).alias("k"),
        F.sum("n").alias("n_rows"),
        noise.alias("n_noise"),
        (noise / F.sum("n")).alias("noise_ratio"),
        F.min(real).alias("min_size"),
        F.max(real).alias("max_size"),
        F.avg(real).alias("mean_size"),
        F.stddev_pop(real).alias("std_size"),
        (F.min(real) / F.max(real)).alias("balance"),
        (ln / F.log(F.lit(2.0))).alias("entropy_bits"),
        ln.alias("entropy_nats"),
    )


def overlap(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """max(0, 1 - d / (r95a + r95b)) for each two clusters: a, b, overlap."""
    rows, centres = with_centroid(df, label, features)
    radius = {r[label]: r.r for r in rows.groupBy(label).agg(F.percentile(F.sqrt("_d2"), F.lit(0.95)).alias("r")).collect()}
    out = []
    for i, (a, x) in enumerate(centres):
        for b, y in centres[i + 1 :]:
            d, r = float(np.linalg.norm(np.subtract(x, y))), radius[a] + radius[b]
            out.append((int(a), int(b), max(0.0, 1 - d / r) if r > 0 else 0.0))
    return df.sparkSession.createDataFrame(out, "a int, b int, overlap double")


def separability(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """Mahalanobis distance of each two centroids under the covariance of all rows plus 1e-6 I."""
    from .profile import covariance

    _, cov, n = covariance(df, features)
    inverse = np.linalg.inv(np.array(cov) * n / max(n - 1, 1) + 1e-6 * np.eye(len(features)))
    centres = distances.centroid_array(df, label, features)
    out = [(int(a), int(b), float(np.sqrt(max((d := np.subtract(x, y)) @ inverse @ d, 0)))) for i, (a, x) in enumerate(centres) for b, y in centres[i + 1 :]]
    return df.sparkSession.createDataFrame(out, "a int, b int, distance double")


def dbcv(df: DataFrame, id_col: str, label: str, features: list[str], k: int = 5) -> DataFrame:
    """Density-based validity from core distances: per cluster (separation - density) / max of both, weighted by size."""
    rows = clean(df, label)

    def fn(d: np.ndarray, q: pd.DataFrame, ref: pd.DataFrame) -> pd.DataFrame:
        same = q[label].to_numpy()[:, None] == ref[label].to_numpy()[None, :]
        inside = np.sort(np.where(same, d, np.inf), axis=1)[:, : k + 1]
        return pd.DataFrame({"id": q[id_col].to_numpy(), "label": q[label].to_numpy(), "near": [r[np.isfinite(r)] for r in inside], "gap": np.where(same, np.inf, d).min(axis=1)})

    kind = df.schema[id_col].dataType.simpleString()
    parts = distances.per_point(rows, rows, id_col, features, fn, f"id {kind}, label int, near array<double>, gap double", [label])
    # The nearest of all is the row itself.
    near = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 2, k)
    points = parts.groupBy("id", "label").agg(F.coalesce(F.array_max(near), F.lit(0.0)).alias("core"), F.min("gap").alias("gap"))
    per = points.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max("core").alias("dens"), F.min("gap").alias("sep"))
    v = (F.col("sep") - F.col("dens")) / F.greatest("sep", "dens", F.lit(1e-300))
    return per.agg((F.sum(v * F.col("n")) / F.sum("n")).alias("dbcv"))


def hopkins(df: DataFrame, id_col: str, features: list[str], m: int | None = None, seed: int = 42) -> float:
    """Hopkins statistic from m sampled rows and m uniform points, each with its nearest other row. Sample and points are hashed from the ids."""
    from .sampling import uniform_sample

    n = df.count()
    m = m or min(150, max(n // 5, 5), 200, n)
    rows = distances.bounded_rows(uniform_sample(df.select(id_col, *features), id_col, m, seed))
    box = df.agg(*[F.min(f) for f in features], *[F.max(f) for f in features]).first()
    d = len(features)
    low, high = np.array(box[:d], float), np.array(box[d:], float)
    draw = np.array([[int(md5(f"{i}-hopkins{seed}-{j}".encode()).hexdigest()[:8], 16) / 4294967296 for j in range(d)] for i in rows[id_col]]).reshape(-1, d)
    u = low + (high - low) * draw
    w = rows[features].to_numpy(float)
    shared = df.sparkSession.sparkContext.broadcast((u, w, rows[id_col].to_numpy()))

    def run(batches):
        u, w, ids = shared.value
        bu, bw = np.full(len(u), np.inf), np.full(len(w), np.inf)
        for pdf in batches:
            for lo in range(0, len(pdf), 2048):
                part = pdf.iloc[lo : lo + 2048]
                x = part[features].to_numpy(float)
                bu = np.minimum(bu, distances.pairwise(u, x).min(axis=1))
                away = distances.pairwise(w, x)
                away[ids[:, None] == part[id_col].to_numpy()[None, :]] = np.inf
                bw = np.minimum(bw, away.min(axis=1))
        yield pd.DataFrame({"i": np.arange(len(u)), "u": bu, "w": bw})

    best = df.select(id_col, *features).mapInPandas(run, "i int, u double, w double").groupBy("i").agg(F.min("u").alias("u"), F.min("w").alias("w"))
    r = best.agg(F.sum(F.pow("u", F.lit(float(d)))).alias("u"), F.sum(F.pow("w", F.lit(float(d)))).alias("w")).first()
    return float(r.u / (r.u + r.w)) if r.u + r.w > 0 else 0.5


def normalised(metric: str, x: Column) -> Column:
    """A metric's value on 0 to 1, higher better."""
    one, zero = F.lit(1.0), F.lit(0.0)
    rule = {
        "silhouette": (x + 1) / 2,
        "davies_bouldin": F.greatest(zero, 1 - x / 5),
        "calinski_harabasz": F.least(one, F.log1p(x) / F.log1p(F.lit(10000.0))),
        "dunn": F.least(one, x),
        "xie_beni": F.greatest(zero, 1 - x / 10),
        "noise_ratio": 1 - x,
        "cluster_balance": x,
        "size_entropy": F.least(one, x / 3),
        "avg_intra_dist": F.greatest(zero, 1 - F.least(one, x / 5)),
        "avg_inter_dist": F.least(one, x / 5),
        "inertia_ratio": F.greatest(zero, 1 - x),  # inertia over the rows' total squares
    }
    return rule.get(metric, x)


#: Metrics that count in the composite score.
SCORED = ("silhouette", "davies_bouldin", "calinski_harabasz", "dunn", "xie_beni", "noise_ratio", "cluster_balance", "size_entropy", "avg_intra_dist", "avg_inter_dist", "inertia_ratio")


def composite(metrics: DataFrame) -> DataFrame:
    """algorithm_id, composite (0 to 100) of (algorithm_id, metric, value): the weighted mean of normalised values that are known."""
    norm, weight = F.lit(None).cast("double"), F.lit(1.0)
    for m in SCORED:
        norm = F.when(F.col("metric") == m, normalised(m, F.col("value"))).otherwise(norm)
        weight = F.when(F.col("metric") == m, F.lit(WEIGHTS.get(m, 1.0))).otherwise(weight)
    rows = metrics.withColumns({"_n": norm, "_w": weight}).where("_n IS NOT NULL")
    return rows.groupBy("algorithm_id").agg((F.sum(F.col("_n") * F.col("_w")) / F.sum("_w") * 100).alias("composite"))


def grade(x: Column) -> Column:
    return F.when(x >= 0.85, "Excellent").when(x >= 0.70, "Good").when(x >= 0.50, "Fair").when(x >= 0.30, "Poor").otherwise("Very Poor")


def _front(x: np.ndarray) -> np.ndarray:
    """The rows of distinct rows that no other beats. The first in descending order is one of them; what it beats goes, and so on."""
    x = x[np.lexsort(tuple(-x[:, j] for j in reversed(range(x.shape[1]))))]
    kept = []
    while len(x):
        kept.append(x[0])
        x = x[~(x <= x[0]).all(axis=1)]
    return np.array(kept).reshape(len(kept), x.shape[1])


def pareto(df: DataFrame, id_col: str, up: list[str], down: list[str]) -> DataFrame:
    """Rows that no other row beats: as good in every objective and better in one. A null or NaN objective is the worst value.

    Each task keeps the front of its scores; the fronts' fronts are taken by ever
    fewer tasks. Rows then meet the front by equality of all their scores.
    """
    from .graph import cut

    worst = F.lit(float("-inf"))
    known = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in (*up, *down)]
    names = [f"_o{i}" for i in range(len(known))]
    scores = [F.coalesce(c if i < len(up) else -c, worst).alias(n) for i, (c, n) in enumerate(zip(known, names, strict=True))]

    def fronts(batches):
        kept = np.zeros((0, len(names)))
        for pdf in batches:
            kept = _front(np.unique(np.concatenate([kept, pdf.to_numpy(float)]), axis=0))
        yield pd.DataFrame(kept, columns=names)

    kinds = ", ".join(f"{n} double" for n in names)
    # Written once: sums of doubles that are computed anew may end in other bits, and rows would miss their own scores.
    rows = cut(df.withColumns(dict(zip(names, scores, strict=True))))
    front = cut(rows.select(*names).mapInPandas(fronts, kinds))
    for tasks in (64, 8, 1):
        front = cut(front.coalesce(tasks).mapInPandas(fronts, kinds))
    return rows.join(front, names, "left_semi").select(*df.columns)


def cluster_statistics(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """Per cluster: n, share, mean, max and deviation of the distance to the centroid, and the nearest cluster."""
    rows, centres = with_centroid(df, label, features)
    near = []
    for a, x in centres:
        others = sorted((float(np.linalg.norm(np.subtract(x, y))), int(b)) for b, y in centres if b != a)
        near.append((int(a), others[0][1] if others else None, others[0][0] if others else None))
    nearest = df.sparkSession.createDataFrame(near, "label int, nearest int, nearest_distance double")
    d = F.sqrt("_d2")
    total = rows.count()
    per = rows.groupBy(F.col(label).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / F.lit(total)).alias("share"), F.avg(d).alias("mean_dist"), F.max(d).alias("max_dist"), F.stddev_pop(d).alias("std_dist"))
    return per.join(F.broadcast(nearest), "label")


def cluster_profiler(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """Long table: label, column_name, mean, std (population), min, max, median."""
    from .profile import long_form

    return long_form(clean(df, label), features, [label]).groupBy(label, "column_name").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.percentile("value", F.lit(0.5)).alias("median"))


def dispersion(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """log_wk: the log of the summed squares of each cluster of two rows and more over twice its size."""
    rows, _centres = with_centroid(df, label, features)
    per = rows.groupBy(label).agg(F.sum("_d2").alias("s"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return per.agg(F.log(F.greatest(F.coalesce(F.sum(F.col("s") / (2 * F.col("n"))), F.lit(0.0)), F.lit(1e-15))).alias("log_wk"))


def gap_curve(logs: DataFrame) -> DataFrame:
    """(k, gap, sk, log_wk, log_wk_ref) from (k, reference, log_wk): reference 0 is the data, others are uniform tables."""
    ref = F.when(F.col("reference") > 0, F.col("log_wk"))
    per = logs.groupBy("k").agg(F.max(F.when(F.col("reference") == 0, F.col("log_wk"))).alias("log_wk"), F.avg(ref).alias("log_wk_ref"), (F.stddev_pop(ref) * F.sqrt(1 + F.try_divide(F.lit(1.0), F.count(ref)))).alias("sk"))
    return per.select("k", (F.col("log_wk_ref") - F.col("log_wk")).alias("gap"), "sk", "log_wk", "log_wk_ref")


def gap_best_k(curve: DataFrame) -> DataFrame:
    """The smallest k whose gap is no less than the next one's less its sk; where there is none, the k of the largest gap."""
    after = curve.orderBy("k").select("k", "gap", F.lead("gap").over(Window.orderBy("k")).alias("g"), F.lead("sk").over(Window.orderBy("k")).alias("s"))  # one row for each k
    return after.agg(F.coalesce(F.min(F.when(F.col("gap") >= F.col("g") - F.col("s"), F.col("k"))), F.max_by("k", F.struct("gap", -F.col("k")))).alias("best_k"))


def gap_statistic(df: DataFrame, id_col: str, features: list[str], ks: range = range(1, 11), references: int = 10, seed: int = 42) -> DataFrame:
    """The gap curve of k-means against uniform tables over the data's box, drawn by hashing the ids."""
    from ..functions.expressions import hash_uniform
    from . import clustering

    box = df.agg(*[F.min(f).alias(f"a{i}") for i, f in enumerate(features)], *[F.max(f).alias(f"b{i}") for i, f in enumerate(features)]).first()
    rows = []
    for r in range(references + 1):
        table = df.select(id_col, *features) if r == 0 else df.select(id_col, *[(F.lit(box[f"a{i}"]) + F.lit((box[f"b{i}"] - box[f"a{i}"]) or 1.0) * hash_uniform(F.col(id_col), f"gap{seed}-{r}-{i}")).alias(f) for i, f in enumerate(features)])
        table = table.persist()
        for k in ks:
            centres, _cost = clustering.kmeans_fit(table, id_col, features, k, seed, 3 if r == 0 else 1)
            near = distances.nearest_centroid(table, [(i, c.tolist()) for i, c in enumerate(centres)], features, "label", "_d")
            rows.append((k, r, dispersion(near, "label", features).first()[0]))
        table.unpersist()
    return gap_curve(df.sparkSession.createDataFrame(rows, "k int, reference int, log_wk double"))


def silhouette_interval(samples: DataFrame, id_col: str = "id", draws: int = 50, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """mean, low, high and deviation of the mean silhouette over ``draws`` bootstrap draws: weights of Poisson(1) hashed from the ids, one aggregate for all draws."""
    from .sampling import poisson_weight

    weights = [poisson_weight(F.col(id_col), f"{seed}-{b}") for b in range(draws)]
    one = samples.agg(*[(F.sum(F.col("silhouette") * w) / F.sum(w)).alias(f"m{b}") for b, w in enumerate(weights)])
    means = one.select(F.explode(F.array(*[f"m{b}" for b in range(draws)])).alias("m"))
    a = (1 - confidence) / 2
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", F.lit(a)).alias("low"), F.percentile("m", F.lit(1 - a)).alias("high"), F.stddev_pop("m").alias("std"))


def clusterability(df: DataFrame, id_col: str, features: list[str], seed: int = 42) -> DataFrame:
    """One row: rows, features, Hopkins statistic, principal components for 90 % of the variance, features of variance below .001, and whether the rows cluster (Hopkins above .5)."""
    from .profile import covariance

    _mean, cov, n = covariance(df, features)
    values = np.maximum(np.linalg.eigvalsh(np.array(cov))[::-1], 0)
    dims = int(np.searchsorted(np.cumsum(values / max(values.sum(), 1e-300)), 0.90)) + 1
    h = hopkins(df, id_col, features, seed=seed)
    flat = int((np.diag(np.array(cov)) < 0.001).sum())
    return df.sparkSession.createDataFrame([(n, len(features), h, min(dims, len(features)), flat, h > 0.5)], "n_rows long, n_features int, hopkins double, dims_90 int, low_variance int, is_clusterable boolean")


def interpretation() -> Column:
    """A sentence or more on a result, from the columns algorithm_id, k, composite, silhouette, davies_bouldin, noise_ratio and cluster_balance."""
    c, s, d, n = F.col("composite"), F.col("silhouette"), F.col("davies_bouldin"), F.col("noise_ratio")
    quality = F.when(c >= 80, "excellent").when(c >= 65, "good").when(c >= 45, "moderate").otherwise("poor")
    shape = F.when(s > 0.7, "dense, well separated clusters").when(s > 0.5, "fairly compact clusters").when(s > 0.25, "some structure with overlap").otherwise("weak structure")
    apart = F.when(d < 0.5, "excellent separation").when(d < 1.0, "acceptable separation").otherwise("possible overlap")
    noise = F.when(n > 0.15, F.format_string("High noise: %.1f %%.", n * 100)).when(n > 0, F.format_string("Noise: %.1f %%.", n * 100))
    return F.concat_ws(
        " ",
        F.format_string("%s found %d clusters, composite %.1f of 100 (%s).", F.col("algorithm_id"), F.col("k").cast("int"), c, quality),
        F.when(s.isNotNull(), F.format_string("Silhouette %.3f: %s.", s, shape)),
        F.when(d.isNotNull(), F.format_string("Davies-Bouldin %.3f: %s.", d, apart)),
        noise,
        F.when(F.col("cluster_balance") < 0.1, F.lit("One cluster dominates.")),
    )
