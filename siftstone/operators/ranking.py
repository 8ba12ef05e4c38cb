"""Ranking, curves over k, and relabelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .order import numbered

def rank_by(df: DataFrame, score: str, id_col: str, descending: bool = True) -> DataFrame:
    """rank 1..n by a score; nulls last, ties by id."""
    order = F.col(score).desc_nulls_last() if descending else F.col(score).asc_nulls_last()
    return numbered(df, [order, F.col(id_col)]).withColumn("rank", F.col("rank").cast("int"))


def leaderboard(df: DataFrame, id_col: str, score: str, n: int = 10) -> DataFrame:
    """mean, sample deviation, count, max and min of each id's scores, best means first."""
    return df.groupBy(id_col).agg(F.round(F.avg(score), 4).alias("mean"), F.round(F.stddev_samp(score), 4).alias("std"), F.count(score).alias("n"), F.round(F.max(score), 4).alias("max"), F.round(F.min(score), 4).alias("min")).orderBy(F.desc("mean"), id_col).limit(n)


def win_rates(df: DataFrame, id_col: str, contest: str, score: str) -> DataFrame:
    """Share of contests in which an id ranks first (ties by id)."""
    first = Window.partitionBy(contest).orderBy(F.col(score).desc_nulls_last(), id_col)
    ranked = df.withColumn("_r", F.row_number().over(first))
    return ranked.groupBy(id_col).agg(F.count_if(F.col("_r") == 1).alias("wins"), F.count(F.lit(1)).alias("contests"), (F.count_if(F.col("_r") == 1) / F.count(F.lit(1))).alias("win_rate"))


def win_matrix(df: DataFrame, id_col: str, contest: str, score: str) -> DataFrame:
    """How often a beats b over the contests both took part in: a, b, wins, contests."""
    a = df.select(F.col(contest), F.col(id_col).alias("a"), F.col(score).alias("sa"))
    b = df.select(F.col(contest), F.col(id_col).alias("b"), F.col(score).alias("sb"))
    return a.join(b, contest).where("a <> b").groupBy("a", "b").agg(F.count_if(F.col("sa") > F.col("sb")).alias("wins"), F.count(F.lit(1)).alias("contests"))


def elbow(df: DataFrame, k: str, cost: str) -> DataFrame:
    """The k at which the second difference of the cost is largest."""
    w = Window.orderBy(k)
    second = F.lag(cost).over(w) - 2 * F.col(cost) + F.lead(cost).over(w)
    return df.withColumn("_d", second).where("_d IS NOT NULL").agg(F.max_by(k, F.struct("_d", -F.col(k))).alias("best_k"))


def kneedle(df: DataFrame, k: str, score: str) -> DataFrame:
    """The k at which the curve, both axes on 0 to 1, lies farthest above (rising) or below (falling) the diagonal."""
    s = df.agg(F.min(k).alias("k0"), F.max(k).alias("k1"), F.min(score).alias("s0"), F.max(score).alias("s1"), F.min_by(score, k).alias("sf"), F.max_by(score, k).alias("sl")).first()
    if s is None or s.k0 is None:
        return df.select(F.col(k).alias("best_k")).limit(0)
    x = (F.col(k) - F.lit(s.k0)) / F.lit(float(s.k1 - s.k0) or 1.0)
    y = (F.col(score) - F.lit(s.s0)) / F.lit(float(s.s1 - s.s0) or 1.0)
    gap = y - x if s.sl >= s.sf else 1 - x - y
    return df.withColumn("_g", gap).agg(F.max_by(k, F.struct("_g", -F.col(k))).alias("best_k"))


def eps_by_second_difference(curve: DataFrame, rank: str, distance: str, floor: float = 0.05) -> DataFrame:
    """eps where the second difference of the descending k-distance curve is largest, at least ``floor``. Ranks meet by number."""
    one, two = (curve.select((F.col(rank) - k).alias(rank), F.col(distance).alias(f"_e{k}")) for k in (1, 2))
    rows = curve.join(one, rank).join(two, rank).withColumn("_d", F.col(distance) - 2 * F.col("_e1") + F.col("_e2")).withColumn("_e", F.col("_e1"))
    return rows.agg(F.greatest(F.max_by("_e", F.struct("_d", -F.col(rank))), F.lit(floor)).alias("eps"))


def k_distance_curve(df: DataFrame, id_col: str, features: list[str], k: int = 5) -> DataFrame:
    """(id, distance, rank): the distance of each row to its ``k``-th neighbour, largest first."""
    from . import distances

    near = distances.knn(df, id_col, features, k).where(F.col("rank") == k).select("id", "distance")
    return rank_by(near, "distance", "id")


def eps_by_knee(curve: DataFrame, rank: str, distance: str, floor: float = 0.05) -> DataFrame:
    """eps at the knee of the descending k-distance curve, at least ``floor``."""
    knee = kneedle(curve, rank, distance).withColumnRenamed("best_k", rank)  # one row
    return curve.join(F.broadcast(knee), rank).select(F.greatest(F.col(distance), F.lit(floor)).alias("eps"))


def relabel_by_size(df: DataFrame, label: str) -> DataFrame:
    """Largest cluster 0, next 1, ...; ties by old label; noise stays -1. The map has one row for each cluster."""
    sizes = df.where(F.col(label) != -1).groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    new = sizes.select(F.col(label).alias("_old"), (F.row_number().over(Window.orderBy(F.desc("_n"), label)) - 1).alias("_new"))
    return df.join(new, F.col(label) == F.col("_old"), "left").withColumn(label, F.coalesce("_new", F.lit(-1))).drop("_old", "_new")


def canonical_labels(df: DataFrame, id_col: str, label: str, run: str | None = None) -> DataFrame:
    """Clusters numbered by their first row; noise stays -1."""
    keys = [run] if run else []
    first = df.where(F.col(label) != -1).groupBy(*keys, label).agg(F.min(id_col).alias("_f"))
    new = first.select(*keys, F.col(label).alias("_old"), (F.row_number().over(Window.partitionBy(*keys).orderBy("_f") if keys else Window.orderBy("_f")) - 1).alias("_new"))
    on = [F.col(f"d.{k}") == F.col(f"m.{k}") for k in keys] + [F.col(f"d.{label}") == F.col("m._old")]
    return df.alias("d").join(new.alias("m"), on, "left").select(*[F.col(f"d.{c}") for c in df.columns if c != label], F.coalesce("m._new", F.lit(-1)).alias(label))


def fingerprints(df: DataFrame, id_col: str, label: str, run: str) -> DataFrame:
    """A fingerprint of each run's partition that doesn't depend on label names, and the first run that has it.

    The sum of hashes of (row, canonical label) takes one combining aggregate
    instead of a string of all labels.
    """
    rows = canonical_labels(df, id_col, label, run)
    mark = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.col(label).cast("string"))), 1, 12), 16, 10).cast("bigint")
    prints = rows.groupBy(run).agg(F.sum(mark.cast("decimal(38,0)")).cast("string").alias("_s")).withColumn("fingerprint", F.substring(F.md5("_s"), 1, 16)).drop("_s")
    return prints.withColumn("first_run", F.min(run).over(Window.partitionBy("fingerprint")))


def merge_small(df: DataFrame, label: str, least: int = 5) -> DataFrame:
    """Clusters below ``least`` rows join the smallest label of a large one, then all are renumbered by size."""
    sizes = {r[label]: r["count"] for r in df.where(F.col(label) != -1).groupBy(label).count().collect()}
    large = sorted(k for k, n in sizes.items() if n >= least)
    small = [k for k, n in sizes.items() if n < least]
    if large and small:
        df = df.withColumn(label, F.when(F.col(label).isin(small), F.lit(large[0])).otherwise(F.col(label)))
    return relabel_by_size(df, label)


def timeline(df: DataFrame, order: str, seconds: str) -> DataFrame:
    """Cumulative seconds in order of execution."""
    return df.withColumn("elapsed", F.sum(seconds).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def degenerate(k: Column, noise: Column) -> Column:
    """Whether a run failed: fewer than two clusters, or noise above 0.8."""
    return F.when(k < 2, "FAILED").when(noise > 0.8, "FAILED").otherwise("OK")


def trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman and Kendall coefficients of a short curve."""
    ranks = df.select(F.col(x).alias("x"), F.col(y).alias("y"), *[(F.rank().over(Window.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(c)) - 1) / 2).alias(f"r_{n}") for n, c in (("x", x), ("y", y))])
    spearman = ranks.agg(F.corr("r_x", "r_y").alias("spearman"))
    a, b = ranks.select(F.col("x").alias("x1"), F.col("y").alias("y1"), F.lit(1).alias("j")), ranks.select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.lit(1).alias("j"))
    pairs = a.join(b, "j").where("x1 < x2")
    kendall = pairs.agg((F.sum(F.signum(F.col("y2") - F.col("y1"))) / F.count(F.lit(1))).alias("kendall"))
    return spearman.withColumn("j", F.lit(1)).join(kendall.withColumn("j", F.lit(1)), "j").drop("j")
