"""Sampling operators. All draws are hashes of the row id and a seed, so they repeat on any cluster."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import hash_uniform
from . import distances


def uniform_sample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement: those whose hash is smallest (a distributed top-n)."""
    return df.orderBy(hash_uniform(F.col(id_col), seed), id_col).limit(n)


def stratified_sample(df: DataFrame, id_col: str, label: str, n: int, seed: int = 42) -> DataFrame:
    """From each label max(1, floor(n * share)) rows: those whose hash is smallest.

    Only rows whose hash may be among the smallest are ordered, some more than
    the sample needs; were they too few for a label, all rows are.
    """
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    total = df.count()
    want = F.greatest(F.lit(1), F.floor(F.lit(n) * F.col("_size") / F.lit(total)))
    hashed = df.withColumn("_u", hash_uniform(F.col(id_col), seed)).join(sizes.withColumn("_want", want), label)
    likely = hashed.where(F.col("_u") * F.col("_size") < F.col("_want") + 10 * F.sqrt("_want") + 20)
    short = likely.groupBy(label, "_size", "_want").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < F.least("_want", "_size"))
    enough = short.isEmpty() and likely.select(label).distinct().count() == sizes.count()
    order = Window.partitionBy(label).orderBy("_u", id_col)
    return (likely if enough else hashed).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= F.col("_want")).drop("_rank", "_size", "_u", "_want")


def density_sample(df: DataFrame, id_col: str, features: list[str], n: int, k: int = 10, seed: int = 42) -> DataFrame:
    """``n`` rows, each drawn in proportion to its mean distance to k neighbours: largest log(u)/w first."""
    weight = distances.knn(df, id_col, features, k).groupBy("id").agg(F.avg("distance").alias("_w"))
    key = F.log(F.greatest(hash_uniform(F.col(id_col), seed), F.lit(1e-12))) / F.greatest("_w", F.lit(1e-12))
    return df.join(weight, F.col(id_col) == F.col("id")).orderBy(key.desc(), id_col).limit(n).drop("id", "_w")


def geometric_sketch(df: DataFrame, id_col: str, features: list[str], n: int) -> list:
    """Ids of a farthest-point traversal from the smallest id, over at most MAX_REFERENCE rows."""
    rows = distances.bounded_rows(df.select(id_col, *features)).sort_values(id_col, ignore_index=True)
    x, picked = rows[features].to_numpy(float), [0]
    far = np.linalg.norm(x - x[0], axis=1)
    while len(picked) < min(n, len(x)):
        picked.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(x - x[picked[-1]], axis=1))
    return rows[id_col].iloc[picked].tolist()


def coreset_sample(df: DataFrame, id_col: str, features: list[str], centres: list[tuple[int, list[float]]]) -> DataFrame:
    """The row nearest to each centre, whichever centre that row is nearest to itself: k minima of one aggregate."""
    points = np.array([c for _, c in centres], float).reshape(len(centres), len(features))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            d = distances.pairwise(pdf[features].to_numpy(float), points)
            if len(pdf):
                order = np.lexsort((pdf[id_col].to_numpy(),))
                at = order[d[order].argmin(axis=0)]
                yield pd.DataFrame({"c": np.arange(len(points)), "d": d[at, np.arange(len(points))], "id": pdf[id_col].to_numpy()[at]})

    best = df.select(id_col, *features).mapInPandas(run, f"c int, d double, id {kind}").groupBy("c").agg(F.min(F.struct("d", "id")).alias("m")).select(F.col("m.id").alias("_id")).distinct()
    return df.join(F.broadcast(best), F.col(id_col) == F.col("_id"), "left_semi")  # one id for each centre


def poisson_weight(key, stream: int | str):
    """A Poisson(1) number hashed from the key: how often a row is drawn with replacement."""
    u = hash_uniform(key, stream)
    w, total, p = F.lit(0), 0.0, 0.36787944117144233
    for k in range(8):
        total += p
        w = w + F.when(u >= F.lit(total), 1).otherwise(0)
        p /= k + 1
    return w


def poisson_bootstrap(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """Rows with a weight of Poisson(1), the scalable form of drawing with replacement."""
    return df.withColumn("weight", poisson_weight(F.col(id_col), seed)).where("weight > 0")
