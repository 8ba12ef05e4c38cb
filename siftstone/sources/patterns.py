"""Synthetic two-dimensional patterns from hashed uniforms: no driver-side data at any size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import hash_normal, hash_uniform

PI = math.pi
#: Names of the patterns: fixed values.
PATTERNS = (
    "blobs_isotropic blobs_anisotropic blobs_varied_sizes moons circles swiss_roll s_curve blobs_with_noise tight_with_outliers nested_circles hierarchical_blobs "
    "unequal_density elongated_clusters heavily_overlapped slightly_overlapped halfmoons_rotated donuts blob_in_circle stripes random_uniform galaxy_spiral checkerboard figure_eight star_clusters crescents"
).split()


def _ring(t: Column, r: Column | float) -> tuple[Column, Column]:
    return F.cos(t) * r, F.sin(t) * r


def raw_pattern(spark: SparkSession, name: str, n: int = 300, k: int = 5, seed: int = 42, noise: float = 0.05) -> DataFrame:
    """row_id, x, y, label before scaling. The row number deals rows over clusters."""
    i = F.col("row_id")
    u = lambda s: hash_uniform(i, f"{s}{seed}")
    g = lambda s: hash_normal(i, f"{s}{seed}")
    t = 2 * PI * u("t")
    two, c = i % 2, i % k
    centre = lambda r=4.0: _ring(c * (2 * PI / k), r)

    def blobs(spread: Column | float, r: float = 4.0):
        x, y = centre(r)
        return x + g("x") * spread, y + g("y") * spread, c

    up = F.when(two == 0, 1).otherwise(-1)
    half = PI * u("t")
    moon = (F.cos(half) * up + F.when(two == 0, 0).otherwise(1), F.sin(half) * up + F.when(two == 0, 0).otherwise(0.5))
    outlier = i % 10 == 9
    if name == "blobs_isotropic":
        x, y, label = blobs(0.6)
    elif name == "blobs_anisotropic":
        x, y, label = blobs(0.8)
        x, y = 0.6 * x - 0.6 * y, -0.4 * x + 0.8 * y
    elif name == "blobs_varied_sizes":
        x, y, label = blobs(0.3 + 0.3 * c)
    elif name in ("moons", "crescents"):
        (x, y), label = moon, two
    elif name == "halfmoons_rotated":
        (a, b), label = moon, two
        x, y = a * math.cos(0.8) - b * math.sin(0.8), a * math.sin(0.8) + b * math.cos(0.8)
    elif name == "circles":
        (x, y), label = _ring(t, F.when(two == 0, 1.0).otherwise(0.5)), two
    elif name == "nested_circles":
        r = 1.0 + 3.5 * c / max(k - 1, 1)
        (x, y), label = _ring(t, r + (0.8 * noise * r * g("r") if noise else 0.0)), c
    elif name == "donuts":
        (x, y), label = _ring(t, 1.0 + 0.3 * u("r")), two
        x = x + 3 * two
    elif name == "blob_in_circle":
        a, b = _ring(t, 3.0)
        x, y, label = F.when(two == 0, a).otherwise(g("x") * 0.5), F.when(two == 0, b).otherwise(g("y") * 0.5), two
    elif name == "swiss_roll":
        s = 1.5 * PI * (1 + 2 * u("t"))
        x, y, label = s * F.cos(s), s * F.sin(s), F.floor(u("t") * k)
    elif name == "s_curve":
        s = 3 * PI * (u("t") - 0.5)
        x, y, label = F.sin(s), F.signum(s) * (F.cos(s) - 1), F.floor(u("t") * k)
    elif name in ("blobs_with_noise", "tight_with_outliers"):
        x, y, label = blobs(0.5 if name == "blobs_with_noise" else 0.15)
        x, y, label = F.when(outlier, 12 * u("a") - 6).otherwise(x), F.when(outlier, 12 * u("b") - 6).otherwise(y), F.when(outlier, -1).otherwise(label)
    elif name == "hierarchical_blobs":
        x, y, label = blobs(0.25)
        x, y, label = x + F.when(two == 0, 0.8).otherwise(-0.8), y, label * 2 + two
    elif name == "unequal_density":
        x, y, label = blobs(0.15 + 0.25 * c)
    elif name == "elongated_clusters":
        x, y, label = g("x") * 3, c * 2.0 + g("y") * 0.2, c
    elif name == "heavily_overlapped":
        x, y, label = blobs(1.6, 2.0)
    elif name == "slightly_overlapped":
        x, y, label = blobs(1.0, 3.0)
    elif name == "stripes":
        x, y, label = 10 * u("x"), c * 2.0 + u("y"), c
    elif name == "random_uniform":
        x, y, label = 10 * u("x"), 10 * u("y"), F.lit(0)
    elif name == "galaxy_spiral":
        s = 4 * u("t")
        x, y = _ring(s + c * (2 * PI / k), s)
        label = c
    elif name == "checkerboard":
        a, b = F.floor(4 * u("x")), F.floor(4 * u("y"))
        x, y, label = 2 * a + (a + b) % 2 + u("p"), 2 * b + u("q"), ((a + b) % 2)
    elif name == "figure_eight":
        x, y, label = F.sin(t), F.sin(t) * F.cos(t), F.when(F.sin(t) >= 0, 1).otherwise(0)
    elif name == "star_clusters":
        r = 4 * u("r")
        x, y = _ring(c * (2 * PI / k), r)
        label = c
    else:
        raise ValueError(f"unknown pattern {name}")
    if noise and name in ("moons", "crescents", "halfmoons_rotated", "circles", "swiss_roll", "s_curve", "galaxy_spiral", "figure_eight", "star_clusters", "donuts", "blob_in_circle"):
        x, y = x + noise * g("nx"), y + noise * g("ny")
    return spark.range(n).withColumnRenamed("id", "row_id").select("row_id", x.cast("double").alias("x"), y.cast("double").alias("y"), label.cast("int").alias("label"))


def normalise(df: DataFrame, x: str = "x", y: str = "y", extent: float = 8.5 * 0.9) -> DataFrame:
    """Centred, then scaled alike in both directions so that the largest coordinate is ``extent``."""
    m = df.agg(F.avg(x).alias("a"), F.avg(y).alias("b"), F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")).first()
    if m.a is None:
        return df
    widest = max(m.a - m.x0, m.x1 - m.a, m.b - m.y0, m.y1 - m.b) or 1.0
    return df.withColumns({x: (F.col(x) - m.a) / F.lit(widest) * extent, y: (F.col(y) - m.b) / F.lit(widest) * extent})


def pattern(spark: SparkSession, name: str, n: int = 300, k: int = 5, seed: int = 42) -> DataFrame:
    return normalise(raw_pattern(spark, name, n, k, seed))


def blobs(spark: SparkSession, n: int, d: int, k: int, seed: int = 42, spread: float = 1.0) -> DataFrame:
    """Gaussian blobs: row_id, f1..fd, label; centres uniform in [-10, 10]."""
    import numpy as np

    centres = np.random.default_rng(seed).uniform(-10, 10, (k, d))
    c = (F.col("row_id") % k).cast("int")
    columns = [(F.array(*[F.lit(float(v)) for v in centres[:, j]])[c] + spread * hash_normal(F.col("row_id"), f"b{j}{seed}")).alias(f"f{j + 1}") for j in range(d)]
    return spark.range(n).withColumnRenamed("id", "row_id").select("row_id", *columns, c.alias("label"))


#: Named sample tables: rows, features, classes, spread. Fixed values.
DATASETS = {
    "blobs_3": (1000, 5, 3, 1.0),
    "blobs_7": (2000, 8, 7, 1.0),
    "moons": (1000, 2, 2, 0.08),
    "circles": (1000, 2, 2, 0.05),
    "anisotropic": (1000, 2, 3, 1.0),
    "iris_like": (150, 4, 3, 1.0),
    "wine_like": (178, 13, 3, 1.0),
    "cancer_like": (569, 30, 2, 1.0),
    "high_dimensional": (1500, 20, 5, 1.0),
    "noisy_blobs": (1200, 6, 4, 2.5),
}
#: Means and deviations of the three iris species (sepal length and width, petal length and width): fixed values.
IRIS = (
    ((5.006, 3.428, 1.462, 0.246), (0.352, 0.379, 0.174, 0.105)),
    ((5.936, 2.770, 4.260, 1.326), (0.516, 0.314, 0.470, 0.198)),
    ((6.588, 2.974, 5.552, 2.026), (0.636, 0.322, 0.552, 0.275)),
)


def dataset(spark: SparkSession, name: str, seed: int = 42) -> DataFrame:
    """row_id, feature_0, ..., true_label of a sample table.

    The measured sets (iris, wine, cancer) are not copied: normal classes of the
    same size and shape stand for them, for iris with its species' means and
    deviations.
    """
    n, d, k, spread = DATASETS[name]
    if name in ("moons", "circles"):
        t = raw_pattern(spark, name, n, k, seed, spread)
        return t.select("row_id", F.col("x").alias("feature_0"), F.col("y").alias("feature_1"), F.col("label").alias("true_label"))
    if name == "high_dimensional":
        return classification(spark, n, d, 10, k, seed, noise=0.0).withColumnRenamed("target", "true_label")
    if name == "iris_like":
        c = (F.col("row_id") % k).cast("int")
        pick = lambda j, part: F.array(*[F.lit(species[part][j]) for species in IRIS])[c]
        return spark.range(n).withColumnRenamed("id", "row_id").select("row_id", *[(pick(j, 0) + pick(j, 1) * hash_normal(F.col("row_id"), f"i{j}{seed}")).alias(f"feature_{j}") for j in range(d)], c.alias("true_label"))
    t = blobs(spark, n, d, k, seed, spread)
    columns = [F.col(f"f{j + 1}") for j in range(d)]
    if name == "anisotropic":
        columns = [0.6 * columns[0] - 0.6 * columns[1], -0.4 * columns[0] + 0.8 * columns[1]]
    return t.select("row_id", *[c.alias(f"feature_{j}") for j, c in enumerate(columns)], F.col("label").alias("true_label"))


def classification(spark: SparkSession, n: int = 10_000, d: int = 20, informative: int = 15, k: int = 5, seed: int = 42, noise: float = 0.5) -> DataFrame:
    """row_id, feature_0, ..., target: classes around corners of a cube in the informative features, the others being mixtures of these; normal noise on all."""
    import numpy as np

    rng = np.random.default_rng(seed)
    corners = rng.integers(0, 2, (k, informative)) * 2.0 - 1.0
    mix = rng.uniform(-1, 1, (d - informative, informative))
    i, c = F.col("row_id"), (F.col("row_id") % k).cast("int")
    base = [F.array(*[F.lit(float(v)) for v in corners[:, j]])[c] + hash_normal(i, f"c{j}{seed}") for j in range(informative)]
    rows = spark.range(n).withColumnRenamed("id", "row_id").select("row_id", c.alias("target"), *[b.alias(f"b{j}") for j, b in enumerate(base)])
    columns = [F.col(f"b{j}") for j in range(informative)]
    columns += [sum((F.lit(float(w)) * F.col(f"b{j}") for j, w in enumerate(m)), F.lit(0.0)) for m in mix]
    return rows.select("row_id", *[(x + noise * hash_normal(i, f"e{j}{seed}") if noise else x).alias(f"feature_{j}") for j, x in enumerate(columns)], "target")
