"""Profiles of tables and columns, and the statistics that build on them."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .order import numbered, quantiles, running_sum


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def split_types(df: DataFrame, as_numeric: list[str] | None = None, as_categorical: list[str] | None = None) -> tuple[list[str], list[str]]:
    """Numeric and other columns; the lists override the schema."""
    numeric = [c for c in numeric_columns(df) if c not in (as_categorical or [])]
    numeric += [c for c in (as_numeric or []) if c not in numeric]
    return numeric, [c for c in df.columns if c not in numeric]


def long_form(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """Columns as rows: (keep..., column_name, value)."""
    return df.select(*(keep or []), F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns])).alias("_p")).select(*(keep or []), "_p.*")


def skewness(m: str = "value") -> Column:
    """Sample skewness with the bias correction (G1)."""
    n = F.count(m)
    return F.when(n > 2, F.skewness(m) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis(m: str = "value") -> Column:
    """Sample excess kurtosis with the bias correction (G2)."""
    n = F.count(m)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(m) + 6))


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per numeric column: counts, moments, quartiles, outliers by 1.5 IQR, and flags.

    Moments are one wide aggregate, distinct values one combining aggregate by
    (column, value), quartiles a few histograms (``order.quantiles``), outliers one
    more aggregate; only one row for each column comes to the driver.
    """
    columns = columns or numeric_columns(df)
    spark = df.sparkSession
    fns = {
        "n_present": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "skew": skewness, "kurtosis": kurtosis,
    }
    cast = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    one = cast.agg(F.count(F.lit(1)).alias("n"), *[f(F.col(c)).alias(f"{k}_{i}") for i, c in enumerate(columns) for k, f in fns.items()]).first()
    unique = {r.column_name: r.n for r in long_form(cast, columns).where("value IS NOT NULL").distinct().groupBy("column_name").agg(F.count(F.lit(1)).alias("n")).collect()}
    quarters = quantiles(cast, columns, [0.25, 0.5, 0.75])
    fences = {c: (q[0] - 1.5 * (q[2] - q[0]), q[2] + 1.5 * (q[2] - q[0])) for c, q in quarters.items() if q[0] is not None}
    beyond = cast.agg(*[F.count_if((F.col(c) < F.lit(a)) | (F.col(c) > F.lit(b))).alias(f"o{columns.index(c)}") for c, (a, b) in fences.items()]).first() if fences else {}
    rows = []
    for i, c in enumerate(columns):
        k = unique.get(c, 0)
        got = {f: one[f"{f}_{i}"] for f in fns}
        missing = one.n - got["n_present"]
        rows.append(
            (c, one.n, got["n_present"], k, got["mean"], got["std"], got["min"], got["max"], *quarters[c], got["skew"], got["kurtosis"], beyond[f"o{i}"] if c in fences else 0,
             missing, missing / one.n * 100 if one.n else None, k <= 1, k == 2, k <= 20)
        )
    kinds = "column_name string, n long, n_present long, n_unique long, mean double, std double, min double, max double, q25 double, median double, q75 double, skew double, kurtosis double, n_outliers long, n_missing long, missing_pct double, is_constant boolean, is_binary boolean, is_categorical boolean"
    return spark.createDataFrame(rows, kinds)


def top_values(df: DataFrame, column: str, limit: int = 10) -> DataFrame:
    """The most frequent values: value, n."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(limit)


def table_profile(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells, duplicate rows and a hash of the content that ignores row order."""
    every = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    missing = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("long") for c in df.columns])
    return every.agg(
        F.sum("_n").alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.sum(missing * F.col("_n")).alias("n_missing"),
        F.sum(F.col("_n") - 1).alias("n_duplicates"),
    )


def content_hash(df: DataFrame) -> int:
    """Order-free hash of all rows."""
    return int(df.agg(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()[0] or 0)


def dropped_columns(df: DataFrame, max_missing: float = 0.99) -> DataFrame:
    """For each column: share of missing values, distinct values, and whether it is dropped (missing or constant)."""
    stats = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"c_{c}") for c in df.columns], *[F.count_distinct(c).alias(f"u_{c}") for c in df.columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), (1 - F.col(f"c_{c}") / F.col("n")).alias("missing_share"), F.col(f"u_{c}").alias("n_unique")) for c in df.columns])
    return stats.select(F.explode(rows).alias("r")).select("r.*").withColumn("dropped", (F.col("missing_share") >= max_missing) | (F.col("n_unique") <= 1))


def correlation_pairs(df: DataFrame, columns: list[str], least: float = 0.0) -> DataFrame:
    """Pearson correlation of each two columns with |r| >= ``least``: one pass for all pairs."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(rows).alias("p")).select("p.*").where(F.abs("r") >= least)


def covariance(df: DataFrame, columns: list[str]) -> tuple[list[float], list[list[float]], int]:
    """Means, population covariances and rows: one aggregate, and beyond a few columns a second of products around the means."""
    d = len(columns)
    if d <= 8:
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        row = df.agg(F.count(F.lit(1)), *[F.avg(c) for c in columns], *[F.covar_pop(columns[i], columns[j]) for i, j in pairs]).first()
        cov = [[0.0] * d for _ in range(d)]
        for (i, j), v in zip(pairs, row[1 + d :], strict=True):
            cov[i][j] = cov[j][i] = float(v)
        return [float(v) for v in row[1 : 1 + d]], cov, int(row[0])
    row = df.agg(F.count(F.lit(1)), *[F.avg(c) for c in columns]).first()
    mean, n = np.array(row[1:], float), int(row[0])

    def run(batches):
        total = np.zeros((d, d))
        for pdf in batches:
            x = pdf.to_numpy(float) - mean
            total += x.T @ x
        yield pd.DataFrame({"i": range(d), "v": list(total)})

    parts = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).mapInPandas(run, "i int, v array<double>")
    rows = parts.groupBy("i").agg(*[F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(d)]).orderBy("i").collect()
    return mean.tolist(), [[v / n for v in list(r)[1:]] for r in rows], n


def variance_importance(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """Between-cluster over total variance of each feature, noise left out."""
    rows = long_form(df.where(F.col(label) != -1), features, [label])
    groups = rows.groupBy("column_name", label).agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.sum("value").alias("s"), F.sum(F.col("value") ** 2).alias("ss"))
    return (
        groups.groupBy("column_name")
        .agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("n") * F.col("m") ** 2).alias("between"))
        .select("column_name", ((F.col("between") - F.col("s") ** 2 / F.col("n")) / (F.col("ss") - F.col("s") ** 2 / F.col("n"))).alias("importance"))
    )


def anova_f(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """One-way ANOVA F of each feature over the clusters."""
    rows = long_form(df.where(F.col(label) != -1), features, [label])
    groups = rows.groupBy("column_name", label).agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    return (
        groups.groupBy("column_name")
        .agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") ** 2).alias("sm"), F.sum(F.col("n") * F.col("v")).alias("within"))
        .select("column_name", (((F.col("sm") - F.col("s") ** 2 / F.col("n")) / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))).alias("f_stat"))
    )


def kruskal_h(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """Kruskal-Wallis H of each feature with tie correction.

    Ranks come from running counts of distinct values, so that equal values cost
    one row and no column is ordered in one task.
    """
    rows = long_form(df.where(F.col(label) != -1), features, [label])
    counts = rows.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("t"))
    ranks = running_sum(counts, ["column_name"], ["value"], F.col("t"), "_upto").select("column_name", "value", "t", (F.col("_upto") - F.col("t") + (F.col("t") + 1) / 2).alias("rank"))
    ties = counts.groupBy("column_name").agg(F.sum("t").alias("n"), F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"))
    sums = rows.join(ranks, ["column_name", "value"]).groupBy("column_name", label).agg(F.sum("rank").alias("r"), F.count(F.lit(1)).alias("m"))
    n = F.col("n")
    return (
        sums.groupBy("column_name")
        .agg(F.sum(F.col("r") ** 2 / F.col("m")).alias("q"))
        .join(ties, "column_name")
        .select("column_name", ((12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (n**3 - n))).alias("h_stat"))
    )


def smart_types(df: DataFrame, columns: list[str], order_col: str) -> DataFrame:
    """What kind of column each is: id-like, constant, skewed, flat-topped, monotonic, autocorrelated."""
    out = []
    n = df.count()
    # Each row meets the one before it by row number.
    rows = numbered(df.select(F.col(order_col).alias("_order"), *columns), ["_order"], "_at")
    before = rows.select((F.col("_at") + 1).alias("_at"), *[F.col(c).alias(f"_l_{c}") for c in columns])
    lagged = rows.join(before, "_at", "left")
    aggs = []
    for c in columns:
        step = F.col(c) - F.col(f"_l_{c}")
        aggs += [
            (F.count_distinct(c) / F.lit(max(n, 1))).alias(f"u_{c}"),
            F.count_distinct(c).alias(f"k_{c}"),
            skewness(c).alias(f"s_{c}"),
            kurtosis(c).alias(f"q_{c}"),
            F.avg((step > 0).cast("double")).alias(f"up_{c}"),
            F.avg((step < 0).cast("double")).alias(f"dn_{c}"),
            F.corr(c, f"_l_{c}").alias(f"a_{c}"),
        ]
    one = lagged.agg(*aggs)
    for c in columns:
        out.append(
            F.struct(
                F.lit(c).alias("column_name"),
                (F.col(f"u_{c}") > 0.95).alias("id_like"),
                (F.col(f"k_{c}") <= 1).alias("constant"),
                F.coalesce(F.abs(F.col(f"s_{c}")) > 2.5, F.lit(False)).alias("skewed"),
                F.coalesce(F.col(f"q_{c}") < -0.5, F.lit(False)).alias("maybe_bimodal"),
                F.coalesce((F.col(f"up_{c}") > 0.98) | (F.col(f"dn_{c}") > 0.98), F.lit(False)).alias("monotonic"),
                F.coalesce(F.abs(F.col(f"a_{c}")) > 0.85, F.lit(False)).alias("autocorrelated"),
            )
        )
    return one.select(F.explode(F.array(*out)).alias("r")).select("r.*")


def centroid_heatmap(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """(label, column_name, z): each cluster's mean of each feature, standardised over the clusters."""
    means = long_form(df.where(F.col(label) != -1), features, [label]).groupBy(label, "column_name").agg(F.avg("value").alias("m"))
    over = Window.partitionBy("column_name")  # one row for each cluster
    return means.select(label, "column_name", ((F.col("m") - F.avg("m").over(over)) / F.stddev_pop("m").over(over)).alias("z"))


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin, low, high, n) of equal widths from the least to the largest value; empty bins have no row."""
    ends = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    low, width = ends[0] or 0.0, ((ends[1] or 0.0) - (ends[0] or 0.0)) / bins or 1.0
    at = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit((width * bins) or 1.0) * bins), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("bin", (F.lit(low) + F.col("bin") * F.lit(width)).alias("low"), (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("high"), "n")
