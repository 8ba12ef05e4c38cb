"""Input frames of the queries, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIMS = 64
FEATURES = [f"f{i + 1}" for i in range(DIMS)]


def every(template: str, separator: str = ", ") -> str:
    """``template`` for each feature ``{f}``."""
    return separator.join(template.format(f=f) for f in FEATURES)


_COLUMNS = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {f}" for i, f in enumerate(FEATURES))
POINTS = f"p AS (SELECT vec_id AS row_id, {_COLUMNS}, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings)"
CLEAN = POINTS + ", q AS (SELECT * REPLACE (CASE WHEN f3 > 0.15 THEN -1 ELSE label END AS label) FROM p)"
CENTRES = CLEAN + f", c AS (SELECT label, count(*) AS n, {every('avg({f}) AS {f}')}, [{every('avg({f})')}] AS e FROM q WHERE label <> -1 GROUP BY label)"
DIST = "list_distance(a.e, b.e)"
RUNS = POINTS + """, runs AS (
  SELECT 'r0' AS run, row_id, label FROM p
  UNION ALL SELECT 'r1', row_id, (label + CASE WHEN f1 > 0 THEN 1 ELSE 0 END) % 10 FROM p
  UNION ALL SELECT 'r2', row_id, CASE WHEN f3 > 0.15 THEN -1 ELSE label END FROM p
  UNION ALL SELECT 'r3', row_id, CAST(row_id % 5 AS INTEGER) FROM p
  UNION ALL SELECT 'r4', row_id, CASE WHEN f2 > 0 THEN label ELSE 9 - label END FROM p)"""
LONG_LINE = "l AS (SELECT 'l_quantity' AS column_name, l_quantity AS value FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem)"
LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(FEATURES)], "label")


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of which some count as noise."""
    return points(spark, sf_dir).withColumn("label", F.when(F.col("f3") > 0.15, F.lit(-1)).otherwise(F.col("label")))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five labelings of the points as one long table; the points are read once."""
    p = points(spark, sf_dir)
    f = F.col
    labels = {
        "r0": f("label"),
        "r1": (f("label") + F.when(f("f1") > 0, 1).otherwise(0)) % 10,
        "r2": F.when(f("f3") > 0.15, F.lit(-1)).otherwise(f("label")),
        "r3": (f("row_id") % 5).cast("int"),
        "r4": F.when(f("f2") > 0, f("label")).otherwise(9 - f("label")),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("run"), v.cast("int").alias("label")) for k, v in labels.items()])
    return p.select("row_id", F.explode(rows).alias("r")).select("r.run", "row_id", "r.label")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, for comparison across engines; -0.0 becomes 0.0."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
