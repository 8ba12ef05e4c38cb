"""Connected components for density clustering."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which all executors share; a temporary one only where all runs in one process."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc._jsc.sc().isLocal():
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="siftstone-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest id reachable from each node over edges (id, neighbour), read in both directions.

    Every round takes the smallest component among the neighbours and then the
    component's own component, which halves long paths.
    """
    both = cut(edges.select("id", "neighbour").union(edges.select("neighbour", "id")).where("id <> neighbour").distinct())
    comp = cut(nodes.select("id", F.col("id").alias("comp")))
    while True:
        near = both.join(comp.select(F.col("id").alias("neighbour"), F.col("comp").alias("c")), "neighbour").groupBy("id").agg(F.min("c").alias("c"))
        stepped = comp.join(near, "id", "left").select("id", F.least("comp", F.coalesce("c", "comp")).alias("comp"), F.col("comp").alias("old"))
        jump = stepped.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        new = cut(stepped.join(jump, "comp", "left").select("id", F.least("comp", F.coalesce("up", "comp")).alias("comp"), "old"))
        if new.where("comp <> old").isEmpty():
            return new.select("id", "comp")
        comp = new.select("id", "comp")
