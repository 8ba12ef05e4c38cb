"""More than 10000 algorithms or runs: none is left out."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftstone.operators import consensus, metrics


def test_front_of_many_rows(spark):
    df = spark.range(10_050).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("up"), (-F.col("id")).cast("double").alias("down"))
    assert [r.row_id for r in metrics.pareto(df, "row_id", ["up"], ["down"]).collect()] == [10_049]


def test_front_of_scores_that_come_out_anew(spark):
    """Sums of doubles in another order end in other bits; a row on the front still meets its own scores."""
    drawn = F.pandas_udf(lambda v: pd.Series(np.random.default_rng().random(len(v))), "double").asNondeterministic()
    df = spark.range(40).withColumn("up", drawn("id"))
    assert metrics.pareto(df, "id", ["up"], []).count() == 1


def test_pairs_of_rows_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(consensus, "MEMBERS", 7)
    labels = {(r, i): -1 if (i + r) % 11 == 0 else i % (r + 2) for r in range(3) for i in range(60)}
    runs = spark.createDataFrame([(f"r{r}", i, v) for (r, i), v in labels.items()], "run string, row_id long, label int")
    got = consensus.coassociation(runs).where("c > 0.5")
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "Generate" in plan and "HashAggregate" not in plan.split("Generate")[0]
    want = {(i, j): sum(labels[r, i] == labels[r, j] != -1 for r in range(3)) / 3 for i in range(60) for j in range(i + 1, 60)}
    rows = got.collect()
    assert {(r.i, r.j): round(r.c, 9) for r in rows} == {k: round(c, 9) for k, c in want.items() if c > 0.5} and len(rows) == len({(r.i, r.j) for r in rows})


def test_weights_of_many_runs(spark):
    names = spark.range(10_050).select(F.col("id").cast("string").alias("run"))
    runs = names.select("run", F.explode(F.expr("array(1L, 2L)")).alias("row_id"), F.lit(0).alias("label"))
    weights = spark.range(10_050).select(F.col("id").cast("string").alias("run"), F.lit(2.0).alias("weight"))
    pairs = consensus.coassociation(runs, weights).collect()
    assert [(r.i, r.j, r.c) for r in pairs] == [(1, 2, pytest.approx(1.0))]
