"""Functions that SQL may call: a table function over parameter grids and a distance of series."""

from __future__ import annotations

import itertools
import json

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class ParameterGrid:
    """Each combination of a JSON object of lists: number and params (JSON)."""

    def eval(self, grid: str):
        options = json.loads(grid or "{}")
        for number, values in enumerate(itertools.product(*options.values())):
            yield number, json.dumps(dict(zip(options, values, strict=True)))


def register(spark: SparkSession) -> None:
    """``parameter_grid(json)`` as a table function; ``dtw(a, b, window)`` over arrays."""
    from ..operators.clustering import dtw

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series, window: pd.Series) -> pd.Series:
        return pd.Series([dtw(np.asarray(x, float), np.asarray(y, float), None if w is None else int(w)) for x, y, w in zip(a, b, window, strict=True)])

    spark.udtf.register("parameter_grid", F.udtf(ParameterGrid, returnType="number int, params string"))
    spark.udf.register("dtw", distance)
