"""Readers and writers of tables. Every table gets an explicit row id, which filters and joins keep."""

from __future__ import annotations

import json
import logging
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts that mean a missing value: fixed values.
NULL_TOKENS = ("NA", "N/A", "na", "n/a", "NaN", "nan", "NULL", "null", "None", "none", "")
#: The most columns that are read; more are left out with a warning.
MAX_COLUMNS = 2_000

log = logging.getLogger(__name__)


def sanitise_names(names: list[str]) -> list[str]:
    """Trimmed; space, dot and slashes become ``_``, parentheses go; repeats get ``_1``, ``_2``, ..."""
    out: list[str] = []
    for name in names:
        clean = re.sub(r"[()]", "", re.sub(r"[ ./\\]", "_", str(name).strip())) or "column"
        unique, n = clean, 1
        while unique in out:
            unique, n = f"{clean}_{n}", n + 1
        out.append(unique)
    return out


def _first_columns(df: DataFrame, max_columns: int) -> DataFrame:
    if len(df.columns) > max_columns:
        log.warning("%d of %d columns are left out: %s ...", len(df.columns) - max_columns, len(df.columns), df.columns[max_columns : max_columns + 5])
    return df.select(*[f"`{c}`" for c in df.columns[:max_columns]])


def _tidy(df: DataFrame, max_columns: int) -> DataFrame:
    return _first_columns(df.toDF(*sanitise_names(df.columns)), max_columns)


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A unique id for each row. Write the table before using the ids in several jobs: they depend on its partitions."""
    return df if name in df.columns else df.withColumn(name, F.monotonically_increasing_id())


def read_csv(spark: SparkSession, path: str, sep: str = ",", max_rows: int | None = None, max_columns: int = MAX_COLUMNS, seed: int = 42) -> DataFrame:
    """Delimited text with a header; all null tokens become null before the types are inferred from the whole file.

    All rows are read; with ``max_rows`` a larger table is sampled by a hash of its rows.
    """
    text = spark.read.csv(path, sep=sep, header=True, inferSchema=False)
    text = _first_columns(text.toDF(*sanitise_names(text.columns)), max_columns)
    tokens = list(NULL_TOKENS)
    text = text.select(*[F.when(~F.trim(c).isin(tokens), F.col(c)).alias(c) for c in text.columns])
    # A column is a number if no value fails the cast: one aggregate for all columns.
    whole = text.agg(*[F.count_if(F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` AS bigint)").isNull()).alias(f"i{k}") for k, c in enumerate(text.columns)], *[F.count_if(F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` AS double)").isNull()).alias(f"d{k}") for k, c in enumerate(text.columns)]).first()
    kinds = ["bigint" if not whole[f"i{k}"] else "double" if not whole[f"d{k}"] else "string" for k in range(len(text.columns))]
    df = text.select(*[F.col(c).cast(t).alias(c) for c, t in zip(text.columns, kinds, strict=True)])
    if max_rows is not None and (n := df.count()) > max_rows:
        log.warning("%d of %d rows are sampled", max_rows, n)
        df = df.orderBy(F.xxhash64(F.lit(seed), *df.columns)).limit(max_rows)
    return df


def read_json(spark: SparkSession, path: str, max_columns: int = MAX_COLUMNS) -> DataFrame:
    """Records of one JSON document, or one record on each line, as the first line tells."""
    first = spark.read.text(path).where("trim(value) <> ''").first()
    try:
        by_line = first is not None and isinstance(json.loads(first.value), dict)
    except ValueError:
        by_line = False
    return _tidy(spark.read.json(path, multiLine=not by_line), max_columns)


def read_parquet(spark: SparkSession, path: str, max_columns: int = MAX_COLUMNS) -> DataFrame:
    return _tidy(spark.read.parquet(path), max_columns)


def read_excel(spark: SparkSession, path: str, max_columns: int = MAX_COLUMNS) -> DataFrame:
    """First sheet; needs an Excel reader for pandas on the driver."""
    import pandas as pd

    return _tidy(spark.createDataFrame(pd.read_excel(path)), max_columns)


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """Reads by extension; CSV where it is unknown."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind == ".parquet":
        return read_parquet(spark, path, **options)
    if kind in (".json", ".jsonl"):
        return read_json(spark, path, **options)
    if kind in (".xls", ".xlsx"):
        return read_excel(spark, path, **options)
    return read_csv(spark, path, sep="\t" if kind in (".tsv", ".tab") else options.pop("sep", ","), **options)


def wide_labels(runs: DataFrame, id_col: str = "row_id") -> DataFrame:
    """One column of labels for each run."""
    return runs.groupBy(id_col).pivot("run").agg(F.first("label"))


def write(df: DataFrame, path: str, kind: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.csv(path, header=True)
    elif kind == "json":
        writer.json(path)
    else:
        writer.parquet(path)


def export_labels(labels: DataFrame, path: str, kind: str = "csv") -> None:
    """Labels with ``is_noise``."""
    write(labels.withColumn("is_noise", F.col("label") == -1), path, kind)


def report_json(row: dict) -> str:
    """A report as JSON with sorted keys."""
    return json.dumps(row, sort_keys=True, default=str)
