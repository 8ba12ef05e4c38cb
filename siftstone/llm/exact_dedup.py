"""Exact deduplication by skew-safe combining.

Every map task first folds its own rows by (digest, salt, content), so that a
group of copies leaves a task as one row whatever its size. Those rows meet by
(digest, salt, content); the winners of all salts then meet by digest, where
the content decides once more. At no stage does a digest alone join two rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _content(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per distinct content: ``_sha, _len, keep_id, group_size``.

    A null text counts as empty. ``keep_id`` is the largest id of the group
    (null if all its ids are null). Should two contents ever share SHA-256 and
    length, the job fails instead of merging them.
    """
    keyed = docs.select(
        F.col(id_col).alias("_id"),
        _content(text_col).alias("_text"),
        F.sha2(_content(text_col), 256).alias("_sha"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)).cast("int").alias("_salt"),
    )
    salted = keyed.groupBy("_sha", "_salt", "_text").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    # Dealt by digest alone: both aggregations below then need no further exchange.
    winners = (
        salted.repartition("_sha")
        .groupBy("_sha", "_text")
        .agg(F.max("_keep").alias("_keep"), F.sum("_n").alias("_n"))
        .withColumn("_len", F.octet_length("_text"))
    )
    return winners.groupBy("_sha", "_len").agg(
        F.max("_keep").alias("keep_id"),
        F.when(F.count(F.lit(1)) == 1, F.sum("_n"))
        .otherwise(F.raise_error(F.lit("two contents share a digest and a length")).cast("long"))
        .alias("group_size"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per row of ``docs``: ``<id_col>, keep_id, group_size, kept, text_sha256``.

    Null text: empty. Empty table: no rows. Other columns, whatever their
    names, are not read. Rows that repeat id and text are the same document
    and get the same verdict. Null ids never win against others; in a group
    of null ids alone every row is marked kept.
    """
    groups = exact_groups(docs, id_col, text_col, salts)
    ids = docs.select(
        F.col(id_col),
        F.sha2(_content(text_col), 256).alias("_sha"),
        F.octet_length(_content(text_col)).alias("_len"),
    )
    return ids.join(groups, ["_sha", "_len"]).select(
        F.col(id_col),
        "keep_id",
        "group_size",
        F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    The winners' ids come from ``exact_groups``; rows that repeat the winning
    id and content count as one document and all stay together.
    """
    groups = exact_groups(docs, id_col, text_col, salts).select(F.col("_sha"), F.col("_len"), F.col("keep_id").alias("_keep"))
    named = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(named))])
    at = {c: f"c{i}" for i, c in enumerate(named)}
    inner = inner.withColumns(
        {"_sha": F.sha2(F.coalesce(F.col(at[text_col]), F.lit("")), 256), "_len": F.octet_length(F.coalesce(F.col(at[text_col]), F.lit("")))}
    )
    hit = (inner["_sha"] == groups["_sha"]) & (inner["_len"] == groups["_len"]) & inner[at[id_col]].eqNullSafe(groups["_keep"])
    return inner.join(groups, hit, "left_semi").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(named)])
