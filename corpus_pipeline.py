"""From raw documents to packed sequences, in five stages.

Each stage takes all rows its predecessor kept; ``run`` writes its rows as
Parquet to the shared checkpoint folder, reads them again for the next one and
then deletes what that one no longer needs. All stages but the last return the
columns of their input, whatever other names these hold. An empty table gives
no rows.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siftstone.llm import decontaminate, exact_dedup, langid, minhash, packing
from siftstone.llm.common import ensure_checkpoint_dir, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification accepts; the model learns from the documents' own labels.

    Null texts and such without a letter go. Where no row has a label, nothing is rejected.
    """
    return langid.keep_accepted(docs, langid.train(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id; a null text equals an empty one. Rows that repeat the winner's id and text stay together, as do equal texts whose ids are all null."""
    return exact_dedup.keep_distinct(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (shingles of five words, similarity 0.8 or more), the document with the smallest id.

    Texts without words and rows with a null id stay.
    """
    return minhash.keep_representatives(docs, width=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null texts and, with an empty benchmark, all rows stay."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of at most 4096 tokens; a null text is empty and has the end id alone."""
    return packing.plan_sequences(docs, public_tokenizers.path("word_bpe_49k.json"), length=4096, end_id=2)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can express neither the language model nor the packing.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            _delete(spark, before)
        before = path
    return docs
