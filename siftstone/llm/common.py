"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, which separates words everywhere in this subpackage.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Rows that fill a partition: small tables are read and written in few tasks and files.
PART_ROWS = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs in one process."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not sc._jsc.sc().isLocal():
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="siftstone-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def packed(df: DataFrame, rows: int, each: int = PART_ROWS) -> DataFrame:
    """``df`` of at most ``rows`` rows in no more partitions than these fill, whatever the width of a shuffle is."""
    return df.coalesce(max(1, -(-rows // each)))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def discard(df: DataFrame) -> None:
    """Delete what ``cut`` wrote for ``df``, once nothing is computed from it any more."""
    rdd = df._jdf.queryExecution().analyzed().rdd()
    if rdd.getCheckpointFile().isDefined():
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(rdd.getCheckpointFile().get())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def crc_split(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5; 0 marks the held-out fold. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
