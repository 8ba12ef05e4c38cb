"""Clustering of streams: centroids as a small state that every micro-batch moves."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import distances


class StreamingKMeans:
    """Mini-batch k-means over ``foreachBatch``: each batch sends k sums and counts, centres move by their share of all rows seen.

    The state is k centres, their counts and the number of the last batch. With
    ``start`` it is kept in a folder beside the query's checkpoint, one file for
    each batch: a restarted query goes on from the centres of its last batch, and
    a batch that is replayed after a failure is applied once.
    """

    #: States that are kept; a replay needs the one before the last batch.
    KEPT = 3

    def __init__(self, centres: np.ndarray, features: list[str], decay: float = 1.0):
        self.centres, self.features, self.decay = np.array(centres, float), features, decay
        self.seen, self.last = np.zeros(len(centres)), -1
        self.folder: str | None = None

    def update(self, batch: DataFrame, number: int) -> None:
        if number <= self.last:
            return
        near = distances.nearest_centroid(batch, [(i, c.tolist()) for i, c in enumerate(self.centres)], self.features, "_k", "_d")
        for r in near.groupBy("_k").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f) for f in self.features]).collect():
            k, n = r["_k"], r["n"]
            self.seen[k] = self.seen[k] * self.decay + n
            self.centres[k] += (np.array([r[f] for f in self.features]) - self.centres[k]) * n / self.seen[k]
        self.last = number
        if self.folder is not None:
            self._save(batch.sparkSession)

    def _at(self, spark: SparkSession, name: str = ""):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path, path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _save(self, spark: SparkSession) -> None:
        state = json.dumps({"last": self.last, "centres": self.centres.tolist(), "seen": self.seen.tolist()})
        part, files = self._at(spark, f".{self.last}.json")
        out = files.create(part, True)
        out.write(state.encode())
        out.close()
        files.rename(part, self._at(spark, f"{self.last}.json")[0])  # a file is there whole or not at all
        old, files = self._at(spark, f"{self.last - self.KEPT}.json")
        files.delete(old, False)

    def restore(self, spark: SparkSession, folder: str) -> None:
        """Go on from the last state in ``folder``, if there is one."""
        self.folder = folder
        path, files = self._at(spark)
        files.mkdirs(path)
        names = [f.getPath().getName() for f in files.listStatus(path)]
        numbers = [int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith(".")]
        if numbers:
            # A batch that was interrupted between its state and its commit comes again and is skipped.
            text = spark.read.text(f"{folder}/{max(numbers)}.json", wholetext=True).first()[0]
            state = json.loads(text)
            self.last, self.centres, self.seen = state["last"], np.array(state["centres"], float), np.array(state["seen"], float)

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        self.restore(stream.sparkSession, f"{checkpoint}-model")
        return stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_profile(stream: DataFrame, time: str, value: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, mean and deviation of a value by key and event-time window; rows later than ``late`` are dropped."""
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))  # watermarks need a time zone
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
