"""Logs of changes that stay small.

A stream of keyed changes writes one folder per micro-batch. Every so many batches they
are merged into one row per key and the folders are removed, so reading costs the same
after a thousand batches as after one, and what is kept grows with the keys alone. The
merged rows can be folded into the next version of a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.sources.versions import Version
from letterloom.streaming.sinks import Query, fold_back, start_batches

EVERY = 100   # batches between merges


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    files, place = _files(spark, path)
    if not files.exists(place):
        return []
    names = [s.getPath().getName() for s in files.listStatus(place)]
    return sorted(int(n[len(prefix):]) for n in names if n.startswith(prefix))


class ChangeLog:
    """Newest row per key of a stream's changes, or the one with the ``smallest`` value.

    Batches belong to generations of ``every``. The first batch of a generation merges the
    one before it: ``merged/g`` holds one row per key of all generations up to ``g``. What a
    merge needs is removed only after the next one, so a batch that is repeated after a
    failure finds it again and replaces its own output.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], *,
                 smallest: str | None = None, every: int = EVERY) -> None:
        self.spark, self.folder, self.keys = spark, folder, keys
        self.smallest, self.every = smallest, every

    def start(self, stream: DataFrame, change: Callable[[DataFrame], DataFrame],
              every: str | None = None) -> Query:
        """Log ``change(batch)`` of every micro-batch."""
        def write(batch: DataFrame, epoch: int) -> None:
            generation, first = divmod(epoch, self.every)
            if first == 0 and generation > 0:
                self._merge(generation - 1)
            change(batch).write.mode("overwrite").parquet(
                f"{self.folder}/rows/generation={generation}/epoch={epoch}")

        return start_batches(stream, self.folder, every, write)

    def read(self) -> DataFrame | None:
        """One row per key; None before the first batch."""
        generations = _numbers(self.spark, f"{self.folder}/rows", "generation=")
        if not generations:
            return None
        return self._reduced(generations[-1]).drop("epoch")

    def _reduced(self, generation: int) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.folder}/rows/generation={generation}")
        if generation > 0:
            rows = self.spark.read.parquet(f"{self.folder}/merged/{generation - 1}").unionByName(
                rows.withColumn("epoch", F.col("epoch").cast("long")))
        rest = [c for c in rows.columns if c not in self.keys]
        picked = (F.max_by(F.struct(*rest), "epoch") if self.smallest is None
                  else F.min_by(F.struct(*rest), F.struct(self.smallest, "epoch")))
        return rows.groupBy(*self.keys).agg(picked.alias("row")).select(*self.keys, "row.*").withColumn(
            "epoch", F.col("epoch").cast("long"))

    def _merge(self, generation: int) -> None:
        self._reduced(generation).write.mode("overwrite").parquet(f"{self.folder}/merged/{generation}")
        for path, prefix, last in ((f"{self.folder}/rows", "generation=", generation - 1),
                                   (f"{self.folder}/merged", "", generation - 2)):
            for number in _numbers(self.spark, path, prefix):
                if number <= last:
                    files, place = _files(self.spark, f"{path}/{prefix}{number}")
                    files.delete(place, True)


def fold_into(version: Version, changes: DataFrame) -> Version:
    """The next version of the mail table with logged changes laid over it; only slices
    that hold a changed message are rewritten. Start the log in a new folder afterwards."""
    return version.change(changes, lambda part: fold_back(part, changes))
