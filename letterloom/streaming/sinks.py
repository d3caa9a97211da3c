"""Starting streams and reading what they wrote.

Two kinds of output: ``append_to`` for rows that never change, and
``changes_to`` for keyed results that do.  The second writes every micro-batch to
its own ``epoch`` folder in overwrite mode, so a batch that is repeated after a
failure replaces its first attempt; ``latest_changes`` reads the newest row per key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from letterloom.session import shared_dir


def job_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run, in the shared folder of the cluster."""
    return f"{shared_dir(spark)}/letterloom/{name}-{uuid.uuid4().hex}"


Query = StreamingQuery


def _start(writer, folder: str, every: str | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", f"{folder}/state")
    if every is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=every).start()


def append_to(stream: DataFrame, folder: str, every: str | None = None) -> StreamingQuery:
    """Append rows to ``folder``/rows; ``every`` None handles what is there and stops."""
    writer = (stream.writeStream.format("parquet").outputMode("append")
              .option("path", f"{folder}/rows"))
    return _start(writer, folder, every)


def changes_to(stream: DataFrame, folder: str, every: str | None = None,
               change: Callable[[DataFrame], DataFrame] = lambda batch: batch
               ) -> StreamingQuery:
    """Write ``change(batch)`` of every micro-batch to its epoch folder."""
    def write(batch: DataFrame, epoch: int) -> None:
        change(batch).write.mode("overwrite").parquet(f"{folder}/rows/epoch={epoch}")

    return start_batches(stream, folder, every, write)


def start_batches(stream: DataFrame, folder: str, every: str | None,
                  write: Callable[[DataFrame, int], None], mode: str = "update") -> Query:
    """Starts a stream whose batches ``write`` stores."""
    return _start(stream.writeStream.outputMode(mode).foreachBatch(write), folder, every)


def rows_of(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/rows")


def latest_changes(spark: SparkSession, folder: str, keys: list[str],
                   smallest: str | None = None) -> DataFrame:
    """The newest row per key over all epochs, or the one with the ``smallest`` value."""
    rows = rows_of(spark, folder)
    rest = [c for c in rows.columns if c not in {*keys, "epoch"}]
    picked = (F.max_by(F.struct(*rest), "epoch") if smallest is None
              else F.min_by(F.struct(*rest), F.struct(smallest, "epoch")))
    return rows.groupBy(*keys).agg(picked.alias("row")).select(*keys, "row.*")


def fold_back(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """The table with the columns that it shares with ``changes`` replaced in the changed
    rows, NULL included.  ``changes`` has one row per key; write the result as the next
    version and start the changes in a new folder."""
    shared = [c for c in table.columns if c in changes.columns and c != key]
    new = changes.select(key, F.struct(*shared).alias("_new"))
    value = lambda c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(
        F.col(c)).alias(c) if c in shared else F.col(c)
    return table.join(new, key, "left").select(*[value(c) for c in table.columns])


def run_append(stream: DataFrame, name: str) -> DataFrame:
    """Run over the available input and return the rows written."""
    spark = stream.sparkSession
    folder = job_dir(spark, name)
    append_to(stream, folder).awaitTermination()
    return rows_of(spark, folder)


def run_changes(stream: DataFrame, name: str, keys: list[str], **options) -> DataFrame:
    """Run over the available input and return the newest row per key."""
    spark = stream.sparkSession
    folder = job_dir(spark, name)
    changes_to(stream, folder, **options).awaitTermination()
    return latest_changes(spark, folder, keys)
