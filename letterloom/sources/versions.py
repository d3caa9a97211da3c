"""Versions of the mail table that share what did not change.

A version is a list of slices: small tables with the rows of one mail folder, one span of
time and one share of the ids. A change rewrites the slices that hold a row it touches and
refers to all others, so its cost follows the change and not the table. Nothing is
overwritten: older versions stay readable, and a version exists once its list is written.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from letterloom.functions.dates import moment
from letterloom.schema import HINTS, MAIL

LIST = "name string, folder string, low timestamp_ntz, high timestamp_ntz, n long"


@dataclass(frozen=True)
class Version:
    """One version under ``root``; ``span`` and ``shares`` say how it is cut."""

    spark: SparkSession
    root: str
    number: int
    span: str = "month"
    shares: int = 4
    hints: bool = False

    @property
    def schema(self) -> StructType:
        return StructType(MAIL.fields + HINTS.fields) if self.hints else MAIL

    def slices(self) -> DataFrame:
        """The slices: (name, folder, first and last date, rows)."""
        return self.spark.read.schema(LIST).parquet(f"{self.root}/versions/{self.number:06d}")

    def _rows(self, names: Iterable[str], columns: list[str] | None = None) -> DataFrame:
        paths = [f"{self.root}/rows/{n}" for n in sorted(names)]
        if not paths:
            return self.spark.createDataFrame([], self.schema).select(*(columns or self.schema.fieldNames()))
        return self.spark.read.schema(self.schema).parquet(*paths).select(
            *(columns or self.schema.fieldNames()))

    def names(self, folders: list[str] | None = None, since=None, until=None) -> list[str]:
        """Names of the slices that can hold such rows. Like a list of files this is kept
        on the driver; it grows with the number of slices, not of rows."""
        found = self.slices()
        if folders is not None:
            found = found.filter(F.col("folder").isin(folders))
        if since is not None:
            found = found.filter(F.col("high") >= moment(since))
        if until is not None:
            found = found.filter(F.col("low") <= moment(until))
        return [r["name"] for r in found.select("name").collect()]

    def read(self, columns: list[str] | None = None, **limits) -> DataFrame:
        """The mail table of this version, or the slices that ``folders``, ``since`` and
        ``until`` leave (whole slices: filter the rows as well)."""
        return self._rows(self.names(**limits), columns)

    def holding(self, ids: DataFrame) -> list[str]:
        """Names of the slices with one of the ``id``s. Only the id column is read."""
        names = self.names()
        if not names:
            return []
        own = F.regexp_extract(F.col("_metadata.file_path"), r"([0-9a-f]{32}/slice=s[0-9a-f]+)/[^/]+$", 1)
        rows = self.spark.read.schema(self.schema).parquet(
            *[f"{self.root}/rows/{n}" for n in names]).select("id", own.alias("name"))
        return [r["name"] for r in
                rows.join(ids.select("id"), "id", "left_semi").select("name").distinct().collect()]

    def change(self, ids: DataFrame, change: Callable[[DataFrame], DataFrame]) -> Version:
        """The next version: slices with one of the ``ids`` hold ``change`` of their rows.

        ``change`` is given the rows of those slices and returns the rows that take their
        place: changed ones, fewer, or moved to another folder. It must leave rows without
        one of the ``ids`` as they are. Ids that are not there change nothing.
        """
        touched = self.holding(ids)
        rest = self.slices().filter(~F.col("name").isin(touched)) if touched else self.slices()
        if touched:
            rest = rest.unionByName(self._written(change(self._rows(touched))))
        return self._listed(rest, self.number + 1)

    def added(self, rows: DataFrame) -> Version:
        """The next version with new rows; no old slice is read."""
        return self._listed(self.slices().unionByName(self._written(rows)), self.number + 1)

    def _written(self, rows: DataFrame) -> DataFrame:
        """Writes rows as slices and returns their list. A share of the ids keeps a slice
        from growing with its folder and span."""
        batch = uuid.uuid4().hex
        share = F.pmod(F.xxhash64("id"), F.lit(self.shares))
        name = F.concat(F.lit("s"), F.lower(F.hex(F.xxhash64("folder", F.date_trunc(self.span, "date"), share))))
        cut = rows.select(*self.schema.fieldNames(), name.alias("slice")).repartition("slice")
        cut.sortWithinPartitions("slice", "date", "id").write.partitionBy("slice").parquet(
            f"{self.root}/rows/{batch}")
        stored = self.spark.read.schema(StructType([*self.schema.fields, StructField("slice", StringType())])).parquet(
            f"{self.root}/rows/{batch}")
        return stored.groupBy(F.concat(F.lit(f"{batch}/slice="), "slice").alias("name")).agg(
            F.min("folder").alias("folder"), F.min("date").alias("low"), F.max("date").alias("high"),
            F.count("*").alias("n"))

    def _listed(self, slices: DataFrame, number: int) -> Version:
        slices.coalesce(1).write.parquet(f"{self.root}/versions/{number:06d}")
        return Version(self.spark, self.root, number, self.span, self.shares, self.hints)


def create(df: DataFrame, root: str, *, span: str = "month", shares: int = 4,
           hints: bool = False) -> Version:
    """Stores a mail table as version 1 in the empty folder ``root``. Choose ``span`` and
    ``shares`` so that a slice of the busiest folder fits a task."""
    new = Version(df.sparkSession, root, 0, span, shares, hints)
    return new._listed(new._written(df), 1)
