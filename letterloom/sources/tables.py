"""Mail tables on storage.

There is no in-place update: every rebuild writes a new version folder, and the
readers of the old one are not disturbed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from letterloom.functions.intent import classify_intent
from letterloom.operators.views import asks_question
from letterloom.schema import DEFAULT_SELF, HINTS, MAIL, MAIL_COLUMNS


def load_mail(spark: SparkSession, path: str, columns: list[str] | None = None,
              fmt: str = "parquet", hints: bool = False) -> DataFrame:
    """The mail table with its declared schema; only ``columns`` are read.  ``hints``
    adds the columns :func:`with_hints` stored."""
    schema = StructType(MAIL.fields + HINTS.fields) if hints else MAIL
    return spark.read.schema(schema).format(fmt).load(path).select(
        *(columns or schema.fieldNames()))


def load_text_layout(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """A table from a store that keeps flags as 0/1 and times as ISO text."""
    kinds = {f.name: f.dataType.typeName() for f in MAIL.fields}
    stored = {"boolean": "INT", "timestamp_ntz": "STRING", "string": "STRING"}
    ddl = ", ".join(f"{name} {stored[kind]}" for name, kind in kinds.items())
    raw = spark.read.schema(ddl).format(fmt).load(path)
    read = {"boolean": lambda c: F.coalesce(F.col(c) == 1, F.lit(False)),
            "timestamp_ntz": lambda c: F.col(c).try_cast("timestamp_ntz"),
            "string": F.col}
    return raw.select(*[read[kind](name).alias(name) for name, kind in kinds.items()])


def write_version(df: DataFrame, path: str, *, partition_by_folder: bool = True,
                  sort_by_date: bool = True) -> None:
    """Write a new version: one directory per folder, rows near in time together.

    Seven folders would give seven hot keys, so rows are spread by date ranges
    first and only laid out by folder when written.
    """
    out = df.repartitionByRange("date", "id") if sort_by_date else df
    writer = out.sortWithinPartitions("folder", "date", "id").write.mode("errorifexists")
    if partition_by_folder:
        writer = writer.partitionBy("folder")
    writer.parquet(path)


def with_intent(df: DataFrame, *, self_email: str = DEFAULT_SELF) -> DataFrame:
    """Fill ``intent`` so that views never run the rules again."""
    return (classify_intent(df, self_email=self_email)
            .withColumn("intent", F.col("signal.intent")).drop("signal"))


def with_hints(df: DataFrame) -> DataFrame:
    """Store what reports would otherwise read the body for."""
    return df.withColumn("has_question", F.coalesce(asks_question(), F.lit(False)))


def rebuild_snapshot(src: DataFrame, path: str, *, self_email: str = DEFAULT_SELF,
                     hints: bool = False) -> DataFrame:
    """Reload the table from a source with intents filled in; returns the new version.

    Rows are spread by date before the rules run: range partitioning samples its input,
    and that way only the source is read twice, not classified twice."""
    rows = with_intent(src.repartitionByRange("date", "id"),
                       self_email=self_email).select(*MAIL_COLUMNS)
    write_version(with_hints(rows) if hints else rows, path, sort_by_date=False)
    return load_mail(src.sparkSession, path, hints=hints)


def mirror(df: DataFrame, first: str, second: str) -> DataFrame:
    """Write the table twice and compare the counts.

    The second copy is made from the first one written, so an expensive source
    is computed once and both copies hold the same rows even if it is not
    deterministic. The first is laid out as its rows come, because dealing them by
    date would sample the source before; the second is dealt by date.
    """
    spark = df.sparkSession
    write_version(df, first, sort_by_date=False)
    write_version(load_mail(spark, first), second)
    counts = [load_mail(spark, p, ["id"]).agg(F.count("*").alias("n"))
              .select(F.lit(p).alias("path"), "n") for p in (first, second)]
    return counts[0].unionByName(counts[1])
