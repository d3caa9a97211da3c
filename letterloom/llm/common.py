"""Helpers that several operators share: shared tables, samples, links to groups."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.session import shared_dir

BLANKS = r"[\x20\x09-\x0D]+"
FOLDS = 5  # a document with crc32(doc_id as text) mod 5 = 0 is held out


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage, survives
    lost executors, and keeps a result that is used twice from being computed twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.stored_at = path
    return written


def forget(*tables: DataFrame) -> None:
    """Removes ``stored`` tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def whole_text(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def words_of(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D."""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS


def held_out(doc_id: str = "doc_id") -> Column:
    return fold(doc_id) == 0


def sample(df: DataFrame, bound: int, *keys: str, total: int | None = None) -> DataFrame:
    """About ``bound`` rows at most, chosen by the hash of ``keys``: the same rows
    however the table is split. For fitting and estimating only."""
    total = df.count() if total is None else total
    return df if total <= bound else df.where(in_sample(bound / total, *keys))


def in_sample(share: float, *keys: str) -> Column:
    """Whether the hash of ``keys`` lies in the first ``share`` of its range."""
    parts = 1 << 20
    return F.pmod(F.xxhash64(F.lit(17), *keys), F.lit(parts)) < F.lit(int(parts * share))


def groups_of_links(links: DataFrame) -> DataFrame:
    """Connected groups of the links ``(a, b)``: rows ``(id, root)`` for every linked id,
    ``root`` the smallest id of its group.

    Alternating large-star and small-star rounds: every vertex sends its greater (then
    its smaller) neighbours to the smallest one it knows. The number of rounds grows
    with the logarithm of the longest path; minima are combined before the shuffle and
    meet their rows in joins, which Spark can split when one vertex has many links.
    Links with a null end are ignored; no links give no rows.
    """
    pairs = stored(links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        state = tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == before or state[0] == 0:
            break
        before = state
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("low"))
        large = stored(both.join(low, "a").where("b > a").select(
            F.col("b").alias("a"), F.col("low").alias("b")).distinct(), "large")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.inline(F.array(
            F.struct("a", F.col("low").alias("b")),
            F.struct(F.col("b").alias("a"), F.col("low").alias("b")))))
        pairs = stored(small.where("a <> b").distinct(), "small")
    roots = pairs.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    return pairs.select(F.col("a").alias("id"), F.col("b").alias("root")).union(roots)
