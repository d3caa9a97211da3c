"""A training corpus from raw documents: five stages, one after the other.

Every stage reads the whole table that the one before it wrote. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.llm import lines, mixing, neardup, pieces, quality, queries
from letterloom.llm.common import stored, table

BATCH = "2000"   # rows of an Arrow batch: with 10,000 texts and their features an executor is short of memory
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score 0.3 or more)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    weights = quality.train(queries.labelled_documents(docs, table(spark, sf_dir, "labels")))
    return quality.scored(docs, weights, out="quality score").where(
        F.col("quality score") >= 0.3).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of similar lines only the first stays; ``n_chars`` follows."""
    done = lines.without_repeated_lines(docs)
    return done.withColumn("n_chars", F.char_length("text").cast("long"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates (5-word shingles, similarity 0.8), found
    by fingerprints and a trie join, and by MinHash keys where fingerprints are further apart."""
    return neardup.one_of_each_group(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weight of their source asks for."""
    return mixing.mixed(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids instead of text; ``intact`` says that they decode to the text again."""
    done = pieces.round_trips(docs, pieces.load_vocabulary(queries.PIECES),
                              ["doc_id", "lang", "source", "n_chars"])
    return done.withColumn("n_pieces", F.coalesce(F.size("ids"), F.lit(0))) \
        .withColumnRenamed("round_trip", "intact")


STAGES = [("quality", quality_stage), ("lines", line_stage), ("simhash", simhash_stage),
          ("mixing", mixing_stage), ("pieces", pieces_stage)]
# A classifier, fuzzy groups and a tokenizer are no SQL: tests hold each stage against
# a brute-force version on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
