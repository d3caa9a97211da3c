"""Combining the replies of several models.

Replies are a table (email_id, model, ordinal, content).  Every rule is an
aggregate that combines in the map tasks, so a message with very many replies is
no problem; ``ordinal`` is the order of preference and breaks all ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from letterloom.functions.intent import classify_intent
from letterloom.functions.replies import parse_model_reply
from letterloom.functions.score import priority_level
from letterloom.operators.commitments import detect_commitments
from letterloom.operators.mutate import update_fields
from letterloom.schema import DEFAULT_SELF, REPLY_JSON


def parsed(replies: DataFrame, *fields: str) -> DataFrame:
    """Replies with their JSON read into columns: all, or the ``fields`` only."""
    schema = StructType.fromDDL(REPLY_JSON)
    wanted = StructType([schema[f] for f in fields]) if fields else schema
    return (replies.withColumn("r", parse_model_reply(F.col("content"), wanted))
            .select("email_id", "model", "ordinal", "content", "r.*"))


def _is_text(column: str):
    return F.coalesce(column, F.lit("")) != ""


# Unusable replies are ranked NULL inside the aggregates instead of being filtered
# out: a filter on parsed fields would move below the parsing and parse twice.

def majority_vote(replies: DataFrame) -> DataFrame:
    """Intent most replies name, its share of the valid replies, and the reason of
    the first reply that named it."""
    # Only the two fields of a vote are read from the JSON.
    fields = parse_model_reply(F.col("content"), "intent STRING, reason STRING")
    read = replies.select("email_id", "ordinal", fields.alias("r")).select("email_id", "ordinal", "r.*")
    votes = read.groupBy("email_id", F.coalesce("intent", F.lit("")).alias("intent")).agg(
        F.count("*").alias("n"), F.min("ordinal").alias("first"),
        F.min_by(F.coalesce("reason", F.lit("")), "ordinal").alias("reason"))
    named = F.col("intent") != ""
    best = F.when(named, F.struct(F.col("n"), (-F.col("first")).alias("first")))
    return (votes.groupBy("email_id")
            .agg(F.max_by(F.struct("intent", "n", "reason"), best).alias("w"),
                 F.sum(F.when(named, F.col("n"))).alias("valid"))
            .filter(F.col("w").isNotNull())
            .select("email_id", F.col("w.intent").alias("intent"),
                    F.col("w.n").alias("votes"),
                    (F.col("w.n") / F.col("valid")).alias("confidence"),
                    F.col("w.reason").alias("reason")))


def best_reply(replies: DataFrame) -> DataFrame:
    """Most confident usable reply: it must summarise or suggest something."""
    usable = _is_text("summary") | _is_text("suggestedReply")
    rank = F.when(usable, F.struct(F.coalesce("confidence", F.lit(0.3)).alias("c"),
                                   (-F.col("ordinal")).alias("o")))
    kept = F.struct("model", F.coalesce("intent", F.lit("FYI")).alias("intent"),
                    F.col("summary"),
                    F.coalesce("confidence", F.lit(0.3)).alias("confidence"), "commitments")
    read = parsed(replies, "intent", "confidence", "summary", "suggestedReply", "commitments")
    return (read.groupBy("email_id").agg(F.max_by(kept, rank).alias("b"))
            .filter(F.col("b").isNotNull()).select("email_id", "b.*"))


def first_reply(replies: DataFrame) -> DataFrame:
    """First non-empty reply in order of preference."""
    return (replies.filter(_is_text("content")).groupBy("email_id")
            .agg(F.min_by(F.struct("model", "content"), "ordinal").alias("r"))
            .select("email_id", "r.*"))


def first_valid_score(replies: DataFrame) -> DataFrame:
    """First reply in order of preference whose score lies in 0..100."""
    score = F.floor(F.col("score") + 0.5).cast("int")
    rank = F.when(F.col("score").between(0, 100), F.col("ordinal"))
    kept = F.struct("model", score.alias("score"),
                    F.coalesce("reasoning", F.lit("")).alias("reasoning"),
                    F.coalesce("confidence", F.lit(0.7)).alias("confidence"))
    read = parsed(replies, "score", "reasoning", "confidence")
    return (read.groupBy("email_id").agg(F.min_by(kept, rank).alias("s"))
            .filter(F.col("s").isNotNull()).select("email_id", "s.*")
            .withColumn("level", priority_level(F.col("score"))))


def refine_intent(df: DataFrame, replies: DataFrame, *,
                  self_email: str = DEFAULT_SELF) -> DataFrame:
    """The vote replaces the rules only when it is strictly more confident."""
    rules = classify_intent(df, self_email=self_email).select("id", "signal")
    vote = majority_vote(replies).select(
        F.col("email_id").alias("id"), F.struct("intent", "confidence", "reason").alias("v"))
    better = F.coalesce(F.col("v.confidence") > F.col("signal.confidence"), F.lit(False))
    chosen = F.when(better, F.col("v")).otherwise(F.col("signal"))
    return (rules.join(vote, "id", "left")
            .select("id", chosen.alias("c"),
                    F.when(better, "ai").otherwise("rules").alias("source"))
            .select("id", "c.*", "source"))


def persist_intents(df: DataFrame, refined: DataFrame) -> DataFrame:
    """The mail table with the refined intents of ``refine_intent`` as its own."""
    return update_fields(df, refined.select("id", "intent"))


def merge_handled(df: DataFrame, replies: DataFrame, *,
                  self_email: str = DEFAULT_SELF) -> DataFrame:
    """Workflow proposal per message: the best reply, with the rules stepping in for
    a weak FYI or for missing commitments."""
    found = detect_commitments(classify_intent(df, self_email=self_email),
                               self_email=self_email)
    base = found.select("id", "from_name", "subject",
                        F.col("signal.intent").alias("rule_intent"), "signals")
    best = best_reply(replies).withColumnRenamed("email_id", "id")
    fallback = F.concat(F.lit("Email from "), "from_name", F.lit(' about "'), "subject",
                        F.lit('".'))
    merged = base.join(best, "id", "left").select(
        "id", "from_name", "rule_intent", "signals", "commitments",
        F.coalesce("intent", F.lit("FYI")).alias("ai_intent"),
        F.coalesce("confidence", F.lit(0.3)).alias("confidence"),
        F.coalesce("summary", fallback).alias("summary"))
    weak = (F.col("ai_intent") == "FYI") & (F.col("confidence") < 0.5)
    from_rules = F.transform("signals", lambda s: F.struct(
        F.when(s["direction"] == "outgoing", "You").otherwise(F.col("from_name")).alias("who"),
        s["action"].alias("action"), s["due_date"].alias("due"),
        s["evidence"].alias("source")))
    has_own = F.coalesce(F.size("commitments"), F.lit(0)) > 0
    return merged.select(
        "id", F.when(weak, F.col("rule_intent")).otherwise(F.col("ai_intent")).alias("intent"),
        "summary", "confidence",
        F.when(has_own, F.col("commitments"))
        .otherwise(F.coalesce(from_rules, F.array())).alias("commitments"))
