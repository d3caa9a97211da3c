"""Promises and requests in message texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.functions import lexicon as lx
from letterloom.functions.dates import moment
from letterloom.functions.lists import unnest
from letterloom.functions.text import collapse_space, drop_tags
from letterloom.operators import views as V
from letterloom.schema import DEFAULT_SELF

# Shortest sentence looked at, cut of the action text, confidence.
MIN_SENTENCE = 10
ACTION_CHARS = 200
CONFIDENCE = 0.6


def plain_text(body: Column) -> Column:
    """The words of a body on one line; only non-breaking spaces are decoded."""
    text = F.replace(drop_tags(F.coalesce(body, F.lit(""))), F.lit("&nbsp;"), F.lit(" "))
    return collapse_space(text)


def sentences(plain: Column) -> Column:
    """One-line text cut after ``.``, ``!`` and ``?``."""
    return F.split(plain, "(?<=[.!?]) +")


def _direction(lower: Column, own: Column) -> Column:
    says = lambda phrases: lower.rlike(lx.whole_words(phrases))
    return (F.when(says(lx.COMMITMENT), F.when(own, "outgoing").otherwise("incoming"))
            .when(~own & says(lx.INCOMING_COMMITMENT), "incoming")
            .when(says(lx.REQUEST), F.when(own, "incoming").otherwise("outgoing")))


def may_commit(plain: Column) -> Column:
    """A cheap test every text with a commitment passes."""
    lower = F.lower(plain)
    texts = lx.required_texts("|".join([lx.COMMITMENT, lx.INCOMING_COMMITMENT, lx.REQUEST]))
    return reduce(lambda a, b: a | b, [lower.contains(t) for t in texts])


def commitment_signals(plain: Column, from_email: Column, self_email: str) -> Column:
    """Array of struct(pos, action, owner, direction, due_date, evidence, confidence),
    one per distinct sentence of one-line text that promises or asks for something.

    Built inside the row: sentences of one message never need a shuffle, and
    repeats are dropped before anything is exploded.
    """
    own = F.lower(from_email) == self_email.lower()
    numbered = F.transform(sentences(plain), lambda s, i: F.struct(
        i.alias("pos"), s.alias("text"), F.lower(s).alias("lower")))
    long_enough = F.filter(numbered, lambda s: F.char_length(s["text"]) > MIN_SENTENCE)
    directed = F.filter(
        F.transform(long_enough, lambda s: F.struct(
            s["pos"].alias("pos"), s["text"].alias("text"), s["lower"].alias("lower"),
            _direction(s["lower"], own).alias("direction"))),
        lambda s: s["direction"].isNotNull())
    keys = F.transform(directed, lambda s: s["lower"])
    first = F.filter(directed, lambda s, i: F.array_position(keys, s["lower"]) == i + 1)
    due = lambda lower: F.regexp_extract(lower, lx.DUE, 0)
    return F.transform(first, lambda s: F.struct(
        s["pos"].alias("pos"),
        F.left(s["text"], F.lit(ACTION_CHARS)).alias("action"),
        F.when(own, "you").otherwise(from_email).alias("owner"),
        s["direction"].alias("direction"),
        F.nullif(due(s["lower"]), F.lit("")).alias("due_date"),
        s["text"].alias("evidence"),
        F.lit(CONFIDENCE).alias("confidence")))


def detect_commitments(df: DataFrame, *, self_email: str = DEFAULT_SELF,
                       body: str = "body", into: str = "signals") -> DataFrame:
    """Add the commitment signals of each message.  Only texts that may hold one are
    cut into sentences."""
    prepared = df.withColumn("_plain", plain_text(F.col(body)))
    found = commitment_signals(F.col("_plain"), F.col("from_email"), self_email)
    return (prepared.withColumn("_may", may_commit(F.col("_plain")))
            .withColumn(into, F.when(F.col("_may"), found)).drop("_plain", "_may"))


def commitments(df: DataFrame, *, self_email: str = DEFAULT_SELF) -> DataFrame:
    """One row per commitment found in correspondence."""
    return _ranked(df, self_email).drop("rank")


def _ranked(df: DataFrame, self_email: str) -> DataFrame:
    """Commitments with their ``rank`` in the message, counted inside the row.  The id is
    made of the message and the place of the sentence; ``short_id`` is for display."""
    signals = detect_commitments(df.filter(V.in_correspondence()), self_email=self_email)
    numbered = F.transform("signals", lambda s, i: F.struct((i + 1).alias("rank"), s.alias("s")))
    found = unnest(signals, numbered, "x", "id", "thread_id", "subject", "from_name", "date") \
        .select("id", "thread_id", "subject", "from_name", "date", "x.*")
    return found.select(
        F.concat_ws(":", "id", F.col("s.pos").cast("string")).alias("commitment_id"),
        F.concat("id", F.lit(":"), F.left("s.evidence", F.lit(40))).alias("short_id"),
        F.col("id").alias("email_id"), "thread_id", "subject", "from_name", "date",
        F.when(F.col("s.direction") == "outgoing", "You").otherwise(F.col("from_name"))
        .alias("who"),
        F.col("s.pos").alias("pos"), F.col("s.action").alias("action"),
        F.col("s.owner").alias("owner"), F.col("s.direction").alias("direction"),
        F.col("s.due_date").alias("due"), F.col("s.evidence").alias("evidence"),
        F.col("s.confidence").alias("confidence"), "rank")


def dedupe_commitments(df: DataFrame) -> DataFrame:
    """First row per (message, evidence without case) of a commitment table, in
    sentence order.  Combines in the map tasks, so a repeated text stays cheap."""
    rest = [c for c in df.columns if c != "email_id"]
    return (df.groupBy("email_id", F.lower("evidence").alias("_key"))
            .agg(F.min_by(F.struct(*rest), "pos").alias("r"))
            .select("email_id", *[F.col(f"r.{c}").alias(c) for c in rest]))


def commitments_by_direction(df: DataFrame, direction: str) -> DataFrame:
    return df.filter(F.col("direction") == direction)


def commitment_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("detected"),
                  F.count_if(F.col("direction") == "incoming").alias("incoming"),
                  F.count_if(F.col("direction") == "outgoing").alias("outgoing"))


def briefing_commitments(df: DataFrame, *, self_email: str = DEFAULT_SELF,
                         newest: int | None = None,
                         per_message: int | None = None) -> DataFrame:
    """Commitments of all messages with their ``rank`` in the message.

    ``newest`` looks at that many messages only, ``per_message`` keeps the first of each
    message; by default nothing is left out.  The newest are picked by (date, id) before
    any body is read, and their rows are found again by a semi-join.
    """
    mail = df.filter(V.in_correspondence())
    if newest is not None:
        mail = V.lookup(mail, "id", V.newest(mail.select("date", "id"), newest))
    found = _ranked(mail, self_email)
    return found if per_message is None else found.filter(F.col("rank") <= per_message)


def overdue_commitments(df: DataFrame, as_of, *, self_email: str = DEFAULT_SELF,
                        days: int = 3) -> DataFrame:
    """Promises of others older than ``days`` in threads the owner never wrote to.

    Both sides are cut down before the join: the left to late promises, the right
    to one row per thread.
    """
    mail = df.filter(V.in_correspondence())
    own = V.is_own(self_email)
    limit = moment(as_of) - F.make_interval(days=F.lit(days))
    late = mail.filter((F.col("intent") == "COMMITMENT") & ~own & (F.col("date") < limit))
    answered = mail.filter(own).select("thread_id").distinct()
    return late.join(answered, "thread_id", "left_anti")


def overdue_count(df: DataFrame, as_of, *, self_email: str = DEFAULT_SELF,
                  days: int = 3) -> DataFrame:
    return overdue_commitments(df, as_of, self_email=self_email, days=days).agg(
        F.count_distinct("id").alias("overdue"))
