"""Threads and conversations.

One thread may hold a large share of the table.  Rollups therefore use
aggregates that combine in the scan tasks, per-thread limits use ranking windows
that Spark also limits before the shuffle, and full positions come from one sort and
sums over its parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from letterloom.functions.text import visible_text
from letterloom.operators import views as V
from letterloom.schema import DEFAULT_SELF
from letterloom.session import kept


def _rank():
    return F.struct("date", "id")


def last_message(df: DataFrame) -> DataFrame:
    """Newest message of each thread."""
    return (df.groupBy("thread_id")
            .agg(F.max_by(F.struct("id", "date", "from_email"), _rank()).alias("m"))
            .select("thread_id", "m.*"))


def newest_foreign_sender(df: DataFrame, *, self_email: str = DEFAULT_SELF) -> DataFrame:
    """Sender of the newest message of each thread that is not the owner's."""
    return (df.filter(~V.is_own(self_email)).groupBy("thread_id")
            .agg(F.max_by(F.struct("from_email", "from_name"), _rank()).alias("m"))
            .select("thread_id", F.col("m.from_email").alias("participant_email"),
                    F.col("m.from_name").alias("participant_name")))


def conversations(df: DataFrame, *, self_email: str | Column = DEFAULT_SELF,
                  keys: Sequence[str] = ("thread_id",)) -> DataFrame:
    """Two-way threads: at least one message each way, with the state of the newest.

    ``max_by`` combines in the map tasks, so a huge thread arrives as one row per
    task.
    """
    own = V.is_own(self_email)
    foreign_rank = F.when(~own, _rank())
    newest = F.struct("date", "subject", "snippet", "intent", own.alias("own"))
    return (df.filter(V.in_correspondence()).groupBy(*keys).agg(
        F.count("*").alias("message_count"),
        F.count_if(~own).alias("n_foreign"),
        F.count_if(~own & ~F.col("is_read")).alias("unread_count"),
        F.max_by(newest, _rank()).alias("last"),
        F.max_by(F.struct("from_name", "from_email"), foreign_rank).alias("person"))
        .filter((F.col("n_foreign") > 0) & (F.col("n_foreign") < F.col("message_count")))
        .select(
            *keys, F.col("last.subject").alias("subject"),
            F.col("person.from_name").alias("participant_name"),
            F.col("person.from_email").alias("participant_email"),
            "message_count", F.col("last.date").alias("last_date"),
            F.when(F.col("last.own"), "outgoing").otherwise("incoming")
            .alias("last_direction"),
            (F.col("unread_count") > 0).alias("has_unread"), "unread_count",
            F.col("last.snippet").alias("snippet"), F.col("last.intent").alias("last_intent")))


def conversation_totals(convs: DataFrame) -> DataFrame:
    return convs.agg(F.count("*").alias("total"),
                     F.count_if("has_unread").alias("unread_threads"))


def recent_conversations(convs: DataFrame, n: int = 20) -> DataFrame:
    return convs.orderBy(F.desc("last_date"), "thread_id").limit(n)


def thread_of(df: DataFrame, ids: DataFrame) -> DataFrame:
    """All messages of the threads the given messages belong to, oldest first."""
    wanted = V.lookup(df.select("id", "thread_id"), "id", ids).select("thread_id").distinct()
    return V.thread_order(df.join(wanted, "thread_id", "left_semi"))


def placed(df: DataFrame) -> DataFrame:
    """(id, thread_id, date, part, place): all messages sorted by thread, date and id and
    dealt by range, so that one thread, day or minute spreads over as many parts as it
    needs. ``place`` counts up inside a ``part`` and the parts are in order."""
    order = ["thread_id", "date", "id"]
    rows = df.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    # Written once: a second reading must find every row in the same place.
    stored = kept(rows.withColumn("place", F.monotonically_increasing_id()), "places")
    return stored.withColumn("part", F.shiftright("place", 33))


def thread_position(df: DataFrame) -> DataFrame:
    """Position of each message in its thread, thread size, and the flags made of
    them.

    Ranks by prefix sums: rows are sorted once, dealt by range; a small table with one row
    per thread and part adds up what stands in earlier parts. No task holds more of a
    thread than its part, whatever the times of its messages.
    """
    rows = placed(df)
    counts = rows.groupBy("thread_id", "part").agg(
        F.min("place").alias("first"), F.count("*").alias("n"))
    by_thread = Window.partitionBy("thread_id")
    earlier = by_thread.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "thread_id", "part",
        (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first") + 1).alias("shift"),
        F.sum("n").over(by_thread).alias("n_in_thread"))
    position = F.col("place") + F.col("shift")
    return rows.join(offsets, ["thread_id", "part"]).select(
        "id", "thread_id", position.alias("position"), "n_in_thread",
        (position == F.col("n_in_thread")).alias("is_last"),
        (F.col("n_in_thread") > 1).alias("is_threaded"))


def thread_participants(df: DataFrame) -> DataFrame:
    """Distinct sender names of each thread with their first message, one row per
    name: a mailing list may have any number of them."""
    first = F.min(_rank()).alias("first")
    return (df.groupBy("thread_id", "from_name")
            .agg(first, F.count("*").alias("n"))
            .select("thread_id", "from_name", F.col("first.date").alias("first_date"),
                    F.col("first.id").alias("first_id"), F.col("n").alias("message_count")))


def first_names(df: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` names of each thread in order of appearance, joined."""
    order = Window.partitionBy("thread_id").orderBy("first_date", "first_id")
    first = (thread_participants(df).withColumn("rank", F.row_number().over(order))
             .filter(F.col("rank") <= n))
    names = F.array_sort(F.collect_list(F.struct("rank", "from_name")))
    return first.groupBy("thread_id").agg(
        F.array_join(F.transform(names, lambda x: x["from_name"]), ", ").alias("names"))


def thread_status(df: DataFrame) -> DataFrame:
    """One line per thread: how many messages and between whom."""
    sizes = df.groupBy("thread_id").agg(F.count("*").alias("n"))
    many = F.concat(F.lit("Thread of "), F.col("n").cast("string"),
                    F.lit(" messages between "), "names", F.lit("."))
    single = F.concat(F.lit("Single message from "), "names", F.lit("."))
    return sizes.join(first_names(df), "thread_id").select(
        "thread_id", F.when(F.col("n") > 1, many).otherwise(single).alias("status"))


def _message_text(rank: Column, body: Column) -> Column:
    return F.concat(
        F.lit("--- Message "), rank.cast("string"), F.lit(" ---\nFrom: "),
        "from_name", F.lit(" <"), "from_email", F.lit(">\nDate: "),
        F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("\nSubject: "), "subject",
        F.lit("\n\n"), body)


def _cut(text: Column, n: int | None) -> Column:
    return text if n is None else F.left(text, F.lit(n))


def transcript_parts(df: DataFrame, per_message: int | None = None, messages: int = 100) -> DataFrame:
    """Readable text of each thread in parts of at most ``messages`` messages:
    (thread_id, part, n_messages, transcript), parts counted from 0, oldest message first.

    Positions come from ``thread_position``, so a thread with any number of messages is
    many groups of a bounded size; its parts in order, joined by an empty line, are the
    transcript of the whole thread.
    """
    at = thread_position(df).select("id", "position")
    rows = df.select("id", "thread_id", "date", "from_name", "from_email", "subject", "body").join(at, "id")
    text = _message_text(F.col("position"), _cut(visible_text(F.col("body")), per_message))
    parts = F.array_sort(F.collect_list(F.struct("position", text.alias("text"))))
    return rows.groupBy("thread_id", F.floor((F.col("position") - 1) / messages).alias("part")).agg(
        F.count("*").alias("n_messages"),
        F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("transcript"))


def thread_transcript(df: DataFrame, per_message: int | None = None,
                      total: int | None = None, messages: int | None = None) -> DataFrame:
    """Readable text of each thread, oldest message first, bodies reduced to their text.

    Lengths of the output: at most ``messages`` messages (oldest first), each body cut at
    ``per_message``, the whole at ``total``; None does not cut.  The ranking limit runs
    before the shuffle too, so a long thread sends at most ``messages`` rows per task,
    and only those rows have their body cleaned. Without that limit a thread is one row
    and one group: use ``transcript_parts`` where threads have no bound.
    """
    order = Window.partitionBy("thread_id").orderBy("date", "id")
    chosen = (df.select("id", "thread_id", "date", "from_name", "from_email", "subject",
                        "body")
              .withColumn("rank", F.row_number().over(order)))
    if messages is not None:
        chosen = chosen.filter(F.col("rank") <= messages)
    text = _message_text(F.col("rank"), _cut(visible_text(F.col("body")), per_message))
    parts = F.array_sort(F.collect_list(F.struct("rank", text.alias("text"))))
    whole = F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n")
    return chosen.groupBy("thread_id").agg(
        F.count("*").alias("n_messages"), _cut(whole, total).alias("transcript"))
