"""Streams made of the batch operators and built-in state.

Streams carry event time as TIMESTAMP (watermarks need it), tables as
TIMESTAMP_NTZ in UTC.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.functions.dates import moment
from letterloom.functions.text import csv_to_array
from letterloom.operators import links as L
from letterloom.operators import stats
from letterloom.operators import views as V
from letterloom.schema import COUNTED_VIEWS, DEFAULT_SELF
from letterloom.sources.inbound import (ingest_inbound, parse_raw_messages, read_raw_messages,
                                        rejected_inbound)
from letterloom.streaming.sinks import Query, start_batches

# Fixed value: how long a send can be taken back.
UNDO_SECONDS = 5


# A table, or a function that returns its current version.
Table = DataFrame | Callable[[], DataFrame]


def _current(table: Table) -> DataFrame:
    return table() if callable(table) else table


def _posted_once(raw: DataFrame, arrived: str, delay: str) -> DataFrame:
    """Posts without repeats.  A post without an ``id`` is named by its content, so that
    the same post has the same id in every attempt."""
    content = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))
               for c in raw.columns if c != arrived]
    named = raw if "id" in raw.columns else raw.withColumn(
        "id", F.left(F.sha2(F.concat_ws("\u0001", *content), 256), F.lit(32)))
    return named.withWatermark(arrived, delay).dropDuplicatesWithinWatermark(["id"])


def stream_inbound(raw: DataFrame, *, self_email: str = DEFAULT_SELF,
                   arrived: str = "arrived", delay: str = "1 hour") -> DataFrame:
    """Received messages as mail rows; a post sent again within ``delay`` is dropped.

    ``raw`` has the declared columns of a post; ``arrived`` is the time of the post and
    stands in for a missing date.
    """
    once = _posted_once(raw, arrived, delay)
    return ingest_inbound(once, F.col(arrived).cast("timestamp_ntz"), self_email=self_email)


def inbound_to(raw: DataFrame, folder: str, every: str | None = None, *,
               self_email: str = DEFAULT_SELF, arrived: str = "arrived",
               delay: str = "1 hour") -> Query:
    """Writes posts as mail rows to ``folder``/rows and refused posts with their reason to
    ``folder``/rejected, one epoch folder per batch in each."""
    def write(batch: DataFrame, epoch: int) -> None:
        at = F.col(arrived).cast("timestamp_ntz")
        for name, rows in (("rows", ingest_inbound(batch, at, self_email=self_email)),
                           ("rejected", rejected_inbound(batch))):
            rows.write.mode("overwrite").parquet(f"{folder}/{name}/epoch={epoch}")

    return start_batches(_posted_once(raw, arrived, delay), folder, every, write, "append")


def raw_messages_to(spark: SparkSession, path: str, folder: str, every: str | None = None,
                    *, self_email: str = DEFAULT_SELF, delay: str = "1 hour",
                    separator: str | None = None) -> Query:
    """Writes the raw messages in the files below ``path`` as ``inbound_to`` does: mail rows,
    and those without a sender with the reason. A file is one message, or many with a
    ``separator`` after each."""
    posts = parse_raw_messages(read_raw_messages(spark, path, stream=True, separator=separator))
    return inbound_to(posts, folder, every, self_email=self_email, delay=delay)


def deliver_due_batch(mail: Table,
                      delivered: Callable[[], DataFrame | None] = lambda: None):
    """For ``changes_to``: the scheduled messages due at the newest tick of a batch, as
    rows that ``sinks.fold_back`` can lay over the mail table.

    Give ``mail`` as a function to see messages scheduled after the start.  ``delivered``
    returns the deliveries known when the batch starts; they are not repeated.  Without
    it a message due twice is reported twice, with the same outcome.
    """
    def change(ticks: DataFrame) -> DataFrame:
        now = ticks.agg(F.max("ts").cast("timestamp_ntz")).scalar()
        due = _current(mail).filter(F.coalesce(V.due_scheduled(now), F.lit(False)))
        known = delivered()
        if known is not None:
            due = due.join(known.select("id"), "id", "left_anti")
        return due.select("id", F.lit("SENT").alias("folder"),
                          F.lit(None).cast("timestamp_ntz").alias("scheduled_for"),
                          now.alias("delivered_at"))
    return change


def first_views_batch(links: Table):
    """For ``changes_to``: ``first_views`` of one batch against the current links.  No
    state is kept: read the result with ``latest_changes(..., smallest="viewed_at")``."""
    return lambda events: first_views(events, _current(links))


def delivery_status_batch(links: Table):
    """For ``changes_to``: ``delivery_status`` of one batch against the current links."""
    return lambda events: delivery_status(events, _current(links))


def create_links_batch(mail: Table, **options):
    """For ``changes_to``: one link per send request, against the current mail table."""
    return lambda events: L.create_links(events, _current(mail), **options)


def undo_window(sends: DataFrame, cancels: DataFrame, seconds: int = UNDO_SECONDS,
                delay: str = "10 seconds") -> DataFrame:
    """Sends that were not cancelled within ``seconds``.

    A left outer interval join: a send leaves the state once the watermark shows
    that no cancel can still arrive.
    """
    s = sends.withWatermark("ts", delay).select(F.col("id").alias("id"),
                                                F.col("ts").alias("sent_at"))
    c = cancels.withWatermark("ts", delay).select(F.col("id").alias("cancel_id"),
                                                  F.col("ts").alias("cancelled_at"))
    window = F.expr(f"cancel_id = id AND cancelled_at >= sent_at AND "
                    f"cancelled_at < sent_at + INTERVAL {seconds} SECONDS")
    return s.join(c, window, "left_outer").filter(F.col("cancel_id").isNull()).select(
        "id", "sent_at")


def first_views(view_events: DataFrame, links: DataFrame) -> DataFrame:
    """First valid opening of each link (update mode).  Openings after the expiry do
    not count, and an earlier recorded time stays.

    A link has a valid opening exactly when its first one is, so openings are
    reduced to one row per link before the links are joined: a link that everybody
    opens stays one row per task.
    """
    first = view_events.groupBy("token").agg(
        F.min("ts").cast("timestamp_ntz").alias("first_at"))
    side = links.select("token", "expires_at", F.col("viewed_at").alias("old_viewed_at"))
    valid = F.col("expires_at").isNull() | (F.col("expires_at") >= F.col("first_at"))
    return first.join(side, "token").filter(valid).select(
        "token", F.coalesce("old_viewed_at", "first_at").alias("viewed_at"),
        F.lit(True).alias("viewed"))


def delivery_status(status_events: DataFrame, links: DataFrame) -> DataFrame:
    """Links reported as delivered count as viewed at the newest report (update
    mode); other reports change nothing.  Reduced per link before the join."""
    newest = status_events.filter(F.col("status") == "delivered").groupBy("link_id").agg(
        F.max("ts").cast("timestamp_ntz").alias("viewed_at"))
    return newest.join(links.select(F.col("id").alias("link_id")), "link_id").select(
        "link_id", "viewed_at", F.lit(True).alias("viewed"))


def create_links(send_events: DataFrame, mail: DataFrame, **options) -> DataFrame:
    """One delivery link per send request."""
    return L.create_links(send_events, mail, **options)


def stream_volume(mail: DataFrame, *, self_email: str = DEFAULT_SELF,
                  delay: str = "1 day") -> DataFrame:
    """Received and sent per day; days older than the watermark are closed."""
    timed = mail.filter(V.in_correspondence()).withColumn(
        "at", F.col("date").cast("timestamp")).withWatermark("at", delay)
    return (timed.groupBy(F.window("at", "1 day")).agg(*stats.received_sent(self_email))
            .select(F.to_date("window.start").alias("day"), "received", "sent"))


def stream_folder_counts(mail: DataFrame) -> DataFrame:
    """Running total and unread per folder."""
    return mail.groupBy("folder").agg(
        F.count("*").alias("total"), F.count_if(~F.col("is_read")).alias("unread"))


def stream_label_counts(mail: DataFrame) -> DataFrame:
    """Running count per label."""
    labels = mail.select(F.explode_outer(csv_to_array(F.col("labels"))).alias("label"))
    return (labels.filter(F.col("label").isNotNull()).groupBy("label")
            .agg(F.count("*").alias("n")))


def view_counts_batch(mail: Table, *, self_email: str = DEFAULT_SELF):
    """For ``changes_to``: view counts that follow the clock.  Every batch of ticks counts
    the current mail table as of its newest tick; the key is ``view``."""
    def change(ticks: DataFrame) -> DataFrame:
        now = ticks.agg(F.max("ts").cast("timestamp_ntz")).scalar()
        return stats.view_counts(_current(mail), now, self_email=self_email).withColumn(
            "as_of", now)
    return change


def view_deltas(mail: DataFrame, since, *, self_email: str = DEFAULT_SELF) -> DataFrame:
    """(view, at, delta): how the view counts move when ``mail`` is there from ``since`` on.

    Only the end of a snooze moves a message between views, so each has its views at
    ``since`` and, if it sleeps then, what changes when it wakes. One row per view and
    moment, whatever the number of messages.
    """
    now, until = moment(since), F.col("snoozed_until")
    question = V.asks_question(mail)
    before = stats.counted_views(now, self_email, question)
    after = stats.counted_views(until, self_email, question)
    wakes = until > now
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    moves = F.array(*[
        F.struct(F.lit(v).alias("view"), at.alias("at"), delta.alias("delta"))
        for v in before for at, delta in (
            (now, one(before[v])),
            (until, F.when(wakes, one(after[v]) - one(before[v])).otherwise(0)))])
    rows = mail.select(F.explode_outer(moves).alias("m")).select("m.*")
    return rows.filter(F.col("delta") != 0).groupBy("view", "at").agg(F.sum("delta").alias("delta"))


def view_counts_by_deltas(deltas: Table, known: Callable[[], DataFrame | None]):
    """For a change log with the key ``view``: view counts that follow the clock without
    counting the mail again. Every batch of ticks adds the moves since the tick before.

    ``deltas`` are those of ``view_deltas``, with rows for later mail (``since`` its tick);
    ``known`` returns the counts of the newest tick, None before the first.
    """
    def change(ticks: DataFrame) -> DataFrame:
        now = ticks.agg(F.max("ts").cast("timestamp_ntz")).scalar()
        views = ticks.sparkSession.range(1).select(F.explode(F.array(
            *[F.lit(v) for v in COUNTED_VIEWS])).alias("view"))
        last = known()
        before = (views.withColumns({"n": F.lit(0).cast("long"),
                                     "as_of": F.lit(None).cast("timestamp_ntz")})
                  if last is None else last.select("view", "n", "as_of"))
        moves = _current(deltas).join(before.select("view", "as_of"), "view").filter(
            (F.col("at") <= now) & (F.col("as_of").isNull() | (F.col("at") > F.col("as_of")))).groupBy(
            "view").agg(F.sum("delta").alias("moved"))
        return before.join(moves, "view", "left").select(
            "view", (F.col("n") + F.coalesce("moved", F.lit(0))).alias("n"), now.alias("as_of"))
    return change


def stream_view_counts(mail: DataFrame, as_of, *, self_email: str = DEFAULT_SELF) -> DataFrame:
    """Running view counts for a fixed moment.  Membership moves with the clock: a
    job that follows the clock recomputes them per batch with ``stats.view_counts``."""
    rules = stats.counted_views(as_of, self_email)
    member = F.array(*[F.when(rule, F.lit(view)) for view, rule in rules.items()])
    views = mail.select(F.explode_outer(member).alias("view"))
    return views.filter(F.col("view").isNotNull()).groupBy("view").agg(
        F.count("*").alias("n"))
