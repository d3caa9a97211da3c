"""The reports for any number of mailboxes at once.

The mail has a ``mailbox`` column, and ``owners`` one row (mailbox, self_email) per mailbox:
own mail is what its owner sent. Every report groups by mailbox in the aggregates of the
single reports, which combine in the scan tasks, so a mailbox with a third of all mail is
one row per task. Mailboxes without mail are there with zeros.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from letterloom.functions.dates import moment
from letterloom.operators import people as P
from letterloom.operators import stats as S
from letterloom.operators import threads as T
from letterloom.operators import views as V
from letterloom.schema import COUNTED_VIEWS

OWNER = "owner_email"


def with_owner(mail: DataFrame, owners: DataFrame) -> DataFrame:
    """Mail with the address of its mailbox's owner; mail of unknown mailboxes is left out."""
    return mail.join(owners.select("mailbox", F.col("self_email").alias(OWNER)), "mailbox")


def _every_mailbox(owners: DataFrame, counts: DataFrame) -> DataFrame:
    """Counts with a row of zeros for each mailbox without any."""
    numbers = [c for c in counts.columns if c != "mailbox"]
    return owners.select("mailbox").join(counts, "mailbox", "left").select(
        "mailbox", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in numbers])


def totals(mail: DataFrame, owners: DataFrame) -> DataFrame:
    rows = with_owner(mail.filter(V.in_correspondence()), owners)
    return _every_mailbox(owners, rows.groupBy("mailbox").agg(*S.total_columns(F.col(OWNER))))


def top_correspondents(mail: DataFrame, owners: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` most frequent senders of each mailbox. Senders are counted first, one row
    each; then every task keeps its best ``k`` of a mailbox before they meet."""
    rows = with_owner(mail.filter(V.in_correspondence()), owners).filter(~V.is_own(F.col(OWNER)))
    counts = rows.groupBy("mailbox", "from_email", "from_name").agg(
        F.count("*").alias("n"), F.max("date").alias("last_date"))
    order = Window.partitionBy("mailbox").orderBy(F.desc("n"), "from_email", "from_name")
    best = counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    return best.withColumn("place", F.col("place").cast("long"))


def daily_volume(mail: DataFrame, owners: DataFrame) -> DataFrame:
    rows = with_owner(mail.filter(V.in_correspondence()), owners)
    return rows.groupBy("mailbox", F.to_date("date").alias("day")).agg(*S.received_sent(F.col(OWNER)))


def volume_by_day(mail: DataFrame, owners: DataFrame, as_of, days: int = 14) -> DataFrame:
    """Received and sent per mailbox and day of the period, zeros included: the calendar is
    made for each row of ``owners``."""
    today = F.to_date(moment(as_of))
    first = F.date_sub(today, days - 1)
    calendar = owners.select("mailbox", F.explode(F.sequence(first, today)).alias("day"))
    in_period = mail.filter((F.col("date") >= first.cast("timestamp_ntz"))
                            & (F.col("date") < F.date_add(today, 1).cast("timestamp_ntz")))
    return calendar.join(daily_volume(in_period, owners), ["mailbox", "day"], "left").select(
        "mailbox", "day", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("received", "sent")])


def folder_counts(mail: DataFrame, owners: DataFrame) -> DataFrame:
    counts = mail.groupBy("mailbox").agg(*S.folder_columns())
    return S.folder_rows(_every_mailbox(owners, counts), "mailbox")


def view_counts(mail: DataFrame, owners: DataFrame, as_of) -> DataFrame:
    rows = with_owner(mail, owners)
    rules = S.counted_views(as_of, F.col(OWNER), V.asks_question(rows))
    counts = rows.groupBy("mailbox").agg(*[F.count_if(rules[v]).alias(v) for v in COUNTED_VIEWS])
    return S.rows_of(_every_mailbox(owners, counts), "view", {"n": COUNTED_VIEWS}, COUNTED_VIEWS, "mailbox")


def conversations(mail: DataFrame, owners: DataFrame) -> DataFrame:
    return T.conversations(with_owner(mail, owners), self_email=F.col(OWNER), keys=("mailbox", "thread_id"))


def contacts(mail: DataFrame, owners: DataFrame) -> DataFrame:
    seen = P.address_union(with_owner(mail, owners), "mailbox", OWNER).filter(
        F.lower("email") != F.lower(OWNER))
    return P.named_addresses(seen, "mailbox")
