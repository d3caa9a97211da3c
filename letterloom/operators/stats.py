"""Counts and trends.

Every report is one pass with partial aggregation in the scan tasks; what is
shuffled is one row per task and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from letterloom.functions.dates import date_bucket, moment
from letterloom.functions.intent import intent_label, with_category
from letterloom.functions.lists import unnest
from letterloom.functions.text import csv_to_array
from letterloom.operators import views as V
from letterloom.schema import (CATEGORIES, COUNTED_VIEWS, DATE_BUCKETS, DEFAULT_SELF,
                               FOLDERS)


def rows_of(one_row: DataFrame, key: str, columns: dict[str, list[str]],
            names: list[str], *keep: str) -> DataFrame:
    """Turn an aggregate of one row (per ``keep``) into one row per name."""
    structs = [F.struct(F.lit(n).alias(key), *[F.col(f"`{cols[i]}`").alias(c)
                                             for c, cols in columns.items()])
               for i, n in enumerate(names)]
    return one_row.select(*keep, F.inline(F.array(*structs)))


def received_sent(self_email: str | Column) -> list[Column]:
    return [F.count_if(~V.is_own(self_email)).alias("received"),
            F.count_if(V.is_own(self_email)).alias("sent")]


def total_columns(self_email: str | Column) -> list[Column]:
    return [*received_sent(self_email),
            F.count_if(~F.col("is_read") & (F.col("folder") == "INBOX")).alias("unread"),
            F.count_if(F.col("intent") == "REQUIRES_REPLY").alias("needs_reply")]


def totals(df: DataFrame, *, self_email: str = DEFAULT_SELF) -> DataFrame:
    return df.filter(V.in_correspondence()).agg(*total_columns(self_email))


def top_correspondents(df: DataFrame, *, self_email: str = DEFAULT_SELF,
                       k: int = 8) -> DataFrame:
    return (df.filter(V.in_correspondence() & ~V.is_own(self_email))
            .groupBy("from_email", "from_name")
            .agg(F.count("*").alias("n"), F.max("date").alias("last_date"))
            .orderBy(F.desc("n"), "from_email", "from_name").limit(k))


def daily_volume(df: DataFrame, *, self_email: str = DEFAULT_SELF) -> DataFrame:
    return (df.filter(V.in_correspondence())
            .groupBy(F.to_date("date").alias("day")).agg(*received_sent(self_email)))


def volume_by_day(df: DataFrame, as_of, *, self_email: str = DEFAULT_SELF,
                  days: int = 14) -> DataFrame:
    """Zero-filled received and sent per day, ending with the day of ``as_of``.

    The mail side is cut to the period and reduced to at most ``days`` rows
    before it meets the calendar.
    """
    today = F.to_date(moment(as_of))
    first = F.date_sub(today, days - 1)
    calendar = df.sparkSession.range(1).select(
        F.explode(F.sequence(first, today)).alias("day"))
    in_period = df.filter((F.col("date") >= first.cast("timestamp_ntz"))
                          & (F.col("date") < F.date_add(today, 1).cast("timestamp_ntz")))
    counts = daily_volume(in_period, self_email=self_email)
    return calendar.join(counts, "day", "left").select(
        "day", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("received", "sent")])


def volume_scaled(volume: DataFrame) -> DataFrame:
    """Bar heights: percent of the largest value of the period.  ``volume`` is a day
    series, a few rows, so one window over it finds the peak without computing it again."""
    whole = Window.partitionBy(F.lit(1))
    peak = F.greatest(F.lit(1), F.max("received").over(whole), F.max("sent").over(whole))
    share = lambda c: F.floor(F.lit(100) * F.col(c) / peak + 0.5)
    return volume.select("day", share("received").alias("received_pct"),
                         share("sent").alias("sent_pct"))


def intent_distribution(df: DataFrame) -> DataFrame:
    return (df.filter(V.in_correspondence() & (F.col("intent") != ""))
            .groupBy("intent").agg(F.count("*").alias("n")))


def intent_ranking(df: DataFrame, k: int = 8) -> DataFrame:
    return (intent_distribution(df).orderBy(F.desc("n"), "intent").limit(k)
            .withColumn("label", intent_label(F.col("intent"))))


def folder_counts(df: DataFrame) -> DataFrame:
    """Total and unread of every folder, empty ones included."""
    return folder_rows(df.agg(*folder_columns()))


def folder_columns() -> list[Column]:
    here = lambda f: F.col("folder") == f
    return [*[F.count_if(here(f)).alias(f"total {f}") for f in FOLDERS],
            *[F.count_if(here(f) & ~F.col("is_read")).alias(f"unread {f}") for f in FOLDERS]]


def folder_rows(one_row: DataFrame, *keep: str) -> DataFrame:
    cols = {"total": [f"total {f}" for f in FOLDERS],
            "unread": [f"unread {f}" for f in FOLDERS]}
    return rows_of(one_row, "folder", cols, FOLDERS, *keep)


def counted_views(as_of, self_email: str | Column, question: Column | None = None
                  ) -> dict[str, Column]:
    """Membership of the views that carry a badge.

    Here every smart view hides snoozed mail, and starred or important mail is
    hidden only while it is snoozed in INBOX or ARCHIVE.
    """
    asleep, own = V.snoozed(as_of), V.is_own(self_email)
    set_aside = asleep & V.in_folders("INBOX", "ARCHIVE")
    awake = {
        "NOW": (F.col("folder") == "INBOX") & V.needs_attention(),
        "REPLY": (~own & (F.col("intent") == "REQUIRES_REPLY")
                  & V.in_folders("INBOX", "ARCHIVE")),
        "WAITING": own & (F.col("folder") == "SENT") & V.awaits_answer(question),
        "RECEIPTS": V.in_correspondence() & V.about_purchase(),
        "SUBSCRIPTIONS": V.in_folders("INBOX", "ARCHIVE") & V.about_subscription(),
    }
    return {
        "STARRED": (~set_aside & F.col("is_starred")
                    & V.in_folders("INBOX", "SENT", "DRAFTS", "ARCHIVE")),
        "IMPORTANT": ~set_aside & F.col("is_important") & V.in_correspondence(),
        "SNOOZED": set_aside,
        **{name: ~asleep & rule for name, rule in awake.items()},
    }


def _newest_in(condition: Column) -> Column:
    """(id, subject, from_name) of the newest row with a subject that satisfies
    ``condition``.  Rows outside it get a NULL rank, which ``max_by`` skips."""
    rank = F.when(condition & (F.col("subject") != ""), F.struct("date", "id"))
    return F.max_by(F.struct("id", "subject", "from_name"), rank)


def view_summary(df: DataFrame, as_of, *, self_email: str = DEFAULT_SELF) -> DataFrame:
    """Count and newest titled item of every counted view, in one pass."""
    rules = counted_views(as_of, self_email, V.asks_question(df))
    smart = [v.upper() for v in V.SMART_VIEWS]
    no_item = F.lit(None).cast("struct<id:string,subject:string,from_name:string>")
    # Conditions first, in a projection, so that count and newest item share them.
    flagged = df.select("id", "subject", "from_name", "date",
                        *[rules[v].alias(f"in {v}") for v in COUNTED_VIEWS])
    one_row = flagged.agg(
        *[F.count_if(F.col(f"`in {v}`")).alias(f"n {v}") for v in COUNTED_VIEWS],
        *[(_newest_in(F.col(f"`in {v}`")) if v in smart else F.first(no_item))
          .alias(f"top {v}") for v in COUNTED_VIEWS])
    return rows_of(one_row, "view", {"n": [f"n {v}" for v in COUNTED_VIEWS],
                                      "top": [f"top {v}" for v in COUNTED_VIEWS]},
                    COUNTED_VIEWS)


def view_counts(df: DataFrame, as_of, *, self_email: str = DEFAULT_SELF) -> DataFrame:
    rules = counted_views(as_of, self_email, V.asks_question(df))
    one_row = df.agg(*[F.count_if(rules[v]).alias(v) for v in COUNTED_VIEWS])
    return rows_of(one_row, "view", {"n": COUNTED_VIEWS}, COUNTED_VIEWS)


def top_item_per_view(df: DataFrame, as_of, *,
                      self_email: str = DEFAULT_SELF) -> DataFrame:
    """Newest titled message of each smart view; NULLs when the view is empty."""
    smart = [v.upper() for v in V.SMART_VIEWS]
    return (view_summary(df, as_of, self_email=self_email)
            .filter(F.col("view").isin(smart)).select("view", "top.*"))


def label_counts(df: DataFrame) -> DataFrame:
    """One per occurrence, in every folder; a repeated label counts again."""
    return (unnest(df, csv_to_array(F.col("labels")), "label")
            .groupBy("label").agg(F.count("*").alias("n")))


def label_summary(labels: DataFrame, df: DataFrame) -> DataFrame:
    """Every label of the dictionary with its count, by name."""
    counts = label_counts(df).withColumnRenamed("label", "name")
    return (labels.join(counts, "name", "left")
            .select("name", "color", F.coalesce("n", F.lit(0)).alias("n")).orderBy("name"))


def category_counts(df: DataFrame, as_of) -> DataFrame:
    """The inbox tabs: ALL and each derived category, zeros included."""
    one_row = with_category(df.filter(V.folder_view("INBOX", as_of))).agg(
        F.count("*").alias("ALL"),
        *[F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES])
    return rows_of(one_row, "category", {"n": ["ALL", *CATEGORIES]}, ["ALL", *CATEGORIES])


def date_bucket_counts(df: DataFrame, as_of) -> DataFrame:
    """Rows per date group, newest group first; empty groups are absent."""
    buckets = F.array(*[F.lit(b) for b in DATE_BUCKETS])
    return (df.groupBy(date_bucket(F.col("date"), as_of).alias("bucket"))
            .agg(F.count("*").alias("n"))
            .withColumn("ordinal", F.array_position(buckets, F.col("bucket")))
            .orderBy("ordinal"))


def common_labels(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Labels that all selected messages carry."""
    chosen = V.lookup(df, "id", ids.distinct()).select("id", "labels")
    n_chosen = chosen.agg(F.count("*")).scalar()
    return (unnest(chosen, F.array_distinct(csv_to_array(F.col("labels"))), "label")
            .groupBy("label").agg(F.count("*").alias("n"))
            .filter(F.col("n") == n_chosen).select("label"))


def changed_rows(before: DataFrame, after: DataFrame, columns: list[str],
                 key: str = "id") -> DataFrame:
    """How many rows differ in ``columns`` between two versions of a table."""
    version = lambda df: df.select(key, F.struct(*columns).alias("v"))
    both = version(before).join(version(after).withColumnRenamed("v", "w"), key)
    return both.agg(F.count_if(~F.col("v").eqNullSafe(F.col("w"))).alias("changed"))
