"""Changes to the mail table (J4, J6-J14, J17, A21, T2, T3, X26 persist).

A change is a new version of the table: the old rows joined to a table of
changes.  Change tables are reduced to one row per key first, so repeated
requests neither duplicate rows nor pile up on one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.functions.compose import reply_subject
from letterloom.functions.dates import moment
from letterloom.functions.intent import classify_intent
from letterloom.functions.lists import add_label, remove_label
from letterloom.functions.text import make_snippet, normalize_body, strip_space
from letterloom.operators.views import due_scheduled, lookup
from letterloom.schema import (DEFAULT_SELF, DEFAULT_SELF_NAME, FOLDERS, MAIL_COLUMNS,
                               PURGEABLE_FOLDERS)

FLAG_FIELDS = ["is_read", "is_starred", "is_important"]
PATCH_FIELDS = FLAG_FIELDS + ["folder", "snippet", "body", "subject", "to_emails",
                              "cc_emails", "labels", "intent"]


def _latest_changes(changes: DataFrame, fields: list[str]) -> DataFrame:
    """One row per id: the last value given for each field, and the last word on
    the snooze (a time, or ``clear_snooze``).  Order is ``seq`` when present; of values
    with the same place the greatest counts, so the result can be repeated."""
    given = [f for f in fields if f in changes.columns]
    order = F.col("seq") if "seq" in changes.columns else F.lit(0)
    snooze = ([F.col("snoozed_until")] if "snoozed_until" in changes.columns
              else [F.lit(None).cast("timestamp_ntz").alias("snoozed_until")])
    clear = (F.coalesce("clear_snooze", F.lit(False)) if "clear_snooze" in changes.columns
             else F.lit(False)).alias("clear_snooze")
    rows = changes.select("id", order.alias("_order"), *given, *snooze, clear)
    speaks = F.col("clear_snooze") | F.col("snoozed_until").isNotNull()
    return rows.groupBy("id").agg(
        *[F.max(F.when(F.col(f).isNotNull(), F.struct("_order", f)))[f].alias(f"new_{f}")
          for f in given],
        F.max(F.when(speaks, F.struct("_order", F.struct("clear_snooze", "snoozed_until")
                                      .alias("snooze"))))["snooze"].alias("snooze"))


def _apply(mail: DataFrame, latest: DataFrame) -> DataFrame:
    """Old row where nothing is given, new value where something is."""
    given = {c[4:] for c in latest.columns if c.startswith("new_")}

    def value(column: str) -> Column:
        old = F.col(column)
        if column in given:
            return F.coalesce(f"new_{column}", old).alias(column)
        if column == "snoozed_until":
            return (F.when(F.col("snooze").isNull(), old)
                    .when(F.col("snooze.snoozed_until").isNotNull(),
                          F.col("snooze.snoozed_until"))
                    .alias(column))
        return old

    return mail.join(latest, "id", "left").select(*[value(c) for c in mail.columns])


def bulk_update(mail: DataFrame, updates: DataFrame) -> DataFrame:
    """Set flags, folder or snooze of many messages.  NULL means unchanged, an
    unknown folder is ignored, ``clear_snooze`` removes the snooze."""
    valid = updates
    if "folder" in updates.columns:
        valid = updates.withColumn(
            "folder", F.when(F.col("folder").isin(FOLDERS), F.col("folder")))
    return _apply(mail, _latest_changes(valid, [*FLAG_FIELDS, "folder"]))


def update_fields(mail: DataFrame, patch: DataFrame) -> DataFrame:
    """Set any of the eleven editable fields, or the snooze, of single messages."""
    return _apply(mail, _latest_changes(patch, PATCH_FIELDS))


def undo_snapshot(mail: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The values to restore later, taken before a bulk change."""
    return lookup(mail, "id", ids).select("id", F.col(column).alias("previous"))


def undo_bulk(mail: DataFrame, previous: DataFrame, column: str) -> DataFrame:
    """Restore ``column`` from a snapshot; a NULL in the snapshot is restored too.  An id
    that the snapshot repeats gets the smallest of its values."""
    kept = previous.groupBy("id").agg(F.min(F.struct("previous")).alias("_kept"))
    old = F.when(F.col("_kept").isNotNull(), F.col("_kept.previous")).otherwise(F.col(column))
    return mail.join(kept, "id", "left").select(
        *[old.alias(c) if c == column else F.col(c) for c in mail.columns])


def relabel(mail: DataFrame, ids: DataFrame, label: str, *, remove: bool = False) -> DataFrame:
    """Add or remove one label on the given messages."""
    change = remove_label if remove else add_label
    marked = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    labels = F.when(F.col("_hit"), change(F.col("labels"), label)).otherwise(F.col("labels"))
    return mail.join(marked, "id", "left").select(
        *[labels.alias(c) if c == "labels" else F.col(c) for c in mail.columns])


# --- Replies ----------------------------------------------------------------------

def build_replies(requests: DataFrame, mail: DataFrame, as_of, *,
                  self_email: str = DEFAULT_SELF, keep_intent_empty: bool = False
                  ) -> DataFrame:
    """Reply rows for (reply_id, original_id, body, attachment_name) requests."""
    html = normalize_body(F.coalesce("r.body", F.lit("")))
    now = moment(as_of)
    file_name = F.coalesce("r.attachment_name", F.lit(""))
    rows = requests.alias("r").join(
        mail.select("id", "thread_id", "from_email", "cc_emails", "subject", "is_starred",
                    "labels").alias("o"),
        F.col("r.original_id") == F.col("o.id")).select(
        F.col("r.reply_id").alias("id"), F.col("o.thread_id").alias("thread_id"),
        F.lit(DEFAULT_SELF_NAME).alias("from_name"), F.lit(self_email).alias("from_email"),
        F.col("o.from_email").alias("to_emails"), F.col("o.cc_emails").alias("cc_emails"),
        F.lit("").alias("bcc_emails"), reply_subject(F.col("o.subject")).alias("subject"),
        html.alias("body"), make_snippet(html).alias("snippet"), now.alias("date"),
        F.lit(True).alias("is_read"), F.col("o.is_starred").alias("is_starred"),
        F.lit(False).alias("is_important"), (file_name != "").alias("has_attachment"),
        F.lit("SENT").alias("folder"), F.col("o.labels").alias("labels"),
        file_name.alias("attachment_name"),
        F.lit(None).cast("timestamp_ntz").alias("snoozed_until"),
        F.lit(None).cast("timestamp_ntz").alias("scheduled_for"),
        now.alias("created_at"), now.alias("updated_at"))
    if keep_intent_empty:
        rows = rows.withColumn("intent", F.lit(""))
    else:
        rows = (classify_intent(rows, self_email=self_email, snippet=None, labels=None,
                                from_name=None)
                .withColumn("intent", F.col("signal.intent")))
    return rows.select(*MAIL_COLUMNS)


def _replied(requests: DataFrame) -> DataFrame:
    return requests.select(F.col("original_id").alias("id")).distinct()


def mark_read_on_reply(mail: DataFrame, requests: DataFrame) -> DataFrame:
    return bulk_update(mail, _replied(requests).withColumn("is_read", F.lit(True)))


def archive_replied(mail: DataFrame, requests: DataFrame, *, enabled: bool = True
                    ) -> DataFrame:
    """Originals that were answered and still sit in the inbox are archived."""
    if not enabled:
        return mail
    hit = _replied(requests).withColumn("_hit", F.lit(True))
    folder = F.when(F.col("_hit") & (F.col("folder") == "INBOX"), "ARCHIVE").otherwise(
        F.col("folder"))
    return mail.join(hit, "id", "left").select(
        *[folder.alias(c) if c == "folder" else F.col(c) for c in mail.columns])


# --- Removal ----------------------------------------------------------------------

def delete_cascade(ids: DataFrame, mail: DataFrame, links: DataFrame
                   ) -> tuple[DataFrame, DataFrame]:
    """Mail without the given ids, and links without links to them."""
    gone = ids.select("id")
    return (mail.join(gone, "id", "left_anti"),
            links.join(gone.withColumnRenamed("id", "email_id"), "email_id", "left_anti")
            .select(*links.columns))


def empty_folder(mail: DataFrame, links: DataFrame, folder: str
                 ) -> tuple[DataFrame, DataFrame]:
    """Drop everything in TRASH or SPAM, with its links."""
    if folder not in PURGEABLE_FOLDERS:
        raise ValueError(f"only {PURGEABLE_FOLDERS} can be emptied")
    there = F.col("folder") == folder
    gone = mail.filter(there).select(F.col("id").alias("email_id"))
    return (mail.filter(~there),
            links.join(gone, "email_id", "left_anti").select(*links.columns))


def drop_sent_drafts(mail: DataFrame, sent: DataFrame) -> DataFrame:
    """Remove drafts that were sent; ``sent`` has ``draft_id``."""
    done = sent.select(F.col("draft_id").alias("id"), F.lit("DRAFTS").alias("folder"))
    return mail.join(done, ["id", "folder"], "left_anti").select(*mail.columns)


# --- Labels -----------------------------------------------------------------------

def add_labels(labels: DataFrame, new: DataFrame) -> DataFrame:
    """The dictionary with new names: trimmed, non-empty, not taken.  A name given
    twice is taken once."""
    name = strip_space(F.coalesce("name", F.lit("")))
    color = strip_space(F.coalesce("color", F.lit("gray")))
    wanted = (new.select(name.alias("name"), color.alias("color")).filter(F.col("name") != "")
              .groupBy("name").agg(F.min("color").alias("color"))
              .join(labels.select("name"), "name", "left_anti")
              .select(F.concat(F.lit("lbl-"), F.lower("name")).alias("id"), "name", "color"))
    return labels.select("id", "name", "color").unionByName(wanted)


# --- Time-driven changes ------------------------------------------------------------

def deliver_due(mail: DataFrame, as_of) -> DataFrame:
    """Scheduled messages whose time has come are sent.  Running it again changes
    nothing; it is one map over the table."""
    due = F.coalesce(due_scheduled(as_of), F.lit(False))
    change = {"folder": F.when(due, "SENT").otherwise(F.col("folder")),
              "scheduled_for": F.when(~due, F.col("scheduled_for"))}
    return mail.select(*[change[c].alias(c) if c in change else F.col(c)
                         for c in mail.columns])


def snooze_returns(mail: DataFrame, t0, t1) -> DataFrame:
    """Messages whose snooze ended after ``t0`` and not later than ``t1``."""
    until = F.col("snoozed_until")
    return mail.filter((until > moment(t0)) & (until <= moment(t1)))


def append_mail(mail: DataFrame, new: DataFrame) -> DataFrame:
    return mail.unionByName(new)
