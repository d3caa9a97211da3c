"""Raw input to mail rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.functions import lexicon as lx
from letterloom.functions.dates import moment
from letterloom.functions.intent import classify_intent
from letterloom.functions.text import (drop_tags, make_snippet, normalize_body,
                                       strip_space, trim_or_empty)
from letterloom.schema import (DEFAULT_SELF, DEFAULT_SELF_NAME, INBOUND, MAIL_COLUMNS,
                               NO_SUBJECT)


def _no_time() -> Column:
    return F.lit(None).cast("timestamp_ntz")


def read_inbound(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INBOUND).json(path)


def _or(name: str, default: str) -> Column:
    return strip_space(F.coalesce(name, F.lit(default)))


def _thread(df: DataFrame) -> Column:
    """The given thread, or a new one named after the message."""
    fresh = F.concat(F.lit("t_"), "id")
    if "threadId" not in df.columns:
        return fresh
    return F.coalesce(F.nullif("threadId", F.lit("")), fresh)


def _with_ids(raw: DataFrame) -> DataFrame:
    return raw if "id" in raw.columns else raw.withColumn("id", F.uuid())


def parse_time(text: Column) -> Column:
    """ISO time text to UTC wall time; NULL when it is not a time."""
    return F.to_utc_timestamp(text.try_cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")


def has_sender() -> Column:
    return (trim_or_empty(F.col("fromName")) != "") & (trim_or_empty(F.col("fromEmail")) != "")


def rejected_inbound(raw: DataFrame) -> DataFrame:
    """Posts without a sender name or address, or with a date that is none."""
    given = F.coalesce("date", F.lit("")) != ""
    reason = (F.when(~has_sender(), "fromName and fromEmail are required")
              .when(given & parse_time(F.col("date")).isNull(), "date is not a time"))
    return _with_ids(raw).withColumn("reason", reason).filter(F.col("reason").isNotNull())


def ingest_inbound(raw: DataFrame, as_of, *, self_email: str = DEFAULT_SELF) -> DataFrame:
    """Received messages as mail rows: unread, in the inbox, with their intent.

    A pure map, so it runs on a stream as it does on a table.  A missing date is
    the time of arrival, ``as_of``.
    """
    text = trim_or_empty(F.col("body"))
    given = F.coalesce("date", F.lit("")) != ""
    date = F.when(given, parse_time(F.col("date"))).otherwise(moment(as_of))
    raw = _with_ids(raw)
    rows = raw.filter(has_sender()).select(
        "id", _thread(raw).alias("thread_id"),
        strip_space(F.col("fromName")).alias("from_name"),
        strip_space(F.col("fromEmail")).alias("from_email"),
        _or("toEmails", self_email).alias("to_emails"),
        trim_or_empty(F.col("ccEmails")).alias("cc_emails"),
        trim_or_empty(F.col("bccEmails")).alias("bcc_emails"),
        _or("subject", NO_SUBJECT).alias("subject"),
        normalize_body(text).alias("body"), make_snippet(drop_tags(text)).alias("snippet"),
        date.alias("date"), F.lit(False).alias("is_read"), F.lit(False).alias("is_starred"),
        F.coalesce("isImportant", F.lit(False)).alias("is_important"),
        F.coalesce("hasAttachment", F.lit(False)).alias("has_attachment"),
        F.lit("INBOX").alias("folder"), trim_or_empty(F.col("labels")).alias("labels"),
        trim_or_empty(F.col("attachmentName")).alias("attachment_name"),
        _no_time().alias("snoozed_until"), _no_time().alias("scheduled_for"),
        moment(as_of).alias("created_at"), moment(as_of).alias("updated_at")
    ).filter(F.col("date").isNotNull())
    return _classified(rows, self_email)


def _classified(rows: DataFrame, self_email: str, **columns) -> DataFrame:
    return (classify_intent(rows, self_email=self_email, **columns)
            .withColumn("intent", F.col("signal.intent")).select(*MAIL_COLUMNS))


def _own_row(raw: DataFrame, as_of, self_email: str, *, subject: Column, text: Column,
             snippet: Column, date: Column, folder: Column, scheduled: Column,
             to: Column) -> DataFrame:
    """A row the mailbox owner wrote; ``raw_text`` stays for the classifier."""
    here = set(raw.columns)
    opt = lambda n: trim_or_empty(F.col(n)) if n in here else F.lit("")
    file_name = opt("attachmentName")
    attached = (F.coalesce("hasAttachment", F.lit(False)) if "hasAttachment" in here
                else file_name != "")
    return raw.select(
        "id", _thread(raw).alias("thread_id"),
        (_or("fromName", DEFAULT_SELF_NAME) if "fromName" in here
         else F.lit(DEFAULT_SELF_NAME)).alias("from_name"),
        (_or("fromEmail", self_email) if "fromEmail" in here
         else F.lit(self_email)).alias("from_email"),
        to.alias("to_emails"), opt("ccEmails").alias("cc_emails"),
        opt("bccEmails").alias("bcc_emails"), subject.alias("subject"),
        normalize_body(text).alias("body"), snippet.alias("snippet"), date.alias("date"),
        F.lit(True).alias("is_read"), F.lit(False).alias("is_starred"),
        F.lit(False).alias("is_important"), attached.alias("has_attachment"),
        folder.alias("folder"), opt("labels").alias("labels"),
        file_name.alias("attachment_name"), _no_time().alias("snoozed_until"),
        scheduled.alias("scheduled_for"), moment(as_of).alias("created_at"),
        moment(as_of).alias("updated_at"), text.alias("raw_text"))


def ingest_outbound(raw: DataFrame, as_of, *, self_email: str = DEFAULT_SELF) -> DataFrame:
    """Sent messages from other programs.  Only a future ``scheduledFor`` schedules;
    the date is always ``as_of``; the intent comes from the body as posted."""
    raw = _with_ids(raw)
    text, to = trim_or_empty(F.col("body")), trim_or_empty(F.col("toEmails"))
    later = F.coalesce(F.col("scheduledFor") > moment(as_of), F.lit(False))
    rows = _own_row(
        raw, as_of, self_email, subject=_or("subject", NO_SUBJECT), text=text,
        snippet=make_snippet(drop_tags(text)), date=moment(as_of),
        folder=F.when(later, "SCHEDULED").otherwise("SENT"),
        scheduled=F.when(later, F.col("scheduledFor")), to=to)
    return _classified(rows.filter(F.col("to_emails") != ""), self_email, body="raw_text",
                       snippet=None, labels=None, from_name=None)


def ingest_composed(raw: DataFrame, as_of, *, self_email: str = DEFAULT_SELF) -> DataFrame:
    """Drafts, scheduled and sent messages from the composer.  Drafts may lack a
    recipient; any ``scheduledFor`` schedules and becomes the date."""
    raw = _with_ids(raw)
    draft = F.coalesce("isDraft", F.lit(False))
    when = F.col("scheduledFor")
    text, to = F.coalesce("body", F.lit("")), trim_or_empty(F.col("toEmails"))
    subject = trim_or_empty(F.col("subject"))
    body = normalize_body(text)
    rows = _own_row(
        raw.filter(draft | (to != "")), as_of, self_email, subject=subject, text=text,
        snippet=make_snippet(body), date=F.coalesce(when, moment(as_of)),
        folder=F.when(draft, "DRAFTS").when(when.isNotNull(), "SCHEDULED").otherwise("SENT"),
        scheduled=when, to=to)
    classified = _classified(rows, self_email, snippet=None, labels=None, from_name=None)
    return classified.withColumn(
        "subject", F.when(F.col("subject") == "", NO_SUBJECT).otherwise(F.col("subject")))


# --- Raw messages -------------------------------------------------------------------

def read_raw_messages(spark: SparkSession, path: str, *, stream: bool = False,
                      separator: str | None = None) -> DataFrame:
    """The messages in the files in any folder below ``path``: (id, value, file, arrived).
    A file is one message, or holds many that each end with ``separator`` (U+0000 suits, which
    no message may contain). The id is made of the content, so a message that is read
    again, from wherever, has the same; ``arrived`` is the time of the file."""
    reader = (spark.readStream if stream else spark.read).format("text")
    reader = reader.option("wholetext", True) if separator is None else reader.option("lineSep", separator)
    return (reader.option("recursiveFileLookup", True)
            .load(path).select(
                F.left(F.sha2("value", 256), F.lit(32)).alias("id"), "value",
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_modification_time").alias("arrived")))


def parse_raw_messages(raw: DataFrame) -> DataFrame:
    """Header and body text to the inbound shape (``envelope_from``/``envelope_to``
    come from the transport when known; ``arrived`` stays)."""
    here = set(raw.columns)
    envelope = lambda n: F.col(n) if n in here else F.lit(None).cast("string")
    cut = F.split("value", "\r\n\r\n", 2)
    header, body = F.get(cut, F.lit(0)), F.coalesce(F.get(cut, F.lit(1)), F.lit(""))
    # A header value is the rest of its line; white space after the colon may
    # contain the line break, as the mail service reads it.
    value_of = lambda name: F.regexp_extract(
        header, rf"(?i){name}:{lx.SPACE}*([^\r\n\x{{2028}}\x{{2029}}]+)", 1)
    subject = F.nullif(value_of("Subject"), F.lit(""))
    sender = F.coalesce(F.nullif(value_of("From"), F.lit("")), envelope("envelope_from"),
                        F.lit(""))
    name = strip_space(F.regexp_replace(sender, "^([^<]*)<[^>]+>", "$1"))
    html = F.when(body.contains("<"), body).otherwise(
        F.concat(F.lit("<p>"), F.replace(body, F.lit("\r\n"), F.lit("<br/>")), F.lit("</p>")))
    return raw.select(
        "id", F.coalesce(F.nullif(name, F.lit("")), F.lit("Unknown")).alias("fromName"),
        F.coalesce(envelope("envelope_from"),
                   F.nullif(F.regexp_extract(sender, "<([^>]+)>", 1), F.lit("")))
        .alias("fromEmail"),
        envelope("envelope_to").alias("toEmails"), F.lit(None).cast("string").alias("ccEmails"),
        F.lit(None).cast("string").alias("bccEmails"),
        F.coalesce(subject, F.lit(NO_SUBJECT)).alias("subject"), html.alias("body"),
        F.lit(None).cast("string").alias("date"), F.lit(None).cast("string").alias("labels"),
        F.lit(None).cast("string").alias("attachmentName"),
        F.lit(None).cast("string").alias("threadId"),
        F.lit(None).cast("boolean").alias("hasAttachment"),
        F.lit(None).cast("boolean").alias("isImportant"), *[c for c in ("arrived",) if c in here])


def ingest_raw_messages(raw: DataFrame, as_of, *, self_email: str = DEFAULT_SELF
                        ) -> DataFrame:
    return ingest_inbound(parse_raw_messages(raw), as_of, self_email=self_email)
