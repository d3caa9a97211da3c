"""Table schemas, enumerations and defaults of the mail model."""

from __future__ import annotations

from pyspark.sql import types as T

DEFAULT_SELF = "me@example.com"
DEFAULT_SELF_NAME = "Me"
NO_SUBJECT = "(no subject)"

# The enumerations of the data model.
FOLDERS = ["INBOX", "SENT", "DRAFTS", "SCHEDULED", "TRASH", "SPAM", "ARCHIVE"]
INTENTS = [
    "REQUIRES_REPLY", "FYI", "INVOICE", "RECEIPT", "ORDER", "SHIPMENT",
    "COMMITMENT", "MEETING", "NEWSLETTER", "PROMOTION", "NOTIFICATION",
    "SECURITY_ALERT", "SOCIAL", "PERSONAL", "BUSINESS",
]
CATEGORIES = ["PRIMARY", "PROMOTIONS", "SOCIAL", "UPDATES"]
DATE_BUCKETS = ["Today", "Yesterday", "This week", "This month", "Earlier"]
PURGEABLE_FOLDERS = ["TRASH", "SPAM"]
COUNTED_VIEWS = [
    "STARRED", "IMPORTANT", "SNOOZED", "NOW", "REPLY", "WAITING", "RECEIPTS",
    "SUBSCRIPTIONS",
]

# Folders whose messages count as correspondence in reports.
CORRESPONDENCE = ["INBOX", "SENT", "ARCHIVE"]


def _fields(names: str, kind: T.DataType, nullable: bool = False) -> list[T.StructField]:
    return [T.StructField(n, kind, nullable) for n in names.split()]


MAIL = T.StructType(
    _fields("id thread_id from_name from_email to_emails cc_emails bcc_emails "
            "subject body snippet", T.StringType())
    + _fields("date", T.TimestampNTZType())
    + _fields("is_read is_starred is_important has_attachment", T.BooleanType())
    + _fields("folder labels attachment_name intent", T.StringType())
    + _fields("snoozed_until scheduled_for created_at updated_at",
              T.TimestampNTZType(), nullable=True)
)
MAIL_COLUMNS = [f.name for f in MAIL.fields]

# Derived at ingest when asked for: spares reports from reading bodies.
HINTS = T.StructType([T.StructField("has_question", T.BooleanType(), False)])

# Everything a list needs: the mail row without its body, copies and bookkeeping.
LIST_COLUMNS = [
    "id", "thread_id", "from_name", "from_email", "to_emails", "subject", "snippet",
    "date", "is_read", "is_starred", "is_important", "folder", "labels",
    "has_attachment", "attachment_name", "snoozed_until", "scheduled_for", "intent",
]

LABEL = T.StructType(_fields("id name color", T.StringType()))

LINK = T.StructType(
    _fields("id email_id recipient_email token", T.StringType())
    + _fields("viewed", T.BooleanType())
    + _fields("viewed_at expires_at created_at", T.TimestampNTZType(), nullable=True)
)

INBOUND = T.StructType(
    _fields("fromName fromEmail toEmails ccEmails bccEmails subject body date labels "
            "attachmentName threadId", T.StringType(), nullable=True)
    + _fields("hasAttachment isImportant", T.BooleanType(), nullable=True)
)

# What a model is asked to answer; every field may be missing.
REPLY_JSON = ("intent STRING, confidence DOUBLE, reason STRING, reasoning STRING, "
              "summary STRING, "
              "suggestedReply STRING, score DOUBLE, "
              "commitments ARRAY<STRUCT<who: STRING, action: STRING, due: STRING, "
              "source: STRING>>")
