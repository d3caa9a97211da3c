"""Smart views, search, sorting and paging.

Predicates are Columns, so they reach the Parquet scan; a view never forces a
shuffle, and lists use ``orderBy().limit()``, which keeps k rows per task.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.functions.dates import moment
from letterloom.functions.lists import has_label, label_mentions
from letterloom.schema import CORRESPONDENCE, DEFAULT_SELF, FOLDERS, LIST_COLUMNS

# The intents behind each smart view.
ATTENTION_INTENTS = ["REQUIRES_REPLY", "SECURITY_ALERT", "COMMITMENT", "MEETING"]
PURCHASE_INTENTS = ["INVOICE", "RECEIPT", "ORDER", "SHIPMENT"]
BULK_INTENTS = ["NEWSLETTER", "PROMOTION"]

SMART_VIEWS = ["now", "reply", "waiting", "receipts", "subscriptions"]

Term = tuple[str, str]


def is_own(self_email: str | Column) -> Column:
    """Sent by the owner, whose address is given or stands in a column."""
    owner = F.lower(self_email) if isinstance(self_email, Column) else self_email.lower()
    return F.lower("from_email") == owner


def in_folders(*folders: str) -> Column:
    return F.col("folder").isin(*folders)


def in_correspondence() -> Column:
    return in_folders(*CORRESPONDENCE)


def not_snoozed(as_of) -> Column:
    until = F.col("snoozed_until")
    return until.isNull() | (until <= moment(as_of))


def snoozed(as_of) -> Column:
    return F.coalesce(F.col("snoozed_until") > moment(as_of), F.lit(False))


# --- What makes a message belong to a view, apart from folder and snooze ---------

def needs_attention() -> Column:
    return (~F.col("is_read") | F.col("is_important")
            | F.col("intent").isin(ATTENTION_INTENTS))


def asks_question(df: DataFrame | None = None) -> Column:
    """Does the body hold a question mark?  Read from the stored hint when ``df`` has
    it, so that the widest column stays on disk."""
    if df is not None and "has_question" in df.columns:
        return F.col("has_question")
    return F.col("body").contains("?")


def awaits_answer(question: Column | None = None) -> Column:
    question = asks_question() if question is None else question
    return (F.col("intent") == "COMMITMENT") | question


def about_purchase() -> Column:
    return (F.col("intent").isin(PURCHASE_INTENTS)
            | label_mentions(F.col("labels"), "finance"))


def about_subscription() -> Column:
    return (F.col("intent").isin(BULK_INTENTS)
            | label_mentions(F.col("labels"), "newsletter"))


# --- Views ----------------------------------------------------------------------

def folder_view(folder: str | None, as_of) -> Column:
    """One folder; unknown or missing means INBOX, which hides snoozed mail."""
    chosen = folder if folder in FOLDERS else "INBOX"
    condition = F.col("folder") == chosen
    return condition & not_snoozed(as_of) if chosen == "INBOX" else condition


def starred_view(as_of) -> Column:
    return (F.col("is_starred") & in_folders("INBOX", "SENT", "DRAFTS", "ARCHIVE")
            & not_snoozed(as_of))


def important_view(as_of) -> Column:
    return F.col("is_important") & in_correspondence() & not_snoozed(as_of)


def snoozed_view(as_of) -> Column:
    return snoozed(as_of) & in_folders("INBOX", "ARCHIVE")


def label_view(label: str, as_of, exact: bool = False) -> Column:
    return (has_label(F.col("labels"), label, exact) & in_correspondence()
            & not_snoozed(as_of))


def smart_view(name: str, as_of, *, self_email: str = DEFAULT_SELF,
               strict_list: bool = False, question: Column | None = None) -> Column:
    """One of now, reply, waiting, receipts, subscriptions.

    ``strict_list`` keeps the owner's own mail in ``reply``; ``question`` replaces the
    search for a question mark in the body.
    """
    inbox_or_archive = in_folders("INBOX", "ARCHIVE")
    if name == "now":
        return (F.col("folder") == "INBOX") & not_snoozed(as_of) & needs_attention()
    if name == "reply":
        wanted = ((F.col("intent") == "REQUIRES_REPLY") & inbox_or_archive
                  & not_snoozed(as_of))
        return wanted if strict_list else wanted & ~is_own(self_email)
    if name == "waiting":
        return (F.col("folder") == "SENT") & awaits_answer(question)
    if name == "receipts":
        return in_correspondence() & not_snoozed(as_of) & about_purchase()
    if name == "subscriptions":
        return inbox_or_archive & not_snoozed(as_of) & about_subscription()
    raise ValueError(f"unknown smart view: {name}")


def view_condition(as_of, *, view: str | None = None, snoozed_only: bool = False,
                   starred: bool = False, important: bool = False,
                   label: str | None = None, folder: str | None = None,
                   self_email: str = DEFAULT_SELF, strict_list: bool = False,
                   question: Column | None = None) -> Column:
    """The most specific request wins: smart view, snoozed, starred, important,
    label, folder, else the inbox."""
    if view in SMART_VIEWS:
        return smart_view(view, as_of, self_email=self_email, strict_list=strict_list,
                          question=question)
    if snoozed_only:
        return snoozed_view(as_of)
    if starred:
        return starred_view(as_of)
    if important:
        return important_view(as_of)
    if label:
        return label_view(label, as_of)
    return folder_view(folder, as_of)


def mail_view(df: DataFrame, as_of, *, unread: bool = False, **request) -> DataFrame:
    """Rows of the requested view; ``unread`` narrows before any limit."""
    rows = df.filter(view_condition(as_of, question=asks_question(df), **request))
    return unread_only(rows) if unread else rows


def unread_only(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("is_read"))


def triage_queue(df: DataFrame, as_of) -> DataFrame:
    return unread_only(df.filter(folder_view("INBOX", as_of)))


def due_scheduled(as_of) -> Column:
    return ((F.col("folder") == "SCHEDULED")
            & (F.col("scheduled_for") <= moment(as_of)))


def category_tab(df: DataFrame, category: str, as_of) -> DataFrame:
    """Inbox rows of one derived category; ``df`` must carry ``category``."""
    return df.filter(folder_view("INBOX", as_of) & (F.col("category") == category))


# --- Search ---------------------------------------------------------------------

FREE_TEXT_COLUMNS = ["subject", "from_name", "from_email", "to_emails", "body", "snippet"]


def mentions(column: str, value: str, lowered: bool = False) -> Column:
    """Case-insensitive substring test; ``lowered`` when the column already is."""
    return (F.col(column) if lowered else F.lower(column)).contains(value.lower())


def _any(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def term_condition(field: str, value: str, lowered: bool = False) -> Column | None:
    """Condition of one term, or None when the term says nothing."""
    key, word = field.lower(), value.lower()
    flags = {"unread": ~F.col("is_read"), "read": F.col("is_read"),
             "starred": F.col("is_starred"), "important": F.col("is_important")}
    if key == "is":
        return flags.get(word)
    if key == "hasattachment" or (key == "has" and word == "attachment"):
        return F.col("has_attachment")
    if key == "from":
        return _any(mentions(c, value, lowered) for c in ("from_email", "from_name"))
    if key == "text":
        return _any(mentions(c, value, lowered) for c in FREE_TEXT_COLUMNS)
    columns = {"to": "to_emails", "subject": "subject", "label": "labels"}
    return mentions(columns[key], value, lowered) if key in columns else None


KNOWN_FIELDS = {"is", "has", "hasattachment", "from", "to", "subject", "label", "in", "text"}


def terms_of(query: str) -> list[Term]:
    """Split a search line into (field, value) terms; quotes group words and the
    words without a known field form one phrase."""
    terms, free, quoted = [], [], query.split('"')
    words: list[str] = []
    glue = False
    for i, chunk in enumerate(quoted):
        pieces = [chunk] if i % 2 else chunk.split()
        if pieces and words and glue and not chunk[:1].isspace():
            words[-1] += pieces.pop(0)
        words.extend(p for p in pieces if p)
        glue = bool(chunk) and not chunk[-1:].isspace()
    for word in words:
        field, colon, value = word.partition(":")
        if colon and field.lower() in KNOWN_FIELDS - {"text"}:
            terms.append((field.lower(), value))
        else:
            free.append(word)
    return terms + ([("text", " ".join(free))] if free else [])


def search(df: DataFrame, terms: Sequence[Term], as_of, **request) -> DataFrame:
    """All terms over a view.  An ``in:`` term replaces the view's folder test."""
    folders = [v.upper() for f, v in terms if f == "in" and v.upper() in FOLDERS]
    conditions = [c for c in (term_condition(f, v) for f, v in terms) if c is not None]
    request = {"question": asks_question(df), **request}
    if folders:
        base = _without_folder(as_of, folders[-1], **request)
    else:
        base = view_condition(as_of, **request)
    return df.filter(reduce(lambda a, b: a & b, conditions, base))


def _without_folder(as_of, folder: str, **request) -> Column:
    """The view's other conditions together with another folder."""
    chosen = F.col("folder") == folder
    view = request.get("view")
    if view in SMART_VIEWS:
        extra = {"now": needs_attention(), "reply": F.col("intent") == "REQUIRES_REPLY",
                 "waiting": awaits_answer(request.get("question")), "receipts": about_purchase(),
                 "subscriptions": about_subscription()}[view]
        if view == "reply" and not request.get("strict_list"):
            extra = extra & ~is_own(request.get("self_email", DEFAULT_SELF))
        return chosen & extra & (F.lit(True) if view == "waiting" else not_snoozed(as_of))
    if request.get("snoozed_only"):
        return chosen & snoozed(as_of)
    if request.get("starred"):
        return chosen & F.col("is_starred") & not_snoozed(as_of)
    if request.get("important"):
        return chosen & F.col("is_important") & not_snoozed(as_of)
    if request.get("label"):
        return chosen & has_label(F.col("labels"), request["label"]) & not_snoozed(as_of)
    asked = request.get("folder")
    inbox = asked == "INBOX" or asked not in FOLDERS
    return chosen & not_snoozed(as_of) if inbox else chosen


def api_list_filter(as_of, *, view: str | None = None, folder: str | None = None,
                    query: str = "", unread: bool = False,
                    self_email: str = DEFAULT_SELF) -> Column:
    """List for other programs: the folder is taken as given, and the text must
    appear in subject, body or sender name."""
    if view in SMART_VIEWS:
        condition = smart_view(view, as_of, self_email=self_email)
    else:
        condition = F.col("folder") == (folder or "INBOX")
    if unread:
        condition = condition & ~F.col("is_read")
    if query.strip():
        condition = condition & _any(
            mentions(c, query.strip()) for c in ("subject", "body", "from_name"))
    return condition


# --- Order and paging -----------------------------------------------------------

def by_newest() -> list[Column]:
    return [F.col("date").desc(), F.col("id").asc()]


def newest(df: DataFrame, n: int = 200) -> DataFrame:
    return df.orderBy(*by_newest()).limit(n)


def page(df: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page by position.  Use :func:`page_after` to go deep."""
    return df.orderBy(*by_newest()).offset(max(0, offset)).limit(max(1, limit))


def api_page(df: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page as the list interface gives it: its length is held to 1..200."""
    return page(df, min(200, limit), offset)


def page_after(df: DataFrame, date, last_id: str, limit: int = 50) -> DataFrame:
    """The page that follows the row (date, last_id): a filter instead of a skip."""
    at = moment(date)
    after = (F.col("date") < at) | ((F.col("date") == at) & (F.col("id") > last_id))
    return page(df.filter(after), limit)


def page_total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def thread_order(df: DataFrame) -> DataFrame:
    return df.orderBy("thread_id", "date", "id")


def by_name(df: DataFrame, *ties: str, collation: str | None = None) -> DataFrame:
    name = F.col("name") if collation is None else F.collate("name", collation)
    return df.orderBy(name, *ties)


# --- Projections and lookups ----------------------------------------------------

def api_projection(df: DataFrame) -> DataFrame:
    return df.select(*LIST_COLUMNS)


def lookup(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows whose ``key`` appears in ``keys``; Spark broadcasts ``keys`` only when
    its size statistics allow."""
    return df.join(keys.select(key), key, "left_semi")
