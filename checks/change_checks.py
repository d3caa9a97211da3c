"""Ingest, replies, updates, removal, links and routes."""

from letterloom.operators import links as L
from letterloom.operators import mutate as M
from letterloom.schema import FOLDERS, MAIL_COLUMNS
from letterloom.sources import inbound as I
from letterloom.sources import versions
from letterloom.sources.tables import mirror, rebuild_snapshot, with_intent
from letterloom.streaming.sinks import job_dir
from pyspark.sql import functions as F

from checks.registry import AS_OF, NOW, OWN, SELF, check
from checks.rule_sql import (normal_body, outcome, q, rule_case, sanitize, snippet, strip,
                             tags)

ALL = ", ".join(MAIL_COLUMNS)
BOTH = ("mail", "updates")


def _same_columns(df):
    return df.select(*MAIL_COLUMNS)


def _stored(t):
    """The mail table as the first version of a stored one."""
    return versions.create(t.mail, job_dir(t.spark, "versions"))


def _ids(df, column="id"):
    return df.select(F.col(column).alias("id"))


def _intent_of(text: str, sender: str, own: str, with_labels: bool = True) -> str:
    return outcome(f"({rule_case(text, sender, own, with_labels)})", 0)


# --- Ingest -------------------------------------------------------------------------

_IN_DATE = """CASE WHEN coalesce(date, '') = '' THEN {now}
  ELSE TRY_CAST(replace(replace(date, 'T', ' '), 'Z', '') AS TIMESTAMP) END"""


def inbound_sql(source: str) -> str:
    """Mail rows of inbound posts in ``source``."""
    body = strip("coalesce(body, '')")
    row = f"""
SELECT id, coalesce(nullif(threadId, ''), concat('t_', id)) AS thread_id,
  {strip('fromName')} AS from_name, {strip('fromEmail')} AS from_email,
  {strip(f"coalesce(toEmails, '{SELF}')")} AS to_emails,
  {strip("coalesce(ccEmails, '')")} AS cc_emails, {strip("coalesce(bccEmails, '')")} AS bcc_emails,
  {strip("coalesce(subject, '(no subject)')")} AS subject,
  {normal_body('b')} AS body, {snippet(tags('b'))} AS snippet,
  {_IN_DATE.format(now=NOW)} AS date, false AS is_read, false AS is_starred,
  coalesce(isImportant, false) AS is_important, coalesce(hasAttachment, false) AS has_attachment,
  'INBOX' AS folder, {strip("coalesce(labels, '')")} AS labels,
  {strip("coalesce(attachmentName, '')")} AS attachment_name,
  CAST(NULL AS TIMESTAMP) AS snoozed_until, CAST(NULL AS TIMESTAMP) AS scheduled_for,
  {NOW} AS created_at, {NOW} AS updated_at
FROM (SELECT *, {body} AS b FROM {source}) AS r
WHERE {strip("coalesce(fromName, '')")} <> '' AND {strip("coalesce(fromEmail, '')")} <> ''"""
    own = f"lower(from_email) = '{SELF}'"
    text = "lower(concat(subject, ' ', snippet, ' ', body))"
    sender = "lower(concat(from_email, ' ', from_name))"
    return f"""SELECT *, {_intent_of(text, sender, own)} AS intent FROM ({row}) AS m
WHERE date IS NOT NULL"""


@check("S2_ingest_inbound", f"SELECT {ALL} FROM ({inbound_sql('inbound')}) AS x", ("inbound",))
def _(t):
    return I.ingest_inbound(t.inbound, AS_OF, self_email=SELF)


_SENDER_OK = (strip("coalesce(fromName, '')") + " <> '' AND "
              + strip("coalesce(fromEmail, '')") + " <> ''")


@check("S2_rejected_inbound", f"""
SELECT id, CASE WHEN NOT ({_SENDER_OK}) THEN 'fromName and fromEmail are required'
  ELSE 'date is not a time' END AS reason FROM inbound
WHERE NOT ({_SENDER_OK}) OR date = 'not a date'""", ("inbound",))
def _(t):
    return I.rejected_inbound(t.inbound).select("id", "reason")


_OWN_FIXED = f"""'Me' AS from_name, '{SELF}' AS from_email"""


def _sent_intent(subject: str, body: str) -> str:
    return _intent_of(f"lower(concat({subject}, '  ', {body}))", f"'{SELF} '", "true", False)


@check("S3_ingest_outbound", f"""
SELECT id, to_emails, subject, body, snippet, folder, date, scheduled_for, is_read,
  has_attachment, {_sent_intent('subject', 'raw_text')} AS intent
FROM (SELECT id, {strip("coalesce(toEmails, '')")} AS to_emails,
    {strip("coalesce(subject, '(no subject)')")} AS subject, b AS raw_text,
    {normal_body('b')} AS body, {snippet(tags('b'))} AS snippet,
    CASE WHEN scheduledFor > {NOW} THEN 'SCHEDULED' ELSE 'SENT' END AS folder, {NOW} AS date,
    CASE WHEN scheduledFor > {NOW} THEN scheduledFor END AS scheduled_for, true AS is_read,
    attachmentName IS NOT NULL AS has_attachment
  FROM (SELECT *, {strip("coalesce(body, '')")} AS b FROM outbound) AS o
  WHERE {strip("coalesce(toEmails, '')")} <> '') AS x""", ("outbound",))
def _(t):
    return I.ingest_outbound(t.outbound, AS_OF, self_email=SELF).select(
        "id", "to_emails", "subject", "body", "snippet", "folder", "date", "scheduled_for",
        "is_read", "has_attachment", "intent")


@check("S4_ingest_composed", f"""
SELECT id, to_emails, CASE WHEN s = '' THEN '(no subject)' ELSE s END AS subject, body, snippet,
  folder, date, scheduled_for, has_attachment, {_sent_intent('s', 'body')} AS intent
FROM (SELECT *, {snippet('body')} AS snippet FROM (
  SELECT id, {strip("coalesce(toEmails, '')")} AS to_emails, {strip("coalesce(subject, '')")} AS s,
    {normal_body('body')} AS body,
    CASE WHEN isDraft THEN 'DRAFTS' WHEN scheduledFor IS NOT NULL THEN 'SCHEDULED' ELSE 'SENT' END
      AS folder, coalesce(scheduledFor, {NOW}) AS date, scheduledFor AS scheduled_for,
    attachmentName IS NOT NULL AS has_attachment
  FROM outbound WHERE isDraft OR {strip("coalesce(toEmails, '')")} <> '') AS y) AS x""",
       ("outbound",))
def _(t):
    return I.ingest_composed(t.outbound, AS_OF, self_email=SELF).select(
        "id", "to_emails", "subject", "body", "snippet", "folder", "date", "scheduled_for",
        "has_attachment", "intent")


_CRLF = "concat(chr(13), chr(10))"
_HEAD = f"split_part(value, concat({_CRLF}, {_CRLF}), 1)"
_REST = f"substr(value, length({_HEAD}) + 5)"


@check("S5_ingest_raw_messages", f"""
SELECT id, CASE WHEN n = '' THEN 'Unknown' ELSE n END AS from_name, envelope_from AS from_email,
  coalesce(nullif(regexp_extract(h, 'Subject:\\s*(.+)', 1, 'i'), ''), '(no subject)') AS subject,
  md5(CASE WHEN contains(r, '<') THEN r ELSE concat('<p>', replace(r, {_CRLF}, '<br/>'), '</p>') END)
    AS digest
FROM (SELECT *, {strip(r"regexp_replace(f, '<[^>]+>', '')")} AS n FROM (
  SELECT id, envelope_from, replace({_HEAD}, chr(13), '') AS h, {strip(_REST)} AS r,
    coalesce(nullif(regexp_extract(replace({_HEAD}, chr(13), ''), 'From:\\s*(.+)', 1, 'i'), ''),
      envelope_from) AS f
  FROM raw_messages) AS a) AS b""", ("raw_messages",))
def _(t):
    parsed = I.parse_raw_messages(t.raw_messages.withColumn("value", F.col("value")))
    plain = F.regexp_replace("body", "(?s)^<p>(.*)</p>$", "$1")
    return parsed.select("id", F.col("fromName").alias("from_name"),
                         F.col("fromEmail").alias("from_email"),
                         F.btrim("subject").alias("subject"),
                         F.md5(F.when(F.col("body").startswith("<p>"), F.concat(
                             F.lit("<p>"), F.btrim(plain, F.lit(" \t\n\r\x0b\x0c")),
                             F.lit("</p>"))).otherwise(F.col("body"))).alias("digest"))


@check("S6_with_intent", f"SELECT id, {outcome('(' + rule_case() + ')', 0)} AS intent FROM mail")
def _(t):
    return with_intent(t.mail, self_email=SELF).select("id", "intent")


@check("S6_rebuild_snapshot", f"""SELECT id, subject, body, date, folder,
  {outcome('(' + rule_case() + ')', 0)} AS intent FROM mail""")
def _(t):
    rebuilt = rebuild_snapshot(t.mail, job_dir(t.spark, "rebuild"), self_email=SELF)
    return rebuilt.select("id", "subject", "body", "date", "folder", "intent")


@check("S7_mirror", """SELECT c.copy, n FROM (SELECT count(*) AS n FROM mail) AS m,
  (VALUES (1), (2)) AS c(copy)""")
def _(t):
    folder = job_dir(t.spark, "mirror")
    counts = mirror(t.mail, f"{folder}/1", f"{folder}/2")
    return counts.select(F.right("path", F.lit(1)).cast("int").alias("copy"), "n")


@check("U5_append_mail", f"""
SELECT folder, count(*) AS n FROM (SELECT id, folder FROM mail
  UNION ALL SELECT id, folder FROM ({inbound_sql('inbound')}) AS x) AS u GROUP BY folder""",
       ("mail", "inbound"))
def _(t):
    both = M.append_mail(t.mail, I.ingest_inbound(t.inbound, AS_OF, self_email=SELF))
    return both.groupBy("folder").agg(F.count("*").alias("n"))


# --- Replies ------------------------------------------------------------------------

_REPLY = f"""
SELECT r.reply_id AS id, o.thread_id, 'Me' AS from_name, '{SELF}' AS from_email,
  o.from_email AS to_emails, o.cc_emails, '' AS bcc_emails,
  CASE WHEN starts_with(lower(o.subject), 're:') THEN o.subject ELSE concat('Re: ', o.subject) END
    AS subject, {normal_body("r.body")} AS body, {NOW} AS date, true AS is_read, o.is_starred,
  false AS is_important, r.attachment_name IS NOT NULL AS has_attachment, 'SENT' AS folder,
  o.labels, coalesce(r.attachment_name, '') AS attachment_name
FROM reply_requests AS r JOIN mail AS o ON o.id = r.original_id"""
REPLY = ("mail", "reply_requests")


@check("J4_build_replies", f"""SELECT *, {snippet('body')} AS snippet,
  {_sent_intent('subject', 'body')} AS intent FROM ({_REPLY}) AS x""", REPLY)
def _(t):
    return M.build_replies(t.reply_requests, t.mail, AS_OF, self_email=SELF).drop(
        "snoozed_until", "scheduled_for", "created_at", "updated_at")


@check("J4_build_replies_plain", f"SELECT id, subject, '' AS intent FROM ({_REPLY}) AS x", REPLY)
def _(t):
    return M.build_replies(t.reply_requests, t.mail, AS_OF, self_email=SELF,
                           keep_intent_empty=True).select("id", "subject", "intent")


_REPLIED = "id IN (SELECT original_id FROM reply_requests)"


def _mail_with(**changed: str) -> str:
    """All mail columns with some of them replaced by expressions over ``m``."""
    return ", ".join(f"{changed[c]} AS {c}" if c in changed else f"m.{c}" for c in MAIL_COLUMNS)


@check("J14_mark_read_on_reply", f"""SELECT {_mail_with(is_read='(is_read OR ' + _REPLIED + ')')}
FROM mail AS m""", REPLY)
def _(t):
    return _stored(t).change(_ids(t.reply_requests, "original_id"),
                             lambda mail: M.mark_read_on_reply(mail, t.reply_requests)).read()


@check("J12_archive_replied", f"""SELECT {_mail_with(
    folder="CASE WHEN folder = 'INBOX' AND " + _REPLIED + " THEN 'ARCHIVE' ELSE folder END")}
FROM mail AS m""", REPLY)
def _(t):
    return _stored(t).change(_ids(t.reply_requests, "original_id"),
                             lambda mail: M.archive_replied(mail, t.reply_requests)).read()


# --- Updates ------------------------------------------------------------------------

_FOLDERS = "(" + ", ".join(f"'{f}'" for f in FOLDERS) + ")"
_SNOOZE = ("CASE WHEN u.clear_snooze THEN NULL ELSE coalesce(u.snoozed_until, m.snoozed_until) END")
_UPDATED = f"""SELECT {_mail_with(
    is_read='coalesce(u.is_read, m.is_read)', is_starred='coalesce(u.is_starred, m.is_starred)',
    is_important='coalesce(u.is_important, m.is_important)',
    folder=f'CASE WHEN u.folder IN {_FOLDERS} THEN u.folder ELSE m.folder END',
    snoozed_until=_SNOOZE)}
FROM mail AS m LEFT JOIN updates AS u ON u.id = m.id"""


@check("J6_bulk_update", _UPDATED, BOTH)
def _(t):
    return _stored(t).change(t.updates, lambda mail: M.bulk_update(mail, t.updates)).read()


@check("J7_update_fields", f"""SELECT {_mail_with(
    subject='coalesce(u.subject, m.subject)', body='coalesce(u.body, m.body)',
    to_emails='coalesce(u.to_emails, m.to_emails)', labels='coalesce(u.labels, m.labels)',
    intent='coalesce(u.intent, m.intent)', snoozed_until=_SNOOZE)}
FROM mail AS m LEFT JOIN patches AS u ON u.id = m.id""", ("mail", "patches"))
def _(t):
    return _stored(t).change(t.patches, lambda mail: M.update_fields(mail, t.patches)).read()


@check("J17_undo_bulk", "SELECT id, folder, snoozed_until FROM mail", BOTH)
def _(t):
    first = _stored(t)
    folders = M.undo_snapshot(first.read(), t.updates, "folder")
    snoozes = M.undo_snapshot(first.read(), t.updates, "snoozed_until")
    changed = first.change(t.updates, lambda mail: M.bulk_update(mail, t.updates))
    restored = changed.change(folders, lambda mail: M.undo_bulk(
        M.undo_bulk(mail, folders, "folder"), snoozes, "snoozed_until"))
    return restored.read(["id", "folder", "snoozed_until"])


@check("U2_relabel", """
SELECT id, CASE WHEN hit THEN array_to_string(list_filter(ls, lambda x, i: list_position(ls, x) = i), ',')
  ELSE labels END AS labels
FROM (SELECT id, labels, id IN (SELECT original_id FROM reply_requests) AS hit, list_append(
    list_filter(list_transform(string_split(labels, ','), lambda x: trim(x)), lambda x: x <> ''),
    'New') AS ls FROM mail) AS m""", REPLY)
def _(t):
    ids = _ids(t.reply_requests, "original_id")
    return _stored(t).change(ids, lambda mail: M.relabel(mail, ids, "New")).read(["id", "labels"])


# --- Removal ------------------------------------------------------------------------

@check("J10_delete_cascade", """
SELECT 'mail' AS kind, id FROM mail WHERE id NOT IN (SELECT original_id FROM reply_requests)
UNION ALL SELECT 'link', id FROM links
  WHERE email_id NOT IN (SELECT original_id FROM reply_requests)""",
       ("mail", "links", "reply_requests"))
def _(t):
    ids = t.reply_requests.select(F.col("original_id").alias("id"))
    mail, links = M.delete_cascade(ids, t.mail, t.links)
    return mail.select(F.lit("mail").alias("kind"), "id").unionByName(
        links.select(F.lit("link").alias("kind"), "id"))


@check("J11_empty_folder", """SELECT 'mail' AS kind, id FROM mail WHERE folder <> 'TRASH'
UNION ALL SELECT 'link', id FROM links
  WHERE email_id NOT IN (SELECT id FROM mail WHERE folder = 'TRASH')""", ("mail", "links"))
def _(t):
    mail, links = M.empty_folder(t.mail, t.links, "TRASH")
    return mail.select(F.lit("mail").alias("kind"), "id").unionByName(
        links.select(F.lit("link").alias("kind"), "id"))


@check("J13_drop_sent_drafts", """SELECT id, folder FROM mail
WHERE NOT (folder = 'DRAFTS' AND id IN (SELECT id FROM updates))""", BOTH)
def _(t):
    sent = t.updates.select(F.col("id").alias("draft_id"))
    return M.drop_sent_drafts(t.mail, sent).select("id", "folder")


# --- Labels, links and routes ---------------------------------------------------------

@check("J9_add_labels", """
SELECT name, color FROM labels_dim
UNION ALL SELECT trim(name), min(coalesce(color, 'gray')) FROM new_labels
  WHERE trim(name) <> '' AND trim(name) NOT IN (SELECT name FROM labels_dim) GROUP BY trim(name)""",
       ("labels_dim", "new_labels"))
def _(t):
    return M.add_labels(t.labels_dim, t.new_labels).select("name", "color")


@check("J3_open_links", f"""
SELECT token, subject, from_name, to_emails, {sanitize("CASE WHEN trim(body) = '' OR body = 'null' "
  "THEN '<p>This email has no content.</p>' ELSE body END")} AS body, expires_at
FROM links AS l JOIN mail AS m ON m.id = l.email_id
WHERE NOT coalesce(expires_at < {NOW}, false)""".replace(
    "SELECT token, subject, from_name, to_emails",
    "SELECT l.token, m.subject, m.from_name, m.to_emails"), ("mail", "links"))
def _(t):
    tokens = t.links.select("token")
    return L.open_links(tokens, t.links, t.mail, AS_OF).drop("from_email", "date")


@check("J15_assign_route", f"""
SELECT m.id, c.id AS route_id, c.name AS route_name, c.host AS route_host, c.port AS route_port,
  c.region AS route_region
FROM mail AS m, (SELECT * FROM route_configs WHERE enabled = 1 ORDER BY priority, id LIMIT 1) AS c
WHERE m.folder = 'SENT'""", ("mail", "route_configs"))
def _(t):
    return L.assign_route(t.mail.filter(F.col("folder") == "SENT"), t.route_configs)


@check("J15_assign_route_direct", """
SELECT id, 'direct-mx' AS route_id, 'Direct MX Delivery' AS route_name, '' AS route_host,
  25 AS route_port, 'global' AS route_region FROM mail WHERE folder = 'SENT'""")
def _(t):
    return L.assign_route(t.mail.filter(F.col("folder") == "SENT"), t.closed_routes)


@check("T7_create_links_batch", """
SELECT concat('link-', id) AS id, id AS email_id, to_emails AS recipient_email, false AS viewed,
  date + INTERVAL '30' DAY AS expires_at FROM mail WHERE folder = 'SENT'""")
def _(t):
    sends = t.mail.filter(F.col("folder") == "SENT").select("id", F.col("date").alias("ts"))
    return L.create_links(sends, t.mail).select(
        "id", "email_id", "recipient_email", "viewed", "expires_at")


# --- Time-driven ----------------------------------------------------------------------

DELIVERED = f"""SELECT {_mail_with(
    folder="CASE WHEN folder = 'SCHEDULED' AND scheduled_for <= " + NOW
           + " THEN 'SENT' ELSE folder END",
    scheduled_for="CASE WHEN folder = 'SCHEDULED' AND scheduled_for <= " + NOW
                  + " THEN NULL ELSE scheduled_for END")} FROM mail AS m"""


@check("T2_deliver_due_batch", DELIVERED)
def _(t):
    return _same_columns(M.deliver_due(t.mail, AS_OF))


@check("T3_snooze_returns_batch", f"""SELECT id, snoozed_until FROM mail
WHERE snoozed_until > {NOW} - INTERVAL '7' DAY AND snoozed_until <= {NOW}""")
def _(t):
    return M.snooze_returns(t.mail, "2024-01-23 12:00:00", AS_OF).select("id", "snoozed_until")
