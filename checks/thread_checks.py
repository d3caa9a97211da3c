"""Threads, conversations and contacts."""

from letterloom.operators import people as P
from letterloom.operators import threads as T
from letterloom.operators import views as V
from pyspark.sql import functions as F

from checks.registry import CORR, OWN, SELF, check
from checks.rule_sql import contacts_sql, csv, visible

CONVERSATIONS = f"""
SELECT thread_id, last(subject ORDER BY date, id) AS subject,
  last(from_name ORDER BY date, id) FILTER (WHERE NOT own) AS participant_name,
  last(from_email ORDER BY date, id) FILTER (WHERE NOT own) AS participant_email,
  count(*) AS message_count, max(date) AS last_date,
  CASE WHEN last(own ORDER BY date, id) THEN 'outgoing' ELSE 'incoming' END AS last_direction,
  count(*) FILTER (WHERE NOT own AND NOT is_read) > 0 AS has_unread,
  count(*) FILTER (WHERE NOT own AND NOT is_read) AS unread_count,
  last(snippet ORDER BY date, id) AS snippet, last(intent ORDER BY date, id) AS last_intent
FROM (SELECT *, {OWN} AS own FROM mail WHERE {CORR}) AS m
GROUP BY thread_id HAVING bool_or(own) AND bool_or(NOT own)"""


@check("A9_conversations", CONVERSATIONS)
def _(t):
    return T.conversations(t.mail, self_email=SELF)


@check("A10_conversation_totals", f"""SELECT count(*) AS total,
  count(*) FILTER (WHERE has_unread) AS unread_threads FROM ({CONVERSATIONS}) AS c""")
def _(t):
    return T.conversation_totals(T.conversations(t.mail, self_email=SELF))


@check("O3_recent_conversations", f"""SELECT thread_id, last_date, message_count
FROM ({CONVERSATIONS}) AS c ORDER BY last_date DESC, thread_id LIMIT 20""")
def _(t):
    return T.recent_conversations(T.conversations(t.mail, self_email=SELF)).select(
        "thread_id", "last_date", "message_count")


@check("W2_last_message", """
SELECT thread_id, last(id ORDER BY date, id) AS id, max(date) AS date,
  last(from_email ORDER BY date, id) AS from_email FROM mail GROUP BY thread_id""")
def _(t):
    return T.last_message(t.mail)


@check("W3_newest_foreign_sender", f"""
SELECT thread_id, last(from_email ORDER BY date, id) AS participant_email,
  last(from_name ORDER BY date, id) AS participant_name
FROM mail WHERE NOT ({OWN}) GROUP BY thread_id""")
def _(t):
    return T.newest_foreign_sender(t.mail, self_email=SELF)


POSITION = """
SELECT id, thread_id, row_number() OVER w AS position,
  count(*) OVER (PARTITION BY thread_id) AS n_in_thread,
  row_number() OVER w = count(*) OVER (PARTITION BY thread_id) AS is_last,
  count(*) OVER (PARTITION BY thread_id) > 1 AS is_threaded
FROM mail WINDOW w AS (PARTITION BY thread_id ORDER BY date, id)"""


@check("W8_thread_position", POSITION)
def _(t):
    return T.thread_position(t.mail)


PARTICIPANTS = """
SELECT thread_id, from_name, min(date) AS first_date, first(id ORDER BY date, id) AS first_id,
  count(*) AS message_count FROM mail GROUP BY thread_id, from_name"""


@check("A19_thread_participants", PARTICIPANTS)
def _(t):
    return T.thread_participants(t.mail)


FIRST_NAMES = f"""
SELECT thread_id, string_agg(from_name, ', ' ORDER BY first_date, first_id) AS names
FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY first_date, first_id) AS r
      FROM ({PARTICIPANTS}) AS p) AS q WHERE r <= 3 GROUP BY thread_id"""


@check("W11_first_names", FIRST_NAMES)
def _(t):
    return T.first_names(t.mail)


@check("X30_thread_status", f"""
SELECT thread_id, CASE WHEN n > 1 THEN concat('Thread of ', n, ' messages between ', names, '.')
  ELSE concat('Single message from ', names, '.') END AS status
FROM (SELECT thread_id, count(*) AS n FROM mail GROUP BY thread_id) AS s
JOIN ({FIRST_NAMES}) AS f USING (thread_id)""")
def _(t):
    return T.thread_status(t.mail)


@check("A22_thread_transcript", f"""
SELECT thread_id, count(*) AS n_messages, left(string_agg(txt, concat(chr(10), chr(10))
    ORDER BY r), 6000) AS transcript
FROM (SELECT thread_id, r, concat('--- Message ', r, ' ---', chr(10), 'From: ', from_name, ' <',
    from_email, '>', chr(10), 'Date: ', strftime(date, '%Y-%m-%dT%H:%M:%S'), '.',
    lpad(CAST(CAST(floor((epoch_us(date) % 1000000) / 1000) AS INT) AS STRING), 3, '0'), 'Z',
    chr(10), 'Subject: ', subject,
    chr(10), chr(10), left({visible('body')}, 1200)) AS txt
  FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY date, id) AS r FROM mail)
    AS n WHERE r <= 30) AS x GROUP BY thread_id""")
def _(t):
    return T.thread_transcript(t.mail, 1200, 6000, 30)


@check("A22_conversation_table_transcript", f"""
SELECT CAST(conv_id AS STRING) AS thread_id, count(*) AS n_messages,
  string_agg(concat('--- Message ', r, ' ---', chr(10), 'From: ', role, ' <', role, '>', chr(10),
    'Date: ', strftime(TIMESTAMP '1970-01-01' + to_seconds(turn), '%Y-%m-%dT%H:%M:%S'), '.000Z',
    chr(10), 'Subject: ', chr(10), chr(10), body), concat(chr(10), chr(10)) ORDER BY r)
    AS transcript
FROM (SELECT *, {visible('text')} AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn)
  AS r FROM conversations) AS c GROUP BY conv_id""", ())
def _(t):
    return T.thread_transcript(_talks(t))


@check("A22_transcript_parts", f"""
SELECT CAST(conv_id AS STRING) AS thread_id, (r - 1) // 3 AS part, count(*) AS n_messages,
  string_agg(concat('--- Message ', r, ' ---', chr(10), 'From: ', role, ' <', role, '>', chr(10),
    'Date: ', strftime(TIMESTAMP '1970-01-01' + to_seconds(turn), '%Y-%m-%dT%H:%M:%S'), '.000Z',
    chr(10), 'Subject: ', chr(10), chr(10), body), concat(chr(10), chr(10)) ORDER BY r)
    AS transcript
FROM (SELECT *, {visible('text')} AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn)
  AS r FROM conversations) AS c GROUP BY conv_id, (r - 1) // 3""", ())
def _(t):
    return T.transcript_parts(_talks(t), messages=3)


def _talks(t):
    """The conversations as threads of mail."""
    return t.conversations.select(
        F.concat_ws("-", "conv_id", F.lpad(F.col("turn").cast("string"), 9, "0")).alias("id"),
        F.col("conv_id").cast("string").alias("thread_id"),
        F.timestamp_seconds("turn").cast("timestamp_ntz").alias("date"),
        F.col("role").alias("from_name"), F.col("role").alias("from_email"),
        F.lit("").alias("subject"), F.col("text").alias("body"))


@check("J5_thread_of", """
SELECT id, thread_id, date FROM mail WHERE thread_id IN (SELECT thread_id FROM mail
  WHERE id IN (SELECT original_id FROM reply_requests))""", ("mail", "reply_requests"))
def _(t):
    ids = t.reply_requests.select(F.col("original_id").alias("id"))
    return T.thread_of(t.mail, ids).select("id", "thread_id", "date")


@check("A13_contacts", contacts_sql())
def _(t):
    return P.contacts(t.mail, self_email=SELF)


@check("U1_address_union", f"""
SELECT email, count(*) AS n, min(source) AS first_source FROM (
  SELECT from_email AS email, 0 AS source FROM mail
  UNION ALL SELECT unnest({csv('to_emails')}), 1 FROM mail
  UNION ALL SELECT unnest({csv('cc_emails')}), 2 FROM mail) AS u
WHERE email <> '' GROUP BY email""")
def _(t):
    return P.address_union(t.mail).groupBy("email").agg(
        F.count("*").alias("n"), F.min("source").alias("first_source"))


@check("U4_reply_all_to", f"""
SELECT id, array_to_string(list_filter(l, lambda a, i:
    list_position(list_transform(l, lambda y: lower(y)), lower(a)) = i), ', ') AS to_emails
FROM (SELECT id, list_filter(list_concat([from_email], {csv('cc_emails')}, {csv('to_emails')}),
    lambda x: x <> '' AND lower(x) <> '{SELF}') AS l FROM mail) AS e""")
def _(t):
    wide = t.mail.withColumn("to_emails", F.concat_ws(",", "cc_emails", "to_emails"))
    return P.reply_all_to(wide, self_email=SELF)


@check("O5_contacts_collated", f"""SELECT email, name FROM ({contacts_sql()}) AS c""")
def _(t):
    return V.by_name(P.contacts(t.mail, self_email=SELF), "email", collation="UNICODE_CI")
