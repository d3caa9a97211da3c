"""Reports over several mailboxes."""

from letterloom.operators import mailboxes as B
from letterloom.schema import FOLDERS

from checks.registry import AS_OF, CORR, OWN, SELF, check
from checks.rule_sql import contacts_sql
from checks.stat_checks import SPINE, VIEW_RULES
from checks.thread_checks import CONVERSATIONS

NEEDS = ("boxed_mail", "mailboxes")
_MINE = "lower(from_email) = lower(self_email)"
_ROWS = "(SELECT b.*, o.self_email FROM boxed_mail AS b JOIN mailboxes AS o ON o.mailbox = b.mailbox)"
_DAILY = f"""SELECT mailbox, CAST(date AS DATE) AS day, count(*) FILTER (WHERE NOT ({_MINE})) AS received,
  count(*) FILTER (WHERE {_MINE}) AS sent FROM {_ROWS} AS m WHERE {CORR} GROUP BY 1, 2"""


@check("A1_totals_by_mailbox", f"""
SELECT mailbox, coalesce(received, 0) AS received, coalesce(sent, 0) AS sent, coalesce(unread, 0) AS unread,
  coalesce(needs_reply, 0) AS needs_reply
FROM mailboxes LEFT JOIN (SELECT mailbox, count(*) FILTER (WHERE NOT ({_MINE})) AS received,
  count(*) FILTER (WHERE {_MINE}) AS sent,
  count(*) FILTER (WHERE NOT is_read AND folder = 'INBOX') AS unread,
  count(*) FILTER (WHERE intent = 'REQUIRES_REPLY') AS needs_reply
  FROM {_ROWS} AS m WHERE {CORR} GROUP BY mailbox) AS c USING (mailbox)""", NEEDS)
def _(t):
    return B.totals(t.boxed_mail, t.mailboxes)


@check("A2_top_correspondents_by_mailbox", f"""
SELECT * FROM (SELECT mailbox, from_email, from_name, count(*) AS n, max(date) AS last_date,
  row_number() OVER (PARTITION BY mailbox ORDER BY count(*) DESC, from_email, from_name) AS place
  FROM {_ROWS} AS m WHERE {CORR} AND NOT ({_MINE}) GROUP BY mailbox, from_email, from_name) AS r
WHERE place <= 8""", NEEDS)
def _(t):
    return B.top_correspondents(t.boxed_mail, t.mailboxes)


@check("A3_daily_volume_by_mailbox", _DAILY, NEEDS)
def _(t):
    return B.daily_volume(t.boxed_mail, t.mailboxes)


@check("J2_volume_by_day_by_mailbox", f"""
SELECT o.mailbox, s.day, coalesce(d.received, 0) AS received, coalesce(d.sent, 0) AS sent
FROM mailboxes AS o CROSS JOIN ({SPINE}) AS s
LEFT JOIN ({_DAILY}) AS d ON d.mailbox = o.mailbox AND d.day = s.day""", NEEDS)
def _(t):
    return B.volume_by_day(t.boxed_mail, t.mailboxes, AS_OF)


@check("A6_folder_counts_by_mailbox", "SELECT o.mailbox, f.folder, count(m.id) AS total, "
       "count(m.id) FILTER (WHERE NOT m.is_read) AS unread FROM mailboxes AS o CROSS JOIN (VALUES "
       + ", ".join(f"('{f}')" for f in FOLDERS)
       + ") AS f(folder) LEFT JOIN boxed_mail AS m ON m.folder = f.folder AND m.mailbox = o.mailbox "
         "GROUP BY o.mailbox, f.folder", NEEDS)
def _(t):
    return B.folder_counts(t.boxed_mail, t.mailboxes)


@check("A7_view_counts_by_mailbox", " UNION ALL ".join(
    f"SELECT o.mailbox, '{v}' AS view, coalesce(n, 0) AS n FROM mailboxes AS o LEFT JOIN (SELECT mailbox, "
    f"count(*) AS n FROM {_ROWS} AS m WHERE {rule.replace(OWN, _MINE)} GROUP BY mailbox) AS c "
    "ON c.mailbox = o.mailbox" for v, rule in VIEW_RULES.items()), NEEDS)
def _(t):
    return B.view_counts(t.boxed_mail, t.mailboxes, AS_OF)


@check("A9_conversations_by_mailbox", CONVERSATIONS.replace("SELECT thread_id", "SELECT mailbox, thread_id")
       .replace("GROUP BY thread_id", "GROUP BY mailbox, thread_id").replace(OWN, _MINE)
       .replace("FROM mail", f"FROM {_ROWS} AS x"), NEEDS)
def _(t):
    return B.conversations(t.boxed_mail, t.mailboxes)


@check("A13_contacts_by_mailbox", " UNION ALL ".join(
    f"(WITH mail AS (SELECT * FROM boxed_mail WHERE mailbox = '{name}') SELECT '{name}' AS mailbox, email, name "
    f"FROM ({contacts_sql().replace(SELF, own)}) AS c)" for name, own in (
        ("AFRICA", SELF), ("AMERICA", "user3@no-reply.example"), ("ASIA", "user7@acme.example"),
        ("EUROPE", "own3@acme.example"))), NEEDS)
def _(t):
    return B.contacts(t.boxed_mail, t.mailboxes)
