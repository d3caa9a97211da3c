"""Counts, trends and label statistics."""

from letterloom.operators import stats as S
from letterloom.operators.mutate import bulk_update
from letterloom.schema import DATE_BUCKETS, FOLDERS
from pyspark.sql import functions as F

from checks.registry import AS_OF, AWAKE, CORR, NOW, OWN, SELF, check
from checks.rule_sql import CATEGORY, csv
from checks.view_checks import ANSWER, ATTENTION, BULK, PURCHASE

DAILY = f"""SELECT CAST(date AS DATE) AS day, count(*) FILTER (WHERE NOT ({OWN})) AS received,
  count(*) FILTER (WHERE {OWN}) AS sent FROM mail WHERE {CORR} GROUP BY 1"""
SPINE = f"""SELECT CAST(unnest(generate_series(CAST({NOW} AS DATE) - 13, CAST({NOW} AS DATE),
  INTERVAL 1 DAY)) AS DATE) AS day"""
VOLUME = f"""SELECT s.day, coalesce(d.received, 0) AS received, coalesce(d.sent, 0) AS sent
  FROM ({SPINE}) AS s LEFT JOIN ({DAILY}) AS d ON s.day = d.day"""


@check("A1_totals", f"""
SELECT count(*) FILTER (WHERE NOT ({OWN})) AS received, count(*) FILTER (WHERE {OWN}) AS sent,
  count(*) FILTER (WHERE NOT is_read AND folder = 'INBOX') AS unread,
  count(*) FILTER (WHERE intent = 'REQUIRES_REPLY') AS needs_reply
FROM mail WHERE {CORR}""")
def _(t):
    return S.totals(t.mail, self_email=SELF)


@check("A2_top_correspondents", f"""
SELECT from_email, from_name, count(*) AS n, max(date) AS last_date FROM mail
WHERE {CORR} AND NOT ({OWN}) GROUP BY from_email, from_name
ORDER BY n DESC, from_email, from_name LIMIT 8""")
def _(t):
    return S.top_correspondents(t.mail, self_email=SELF)


@check("A3_daily_volume", DAILY)
def _(t):
    return S.daily_volume(t.mail, self_email=SELF)


@check("J2_volume_by_day", VOLUME)
def _(t):
    return S.volume_by_day(t.mail, AS_OF, self_email=SELF)


@check("A20_volume_scaled", f"""
WITH v AS ({VOLUME}), m AS (SELECT greatest(1, max(received), max(sent)) AS m FROM v)
SELECT day, CAST(floor(100 * received / m + 0.5) AS BIGINT) AS received_pct,
  CAST(floor(100 * sent / m + 0.5) AS BIGINT) AS sent_pct FROM v, m""")
def _(t):
    return S.volume_scaled(S.volume_by_day(t.mail, AS_OF, self_email=SELF))


@check("A5_intent_distribution", f"""SELECT intent, count(*) AS n FROM mail
WHERE {CORR} AND intent <> '' GROUP BY intent""")
def _(t):
    return S.intent_distribution(t.mail)


@check("A23_intent_ranking", f"""
SELECT intent, n, CASE intent WHEN 'REQUIRES_REPLY' THEN 'Needs reply' WHEN 'FYI' THEN 'FYI'
  WHEN 'SECURITY_ALERT' THEN 'Security' ELSE concat(left(intent, 1), lower(substr(intent, 2)))
  END AS label
FROM (SELECT intent, count(*) AS n FROM mail WHERE {CORR} AND intent <> '' GROUP BY intent
      ORDER BY n DESC, intent LIMIT 8) AS r""")
def _(t):
    return S.intent_ranking(t.mail)


@check("A6_folder_counts", "SELECT f.folder, count(m.id) AS total, "
       "count(m.id) FILTER (WHERE NOT m.is_read) AS unread FROM (VALUES "
       + ", ".join(f"('{f}')" for f in FOLDERS)
       + ") AS f(folder) LEFT JOIN mail AS m ON m.folder = f.folder GROUP BY f.folder")
def _(t):
    return S.folder_counts(t.mail)


_AWAKE_NOW = f"NOT coalesce(snoozed_until > {NOW}, false)"
_ASIDE = f"(coalesce(snoozed_until > {NOW}, false) AND folder IN ('INBOX', 'ARCHIVE'))"
VIEW_RULES = {
    "STARRED": f"NOT {_ASIDE} AND is_starred AND folder IN ('INBOX','SENT','DRAFTS','ARCHIVE')",
    "IMPORTANT": f"NOT {_ASIDE} AND is_important AND {CORR}",
    "SNOOZED": _ASIDE,
    "NOW": f"{_AWAKE_NOW} AND folder = 'INBOX' AND {ATTENTION}",
    "REPLY": f"{_AWAKE_NOW} AND NOT ({OWN}) AND intent = 'REQUIRES_REPLY' "
             "AND folder IN ('INBOX','ARCHIVE')",
    "WAITING": f"{_AWAKE_NOW} AND {OWN} AND folder = 'SENT' AND {ANSWER}",
    "RECEIPTS": f"{_AWAKE_NOW} AND {CORR} AND {PURCHASE}",
    "SUBSCRIPTIONS": f"{_AWAKE_NOW} AND folder IN ('INBOX','ARCHIVE') AND {BULK}",
}


@check("A7_view_counts", " UNION ALL ".join(
    f"SELECT '{v}' AS view, count(*) AS n FROM mail WHERE {rule}"
    for v, rule in VIEW_RULES.items()))
def _(t):
    return S.view_counts(t.mail, AS_OF, self_email=SELF)


_TOP = " UNION ALL ".join(
    f"(SELECT '{v}' AS view, id, subject, from_name FROM mail WHERE {VIEW_RULES[v]} "
    "AND subject <> '' ORDER BY date DESC, id DESC LIMIT 1)"
    for v in ("NOW", "REPLY", "WAITING", "RECEIPTS", "SUBSCRIPTIONS"))


@check("W1_top_item_per_view", f"""
SELECT v.view, t.id, t.subject, t.from_name FROM (VALUES ('NOW'), ('REPLY'), ('WAITING'),
  ('RECEIPTS'), ('SUBSCRIPTIONS')) AS v(view) LEFT JOIN ({_TOP}) AS t ON t.view = v.view""")
def _(t):
    return S.top_item_per_view(t.mail, AS_OF, self_email=SELF)


@check("A7_W1_view_summary", f"""
SELECT c.view, c.n, t.id AS top_id, t.subject AS top_subject FROM (""" + " UNION ALL ".join(
    f"SELECT '{v}' AS view, count(*) AS n FROM mail WHERE {rule}"
    for v, rule in VIEW_RULES.items()) + f") AS c LEFT JOIN ({_TOP}) AS t ON t.view = c.view")
def _(t):
    return S.view_summary(t.mail, AS_OF, self_email=SELF).select(
        "view", "n", F.col("top.id").alias("top_id"), F.col("top.subject").alias("top_subject"))


LABEL_COUNTS = (f"SELECT label, count(*) AS n FROM (SELECT unnest({csv('labels')}) AS label "
                "FROM mail) AS x GROUP BY label")


@check("A8_label_counts", LABEL_COUNTS)
def _(t):
    return S.label_counts(t.mail)


@check("J8_label_summary", f"""SELECT l.name, l.color, coalesce(c.n, 0) AS n
FROM labels_dim AS l LEFT JOIN ({LABEL_COUNTS}) AS c ON c.label = l.name ORDER BY l.name""",
       ("mail", "labels_dim"))
def _(t):
    return S.label_summary(t.labels_dim, t.mail)


@check("A11_category_counts", f"""
WITH inbox AS (SELECT {CATEGORY} AS category FROM mail WHERE folder = 'INBOX' AND {AWAKE})
SELECT 'ALL' AS category, count(*) AS n FROM inbox
UNION ALL SELECT v.c, count(i.category) FROM (VALUES ('PRIMARY'), ('PROMOTIONS'), ('SOCIAL'),
  ('UPDATES')) AS v(c) LEFT JOIN inbox AS i ON i.category = v.c GROUP BY v.c""")
def _(t):
    return S.category_counts(t.mail, AS_OF)


BUCKET = f"""CASE WHEN CAST(date AS DATE) = CAST({NOW} AS DATE) THEN 'Today'
  WHEN CAST(date AS DATE) = CAST({NOW} AS DATE) - 1 THEN 'Yesterday'
  WHEN date_trunc('week', CAST(date AS DATE) + 1) = date_trunc('week', CAST({NOW} AS DATE) + 1)
    THEN 'This week'
  WHEN date_trunc('month', date) = date_trunc('month', {NOW}) THEN 'This month'
  ELSE 'Earlier' END"""


@check("A12_date_bucket_counts", f"""
SELECT bucket, count(*) AS n, CAST(CASE bucket """ + " ".join(
    f"WHEN '{b}' THEN {i + 1}" for i, b in enumerate(DATE_BUCKETS)) + f""" END AS BIGINT) AS ordinal
FROM (SELECT {BUCKET} AS bucket FROM mail) AS x GROUP BY bucket ORDER BY ordinal""")
def _(t):
    return S.date_bucket_counts(t.mail, AS_OF)


@check("A18_common_labels", f"""
WITH chosen AS (SELECT id, labels FROM mail WHERE labels LIKE '%Work%')
SELECT label FROM (SELECT id, unnest(list_distinct({csv('labels')})) AS label FROM chosen) AS x
GROUP BY label HAVING count(*) = (SELECT count(*) FROM chosen)""")
def _(t):
    ids = t.mail.filter(F.col("labels").contains("Work")).select("id")
    return S.common_labels(t.mail, ids)


@check("A21_changed_rows", """
SELECT count(*) FILTER (WHERE u.is_read IS NOT NULL AND u.is_read <> m.is_read
  OR (u.folder IN ('TRASH', 'ARCHIVE') AND u.folder <> m.folder)) AS changed
FROM mail AS m JOIN updates AS u USING (id)""", ("mail", "updates"))
def _(t):
    return S.changed_rows(t.mail, bulk_update(t.mail, t.updates), ["is_read", "folder"])
