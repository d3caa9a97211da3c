"""Views, search, sorting and paging."""

from letterloom.operators import views as V
from letterloom.functions.intent import (is_purchase_like, is_subscription_like,
                                         with_category)
from letterloom.operators.links import link_state
from letterloom.operators.people import contacts, suggest_contacts
from letterloom.operators.saved_searches import match_saved_searches
from letterloom.schema import LIST_COLUMNS
from letterloom.sources.tables import load_mail, write_version
from letterloom.streaming.sinks import job_dir
from pyspark.sql import functions as F

from checks.registry import AS_OF, AWAKE, CORR, NOW, OWN, SELF, check
from checks.rule_sql import (CATEGORY, LABELS, PURCHASE_TEXT, SENDER, SUBSCRIPTION_TEXT,
                             contacts_sql)

ROW = ("id", "thread_id", "folder", "subject", "date")
ROW_SQL = "SELECT id, thread_id, folder, subject, date FROM mail WHERE "
LIST_SQL = "SELECT " + ", ".join(LIST_COLUMNS) + " FROM mail WHERE "


def _rows(df):
    return df.select(*ROW)


FINANCE = "contains(lower(labels), 'finance')"
NEWS = "contains(lower(labels), 'newsletter')"
ATTENTION = ("(NOT is_read OR is_important OR intent IN ('REQUIRES_REPLY', "
             "'SECURITY_ALERT', 'COMMITMENT', 'MEETING'))")
PURCHASE = f"(intent IN ('INVOICE', 'RECEIPT', 'ORDER', 'SHIPMENT') OR {FINANCE})"
BULK = f"(intent IN ('NEWSLETTER', 'PROMOTION') OR {NEWS})"
ANSWER = "(intent = 'COMMITMENT' OR contains(body, '?'))"


@check("S1_load_mail", "SELECT id, from_email, date, is_read, folder, body FROM mail")
def _(t):
    path = job_dir(t.spark, "load")
    write_version(t.mail, path)
    return load_mail(t.spark, path, ["id", "from_email", "date", "is_read", "folder", "body"])


@check("S8_lookup", "SELECT id, folder FROM mail WHERE id IN (SELECT id FROM updates)",
       ("mail", "updates"))
def _(t):
    return V.lookup(t.mail, "id", t.updates).select("id", "folder")


@check("S9_api_projection", LIST_SQL + "true")
def _(t):
    return V.api_projection(t.mail)


@check("F1_not_snoozed", ROW_SQL + AWAKE)
def _(t):
    return _rows(t.mail.filter(V.not_snoozed(AS_OF)))


@check("F2_view_folder", ROW_SQL + f"folder = 'INBOX' AND {AWAKE}")
def _(t):
    return _rows(V.mail_view(t.mail, AS_OF, folder="NOT A FOLDER"))


@check("F2_view_folder_archive", ROW_SQL + "folder = 'ARCHIVE'")
def _(t):
    return _rows(V.mail_view(t.mail, AS_OF, folder="ARCHIVE"))


@check("F3_view_starred", ROW_SQL
       + f"is_starred AND folder IN ('INBOX', 'SENT', 'DRAFTS', 'ARCHIVE') AND {AWAKE}")
def _(t):
    return _rows(V.mail_view(t.mail, AS_OF, starred=True))


@check("F4_view_important", ROW_SQL + f"is_important AND {CORR} AND {AWAKE}")
def _(t):
    return _rows(V.mail_view(t.mail, AS_OF, important=True))


@check("F5_view_snoozed", ROW_SQL
       + f"snoozed_until > {NOW} AND folder IN ('INBOX', 'ARCHIVE')")
def _(t):
    return _rows(V.mail_view(t.mail, AS_OF, snoozed_only=True))


@check("F6_view_label", ROW_SQL + f"contains(labels, 'Personal') AND {CORR} AND {AWAKE}")
def _(t):
    return _rows(V.mail_view(t.mail, AS_OF, label="Personal"))


@check("F6_view_label_exact", ROW_SQL
       + "list_contains(list_transform(string_split(labels, ','), lambda x: trim(x)), "
       + f"'Social') AND {CORR} AND {AWAKE}")
def _(t):
    return _rows(t.mail.filter(V.label_view("Social", AS_OF, exact=True)))


@check("F7_view_now", ROW_SQL + f"folder = 'INBOX' AND {AWAKE} AND {ATTENTION}")
def _(t):
    return _rows(V.mail_view(t.mail, AS_OF, view="now"))


@check("F8_view_reply", ROW_SQL + "intent = 'REQUIRES_REPLY' AND "
       f"folder IN ('INBOX', 'ARCHIVE') AND {AWAKE} AND NOT ({OWN})")
def _(t):
    return _rows(V.mail_view(t.mail, AS_OF, view="reply", self_email=SELF))


@check("F9_view_waiting", ROW_SQL + f"folder = 'SENT' AND {ANSWER}")
def _(t):
    return _rows(V.mail_view(t.mail, AS_OF, view="waiting"))


@check("F10_view_receipts", ROW_SQL + f"{CORR} AND {AWAKE} AND {PURCHASE}")
def _(t):
    return _rows(V.mail_view(t.mail, AS_OF, view="receipts"))


@check("F11_view_subscriptions", ROW_SQL
       + f"folder IN ('INBOX', 'ARCHIVE') AND {AWAKE} AND {BULK}")
def _(t):
    return _rows(V.mail_view(t.mail, AS_OF, view="subscriptions"))


@check("F12_view_precedence", ROW_SQL
       + f"snoozed_until > {NOW} AND folder IN ('INBOX', 'ARCHIVE')")
def _(t):
    return _rows(V.mail_view(t.mail, AS_OF, view="unknown", snoozed_only=True, starred=True,
                             important=True, label="Work", folder="SENT"))


@check("F13_unread_only", ROW_SQL + "folder = 'SENT' AND NOT is_read")
def _(t):
    return _rows(V.mail_view(t.mail, AS_OF, folder="SENT", unread=True))


@check("F14_search_terms", ROW_SQL
       + "folder = 'ARCHIVE' AND NOT is_read AND has_attachment AND "
       "(contains(lower(from_email), 'user1') OR contains(lower(from_name), 'user1')) AND "
       f"contains(lower(labels), 'work') AND {AWAKE}")
def _(t):
    terms = V.terms_of("is:unread has:attachment from:User1 label:work in:archive is:odd")
    return _rows(V.search(t.mail, terms, AS_OF))


@check("F15_search_text", ROW_SQL + f"folder = 'INBOX' AND {AWAKE} AND ("
       + " OR ".join(f"contains(lower({c}), 'the board')" for c in V.FREE_TEXT_COLUMNS) + ")")
def _(t):
    return _rows(V.search(t.mail, V.terms_of('the "BOARD"'), AS_OF))


def _in_list(word: str) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), '{word}')"
                             for c in ("subject", "body", "from_name")) + ")"


@check("F16_api_list_filter", ROW_SQL + f"{CORR} AND {AWAKE} AND {PURCHASE} AND "
       + _in_list("invoice"))
def _(t):
    return _rows(t.mail.filter(V.api_list_filter(AS_OF, view="receipts", query=" Invoice ")))


@check("F16_api_list_unread", ROW_SQL + "folder = 'INBOX' AND NOT is_read AND "
       + _in_list("draft"))
def _(t):
    return _rows(t.mail.filter(V.api_list_filter(AS_OF, query="DRAFT", unread=True)))


@check("F17_is_purchase_like", "SELECT id, (" + PURCHASE_TEXT + ") AS hit FROM mail")
def _(t):
    return t.mail.select("id", is_purchase_like(
        *[F.col(c) for c in ("subject", "snippet", "body", "labels")]).alias("hit"))


@check("F18_is_subscription_like", "SELECT id, (" + SUBSCRIPTION_TEXT + ") AS hit FROM mail")
def _(t):
    return t.mail.select("id", is_subscription_like(*[F.col(c) for c in (
        "subject", "snippet", "from_email", "from_name", "labels")]).alias("hit"))


@check("F19_suggest_contacts", f"""
WITH people AS ({contacts_sql()}),
typed AS (SELECT DISTINCT c_mktsegment AS text, '' AS token FROM customer
  UNION ALL SELECT DISTINCT concat(n_name, ', ruiz ', n_nationkey),
    CAST(n_nationkey AS STRING) FROM nation
  UNION ALL SELECT DISTINCT concat('ana@x, ', left(p_type, 2)), lower(left(p_type, 2)) FROM part),
tok AS (SELECT text, CASE WHEN token = '' THEN lower(text) ELSE token END AS token FROM typed
  UNION ALL SELECT DISTINCT '' , '' FROM region)
SELECT text, token, rank, email, name FROM (
  SELECT text, token, email, name,
    row_number() OVER (PARTITION BY text ORDER BY name, email) AS rank
  FROM tok JOIN people ON contains(lower(email), token) OR contains(lower(name), token)) AS x
WHERE rank <= 6""")
def _(t):
    typed = (t.customer.select(F.col("c_mktsegment").alias("text")).distinct()
             .unionByName(t.nation.select(F.concat(
                 "n_name", F.lit(", ruiz "), F.col("n_nationkey").cast("string")).alias("text")))
             .unionByName(t.part.select(F.concat(
                 F.lit("ana@x, "), F.left("p_type", F.lit(2))).alias("text")).distinct())
             .unionByName(t.region.select(F.lit("").alias("text")).distinct()))
    found = suggest_contacts(contacts(t.mail, self_email=SELF), typed)
    return found.select("text", "token", F.col("rank").cast("bigint").alias("rank"),
                        "email", "name")


@check("F20_link_state", f"""
SELECT id, CASE WHEN expires_at < {NOW} THEN 'expired' WHEN viewed THEN 'viewed'
  ELSE 'open' END AS state FROM links""", ("links",))
def _(t):
    return link_state(t.links, AS_OF).select("id", "state")


@check("F21_due_scheduled", ROW_SQL + f"folder = 'SCHEDULED' AND scheduled_for <= {NOW}")
def _(t):
    return _rows(t.mail.filter(V.due_scheduled(AS_OF)))


@check("F22_triage_queue", ROW_SQL + f"folder = 'INBOX' AND {AWAKE} AND NOT is_read")
def _(t):
    return _rows(V.triage_queue(t.mail, AS_OF))


@check("F23_category_tab", f"""SELECT id, category FROM (SELECT *, {CATEGORY} AS category
  FROM mail) AS c WHERE folder = 'INBOX' AND {AWAKE} AND category = 'UPDATES'""")
def _(t):
    return V.category_tab(with_category(t.mail), "UPDATES", AS_OF).select("id", "category")


@check("O1_newest", "SELECT id, date FROM mail ORDER BY date DESC, id LIMIT 200")
def _(t):
    return V.newest(t.mail).select("id", "date")


@check("O2_page", f"""SELECT id, date FROM mail WHERE folder = 'INBOX' AND {AWAKE}
ORDER BY date DESC, id LIMIT 200 OFFSET 100""")
def _(t):
    return V.api_page(V.mail_view(t.mail, AS_OF), 500, 100).select("id", "date")


@check("O2_page_after", """SELECT id, date FROM mail
WHERE date < CAST('2024-01-15 00:00:00' AS TIMESTAMP) ORDER BY date DESC, id LIMIT 50""")
def _(t):
    return V.page_after(t.mail, "2024-01-15 00:00:00", "zzz").select("id", "date")


@check("O4_thread_order", "SELECT thread_id, date, id FROM mail ORDER BY thread_id, date, id")
def _(t):
    return V.thread_order(t.mail).select("thread_id", "date", "id")


@check("O5_by_name", "SELECT c_name AS name, c_custkey AS id FROM customer ORDER BY 1, 2", ())
def _(t):
    people = t.customer.selectExpr("c_name AS name", "c_custkey AS id")
    return V.by_name(people, "id")


@check("O6_briefing_scan", f"""SELECT id, date FROM mail WHERE {CORR}
ORDER BY date DESC, id LIMIT 200""")
def _(t):
    return V.newest(t.mail.filter(V.in_correspondence())).select("id", "date")


@check("A17_page_total", f"SELECT count(*) AS total FROM mail WHERE folder = 'INBOX' AND {AWAKE}")
def _(t):
    return V.page_total(V.mail_view(t.mail, AS_OF))


@check("J16_match_saved_searches", """
WITH term AS (SELECT query_id, field, lower(value) AS v FROM saved_searches AS s
  WHERE field <> 'in' OR term_no = (SELECT max(term_no) FROM saved_searches AS o
    WHERE o.query_id = s.query_id AND o.field = 'in')),
hit AS (SELECT query_id, id FROM term JOIN mail ON
  CASE field
    WHEN 'is' THEN CASE v WHEN 'unread' THEN NOT is_read WHEN 'read' THEN is_read END
    WHEN 'has' THEN has_attachment
    WHEN 'in' THEN folder = upper(v)
    WHEN 'from' THEN contains(lower(from_email), v) OR contains(lower(from_name), v)
    WHEN 'to' THEN contains(lower(to_emails), v)
    WHEN 'subject' THEN contains(lower(subject), v)
    WHEN 'label' THEN contains(lower(labels), v)
    ELSE contains(lower(subject), v) OR contains(lower(from_name), v)
      OR contains(lower(from_email), v) OR contains(lower(to_emails), v)
      OR contains(lower(body), v) OR contains(lower(snippet), v) END),
want AS (SELECT query_id, count(*) AS n FROM term GROUP BY query_id)
SELECT query_id, id FROM hit JOIN want USING (query_id)
GROUP BY query_id, id, n HAVING count(*) = n""", ("mail", "saved_searches"))
def _(t):
    return match_saved_searches(t.saved_searches, t.mail)
