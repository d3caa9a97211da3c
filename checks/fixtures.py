"""Mail tables derived from the given tables, in SQL both engines run.

Each definition reads the given tables (written ``@events@`` and so on) or other
definitions by name.  Nothing is sampled: every row of the source table yields a
row, and the variety comes from ``CASE`` expressions over its columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-30 12:00:00"
SELF = "me@example.com"
AS_OF_SQL = f"CAST('{AS_OF}' AS TIMESTAMP)"

# (intent, subject, snippet, body); every reachable intent at least once.
TEMPLATES = [
    ("REQUIRES_REPLY", "Can you look at the draft?", "Could you read the draft",
     "<p>Hello,</p><p>Could you read the draft and tell me what is missing?</p>"),
    ("INVOICE", "Invoice 2291 for March", "The invoice is attached.",
     "<p>The invoice is attached. Amount due: 310 EUR.</p>"),
    ("RECEIPT", "Receipt for your payment", "We charged your card.",
     "<p>Payment received, we charged your card.</p>"),
    ("SHIPMENT", "Parcel on its way", "The package has shipped.",
     "<p>The package has shipped with the carrier. Have a good day.</p>"),
    ("ORDER", "Order confirmation", "It is in our system.",
     "<p>Your order is in our system. We close at noon.</p>"),
    ("MEETING", "Calendar invite: planning", "Let's meet in room four.",
     "<p>Let's meet in room four. The calendar invite follows.</p>"),
    ("COMMITMENT", "Status of the offer", "I will send the offer by Friday.",
     "<p>I will send the offer by Friday. I will send the offer by Friday. "
     "We'll follow up next week.</p>"),
    ("SECURITY_ALERT", "Security alert", "Unusual sign-in.",
     "<p>Unusual sign-in. Verify your account with the recovery code.</p>"),
    ("NEWSLETTER", "Garden newsletter", "This week in the garden.",
     "<style>p{color:red}</style><p>This week in the garden. Unsubscribe here.</p>"),
    ("PROMOTION", "Spring prices", "Save up to 30% today.",
     "<p>Save up to 30% today. Limited time, shop now!</p>"),
    ("PERSONAL", "Hello from the lake", "The weather is fine.",
     "<p>The weather is fine &amp; the water is warm. Greetings to all of you.</p>"),
    ("FYI", "Menu du jour", "Les cafés sont là.",
     "<p>Les cafés et thés éshipped sont prêts, voilà l'invoiceé.</p>"),
    ("", "Odd markup", "Hi there",
     "<p onclick=\"go()\">Hi <b>there</b></p><script>alert(1)</script>"
     "<a href=\"javascript:run()\">x</a><iframe src=\"http://a.example\"></iframe>"
     "<img src='data:text/html,abc'><form><b>in</b></form><meta charset=\"x\"/>"),
    ("FYI", "Plain notes", "Notes: see https://docs.example",
     "Notes: see https://docs.example/a?b=1 & more\nSecond line with \"quotes\", it's <3"),
    ("REQUIRES_REPLY", "Any news?", "Is there any news",
     "<p>Is there any news on the contract?</p>"),
    ("COMMITMENT", "Roadmap", "We will have the roadmap ready.",
     "<p>We will have the roadmap ready by end of month. "
     "Please review the table before Monday!</p>"),
    ("REQUIRES_REPLY", "Permit copy", "Please send the parking permit.",
     "<p>Please send the parking permit today. Thanks a lot for the help.</p>"),
    ("BUSINESS", "Minutes", "Minutes of the board",
     "<p>Minutes of the board are in the folder.</p>"),
    ("FYI", "", "Short note", "<p>Short note without a subject.</p>"),
    ("SOCIAL", "You were tagged", "Someone tagged a photo.",
     "<p>Someone tagged a photo of you.</p>"),
    ("FYI", "re: Fish &amp; chips", "Fish & chips",
     "<p>Fish&nbsp;&amp;&nbsp;chips &lt;hot&gt; for   two.</p>"),
    ("", "Fwd: Trip report", "We left the harbour",
     "<p>We left the harbour at dawn and crossed the bay under a pale sky. The crew was "
     "calm, the sea was flat and the old boat moved slowly past the islands. At noon we "
     "landed on the northern shore and walked up to the village.</p>"),
    ("INVOICE", "Invoice and tracking", "The invoice is paid.",
     "<p>The invoice is paid and the tracking number is 77. Delivery tomorrow.</p>"),
    ("COMMITMENT", "Next steps", "I plan to finish the report.",
     "<p>I plan to finish the report tomorrow. I'm going to call the bank by 3rd May. "
     "You can rest now. Will you join? We expect to close by 12th.</p>"),
]


def _literal(text: str) -> str:
    lines = ["'" + line.replace("'", "''") + "'" for line in text.split("\n")]
    return lines[0] if len(lines) == 1 else "concat(" + ", chr(10), ".join(lines) + ")"


def _pick(column: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN {_literal(v)}" for i, v in enumerate(values))
    return f"CASE {column} {arms} END"


_T = len(TEMPLATES)

TABLES: dict[str, tuple[list[str], str]] = {}

TABLES["mail"] = ([], f"""
SELECT id, thread_id,
  CASE WHEN own THEN 'Me' ELSE person_name END AS from_name,
  CASE WHEN own THEN '{SELF}' ELSE person END AS from_email,
  CASE WHEN own THEN person ELSE '{SELF}' END AS to_emails,
  CASE WHEN k % 5 = 0 THEN concat(' user', CAST((user_id + 1) % 200 AS STRING),
         '@acme.example , Jo.van-Dam_', CAST(user_id AS STRING), '@studio.example')
       WHEN k % 5 = 1 THEN concat('USER', CAST(user_id AS STRING), '@studio.example,')
       ELSE '' END AS cc_emails,
  CASE WHEN k % 19 = 0 THEN 'hidden@acme.example' ELSE '' END AS bcc_emails,
  {_pick('t', [t[1] for t in TEMPLATES])} AS subject,
  {_pick('t', [t[3] for t in TEMPLATES])} AS body,
  {_pick('t', [t[2] for t in TEMPLATES])} AS snippet,
  ts AS date,
  (k % 3 <> 0) AS is_read, (k % 11 = 0) AS is_starred, (k % 9 = 0) AS is_important,
  (k % 6 = 0) AS has_attachment,
  folder,
  CASE k % 7 WHEN 0 THEN '' WHEN 1 THEN 'Work' WHEN 2 THEN 'Personal' WHEN 3 THEN 'Finance'
    WHEN 4 THEN 'Newsletter' WHEN 5 THEN 'Personal, Social' ELSE 'Travel,Work,Travel' END
    AS labels,
  CASE WHEN k % 6 = 0 THEN concat('file-', CAST(k AS STRING), '.pdf') ELSE '' END
    AS attachment_name,
  {_pick('t', [t[0] for t in TEMPLATES])} AS intent,
  CASE k % 13 WHEN 0 THEN ts + INTERVAL '2' DAY WHEN 1 THEN ts + INTERVAL '20' DAY END
    AS snoozed_until,
  CASE WHEN folder = 'SCHEDULED' THEN
    CASE k % 3 WHEN 0 THEN ts WHEN 1 THEN ts + INTERVAL '1' DAY
         ELSE ts + INTERVAL '20' DAY END END AS scheduled_for,
  ts AS created_at, ts AS updated_at
FROM (
  SELECT event_id AS k, ts, user_id, event_id % {_T} AS t, concat('m', CAST(event_id AS STRING)) AS id,
    concat('t_', CAST(user_id AS STRING), '_', CAST(CAST(ts AS DATE) AS STRING)) AS thread_id,
    event_type = 'click' AS own,
    concat(CASE user_id % 5 WHEN 0 THEN 'Ana' WHEN 1 THEN 'Bo' WHEN 2 THEN 'Émile'
      WHEN 3 THEN 'dora' ELSE 'Yi' END, ' ', CASE user_id % 7 WHEN 0 THEN 'Ruiz'
      WHEN 1 THEN 'Lund' WHEN 2 THEN 'Okafor' ELSE 'Stein' END, ' ',
      CAST(user_id AS STRING)) AS person_name,
    concat(CASE WHEN event_type = 'error' THEN 'User' ELSE 'user' END, CAST(user_id AS STRING),
      CASE user_id % 7 WHEN 0 THEN '@acme.example' WHEN 1 THEN '@deals.example'
        WHEN 2 THEN '@github.example' WHEN 3 THEN '@no-reply.example'
        WHEN 4 THEN '@studio.example' WHEN 5 THEN '@bank.example'
        ELSE '@weekly.example' END) AS person,
    CASE WHEN event_type = 'click' THEN
           CASE event_id % 10 WHEN 0 THEN 'DRAFTS' WHEN 1 THEN 'SCHEDULED' ELSE 'SENT' END
         WHEN event_id % 20 = 0 THEN 'SPAM' WHEN event_id % 20 = 1 THEN 'TRASH'
         WHEN event_id % 20 < 7 THEN 'ARCHIVE' ELSE 'INBOX' END AS folder
  FROM @events@) AS e
""")

# The label dictionary: six labels in use and one that is not.
TABLES["labels_dim"] = ([], """
SELECT concat('lbl-', lower(name)) AS id, name, color FROM (VALUES
  ('Work', 'purple'), ('Personal', 'green'), ('Finance', 'red'), ('Newsletter', 'amber'),
  ('Travel', 'teal'), ('Social', 'pink'), ('Unused', 'gray')) AS v(name, color)
""")

TABLES["new_labels"] = ([], """
SELECT p_brand AS seq_name, name, color FROM (
  SELECT DISTINCT p_brand, concat(' ', p_brand, ' ') AS name,
    CASE WHEN p_brand < 'Brand#2' THEN 'blue' END AS color FROM @part@
  UNION ALL SELECT DISTINCT p_type, CASE WHEN p_type < 'F' THEN 'Work' ELSE '  ' END, 'red'
  FROM @part@) AS u
""")

TABLES["links"] = (["mail"], """
SELECT concat('d', id) AS id,
  CASE WHEN is_starred THEN concat('gone-', id) ELSE id END AS email_id,
  to_emails AS recipient_email, md5(id) AS token,
  is_important AS viewed,
  CASE WHEN is_important THEN date + INTERVAL '1' DAY END AS viewed_at,
  CASE WHEN has_attachment THEN NULL WHEN is_read THEN date + INTERVAL '2' DAY
       ELSE date + INTERVAL '30' DAY END AS expires_at,
  date AS created_at
FROM mail WHERE folder = 'SENT'
""")

TABLES["route_configs"] = ([], """
SELECT concat('r', CAST(s_suppkey AS STRING)) AS id, s_name AS name,
  CASE WHEN s_acctbal > 5000 THEN concat('relay-', CAST(s_suppkey AS STRING), '.example')
       ELSE '' END AS host,
  CASE WHEN s_acctbal > 5000 THEN 587 ELSE 25 END AS port,
  concat('region-', CAST(s_nationkey AS STRING)) AS region,
  CAST(s_nationkey AS INT) AS priority,
  CASE WHEN s_acctbal > 2000 THEN 1 ELSE 0 END AS enabled
FROM @supplier@
""")

# Mailboxes named after the regions; the first has half of the mail and the last none.
TABLES["mailboxes"] = ([], f"""
SELECT r_name AS mailbox, CASE r_regionkey WHEN 0 THEN '{SELF}' WHEN 1 THEN 'user3@NO-reply.example'
  WHEN 2 THEN 'user7@acme.example' ELSE concat('own', CAST(r_regionkey AS STRING), '@acme.example') END
  AS self_email FROM @region@
""")
TABLES["boxed_mail"] = (["mail"], """
SELECT mail.*, CASE CAST(substr(id, 2) AS BIGINT) % 6 WHEN 3 THEN 'AMERICA' WHEN 4 THEN 'ASIA'
  WHEN 5 THEN 'EUROPE' ELSE 'AFRICA' END AS mailbox FROM mail
""")

# A mail system all of whose routes are switched off.
TABLES["closed_routes"] = (["route_configs"], "SELECT * FROM route_configs WHERE enabled = 0")

# Answers of up to seven models about a message; keys beyond the mail table stay unmatched.
TABLES["model_replies"] = ([], """
SELECT email_id, concat('model-', CAST(l_linenumber AS STRING)) AS model,
  seq AS ordinal,
  CASE WHEN l_returnflag = 'A' AND l_quantity < 5 THEN NULL
       WHEN l_quantity < 10 THEN concat('I cannot answer ', reply, ' as asked')
       WHEN l_quantity < 12 THEN concat('{"intent": "FYI", "confidence": ', conf)
       WHEN l_quantity < 20 THEN concat('```json', chr(10), reply, chr(10), '```')
       ELSE reply END AS content
FROM (SELECT concat('m', CAST(l_orderkey AS STRING)) AS email_id, l_linenumber, l_quantity,
        l_returnflag,
        (CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 1000000 + l_suppkey) * 100
          + CAST(l_quantity AS BIGINT) AS seq,
        CAST(CAST(round(l_discount * 100) AS INT) AS STRING) AS conf,
        concat('{"intent": "', CASE WHEN l_returnflag = 'R' THEN 'INVOICE'
            WHEN l_linestatus = 'F' THEN 'FYI' WHEN l_linenumber < 4 THEN 'MEETING'
            ELSE 'COMMITMENT' END,
          '", "confidence": 0.', CAST(CAST(round(l_discount * 100) AS INT) AS STRING),
          ', "reason": "part ', CAST(l_partkey AS STRING),
          CASE WHEN l_linenumber = 3 THEN '' ELSE concat('", "reasoning": "scored ',
            CAST(l_suppkey AS STRING)) END, '", "summary": "',
          CASE WHEN l_linenumber = 2 THEN '' ELSE concat('about ', CAST(l_suppkey AS STRING)) END,
          '", "score": ', CAST(CAST(l_quantity * 3 AS INT) AS STRING), '}') AS reply
      FROM @lineitem@) AS r
""")

TABLES["updates"] = ([], """
SELECT concat('m', CAST(o_orderkey AS STRING)) AS id, o_orderkey AS seq,
  CASE WHEN o_orderstatus = 'F' THEN true WHEN o_orderstatus = 'O' THEN false END AS is_read,
  CASE WHEN o_orderpriority = '1-URGENT' THEN true END AS is_starred,
  CASE WHEN o_orderpriority = '2-HIGH' THEN true WHEN o_orderpriority = '5-LOW' THEN false END
    AS is_important,
  CASE WHEN o_totalprice < 50000 THEN 'TRASH' WHEN o_totalprice < 100000 THEN 'NOWHERE'
       WHEN o_totalprice < 150000 THEN 'ARCHIVE' END AS folder,
  CASE WHEN o_orderpriority = '3-MEDIUM' THEN o_orderdate END AS snoozed_until,
  o_orderpriority = '4-NOT SPECIFIED' AS clear_snooze
FROM @orders@
""")

TABLES["patches"] = ([], """
SELECT concat('m', CAST(o_orderkey AS STRING)) AS id, o_orderkey AS seq,
  CASE WHEN o_orderstatus = 'F' THEN concat('Changed ', o_orderpriority) END AS subject,
  CASE WHEN o_orderstatus = 'O' THEN concat('<p>', o_orderpriority, '</p>') END AS body,
  CASE WHEN o_totalprice < 100000 THEN 'a@acme.example' END AS to_emails,
  CASE WHEN o_totalprice > 400000 THEN 'Work' END AS labels,
  CASE WHEN o_totalprice > 450000 THEN 'FYI' END AS intent,
  CAST(NULL AS BOOLEAN) AS is_read,
  CAST(NULL AS TIMESTAMP) AS snoozed_until, o_orderstatus = 'P' AS clear_snooze
FROM @orders@
""")

TABLES["reply_requests"] = ([], """
SELECT concat('m', CAST(p_partkey AS STRING)) AS original_id,
  concat('r', CAST(p_partkey AS STRING)) AS reply_id,
  CASE WHEN p_size < 25 THEN concat('Thanks & regards,', chr(10), p_name, ' see http://x.example/', p_type)
       ELSE concat('<p>I will send ', p_name, ' by Friday.</p>') END AS body,
  CASE WHEN p_size > 40 THEN 'offer.pdf' END AS attachment_name
FROM @part@
""")

# Four saved searches per nation: flags, folder, sender and words.
_WORD_OF = ("CASE n_regionkey WHEN 0 THEN 'Offer' WHEN 1 THEN 'invoice' "
            "WHEN 2 THEN 'the board' WHEN 3 THEN 'CAFÉS' ELSE 'draft' END")
_FOLDER_OF = ("CASE n_regionkey WHEN 0 THEN 'sent' WHEN 1 THEN 'archive' "
              "WHEN 2 THEN 'drafts' ELSE 'inbox' END")
_TERMS = [
    (0, "is", "'unread'"), (0, "from", "concat('USER', CAST(n_nationkey AS STRING))"),
    (1, "in", _FOLDER_OF), (1, "text", _WORD_OF),
    (2, "has", "'attachment'"), (2, "label", "'work'"),
    (2, "to", "concat('user', CAST(n_nationkey * 2 AS STRING))"),
    (3, "subject", _WORD_OF), (3, "is", "'read'"), (3, "in", "'trash'"), (3, "in", _FOLDER_OF),
]
TABLES["saved_searches"] = ([], " UNION ALL ".join(
    f"SELECT CAST(n_nationkey * 4 + {q} AS INT) AS query_id, '{field}' AS field, "
    f"{value} AS value, {k} AS term_no FROM @nation@"
    for k, (q, field, value) in enumerate(_TERMS)))

TABLES["command_log"] = ([], f"""
SELECT event_id AS command_id, concat({_pick('event_id % 17', [
    'Compose a note to', 'waiting on', 'What needs a reply from', 'urgent items of',
    'list commitments of', 'invoices from', 'newsletters by', 'contacts near', 'inbox of',
    'starred by', 'find mail of', 'Show  the plans of', 'nothing special', 'draft for',
    'knowledge of', '  where is user', 'which file of'])}, ' ', CAST(user_id AS STRING)) AS text
FROM @events@
""")

# Inbound messages as posted: optional fields missing, some without a sender.
TABLES["inbound"] = ([], f"""
SELECT concat('in', CAST(event_id AS STRING)) AS id,
  CASE WHEN value < 1 THEN '  ' ELSE concat(' Sender ', CAST(user_id AS STRING), ' ') END
    AS fromName,
  CASE WHEN value > 60 THEN NULL ELSE concat('s', CAST(user_id AS STRING), '@acme.example') END
    AS fromEmail,
  CASE WHEN event_type = 'view' THEN ' team@acme.example ' END AS toEmails,
  CASE WHEN event_type = 'click' THEN ' boss@acme.example' END AS ccEmails,
  CAST(NULL AS STRING) AS bccEmails,
  CASE WHEN event_type = 'error' THEN NULL
       ELSE concat(' ', {_pick(f'event_id % {_T}', [t[1] for t in TEMPLATES])}) END AS subject,
  {_pick(f'event_id % {_T}', [t[3] for t in TEMPLATES])} AS body,
  CASE WHEN event_type = 'signup' THEN 'not a date' WHEN event_type = 'view' THEN NULL
       ELSE concat(CAST(CAST(ts AS DATE) AS STRING), 'T10:00:00Z') END AS date,
  CASE WHEN event_type = 'purchase' THEN ' Work ' END AS labels,
  CAST(NULL AS STRING) AS attachmentName,
  CASE WHEN event_type = 'click' THEN concat('t_', CAST(user_id AS STRING)) END AS threadId,
  CASE WHEN event_type = 'error' THEN true END AS hasAttachment,
  CASE WHEN event_type = 'click' THEN true END AS isImportant
FROM @events@
""")

# Outbound and composed messages.
TABLES["outbound"] = ([], f"""
SELECT concat('out', CAST(event_id AS STRING)) AS id,
  CASE WHEN event_type = 'error' THEN ' ' ELSE concat('s', CAST(user_id AS STRING),
    '@acme.example') END AS toEmails,
  CASE WHEN event_type = 'view' THEN NULL
       ELSE {_pick(f'event_id % {_T}', [t[1] for t in TEMPLATES])} END AS subject,
  {_pick(f'event_id % {_T}', [t[3] for t in TEMPLATES])} AS body,
  CASE WHEN event_type = 'click' THEN ts + INTERVAL '3' DAY END AS scheduledFor,
  CASE WHEN event_type = 'signup' THEN true ELSE false END AS isDraft,
  CASE WHEN value > 30 THEN 'plan.pdf' END AS attachmentName
FROM @events@
""")

# Whole documents as raw messages: header lines, blank line, body.
TABLES["raw_messages"] = ([], """
SELECT concat('raw', CAST(doc_id AS STRING)) AS id,
  concat('s', CAST(doc_id AS STRING), '@acme.example') AS envelope_from,
  'me@example.com' AS envelope_to,
  concat(CASE WHEN lang = 'en' THEN concat('From: "Ana ', source, '" <ana@acme.example>',
            chr(13), chr(10)) WHEN lang = 'fr' THEN concat('from:   <x@acme.example>', chr(13), chr(10))
           ELSE '' END,
         CASE WHEN lang = 'de' THEN 'X-Mailer: none' ELSE concat('Subject:  Text ',
            CAST(doc_id AS STRING), ' in ', lang) END,
         chr(13), chr(10), chr(13), chr(10), text) AS value
FROM @documents@
""")

SOURCES = ("region nation customer supplier part orders lineitem events documents "
           "embeddings pages benchmark labels conversations").split()


def _order(names) -> list[str]:
    out: list[str] = []
    for name in names:
        for dep in _order(TABLES[name][0]):
            if dep not in out:
                out.append(dep)
        if name not in out:
            out.append(name)
    return out


def _duck(text: str) -> str:
    for source in SOURCES:
        text = text.replace(f"@{source}@", source)
    return text


def duck_sql(body: str, *names: str) -> str:
    """``body`` with the named definitions in front, for DuckDB."""
    ctes = [f"{n} AS ({_duck(TABLES[n][1])})" for n in _order(names)]
    body = _duck(body).strip()
    if body[:5].upper() == "WITH ":
        ctes.append(body[5:])
        return "WITH " + ",\n".join(ctes)
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a DataFrame over the given tables."""
    def spark_sql(text: str) -> str:
        for src in SOURCES:
            text = text.replace(f"@{src}@", f"parquet.`{sf_dir}/{src}.parquet`")
        return text.replace("AS TIMESTAMP)", "AS TIMESTAMP_NTZ)")

    order = _order([name])
    ctes = ", ".join(f"{n} AS ({spark_sql(TABLES[n][1])})" for n in order)
    return spark.sql(f"WITH {ctes} SELECT * FROM {name}")



def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream; ``ts`` as TIMESTAMP for watermarks."""
    schema = source(spark, sf_dir, "events").schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
            .load(sf_dir))


def stream_of(events: DataFrame, name: str) -> DataFrame:
    """A derived table over a stream of events."""
    view = f"letterloom_{name}_events"
    events.createOrReplaceTempView(view)
    text = TABLES[name][1].replace("@events@", view)
    return events.sparkSession.sql(text.replace("AS TIMESTAMP)", "AS TIMESTAMP_NTZ)"))
