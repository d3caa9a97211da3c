"""Rules and text functions, over mail, documents and pages as a whole."""

from letterloom.functions import dates, lists, replies, score, text
from letterloom.functions.command import route_command
from letterloom.functions.compose import forward_subject, reply_subject
from letterloom.functions.intent import (classify_intent, derive_category, intent_label)
from letterloom.operators import briefing as B
from letterloom.operators import commitments as C
from letterloom.operators import votes
from pyspark.sql import functions as F

from checks.registry import AS_OF, CORR, NOW, OWN, SELF, check
from checks.rule_sql import (CATEGORY, commitments_sql, csv, display_name, normal_body,
                             outcome, q, rule_case, sanitize, snippet, strip, tags, to_html,
                             visible, words, collapse)
from checks.stat_checks import BUCKET
from letterloom.functions import lexicon as lx

c = F.col


@check("X1_classify_intent", f"""
SELECT id, {outcome('r', 0)} AS intent, {outcome('r', 1)} AS confidence, {outcome('r', 2)} AS reason
FROM (SELECT id, {rule_case()} AS r FROM mail) AS x""")
def _(t):
    return classify_intent(t.mail, self_email=SELF).select("id", "signal.*")


_DOC = "lower(concat('', ' ', '', ' ', text))"


@check("X1_classify_documents", f"""
SELECT doc_id, {outcome('r', 0)} AS intent FROM (SELECT doc_id, {rule_case(
    _DOC, "lower(concat('x@acme.example', ' ', source))", 'false', False)} AS r
  FROM documents) AS x""", ())
def _(t):
    docs = t.documents.select("doc_id", c("text").alias("body"), c("source").alias("from_name"),
                              F.lit("").alias("subject"),
                              F.lit("x@acme.example").alias("from_email"))
    return classify_intent(docs, self_email=SELF, snippet=None, labels=None).select(
        "doc_id", c("signal.intent").alias("intent"))


@check("X2_derive_category", f"SELECT id, {CATEGORY} AS category FROM mail")
def _(t):
    return t.mail.select("id", derive_category(
        c("labels"), c("from_email"), c("from_name"), c("subject"), c("snippet"))
        .alias("category"))


_FOUND = ("commitment_id, short_id, email_id, thread_id, subject, from_name, date, who, action, owner, "
          "direction, due, evidence, confidence, CAST(pos AS BIGINT) AS pos")


def _commitments(t):
    return C.commitments(t.mail, self_email=SELF).withColumn("pos", c("pos").cast("bigint"))


@check("X4_commitments", commitments_sql(f"SELECT {_FOUND} FROM found"))
def _(t):
    return _commitments(t)


@check("X3_detect_commitments", commitments_sql(
    "SELECT email_id, count(*) AS n, count(due) AS with_due, "
    "count(*) FILTER (WHERE direction = 'incoming') AS incoming FROM found GROUP BY email_id"))
def _(t):
    own = t.mail.filter("folder IN ('INBOX', 'SENT', 'ARCHIVE')")
    signals = C.detect_commitments(own, self_email=SELF).select(
        c("id").alias("email_id"), c("signals").alias("s"))
    size = lambda col: F.size(col).cast("bigint")
    return signals.filter(F.size("s") > 0).select(
        "email_id", size("s").alias("n"),
        size(F.filter("s", lambda s: s["due_date"].isNotNull())).alias("with_due"),
        size(F.filter("s", lambda s: s["direction"] == "incoming")).alias("incoming"))


@check("X3_detected_signals", commitments_sql(
    "SELECT email_id, CAST(pos AS BIGINT) AS pos, action, owner, direction, due, evidence, confidence FROM found"))
def _(t):
    """The signals themselves, one row each."""
    own = t.mail.filter("folder IN ('INBOX', 'SENT', 'ARCHIVE')")
    signals = C.detect_commitments(own, self_email=SELF)
    return signals.select(c("id").alias("email_id"), F.explode_outer("signals").alias("s")).filter(
        c("s").isNotNull()).select(
        "email_id", c("s.pos").cast("bigint").alias("pos"), "s.action", "s.owner", "s.direction",
        c("s.due_date").alias("due"), "s.evidence", "s.confidence")


_DOC_PARTS = (rf"string_split(regexp_replace({collapse('replace(' + tags('text') + ', ' + q('&nbsp;') + ', ' + q(' ') + ')')}, "
              rf"'([.!?]) +', concat('\1', chr(1)), 'g'), chr(1))")


@check("X3_document_sentences", f"""
SELECT doc_id, len(ps) AS n_sentences, list_max(list_transform(ps, lambda x: length(x))) AS longest,
  len(list_filter(ps, lambda x: length(x) > 10)) AS n_long
FROM (SELECT doc_id, {_DOC_PARTS} AS ps FROM documents) AS x""", ())
def _(t):
    parts = t.documents.select("doc_id", C.sentences(C.plain_text(c("text"))).alias("ps"))
    big = lambda col: col.cast("bigint")
    return parts.select(
        "doc_id", big(F.size("ps")).alias("n_sentences"),
        big(F.array_max(F.transform("ps", F.char_length))).alias("longest"),
        big(F.size(F.filter("ps", lambda s: F.char_length(s) > 10))).alias("n_long"))


@check("W4_dedupe_commitments", commitments_sql(
    "SELECT email_id, evidence, CAST(pos AS BIGINT) AS pos, direction FROM found"))
def _(t):
    twice = _commitments(t).select("email_id", "evidence", "pos", "direction")
    again = twice.withColumn("pos", c("pos") + 1000).withColumn("evidence", F.upper("evidence"))
    return C.dedupe_commitments(twice.unionByName(again))


@check("F24_commitments_incoming", commitments_sql(
    "SELECT commitment_id, direction, who FROM found WHERE direction = 'incoming'"))
def _(t):
    return C.commitments_by_direction(_commitments(t), "incoming").select(
        "commitment_id", "direction", "who")


@check("A15_commitment_summary", commitments_sql(
    "SELECT count(*) AS detected, count(*) FILTER (WHERE direction = 'incoming') AS incoming, "
    "count(*) FILTER (WHERE direction = 'outgoing') AS outgoing FROM found"))
def _(t):
    return C.commitment_summary(C.commitments(t.mail, self_email=SELF))


OVERDUE = f"""SELECT id, thread_id, date FROM mail AS e WHERE {CORR} AND intent = 'COMMITMENT'
  AND NOT ({OWN}) AND date < {NOW} - INTERVAL '3' DAY AND NOT EXISTS (SELECT 1 FROM mail AS s
    WHERE s.thread_id = e.thread_id AND lower(s.from_email) = '{SELF}'
      AND s.folder IN ('INBOX', 'SENT', 'ARCHIVE'))"""


@check("J1_overdue_commitments", OVERDUE)
def _(t):
    return C.overdue_commitments(t.mail, AS_OF, self_email=SELF).select(
        "id", "thread_id", "date")


@check("A4_overdue_count", f"SELECT count(DISTINCT id) AS overdue FROM ({OVERDUE}) AS o")
def _(t):
    return C.overdue_count(t.mail, AS_OF, self_email=SELF)


_RECENT = f"""recent AS (SELECT id AS rid FROM mail WHERE {CORR} ORDER BY date DESC, id LIMIT 60),
ranked AS (SELECT *, row_number() OVER (PARTITION BY email_id ORDER BY pos) AS rank FROM found),
newest AS (SELECT * FROM ranked JOIN recent ON rid = email_id)"""


def _with_more(extra: str, columns: str) -> str:
    """The commitment SQL with further definitions before its final SELECT."""
    return commitments_sql("\x00").replace("\n\x00", ",\n" + extra + "\n" + columns)


@check("W6_briefing_commitments", _with_more(
    _RECENT, "SELECT email_id, evidence, rank FROM ranked"))
def _(t):
    return C.briefing_commitments(t.mail, self_email=SELF).select(
        "email_id", "evidence", c("rank").cast("bigint").alias("rank"))


@check("W6_briefing_commitments_cut", _with_more(
    _RECENT, "SELECT email_id, evidence, rank FROM newest WHERE rank <= 2"))
def _(t):
    return C.briefing_commitments(t.mail, self_email=SELF, newest=60, per_message=2).select(
        "email_id", "evidence", c("rank").cast("bigint").alias("rank"))


_ANSWER = "(intent = 'COMMITMENT' OR contains(body, '?'))"
_SECTIONS = f"""{_RECENT},
items AS (
  SELECT 'needs_reply' AS section, date, id, 0 AS pos, subject AS title, from_name AS who,
    snippet AS detail, CAST(NULL AS BIGINT) AS age_days FROM mail
    WHERE {CORR} AND NOT ({OWN}) AND intent = 'REQUIRES_REPLY' AND folder IN ('INBOX', 'ARCHIVE')
  UNION ALL SELECT 'waiting', date, id, 0, subject, to_emails, snippet,
    greatest(0, CAST(floor((epoch_us({NOW}) - epoch_us(date)) / 86400000000) AS BIGINT)) FROM mail
    WHERE {OWN} AND folder = 'SENT' AND {_ANSWER}
  UNION ALL SELECT 'commitments', date, email_id, pos, left(action, 120), who, due, NULL
    FROM ranked
  UNION ALL SELECT 'receipts', date, id, 0, subject, from_name, snippet, NULL FROM mail
    WHERE {CORR} AND (intent IN ('INVOICE', 'RECEIPT', 'ORDER', 'SHIPMENT') OR
      (contains(lower(body), 'invoice') AND contains(lower(labels), 'finance')))),
sections AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY section
    ORDER BY date DESC, id, pos) AS nth FROM items) AS x
  WHERE nth <= CASE section WHEN 'needs_reply' THEN 6 WHEN 'commitments' THEN 5 ELSE 4 END)"""


def _sections(t):
    return B.briefing_sections(t.mail, AS_OF, self_email=SELF)


@check("W7_briefing_sections", _with_more(
    _SECTIONS, "SELECT section, nth AS rank, title, who, detail, age_days FROM sections"))
def _(t):
    return _sections(t).withColumn("rank", c("rank").cast("bigint"))


_COUNTS = ", ".join(f"count(*) FILTER (WHERE section = '{s}') AS {s}" for s in B.SECTIONS)


@check("A16_briefing_counts", _with_more(_SECTIONS, """SELECT
  least(6, count(*) FILTER (WHERE section = 'needs_reply')) AS needs_reply,
  least(4, count(*) FILTER (WHERE section = 'waiting')) AS waiting,
  count(*) FILTER (WHERE section = 'commitments') AS commitments,
  least(4, count(*) FILTER (WHERE section = 'receipts')) AS receipts FROM items"""))
def _(t):
    return B.briefing_counts(t.mail, self_email=SELF)


@check("X28_briefing_headline", _with_more(_SECTIONS, f"""
SELECT concat(needs_reply + waiting + commitments + receipts, ' items need a look: ', needs_reply,
  ' to reply, ', waiting, ' waiting, ', commitments, CASE WHEN commitments = 1 THEN ' commitment'
  ELSE ' commitments' END, ', ', receipts, CASE WHEN receipts = 1 THEN ' receipt'
  ELSE ' receipts' END, '.') AS headline,
  concat('Reply to ', lead_who, ' — "', lead_title, '".') AS first_action
FROM (SELECT {_COUNTS}, max(who) FILTER (WHERE section = 'needs_reply' AND nth = 1) AS lead_who,
  max(title) FILTER (WHERE section = 'needs_reply' AND nth = 1) AS lead_title FROM sections)
  AS x"""))
def _(t):
    return B.briefing_headline(_sections(t))


@check("X5_date_bucket", f"SELECT id, {BUCKET} AS bucket FROM mail")
def _(t):
    return t.mail.select("id", dates.date_bucket(c("date"), AS_OF).alias("bucket"))


_SCORE = """least(100, greatest(0, 30 + CASE WHEN is_important THEN 25 ELSE 0 END
  + CASE WHEN has_attachment THEN 10 ELSE 0 END + CASE WHEN intent = 'REQUIRES_REPLY' THEN 30
    WHEN intent IN ('COMMITMENT', 'MEETING') THEN 20 WHEN intent = 'SECURITY_ALERT' THEN 40
    WHEN intent IN ('INVOICE', 'RECEIPT') THEN 5
    WHEN intent IN ('NEWSLETTER', 'PROMOTION') THEN -15 ELSE 0 END))"""
_LEVEL = ("CASE WHEN score >= 86 THEN 'urgent' WHEN score >= 61 THEN 'high' "
          "WHEN score >= 31 THEN 'medium' ELSE 'low' END")


def _scores(t):
    return t.mail.select("id", score.priority_score(
        c("intent"), c("is_important"), c("has_attachment")).alias("score"))


@check("X6_priority_score", f"SELECT id, {_SCORE} AS score FROM mail")
def _(t):
    return _scores(t)


@check("X7_priority_level", f"""SELECT {_LEVEL} AS level, count(*) AS n
FROM (SELECT {_SCORE} AS score FROM mail) AS s GROUP BY 1""")
def _(t):
    return (_scores(t).groupBy(score.priority_level(c("score")).alias("level"))
            .agg(F.count("*").alias("n")))


@check("X8_make_snippet", f"SELECT id, {snippet('body')} AS s FROM mail")
def _(t):
    return t.mail.select("id", text.make_snippet(c("body")).alias("s"))


@check("X8_page_snippets", f"SELECT page_id, {snippet('html')} AS s FROM pages", ())
def _(t):
    return t.pages.select("page_id", text.make_snippet(c("html")).alias("s"))


@check("X9_strip_html", f"""SELECT page_id, md5({visible('html')}) AS digest,
  left({visible('html')}, 3000) AS s FROM pages""", ())
def _(t):
    return t.pages.select("page_id", F.md5(text.strip_html(c("html"))).alias("digest"),
                          text.strip_html(c("html"), 3000).alias("s"))


@check("X10_text_to_html", f"""SELECT doc_id, md5({to_html('text')}) AS digest,
  length({to_html('text')}) AS n FROM documents""", ())
def _(t):
    html = text.text_to_html(c("text"))
    return t.documents.select("doc_id", F.md5(html).alias("digest"),
                              F.char_length(html).cast("bigint").alias("n"))


@check("X11_normalize_body", f"SELECT id, {normal_body('body')} AS html FROM mail")
def _(t):
    return t.mail.select("id", text.normalize_body(c("body")).alias("html"))


def _reading(column: str) -> str:
    return (f"(SELECT CASE WHEN m < 0.5 THEN '<1 min' WHEN m < 1 THEN '1 min' "
            f"ELSE concat(CAST(floor(m + 0.5) AS BIGINT), ' min') END FROM (SELECT "
            f"len(list_filter(string_split({collapse(tags(column))}, ' '), lambda x: x <> '')) "
            "/ 200.0 AS m))")


@check("X12_reading_time", f"SELECT page_id, {_reading('html')} AS reading_time FROM pages", ())
def _(t):
    return t.pages.select("page_id", text.reading_time(c("html")).alias("reading_time"))


@check("X12_document_reading_time",
       f"SELECT doc_id, {_reading('text')} AS reading_time FROM documents", ())
def _(t):
    return t.documents.select("doc_id", text.reading_time(c("text")).alias("reading_time"))


@check("X13_sanitize_html", f"SELECT id, {sanitize('body')} AS html FROM mail")
def _(t):
    return t.mail.select("id", text.sanitize_html(c("body")).alias("html"))


@check("X13_sanitize_pages", f"""SELECT page_id, md5(h) AS digest, length(h) AS n
FROM (SELECT page_id, {sanitize('html')} AS h FROM pages) AS x""", ())
def _(t):
    html = text.sanitize_html(c("html"))
    return t.pages.select("page_id", F.md5(html).alias("digest"),
                          F.char_length(html).cast("bigint").alias("n"))


@check("X14_csv_to_array", f"""SELECT id, array_to_string({csv('cc_emails')}, '|') AS cc,
  {strip("concat(' ', attachment_name, chr(9), chr(160))")} AS file FROM mail""")
def _(t):
    return t.mail.select(
        "id", F.array_join(text.csv_to_array(c("cc_emails")), "|").alias("cc"),
        text.trim_or_empty(F.concat(F.lit(" "), "attachment_name", F.lit("\t "))).alias("file"))


@check("X15_display_name", f"""SELECT email, {display_name('email')} AS name FROM (
  SELECT DISTINCT unnest({csv('cc_emails')}) AS email FROM mail
  UNION SELECT DISTINCT concat(c_name, '.o''neil-mc_Éa@', c_mktsegment) FROM customer) AS a""")
def _(t):
    cc = t.mail.select(F.explode(text.csv_to_array(c("cc_emails"))).alias("email"))
    made = t.customer.select(F.concat("c_name", F.lit(".o'neil-mc_Éa@"), "c_mktsegment")
                             .alias("email"))
    return cc.unionByName(made).distinct().select(
        "email", text.display_name_from_address(c("email")).alias("name"))


@check("X20_age_days", f"""SELECT id, greatest(0, CAST(floor((epoch_us({NOW}) - epoch_us(date))
  / 86400000000) AS BIGINT)) AS age FROM mail""")
def _(t):
    return t.mail.select("id", dates.age_days(c("date"), AS_OF).alias("age"))


@check("X21_snooze_until", """
SELECT id, preset, CASE preset WHEN 'later-today' THEN date + INTERVAL '4' HOUR
  WHEN 'tomorrow' THEN date_trunc('day', date) + INTERVAL '1' DAY + INTERVAL '9' HOUR
  WHEN 'next-week' THEN date_trunc('day', date) + INTERVAL '7' DAY + INTERVAL '9' HOUR
  WHEN 'weekend' THEN date_trunc('day', date) + INTERVAL '10' HOUR
    + to_days(CAST(CASE WHEN dayofweek(date) = 6 THEN 7 ELSE 6 - dayofweek(date) END AS INT))
  END AS until
FROM mail CROSS JOIN (VALUES ('later-today'), ('tomorrow'), ('next-week'), ('weekend'),
  ('never')) AS p(preset)""")
def _(t):
    presets = F.array(*[F.lit(p) for p in (
        "later-today", "tomorrow", "next-week", "weekend", "never")])
    rows = t.mail.select("id", "date", F.explode(presets).alias("preset"))
    return rows.select("id", "preset",
                       dates.snooze_until(c("preset"), c("date")).alias("until"))


@check("X22_subjects", """
SELECT id, CASE WHEN starts_with(lower(subject), 're:') THEN subject
  ELSE concat('Re: ', subject) END AS reply,
  CASE WHEN starts_with(lower(subject), 'fwd:') THEN subject
  ELSE concat('Fwd: ', subject) END AS forward FROM mail""")
def _(t):
    return t.mail.select("id", reply_subject(c("subject")).alias("reply"),
                         forward_subject(c("subject")).alias("forward"))


_VIEW_ARMS = " ".join(
    f"WHEN {words('low', w)} THEN {{{i}}}" for i, (w, _v, _c) in enumerate(lx.COMMAND_VIEWS))
_STRIP_VERB = f"regexp_replace(cmd, {q('^(?:' + lx.COMMAND_VERB + ')' + lx.SPACE + '+')}, '', 'i')"


def _command_case(compose: str, views: list[str], search: str, other: str) -> str:
    arms = _VIEW_ARMS
    for i, value in enumerate(views):
        arms = arms.replace("{" + str(i) + "}", value)
    return (f"CASE WHEN regexp_matches(low, '^(?:{lx.COMMAND_COMPOSE})') THEN {compose} {arms} "
            f"WHEN {words('low', lx.COMMAND_SEARCH)} THEN {search} ELSE {other} END")


_N = len(lx.COMMAND_VIEWS)


@check("X24_route_command", f"""
SELECT command_id,
  {_command_case("'compose'", ["'view'"] * _N, "'search'", "'search'")} AS action,
  {_command_case("NULL", ["'" + v + "'" for _, v, _c in lx.COMMAND_VIEWS], "NULL", "NULL")} AS view,
  {_command_case("NULL", ["NULL"] * _N, strip(_STRIP_VERB), "cmd")} AS query,
  CAST({_command_case("0.9", [str(x) for _, _v, x in lx.COMMAND_VIEWS], "0.6", "0.3")} AS DOUBLE)
    AS confidence
FROM (SELECT command_id, {strip('text')} AS cmd, lower({strip('text')}) AS low FROM command_log)
  AS x""", ("command_log",))
def _(t):
    return t.command_log.select("command_id", route_command(c("text")).alias("r")).select(
        "command_id", "r.*")


# --- Model replies ------------------------------------------------------------------

_CLEAN = r"""trim(replace(regexp_replace(content, '```(?:json|JSON)?[ \n\t\r]*', '', 'g'), '```', ''),
  concat(' ', chr(10)))"""
_PARSED = f"""parsed AS (SELECT *, CASE WHEN json_valid(j) THEN json_extract_string(j, '$.intent') END
    AS intent, CASE WHEN json_valid(j) THEN CAST(json_extract(j, '$.confidence') AS DOUBLE) END AS conf,
    CASE WHEN json_valid(j) THEN json_extract_string(j, '$.reason') END AS reason,
    CASE WHEN json_valid(j) THEN json_extract_string(j, '$.reasoning') END AS reasoning,
    CASE WHEN json_valid(j) THEN json_extract_string(j, '$.summary') END AS summary,
    CASE WHEN json_valid(j) THEN CAST(json_extract(j, '$.score') AS DOUBLE) END AS score
  FROM (SELECT *, nullif(regexp_extract({_CLEAN}, '\\{{(?s:.*)\\}}'), '') AS j
        FROM model_replies) AS x)"""
REPLIES = ("model_replies",)


@check("X25_parse_model_reply", f"""WITH {_PARSED}
SELECT email_id, ordinal, intent, conf AS confidence, reason, summary, score FROM parsed""", REPLIES)
def _(t):
    return votes.parsed(t.model_replies).select(
        "email_id", "ordinal", "intent", "confidence", "reason", "summary", "score")


_VOTES = f"""{_PARSED},
vote AS (SELECT email_id, intent, count(*) AS n, min(ordinal) AS o,
    first(coalesce(reason, '') ORDER BY ordinal) AS reason
  FROM parsed WHERE intent <> '' GROUP BY email_id, intent),
won AS (SELECT email_id, intent, n AS votes, CAST(n AS DOUBLE) / valid AS confidence, reason
  FROM (SELECT *, sum(n) OVER (PARTITION BY email_id) AS valid,
    row_number() OVER (PARTITION BY email_id ORDER BY n DESC, o) AS r FROM vote) AS x
  WHERE r = 1)"""


@check("A14_majority_vote", f"""WITH {_VOTES}
SELECT email_id, intent, votes, confidence, reason FROM won""", REPLIES)
def _(t):
    return votes.majority_vote(t.model_replies)


_BEST = f"""{_PARSED},
best AS (SELECT email_id, model, coalesce(intent, 'FYI') AS intent, summary,
    coalesce(conf, 0.3) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY email_id
      ORDER BY coalesce(conf, 0.3) DESC, ordinal) AS r FROM parsed WHERE summary <> '') AS x
  WHERE r = 1)"""


@check("W5_best_reply", f"""WITH {_BEST}
SELECT email_id, model, intent, summary, CAST(confidence AS DOUBLE) AS confidence FROM best""",
       REPLIES)
def _(t):
    return votes.best_reply(t.model_replies).drop("commitments")


@check("W9_first_reply", """SELECT email_id, model, content FROM (SELECT *, row_number() OVER (
  PARTITION BY email_id ORDER BY ordinal) AS r FROM model_replies WHERE content <> '') AS x
WHERE r = 1""", REPLIES)
def _(t):
    return votes.first_reply(t.model_replies)


@check("W10_first_valid_score", f"""WITH {_PARSED}
SELECT email_id, model, CAST(score AS INT) AS score, reasoning, confidence, {_LEVEL} AS level
FROM (SELECT email_id, model, floor(score + 0.5) AS score, coalesce(reasoning, '') AS reasoning,
    CAST(coalesce(conf, 0.7) AS DOUBLE) AS confidence,
    row_number() OVER (PARTITION BY email_id ORDER BY ordinal) AS r
  FROM parsed WHERE score BETWEEN 0 AND 100) AS x WHERE r = 1""", REPLIES)
def _(t):
    return votes.first_valid_score(t.model_replies)


_RULES = f"rules AS (SELECT *, {rule_case()} AS r FROM mail)"


@check("X26_refine_intent", f"""
WITH {_VOTES}, {_RULES},
base AS (SELECT id, {outcome('r', 0)} AS i, {outcome('r', 1)} AS c, {outcome('r', 2)} AS w
  FROM rules)
SELECT id, CASE WHEN v.confidence > c THEN v.intent ELSE i END AS intent,
  CASE WHEN v.confidence > c THEN v.confidence ELSE c END AS confidence,
  CASE WHEN v.confidence > c THEN v.reason ELSE w END AS reason,
  CASE WHEN v.confidence > c THEN 'ai' ELSE 'rules' END AS source
FROM base LEFT JOIN won AS v ON v.email_id = id""", ("mail", "model_replies"))
def _(t):
    return votes.refine_intent(t.mail, t.model_replies, self_email=SELF)


_TOLD = '[{"who": "VARCHAR", "action": "VARCHAR", "due": "VARCHAR", "source": "VARCHAR"}]'


# The commitments are JSON text, so that both engines give one column of a plain type.
@check("X27_merge_handled", f"""{commitments_sql('', 'true')}, {_PARSED}, {_RULES},
best AS (SELECT email_id, coalesce(intent, 'FYI') AS intent, summary,
    coalesce(conf, 0.3) AS confidence, from_json(json_extract(j, '$.commitments'), {q(_TOLD)}) AS told
  FROM (SELECT *, row_number() OVER (PARTITION BY email_id
      ORDER BY coalesce(conf, 0.3) DESC, ordinal) AS r FROM parsed WHERE summary <> '') AS x
  WHERE r = 1),
ruled AS (SELECT email_id, list({{'who': who, 'action': action, 'due': due, 'source': evidence}}
    ORDER BY pos) AS signals FROM found GROUP BY email_id)
SELECT id, CASE WHEN coalesce(b.intent, 'FYI') = 'FYI' AND coalesce(b.confidence, 0.3) < 0.5
    THEN {outcome('r', 0)} ELSE b.intent END AS intent,
  coalesce(b.summary, concat('Email from ', from_name, ' about "', subject, '".')) AS summary,
  CAST(coalesce(b.confidence, 0.3) AS DOUBLE) AS confidence,
  CAST(to_json(CASE WHEN len(b.told) > 0 THEN b.told ELSE coalesce(s.signals, []) END) AS VARCHAR)
    AS commitments
FROM rules LEFT JOIN best AS b ON b.email_id = id LEFT JOIN ruled AS s ON s.email_id = id""",
       ("mail", "model_replies"))
def _(t):
    handled = votes.merge_handled(t.mail, t.model_replies, self_email=SELF)
    return handled.withColumn("commitments", F.to_json("commitments", {"ignoreNullFields": "false"}))


@check("X27_handled_commitments", commitments_sql(
    "SELECT email_id AS id, evidence AS source, who, due FROM found"))
def _(t):
    own = t.mail.filter("folder IN ('INBOX', 'SENT', 'ARCHIVE')")
    handled = votes.merge_handled(own, t.model_replies, self_email=SELF)
    return handled.select("id", F.explode("commitments").alias("x")).select(
        "id", "x.source", "x.who", "x.due")


@check("X29_intent_label", """
SELECT id, CASE intent WHEN 'REQUIRES_REPLY' THEN 'Needs reply' WHEN 'FYI' THEN 'FYI'
  WHEN 'SECURITY_ALERT' THEN 'Security' WHEN '' THEN ''
  ELSE concat(left(intent, 1), lower(substr(intent, 2))) END AS label FROM mail""")
def _(t):
    return t.mail.select("id", intent_label(c("intent")).alias("label"))


@check("U2_add_label", f"""SELECT id, array_to_string(list_filter(l, lambda a, i:
  list_position(l, a) = i), ',') AS labels
FROM (SELECT id, list_concat({csv('labels')}, ['Work']) AS l FROM mail) AS x""")
def _(t):
    return t.mail.select("id", lists.add_label(c("labels"), "Work").alias("labels"))


@check("U3_remove_label", f"""SELECT id, array_to_string(list_filter({csv('labels')},
  lambda x: x <> 'Work'), ',') AS labels FROM mail""")
def _(t):
    return t.mail.select("id", lists.remove_label(c("labels"), "Work").alias("labels"))
