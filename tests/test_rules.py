"""Unit cases of rules and text functions, and the order of the rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from letterloom.functions import dates, lists, text
from letterloom.functions import lexicon as lx
from letterloom.functions.command import route_command
from letterloom.functions.intent import classify_intent, says, with_category
from letterloom.functions.replies import parse_model_reply
from letterloom.functions.score import priority_level, priority_score
from letterloom.operators.commitments import commitments, dedupe_commitments
from letterloom.operators.views import terms_of

SELF = "me@example.com"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def intents(spark, rows):
    names = "subject snippet body from_email from_name labels".split()
    data = [(i, *[r.get(n, "") for n in names]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "i int, " + ", ".join(f"{n} string" for n in names))
    out = classify_intent(df, self_email=SELF).select("i", "signal.*").orderBy("i").collect()
    return [(r["intent"], r["confidence"]) for r in out]


def test_each_rule_and_its_order(spark):
    cases = [
        ({"body": "Amount due: 12. Invoice 7."}, "INVOICE", 0.8),
        ({"body": "Could you check the plan?"}, "REQUIRES_REPLY", 0.6),
        ({"body": "Could you check the plan?", "from_email": SELF}, "FYI", 0.4),
        ({"body": "Could you check the plan?", "from_email": "ME@Example.com"}, "FYI", 0.4),
        ({"body": "Security alert: unusual sign-in. Invoice inside."}, "SECURITY_ALERT", 0.85),
        ({"body": "Unsubscribe here. 20% off."}, "NEWSLETTER", 0.8),
        ({"labels": "Work, Newsletter"}, "NEWSLETTER", 0.8),
        ({"body": "20% off, and an invoice"}, "PROMOTION", 0.75),
        ({"from_email": "a@deals.example"}, "PROMOTION", 0.75),
        ({"from_email": "a@github.example"}, "SOCIAL", 0.7),
        ({"labels": "social"}, "SOCIAL", 0.7),
        ({"labels": "Finance"}, "INVOICE", 0.8),
        ({"body": "the invoice shipped"}, "INVOICE", 0.8),
        ({"body": "receipt for the package"}, "RECEIPT", 0.75),
        ({"body": "the package of your order"}, "SHIPMENT", 0.75),
        ({"body": "your order, book a room"}, "ORDER", 0.7),
        ({"body": "Let's meet, I will come"}, "MEETING", 0.7),
        ({"body": "I will come. What now?"}, "COMMITMENT", 0.65),
        ({"body": "We'll see"}, "COMMITMENT", 0.65),
        ({"body": "We’ll see"}, "FYI", 0.4),
        ({"labels": "Personal,Work"}, "PERSONAL", 0.55),
        ({"labels": "work"}, "BUSINESS", 0.5),
        ({"body": "nothing of note"}, "FYI", 0.4),
        ({"body": "taxi, totally upset"}, "FYI", 0.4),
        ({"body": "éshipped"}, "SHIPMENT", 0.75),
        ({"body": "xshipped"}, "FYI", 0.4),
    ]
    assert intents(spark, [c[0] for c in cases]) == [(c[1], c[2]) for c in cases]


PATTERNS = ["QUESTION", "COMMITMENT", "INCOMING_COMMITMENT", "REQUEST", "INVOICE", "RECEIPT",
            "ORDER", "SHIPMENT", "MEETING", "SECURITY", "NEWSLETTER", "PROMOTION"]


@pytest.mark.parametrize("name", PATTERNS)
def test_the_substring_test_never_hides_a_match(spark, name):
    """Each phrase, expanded in a few ways, is found with and without the test."""
    pattern = getattr(lx, name)
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(
        F.lower("text").alias("t"))
    made = spark.createDataFrame([(f"so {p} it",) for p in [
        "can you", "please  tell", "feedback?x", "i'll", "ill", "we'll", "i'm going to",
        "im going to", "committed", "delivering by", "send it by", "will have it ready",
        "by end of week", "please sign", "total", "total:9", "pay before", "order #",
        "order #9", "thank you for your order", "tracking #", "ups", "would we meet",
        "schedule a call", "let's meet", "lets meet", "book the room", "verify it's you",
        "verify your email", "account locked", "this week in", "50% off", "save 5",
        "save up to 10%"]], "t string")
    rows = texts.unionByName(made)
    plain = F.col("t").rlike(lx.whole_words(pattern))
    counts = rows.agg(F.count_if(says(F.col("t"), pattern) != plain).alias("differ"),
                      F.count_if(plain).alias("hits")).first()
    assert counts["differ"] == 0 and counts["hits"] > 0


def signals(spark, body, sender):
    df = spark.createDataFrame(
        [("1", "t", "s", "Ana", dt.datetime(2024, 1, 1), "INBOX", body, sender)],
        "id string, thread_id string, subject string, from_name string, date timestamp_ntz, "
        "folder string, body string, from_email string")
    return commitments(df, self_email=SELF).orderBy("pos").collect()


def test_commitments(spark):
    own = signals(spark, "<p>I will post the offer tomorrow.</p>", SELF)
    assert [(s.direction, s.due, s.who, s.owner) for s in own] == [
        ("outgoing", "tomorrow", "You", "you")]
    theirs = signals(spark, "<p>We will paint the fence by Friday.</p>", "a@b.example")
    assert [(s.direction, s.due, s.who) for s in theirs] == [("incoming", "by friday", "Ana")]
    asked = signals(spark, "<p>Please share the parking permit.</p>", "a@b.example")
    assert [(s.direction, s.due) for s in asked] == [("outgoing", None)]
    assert signals(spark, "<p>Please send it all.</p>", SELF)[0].direction == "incoming"
    assert signals(spark, "<p>The garden is green. Rain is near.</p>", "a@b.example") == []
    twice = signals(spark, "I will send it soon. I WILL send it soon. I will go there!", SELF)
    assert [s.pos for s in twice] == [0, 2]
    assert signals(spark, "I will go.", SELF) == []  # ten characters
    across = signals(spark, "I&nbsp;<b>will</b>\n send this.", SELF)
    assert across[0].evidence == "I will send this."
    assert signals(spark, None, SELF) == []


def test_dedupe_keeps_the_first(spark):
    df = spark.createDataFrame([("m", "A b.", 3), ("m", "a B.", 1), ("n", "a b.", 9)],
                               "email_id string, evidence string, pos int")
    rows = {(r.email_id, r.evidence, r.pos) for r in dedupe_commitments(df).collect()}
    assert rows == {("m", "a B.", 1), ("n", "a b.", 9)}


def test_sanitizer(spark):
    clean = lambda html: value(spark, text.sanitize_html(F.lit(html)))
    assert clean("<i>ok</i><script>run(1)</script>") == "<i>ok</i>"
    assert clean('<i onload="run()">ok</i>') == "<i>ok</i>"
    assert clean("<a href='javascript:run()'>x</a>") == "<a href='#'>x</a>"
    assert clean('<a HREF="VBScript:run()">x</a>') == '<a HREF="#">x</a>'
    safe = '<ul style="color:red"><li>one <b>two</b></li></ul>'
    assert clean(safe) == safe
    assert clean("<iframe src=a>in</iframe><link rel=x><basefont>") == "<basefont>"
    assert value(spark, text.sanitize_html(F.lit(None).cast("string"))) == ""


def test_category(spark):
    def category(**given):
        cols = "labels from_email from_name subject snippet".split()
        row = spark.createDataFrame([tuple(given.get(c, "") for c in cols)],
                                    ", ".join(f"{c} string" for c in cols))
        return with_category(row).first()["category"]
    assert category(labels="Newsletter") == "PROMOTIONS"
    assert category(labels="Social") == "SOCIAL"
    assert category(labels="Finance") == "UPDATES"
    assert category(labels="Work") == "PRIMARY"
    assert category(subject="A wholesale matter") == "PROMOTIONS"  # no word boundary
    assert category(from_email="noreply@x.example") == "UPDATES"


def test_dates(spark):
    as_of = "2024-01-31 12:00:00"  # a Wednesday
    bucket = lambda d: value(spark, dates.date_bucket(
        F.lit(d).cast("timestamp_ntz"), as_of))
    assert bucket("2024-01-31 00:00:00") == "Today"
    assert bucket("2024-01-30 23:59:59") == "Yesterday"
    assert bucket("2024-01-28 00:00:00") == "This week"  # Sunday
    assert bucket("2024-01-27 23:59:59") == "This month"  # Saturday before
    assert bucket("2024-02-03 08:00:00") == "This week"
    assert bucket("2023-01-31 08:00:00") == "Earlier"
    until = lambda p, now: value(spark, dates.snooze_until(F.lit(p), now))
    assert until("later-today", as_of) == dt.datetime(2024, 1, 31, 16)
    assert until("tomorrow", as_of) == dt.datetime(2024, 2, 1, 9)
    assert until("next-week", as_of) == dt.datetime(2024, 2, 7, 9)
    assert until("weekend", as_of) == dt.datetime(2024, 2, 3, 10)
    assert until("weekend", "2024-02-03 08:00:00") == dt.datetime(2024, 2, 10, 10)
    assert until("weekend", "2024-02-04 08:00:00") == dt.datetime(2024, 2, 10, 10)
    age = lambda d: value(spark, dates.age_days(
        F.lit(d).cast("timestamp_ntz"), as_of))
    assert (age("2024-01-30 12:00:01"), age("2024-01-30 12:00:00"), age("2024-02-09 00:00:00")
            ) == (0, 1, 0)


def test_text(spark):
    snippet = value(spark, text.make_snippet(F.lit("<p>Green <b>garden</b> gate</p>"), 10))
    assert snippet == "Green gard…"
    html = value(spark, text.text_to_html(F.lit("<tag>x\nsee http://a.b/?c=1&d 'q'")))
    assert html.startswith("&lt;tag&gt;x<br/>see <a href=\"http://a.b/?c=1&amp;d\"")
    assert html.endswith(" &#39;q&#39;")
    reading = lambda n: value(spark, text.reading_time(F.lit("<p>" + "word " * n)))
    assert [reading(n) for n in (1, 99, 100, 199, 200, 299, 300, 500)] == [
        "<1 min", "<1 min", "1 min", "1 min", "1 min", "1 min", "2 min", "3 min"]
    name = lambda a: value(spark, text.display_name_from_address(F.lit(a)))
    assert name("jo.van-DAM_x@a.example") == "Jo Van DAM X"
    assert name("o'neil@a") == "O'Neil"
    assert value(spark, text.collapse_space(F.lit("  a  \t b "))) == "a b"


def test_lists(spark):
    assert value(spark, lists.add_label(F.lit(" a,b ,a"), "c")) == "a,b,c"
    assert value(spark, lists.remove_label(F.lit("a, b,a"), "a")) == "b"
    undone = lists.remove_label(lists.add_label(F.lit("x,y"), "n"), "n")
    assert value(spark, undone) == "x,y"
    everyone = lists.reply_all_recipients(
        F.lit("Bo@x"), F.lit("me@example.com, bo@X ,c@y,ME@example.com"), SELF)
    assert value(spark, everyone) == "Bo@x, c@y"


def test_scores(spark):
    score = lambda *a: value(spark, priority_score(*[F.lit(x) for x in a]))
    assert score("SECURITY_ALERT", True, True) == 100
    assert score("PROMOTION", False, False) == 15
    assert score("", True, False) == 55
    levels = [value(spark, priority_level(F.lit(s))) for s in (0, 30, 31, 60, 61, 85, 86)]
    assert levels == ["low", "low", "medium", "medium", "high", "high", "urgent"]


def test_commands(spark):
    route = lambda c: tuple(value(spark, route_command(F.lit(c))))
    assert route("Reply to Ana") == ("compose", None, None, 0.9)
    assert route("what needs a reply") == ("view", "reply", None, 0.85)
    assert route("urgent invoices") == ("view", "now", None, 0.8)
    assert route("Find  old plans") == ("search", None, "old plans", 0.6)
    assert route("knowledge") == ("search", None, "knowledge", 0.3)


def test_model_replies(spark):
    read = lambda raw: value(spark, parse_model_reply(F.lit(raw)))
    assert read('```json\n{"intent": "FYI", "confidence": 0.5}\n```').confidence == 0.5
    assert read('Here: {"intent": "ORDER"} as asked').intent == "ORDER"
    for broken in ('{"intent": "ORDER"', "no json", '{"intent": }'):
        assert not read(broken) or read(broken).intent is None


def test_search_line():
    assert terms_of('is:unread from:"Ana Ruiz" old plans "and more" foo:bar') == [
        ("is", "unread"), ("from", "Ana Ruiz"), ("text", "old plans and more foo:bar")]
    assert terms_of('"old plans"') == [("text", "old plans")]
    assert terms_of("  ") == []
