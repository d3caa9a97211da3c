"""Properties that hold whatever the data, and behaviour under skew."""

import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401
from checks import fixtures as fx
from checks.registry import QUERIES
from letterloom.functions.replies import outer_object
from letterloom.operators import mutate as M
from letterloom.operators import people as P
from letterloom.operators import saved_searches as SS
from letterloom.operators import stats as S
from letterloom.operators import threads as T
from letterloom.operators import views as V
from letterloom.operators import votes
from letterloom.plans import reports
from letterloom.sources import inbound, versions
from letterloom.sources.tables import (load_mail, load_text_layout, mirror, rebuild_snapshot,
                                       write_version)

DATA = "/root/testdata/sf0.001"
AS_OF, SELF = fx.AS_OF, fx.SELF


@pytest.fixture(scope="module")
def mail(spark):
    return fx.table(spark, DATA, "mail").cache()


@pytest.fixture(scope="module")
def hot_mail(spark, mail):
    """The same mail with a third of all rows in one thread of one sender."""
    hot = F.pmod(F.hash("id"), F.lit(3)) == 0
    return mail.withColumns({
        "thread_id": F.when(hot, "hot").otherwise(F.col("thread_id")),
        "from_email": F.when(hot & (F.col("from_email") != SELF), "hot@acme.example")
        .otherwise(F.col("from_email"))})


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_counts_add_up(mail):
    n = mail.count()
    assert S.folder_counts(mail).agg(F.sum("total")).first()[0] == n
    assert S.date_bucket_counts(mail, AS_OF).agg(F.sum("n")).first()[0] == n
    tabs = dict(S.category_counts(mail, AS_OF).collect())
    assert tabs.pop("ALL") == sum(tabs.values())
    per_label = S.label_counts(mail).agg(F.sum("n")).first()[0]
    split = mail.select(F.explode(F.split("labels", ",")).alias("x")).filter("trim(x) <> ''")
    assert per_label == split.count()


def test_empty_tables_still_report(mail):
    none = mail.limit(0)
    assert S.volume_by_day(none, AS_OF).count() == 14
    assert S.volume_by_day(mail, AS_OF, days=30).count() == 30
    assert rows(S.volume_scaled(S.volume_by_day(none, AS_OF)).select(
        F.sum("received_pct"))) == [(0,)]
    assert [tuple(r)[1:] for r in S.folder_counts(none).collect()] == [(0, 0)] * 7
    assert S.view_counts(none, AS_OF).agg(F.sum("n")).first()[0] == 0
    assert {r["id"] for r in S.top_item_per_view(none, AS_OF).collect()} == {None}
    bundle = reports.daily_briefing(none, AS_OF)
    assert bundle["headline"].first()["headline"].startswith("You're all caught up")


def test_updates(mail, spark):
    nothing = spark.createDataFrame([], "id string, is_read boolean, folder string")
    assert rows(M.bulk_update(mail, nothing)) == rows(mail)
    some = mail.select("id", F.lit(0).alias("seq"), F.lit(True).alias("is_read"),
                       F.lit("NOWHERE").alias("folder"))
    changed = M.bulk_update(mail, some)
    assert changed.filter("NOT is_read").count() == 0
    assert rows(changed.select("id", "folder")) == rows(mail.select("id", "folder"))


def test_later_update_wins_and_rows_stay_single(spark, mail):
    one = mail.select("id").first()["id"]
    t = dt.datetime(2024, 5, 1)
    changes = spark.createDataFrame(
        [(one, 1, True, "TRASH", t, False), (one, 2, None, "ARCHIVE", None, False),
         (one, 3, False, None, None, True)],
        "id string, seq int, is_read boolean, folder string, snoozed_until timestamp_ntz, "
        "clear_snooze boolean")
    out = M.bulk_update(mail, changes).filter(F.col("id") == one).collect()
    assert [(r["is_read"], r["folder"], r["snoozed_until"]) for r in out] == [
        (False, "ARCHIVE", None)]
    kept = M.bulk_update(mail, changes.filter("seq = 1")).filter(F.col("id") == one).first()
    assert kept["snoozed_until"] == t


def test_delivery_is_idempotent(mail):
    once = M.deliver_due(mail, AS_OF)
    assert rows(M.deliver_due(once, AS_OF)) == rows(once)
    assert rows(once) != rows(mail)


def test_undo_restores_nulls(mail):
    before = M.undo_snapshot(mail, mail, "snoozed_until")
    cleared = mail.withColumn("snoozed_until", F.lit(AS_OF).cast("timestamp_ntz"))
    assert rows(M.undo_bulk(cleared, before, "snoozed_until").select("id", "snoozed_until")
                ) == rows(mail.select("id", "snoozed_until"))


def test_one_thread_in_one_minute_spreads_over_tasks(spark, mail):
    """Positions and transcripts when all mail is one thread of one moment."""
    one = mail.withColumns({"thread_id": F.lit("t"), "date": F.lit(AS_OF).cast("timestamp_ntz")})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in T.placed(one).groupBy("part").count().collect()]
        got = rows(T.thread_position(one).select("id", "position", "is_last"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    n = mail.count()
    assert len(sizes) == 8 and max(sizes) < 2 * n / 8
    ids = sorted(r.id for r in mail.select("id").collect())
    assert got == sorted(((x, i + 1, i + 1 == n) for i, x in enumerate(ids)), key=repr)
    parts = T.transcript_parts(one.limit(250), messages=100).orderBy("part").collect()
    assert [(p.part, p.n_messages) for p in parts] == [(0, 100), (1, 100), (2, 50)]
    whole = T.thread_transcript(one.limit(250)).first()["transcript"]
    assert "\n\n".join(p.transcript for p in parts) == whole


def test_hot_thread_positions(hot_mail):
    out = T.thread_position(hot_mail).filter("thread_id = 'hot'")
    n = hot_mail.filter("thread_id = 'hot'").count()
    got = [r["position"] for r in out.orderBy("position").collect()]
    assert got == list(range(1, n + 1)) and out.filter("is_last").count() == 1
    in_order = hot_mail.filter("thread_id = 'hot'").orderBy("date", "id").select("id").collect()
    assert [r["id"] for r in out.orderBy("position").collect()] == [r["id"] for r in in_order]


def test_hot_thread_rollups(hot_mail):
    n = hot_mail.filter("thread_id = 'hot'").count()
    sizes = T.thread_participants(hot_mail).filter("thread_id = 'hot'")
    assert sizes.agg(F.sum("message_count")).first()[0] == n
    assert T.thread_transcript(hot_mail, messages=30).filter("thread_id = 'hot'").first()["n_messages"] == 30
    status = T.thread_status(hot_mail).filter("thread_id = 'hot'").first()["status"]
    assert status.startswith(f"Thread of {n} messages between ")


def test_hot_message_votes(spark):
    many = spark.range(3000).select(
        F.lit("m").alias("email_id"), F.concat(F.lit("x"), F.col("id").cast("string"))
        .alias("model"), F.col("id").alias("ordinal"),
        F.concat(F.lit('{"intent": "'), F.when(F.col("id") % 3 == 0, "ORDER").otherwise("FYI"),
                 F.lit('", "reason": "r'), F.col("id").cast("string"), F.lit('"}')
                 ).alias("content"))
    assert tuple(votes.majority_vote(many).first()) == ("m", "FYI", 2000, 2 / 3, "r1")


def test_vote_tie_goes_to_the_first(spark):
    said = spark.createDataFrame(
        [("m", "a", 0, '{"intent": "ORDER", "confidence": 0.4, "summary": "s0"}'),
         ("m", "b", 1, '{"intent": "FYI", "confidence": 0.4, "summary": "s1"}'),
         ("m", "c", 2, "broken"), ("n", "a", 0, None), ("n", "b", 1, '{"score": 101}'),
         ("n", "c", 2, '{"score": 84.5}'), ("n", "d", 3, '{"score": 1}')],
        "email_id string, model string, ordinal long, content string")
    assert tuple(votes.majority_vote(said).first())[1:4] == ("ORDER", 1, 0.5)
    assert votes.best_reply(said).first()["summary"] == "s0"
    assert rows(votes.first_reply(said).select("email_id", "model")) == [
        ("m", "a"), ("n", "b")]
    assert [(r.score, r.level) for r in votes.first_valid_score(said).collect()] == [
        (85, "high")]


def test_replies_are_cut_once_and_read_in_part(spark):
    """A reply is cut at its outer braces without being turned round, and only the fields
    that an operator uses are read from the JSON."""
    texts = ["", None, "{", "}", "{}", "}{", "a{b}c", "}a{b}c{", "é{ü}ß", "{a}}x", "{{a}", "a}b", "x}{}y{", " {x} "]
    odd = spark.createDataFrame([(t,) for t in texts], "t string")
    got = odd.select("t", outer_object(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [None if t is None else t[t.find("{"):t.rfind("}") + 1]
                                  if "{" in t and "}" in t[t.find("{"):] else "" for t in (r.t for r in got)]
    said = spark.createDataFrame([("m", "a", 0, '{"score": "none", "summary": "s", "reasoning": 7}')],
                                 "email_id string, model string, ordinal long, content string")
    best = votes.best_reply(said)
    assert best.first()["summary"] == "s"
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert "reverse(" not in plan and "StructField(reasoning" not in plan and "StructField(score" not in plan


def test_handled_mail_keeps_its_commitments(spark, mail):
    """The query returns the commitments of every message, whatever its folder: those of the
    best reply if it has some, else those of the rules."""
    done = QUERIES["X27_merge_handled"](spark, DATA)
    assert done.count() == mail.count()
    in_mail = "folder IN ('INBOX', 'SENT', 'ARCHIVE')"
    got = {r.id: [(x["source"], x["who"], x["due"]) for x in json.loads(r.commitments)] for r in done.collect()}
    want = rows(QUERIES["X27_handled_commitments"](spark, DATA))
    own = {r.id for r in mail.filter(in_mail).select("id").collect()}
    assert rows_of(got, own) == want and rows_of(got, set(got) - own)
    first, second, third = mail.filter("body LIKE '%I will send the offer%'").orderBy("id").limit(3).collect()
    told = '{"intent": "FYI", "confidence": 0.9, "summary": "s", "commitments": %s}'
    said = spark.createDataFrame(
        [(first.id, "a", 0, told % '[{"who": "Bo", "action": "a", "due": null, "source": "q"}]'),
         (second.id, "a", 0, told % "[]"), (third.id, "a", 0, told % "null")],
        "email_id string, model string, ordinal long, content string")
    handled = {r.id: [x.who for x in r.commitments] for r in votes.merge_handled(mail, said, self_email=SELF).collect()}
    assert handled[first.id] == ["Bo"]
    assert handled[second.id] == [w for _, w, _ in got[second.id]] and len(handled[second.id]) == 2
    assert handled[third.id] == [w for _, w, _ in got[third.id]] and len(handled[third.id]) == 2


def rows_of(found, ids):
    return sorted(((i, *x) for i in ids for x in found[i]), key=repr)


def test_odd_saved_searches(spark, mail):
    odd = spark.createDataFrame(
        [(1, "subject", "invoice"), (1, "subject", "track"), (1, "text", "77"),
         (1, "text", "invoice"), (2, "is", "read"), (2, "is", "unread"), (3, "is", "odd"),
         (4, "in", "nowhere"), (4, "is", "starred"), (5, "in", "sent"), (5, "in", "inbox"),
         (6, "text", ""), (7, "subject", None), (8, "subject", "é"), (9, "from", "R1"),
         (10, "text", "Fish & CHIPS \u2014"), (11, "is", "starred"), (11, "subject", None)],
        "query_id int, field string, value string").withColumn(
            "term_no", F.when(F.col("value") == "inbox", 1).otherwise(0))
    got = rows(SS.match_saved_searches(odd, mail))
    want = {1: "lower(subject) LIKE '%invoice%' AND lower(subject) LIKE '%track%' AND body LIKE '%77%'",
            4: "is_starred", 5: "folder = 'INBOX'", 6: "true", 8: "lower(subject) LIKE '%é%'",
            9: "lower(from_name) LIKE '%r1%' OR lower(from_email) LIKE '%r1%'"}
    assert got == sorted(((q, r.id) for q, rule in want.items() for r in mail.filter(rule).collect()), key=repr)
    assert SS.match_saved_searches(odd.limit(0), mail).count() == 0


def test_any_number_of_searches_is_one_plan_with_few_pairs(spark, mail):
    """Text searches meet the messages that have their rarest piece, and one plan does
    for 25 and 10,000 of them."""
    words = ["invoice and tr", "board meets", "pale sky", "hot> for two", "no such words"]
    searches = lambda n: spark.range(n).select(
        F.col("id").alias("query_id"), F.lit("text").alias("field"),
        F.concat(F.element_at(F.array(*map(F.lit, words)), (F.col("id") % 5 + 1).cast("int")),
                 F.when(F.col("id") >= 25, F.concat(F.lit(" q"), F.col("id"))).otherwise("")).alias("value"))
    shape = lambda df: re.sub(r"[#\d]+|file:\S+", "", plan_of(df))
    few, many = (SS.match_saved_searches(searches(n), mail) for n in (25, 10_000))
    assert shape(few) == shape(many)
    for word in ("NestedLoop", "Cartesian", "Python"):
        assert word not in plan_of(few)
    low = F.lower(F.concat_ws("\n", *SS.LOWERED))
    want = sorted((i, r.id) for i in range(25) for r in mail.filter(low.contains(words[i % 5])).collect())
    want.sort(key=repr)
    assert rows(few) == rows(many) == want and want
    lowered = mail.select(*[F.lower(c).alias(c) if c in SS.LOWERED else c for c in mail.columns])
    index = SS.filed(searches(10_000), lowered)
    met = SS._keyed(lowered, F.array().cast("array<int>"), "id").distinct().join(index, "key").count()
    assert met <= 10 * len(want) and met * 1_000 < 10_000 * mail.count()


def test_saved_search_equals_single_search(spark, mail):
    terms = [("is", "unread"), ("from", "USER1"), ("text", "the")]
    stored = spark.createDataFrame([(9, f, v) for f, v in terms],
                                   "query_id int, field string, value string")
    anywhere = mail.withColumn("folder", F.lit("ARCHIVE"))
    single = V.search(anywhere, terms, AS_OF, folder="ARCHIVE").select(F.lit(9), "id")
    assert rows(SS.match_saved_searches(stored, anywhere)) == rows(single)


def test_a_change_reads_and_writes_only_slices_that_it_touches(spark, mail, folder):
    first = versions.create(mail, folder, shares=8)
    assert rows(first.read()) == rows(mail)
    before = {r["name"]: r.n for r in first.slices().collect()}
    assert sum(before.values()) == mail.count() and len(before) > 20
    ids = mail.filter("folder = 'INBOX'").select("id").limit(3).union(spark.createDataFrame([("none",)], "id string"))
    updates = spark.createDataFrame([(r.id,) for r in ids.collect()], "id string").withColumns(
        {"folder": F.lit("ARCHIVE"), "is_starred": F.lit(True)})
    seen = []
    second = first.change(updates, lambda part: (seen.extend(part.inputFiles()), M.bulk_update(part, updates))[1])
    touched = first.holding(updates)
    assert 1 <= len(touched) <= 3
    assert seen and all(any(n in f for n in touched) for f in seen)
    after = {r["name"] for r in second.slices().collect()}
    assert set(before) - after == set(touched) and sum(r.n for r in second.slices().collect()) == mail.count()
    assert rows(second.read()) == rows(M.bulk_update(mail, updates))
    assert rows(first.read()) == rows(mail)          # the old version stays
    moved = second.read(["id"], folders=["ARCHIVE"])
    assert rows(moved) == rows(M.bulk_update(mail, updates).filter("folder = 'ARCHIVE'").select("id"))
    third = second.change(updates, lambda part: part.join(updates, "id", "left_anti"))
    assert rows(third.read()) == rows(mail.join(updates, "id", "left_anti").select(*mail.columns))
    same = third.change(updates, lambda part: part)
    assert same.number == 4 and rows(same.slices()) == rows(third.slices())
    assert rows(same.added(mail.filter("id = 'none'")).read(["id"])) == rows(third.read(["id"]))
    some = first.read(["id", "date"], since="2024-01-20 00:00:00")
    assert rows(some.filter("date >= '2024-01-20'")) == rows(mail.filter("date >= '2024-01-20'").select("id", "date"))


def test_reports_by_mailbox_equal_single_reports(spark, mail):
    from letterloom.operators import mailboxes as B

    owners = spark.createDataFrame([("one", SELF), ("two", "USER3@no-reply.example"), ("none", "x@x")],
                                   "mailbox string, self_email string")
    boxed = mail.withColumn("mailbox", F.when(F.pmod(F.hash("id"), F.lit(3)) == 0, "two").otherwise("one"))
    for name, own in (("one", SELF), ("two", "user3@no-reply.example"), ("none", "x@x")):
        part = boxed.filter(F.col("mailbox") == name).drop("mailbox")
        only = lambda df: rows(df.filter(F.col("mailbox") == name).drop("mailbox"))  # noqa: B023,E731
        assert only(B.totals(boxed, owners)) == rows(S.totals(part, self_email=own))
        assert only(B.volume_by_day(boxed, owners, AS_OF)) == rows(S.volume_by_day(part, AS_OF, self_email=own))
        assert only(B.folder_counts(boxed, owners)) == rows(S.folder_counts(part))
        assert only(B.view_counts(boxed, owners, AS_OF)) == rows(S.view_counts(part, AS_OF, self_email=own))
        assert only(B.contacts(boxed, owners)) == rows(P.contacts(part, self_email=own))
        assert only(B.conversations(boxed, owners)) == rows(T.conversations(part, self_email=own))
        assert only(B.top_correspondents(boxed, owners).drop("place")) == rows(
            S.top_correspondents(part, self_email=own))
    plan = plan_of(B.top_correspondents(boxed, owners))
    assert "WindowGroupLimit" in plan.split("Exchange hashpartitioning(mailbox", 1)[1]


def test_suggestions_by_brute_force(spark, mail):
    people = P.contacts(mail, self_email=SELF)
    typed = ["", "an", "x@y, 1", "STEIN 2", "nobody-here", "@bank.example", "É", "émi", "ser1", "ruiz"]
    asked = spark.createDataFrame([(t,) for t in typed], "text string")
    got = P.suggest_contacts(people, asked)
    # Contacts are read for the sizes and for the matches, tokens for both and at the end.
    scans = lambda df: plan_of(df).count("FileScan")
    assert scans(got) <= 4 and scans(P.suggest_contacts(people, asked.limit(2))) == scans(got)
    everyone = [(r.name, r.email) for r in people.collect()]
    want = []
    for t in typed:
        token = ([p for p in t.lower().replace(",", " ").split()] or [""])[-1]
        hits = sorted(p for p in everyone if token in p[0].lower() or token in p[1].lower())
        want += [(t, token, i + 1, p[1], p[0]) for i, p in enumerate(hits[:6])]
    assert rows(got) == sorted(want, key=repr)


def test_paging_meets_itself(mail):
    listed = [tuple(r) for r in V.newest(mail, 100).select("date", "id").collect()]
    first = [tuple(r) for r in V.page(mail, 60).select("date", "id").collect()]
    rest = [tuple(r) for r in V.page_after(mail, F.lit(first[-1][0]), first[-1][1], 40)
            .select("date", "id").collect()]
    assert first + rest == listed
    assert V.api_page(mail, 9999).count() == 200 and V.api_page(mail, -5, -5).count() == 1
    assert V.page(mail, 9999).count() == min(9999, mail.count())


def test_reports(spark, mail):
    bundle = reports.analytics(mail, AS_OF, self_email=SELF, keep=True)
    assert bundle["totals"].first()["sent"] == mail.filter(
        F.col("folder").isin("INBOX", "SENT", "ARCHIVE") & (F.col("from_email") == SELF)).count()
    bundle["mail"].unpersist()
    center = reports.command_center(mail, AS_OF)
    assert center["views"].count() == 8 and center["folders"].count() == 7
    page = reports.list_page(mail, AS_OF, folder="ARCHIVE", limit=5)
    assert page["page"].count() == 5 and "body" not in page["page"].columns
    assert reports.conversation_list(mail)["conversations"].count() == 20


# --- Storage ------------------------------------------------------------------------

def test_rebuild_and_mirror(spark, mail, folder):
    rebuilt = rebuild_snapshot(mail.withColumn("intent", F.lit("")), f"{folder}/v1")
    assert rebuilt.count() == mail.count() and rebuilt.filter("intent = ''").count() == 0
    assert rows(rebuilt.drop("intent")) == rows(mail.select(*rebuilt.columns).drop("intent"))
    counts = mirror(mail, f"{folder}/a", f"{folder}/b").collect()
    assert {r["n"] for r in counts} == {mail.count()}
    with pytest.raises(Exception):
        write_version(mail, f"{folder}/a")  # a version is never overwritten


def test_text_layout(spark, mail, folder):
    flags = ["is_read", "is_starred", "is_important", "has_attachment"]
    times = ["date", "snoozed_until", "scheduled_for", "created_at", "updated_at"]
    stored = mail.select(*[
        F.col(c).cast("int").alias(c) if c in flags else
        F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(c) if c in times else F.col(c)
        for c in mail.columns])
    stored.write.json(f"{folder}/json")
    loaded = load_text_layout(spark, f"{folder}/json")
    assert rows(loaded.select(*sorted(mail.columns))) == rows(mail.select(*sorted(mail.columns)))


def test_inbound_files(spark, folder):
    posts = [
        '{"fromName": " Ana ", "fromEmail": "a@x", "body": "Hi\\nhttp://x.y", "date": '
        '"2024-01-02T03:04:05+02:00"}',
        '{"fromName": "", "fromEmail": "a@x"}',
        '{"fromName": "Bo", "fromEmail": "b@x", "date": "soon"}']
    spark.createDataFrame([(p,) for p in posts], "value string").write.text(f"{folder}/in")
    raw = inbound.read_inbound(spark, f"{folder}/in")
    good = inbound.ingest_inbound(raw, AS_OF, self_email=SELF).collect()
    assert [(r.from_name, r.subject, r.date, r.to_emails, r.is_read, r.folder) for r in good] == [
        ("Ana", "(no subject)", dt.datetime(2024, 1, 2, 1, 4, 5), SELF, False, "INBOX")]
    assert good[0].body.startswith("Hi<br/><a href=") and good[0].snippet == "Hi http://x.y"
    assert inbound.rejected_inbound(raw).count() == 2


def test_raw_message_files(spark, folder):
    import os
    os.makedirs(f"{folder}/raw")
    texts = {"a": "From: Ana Ruiz <ana@x>\r\nSubject: Plans\r\n\r\nLine one\r\nLine two\r\n\r\nEnd",
             "b": "X: y\r\nFrom: <bo@x>\r\n\r\n<b>hi</b>"}
    for name, value in texts.items():
        with open(f"{folder}/raw/{name}.eml", "w", newline="") as out:
            out.write(value)
    raw = inbound.read_raw_messages(spark, f"{folder}/raw")
    got = {(r.fromName, r.fromEmail, r.subject, r.body)
           for r in inbound.parse_raw_messages(raw).collect()}
    assert got == {
        ("Ana Ruiz", "ana@x", "Plans", "<p>Line one<br/>Line two<br/><br/>End</p>"),
        ("Unknown", "bo@x", "(no subject)", "<b>hi</b>")}
    assert inbound.ingest_raw_messages(raw, AS_OF).count() == 2


def test_storage_reads_what_is_needed(spark, mail, folder):
    write_version(mail, f"{folder}/v")
    stored = load_mail(spark, f"{folder}/v")
    plan = S.totals(stored)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [folder" in plan and "body" not in plan.split("ReadSchema")[1]
    late = V.mail_view(stored, AS_OF, starred=True).select("id")
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(is_starred,true)" in plan and "body" not in plan.split("ReadSchema")[1]


def test_hints_spare_the_body(spark, mail, folder):
    stored = rebuild_snapshot(mail, f"{folder}/h", hints=True)
    for report in (lambda df: S.view_summary(df, AS_OF, self_email=SELF),
                   lambda df: V.mail_view(df, AS_OF, view="waiting").select("id"),
                   lambda df: reports.command_center(df, AS_OF)["views"]):
        plan = report(stored)._jdf.queryExecution().executedPlan().toString()
        assert "body" not in plan.split("ReadSchema")[1]
        assert rows(report(stored)) == rows(report(stored.drop("has_question")))


def test_undo_with_a_repeated_id_keeps_the_rows(spark, mail):
    from letterloom.operators import mutate as M

    ids = mail.select("id").limit(3)
    twice = M.undo_snapshot(mail, ids.union(ids), "folder")
    twice = twice.union(twice.withColumn("previous", F.lit("ZZZ")))
    assert M.undo_bulk(mail, twice, "folder").count() == mail.count()
    assert rows(M.undo_bulk(mail, twice, "folder").select("id", "folder")) == rows(
        mail.select("id", "folder"))


def test_changes_without_an_order_can_be_repeated(spark, mail):
    from letterloom.operators import mutate as M

    some = mail.select("id").limit(2)
    changes = some.withColumn("folder", F.lit("TRASH")).union(some.withColumn("folder", F.lit("INBOX")))
    for given in (changes, changes.orderBy("folder"), changes.orderBy(F.desc("folder"))):
        got = M.bulk_update(mail, given.withColumn("clear_snooze", F.lit(False))).join(some, "id")
        assert {r.folder for r in got.select("folder").collect()} == {"TRASH"}


def test_phrases_take_any_mail_space(spark):
    from letterloom.functions.intent import classify_intent

    mails = spark.createDataFrame(
        [(i, f"please{space}call back") for i, space in enumerate([" ", " ", " ", "\t"])],
        "id int, body string").selectExpr(
        "id", "body", "'' AS subject", "'x@y.example' AS from_email", "'x' AS from_name")
    got = classify_intent(mails, self_email=SELF, snippet=None, labels=None).select("signal.intent").distinct()
    assert [r[0] for r in got.collect()] == ["REQUIRES_REPLY"]


def test_score_gives_its_reasoning(spark):
    said = spark.createDataFrame(
        [("n", "a", 0, '{"score": 70, "reasoning": "because", "reason": "other"}')],
        "email_id string, model string, ordinal long, content string")
    assert votes.first_valid_score(said).first()["reasoning"] == "because"


def test_transcripts_and_suggestions_are_whole(spark, mail):
    from letterloom.operators import people as P

    long = mail.limit(1).select(*[F.lit("word " * 3000).alias(c) if c == "body" else c
                                  for c in mail.columns])
    assert len(T.thread_transcript(long).first()["transcript"]) > 14_000
    name = "n" * 500
    people = spark.createDataFrame([("a@b.example", name)], "email string, name string")
    typed = spark.createDataFrame([(name,)], "text string")
    assert P.suggest_contacts(people, typed).count() == 1


def test_refined_intents_are_stored(spark, mail):
    replies = mail.select(
        F.col("id").alias("email_id"), F.lit("a").alias("model"), F.lit(0).cast("long").alias("ordinal"),
        F.lit('{"intent": "ORDER", "confidence": 1.0}').alias("content"))
    refined = votes.refine_intent(mail, replies, self_email=SELF)
    stored = votes.persist_intents(mail, refined)
    assert stored.columns == mail.columns
    assert rows(stored.select("id", "intent")) == rows(refined.select("id", "intent"))


def test_postings_are_never_broadcast_whole(spark):
    """Few contacts in the file, very many postings: no join may send these to the driver,
    whose size Spark takes for that of the contacts."""
    from letterloom.operators import people as P

    people = spark.range(300).select(
        F.concat(F.lit("user"), F.col("id"), F.lit("@acme.example")).alias("email"),
        F.repeat(F.concat(F.lit("Ana Ruiz "), F.col("id"), F.lit(" ")), F.lit(20)).alias("name"))
    typed = spark.range(3000).select(F.concat(F.lit("x, r"), F.col("id")).alias("text"))
    got = P.suggest_contacts(people, typed)
    got.write.format("noop").mode("overwrite").save()
    assert "Generate" not in plan_of(got)
    asked = [(str(i), f"r{i}") for i in range(3000)]
    everyone = [(r.name, r.email) for r in people.collect()]
    want = sum(min(6, sum(t in n.lower() or t in e for n, e in everyone)) for _, t in asked)
    assert got.count() == want
