"""Streams over several micro-batches: repeats, late rows, restarts, limits."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from checks import fixtures as fx
from letterloom.streaming import jobs as J
from letterloom.streaming import stateful as ST
from letterloom.schema import INBOUND
from letterloom.sources import versions
from letterloom.streaming import changelog as CL
from letterloom.streaming.sinks import (append_to, changes_to, fold_back, latest_changes,
                                        rows_of)

T0 = dt.datetime(2024, 1, 1, 12)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


class Feed:
    """A folder of files; each ``add`` is a later micro-batch."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, folder, schema, 0

    def add(self, *rows):
        self.n += 1
        df = self.spark.createDataFrame(list(rows), self.schema).coalesce(1)
        df.write.parquet(f"{self.folder}/part={self.n:03d}")
        return self

    def stream(self):
        return (self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1)
                .load(f"{self.folder}/*").select(*[c.split()[0] for c in self.schema.split(", ")]))


def finish(query):
    query.awaitTermination()


def test_repeated_posts_are_taken_once_across_restarts(spark, folder):
    schema = "id string, fromName string, fromEmail string, toEmails string, ccEmails string, " \
             "bccEmails string, subject string, body string, date string, labels string, " \
             "attachmentName string, threadId string, hasAttachment boolean, " \
             "isImportant boolean, arrived timestamp"
    post = lambda i, t, name="Ana": (i, name, "a@x", *[None] * 11, at(t))
    feed = Feed(spark, f"{folder}/in", schema)
    feed.add(post("1", 0), post("1", 1), post("2", 2), post("3", 3, " "))
    finish(append_to(J.stream_inbound(feed.stream()), f"{folder}/out"))
    feed.add(post("2", 60), post("4", 61))
    finish(append_to(J.stream_inbound(feed.stream()), f"{folder}/out"))
    got = rows_of(spark, f"{folder}/out").orderBy("id").collect()
    assert [(r.id, r.date, r.intent) for r in got] == [
        ("1", got[0].date, "FYI"), ("2", at(2), "FYI"), ("4", at(61), "FYI")]
    assert got[0].date in (at(0), at(1))


def test_undo_window_limits(spark, folder):
    sends = Feed(spark, f"{folder}/s", "id string, ts timestamp")
    cancels = Feed(spark, f"{folder}/c", "id string, ts timestamp")
    sends.add(("a", at(0)), ("b", at(0)), ("c", at(0)), ("d", at(0)))
    cancels.add(("a", at(4.9)), ("b", at(5.1)), ("c", at(5)), ("z", at(1)))
    sends.add(("late", at(3600)))
    cancels.add(("none", at(3600)))
    out = f"{folder}/out"
    finish(append_to(J.undo_window(sends.stream(), cancels.stream()), out))
    assert sorted(r.id for r in rows_of(spark, out).collect()) == ["b", "c", "d"]


def test_first_view_and_expiry(spark, folder):
    links = spark.createDataFrame(
        [("l1", "t1", None, None), ("l2", "t2", at(50), None), ("l3", "t3", None, at(-9))],
        "id string, token string, expires_at timestamp_ntz, viewed_at timestamp_ntz")
    feed = Feed(spark, f"{folder}/v", "token string, ts timestamp")
    feed.add(("t1", at(20)), ("t2", at(51)), ("t3", at(1)), ("t9", at(1)))
    feed.add(("t1", at(10)), ("t1", at(30)))
    out = f"{folder}/out"
    finish(changes_to(J.first_views(feed.stream(), links), out))
    got = latest_changes(spark, out, ["token"]).orderBy("token").collect()
    assert [(r.token, r.viewed_at) for r in got] == [("t1", at(10)), ("t3", at(-9))]


def test_delivery_over_batches(spark, folder):
    mail = fx.table(spark, "/root/testdata/sf0.001", "mail")
    feed = Feed(spark, f"{folder}/t", "ts timestamp")
    feed.add((dt.datetime(2024, 1, 10),)).add((dt.datetime(2024, 1, 30, 12),))
    out = f"{folder}/out"
    finish(changes_to(feed.stream(), out, change=J.deliver_due_batch(mail)))
    done = latest_changes(spark, out, ["id"])
    due = mail.filter("folder = 'SCHEDULED' AND scheduled_for <= timestamp_ntz'2024-01-30 12:00:00'")
    assert done.count() == due.count() > 0


def test_late_days_are_closed(spark, folder):
    schema = "folder string, from_email string, date timestamp_ntz"
    feed = Feed(spark, f"{folder}/m", schema)
    day = lambda n: T0 + dt.timedelta(days=n)
    feed.add(("INBOX", "a@x", day(0)), ("SENT", "me@example.com", day(0)),
             ("SPAM", "a@x", day(0)))
    feed.add(("INBOX", "a@x", day(10)))
    feed.add(("INBOX", "a@x", day(10)))  # from here on the watermark is known
    feed.add(("INBOX", "a@x", day(0)), ("INBOX", "a@x", day(10)))
    out = f"{folder}/out"
    finish(changes_to(J.stream_volume(feed.stream()), out))
    got = latest_changes(spark, out, ["day"]).orderBy("day").collect()
    assert [(r.day.day, r.received, r.sent) for r in got] == [(1, 1, 1), (11, 3, 0)]


def test_running_counts_over_batches(spark, folder):
    feed = Feed(spark, f"{folder}/m", "folder string, is_read boolean, labels string")
    feed.add(("INBOX", True, "a, b"), ("INBOX", False, "a,a"))
    feed.add(("SENT", True, ""), ("INBOX", False, "b"))
    finish(changes_to(J.stream_folder_counts(feed.stream()), f"{folder}/f"))
    finish(changes_to(J.stream_label_counts(feed.stream()), f"{folder}/l"))
    folders = latest_changes(spark, f"{folder}/f", ["folder"])
    assert {tuple(r) for r in folders.collect()} == {("INBOX", 3, 2), ("SENT", 1, 0)}
    labels = latest_changes(spark, f"{folder}/l", ["label"])
    assert {tuple(r) for r in labels.collect()} == {("a", 3), ("b", 2)}


def test_presence_over_batches(spark, folder):
    """Rows come late and out of order over two batches; the result is that of time order."""
    feed = Feed(spark, f"{folder}/p",
                "conn_id string, username string, type string, ts timestamp, seq long")
    feed.add(("c", "ana", "message", at(2), 3), ("c", "ana", "message", at(0), 0),
             ("d", "bo", "leave", at(1), 2), ("c", "", "leave", at(4), 5), ("z", "", "message", at(30), 90))
    feed.add(("c", "ana", "join", at(1), 1), ("c", "bo", "message", at(3), 4),
             ("c", "ana", "message", at(5), 6), ("z", "", "message", at(200), 91))
    out = f"{folder}/out"
    finish(append_to(ST.presence(feed.stream()), out))
    got = rows_of(spark, out).orderBy("seq").collect()
    assert [(r.seq, r.kind, r.username) for r in got] == [
        (1, "user-joined", "ana"), (3, "message", "ana"), (5, "user-left", "ana")]


def test_silent_connections_are_forgotten(spark, folder):
    feed = Feed(spark, f"{folder}/p",
                "conn_id string, username string, type string, ts timestamp, seq long")
    feed.add(("a", "ana", "join", at(0), 1), ("b", "bo", "join", at(0), 2), ("a", "ana", "message", at(50), 3))
    feed.add(("b", "bo", "message", at(101), 4), ("a", "ana", "message", at(150), 5))
    feed.add(("a", "ana", "leave", at(200), 6), ("z", "", "message", at(1_000), 7))
    feed.add(("z", "", "message", at(2_000), 8))
    out = f"{folder}/out"
    finish(append_to(ST.presence(feed.stream(), ttl_seconds=100), out))
    got = rows_of(spark, out).orderBy("seq").collect()
    # b is silent for 101 seconds, a never for more than 100.
    assert [(r.seq, r.kind) for r in got] == [
        (1, "user-joined"), (2, "user-joined"), (3, "message"), (5, "message"), (6, "user-left")]
    kept_ = {v: spark.read.format("statestore").option("path", f"{out}/state")
             .option("stateVarName", v).load().count() for v in ("known", "waiting")}
    assert kept_ == {"known": 0, "waiting": 1}   # only the newest row of z


def test_snooze_timer(spark, folder):
    feed = Feed(spark, f"{folder}/z",
                "id string, ts timestamp, snoozed_until timestamp_ntz")
    feed.add(("a", at(0), at(100)), ("b", at(0), at(5000)), ("c", at(0), at(100)))
    feed.add(("c", at(1), None), ("a", at(2), at(200)))
    feed.add(("x", at(1000), None))
    out = f"{folder}/out"
    finish(append_to(ST.snooze_timer(feed.stream()), out))
    assert [(r.id, r.snoozed_until) for r in rows_of(spark, out).collect()] == [("a", at(200))]


@pytest.fixture(autouse=True)
def quiet(spark):
    spark.sparkContext.setLogLevel("OFF")
    assert spark.range(1).agg(F.count("*")).first()[0] == 1


def test_declared_posts_without_ids(spark, folder):
    """Posts as declared have no id: equal ones are one, refused ones are kept apart."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in INBOUND) + ", arrived timestamp"
    names = [f.name for f in INBOUND] + ["arrived"]
    post = lambda t, **given: tuple({**dict.fromkeys(names), "arrived": at(t), **given}[n]
                                    for n in names)
    ana = {"fromName": "Ana", "fromEmail": "a@x", "subject": "one"}
    feed = Feed(spark, f"{folder}/in", schema)
    feed.add(post(0, **ana), post(1, **ana), post(2, **{**ana, "subject": "two"}))
    feed.add(post(5, **ana), post(6, fromName=" "), post(7, **ana, date="no time"))
    out = f"{folder}/out"
    finish(J.inbound_to(feed.stream(), out))
    feed.add(post(9, **ana), post(10, **{**ana, "subject": "three"}))
    finish(J.inbound_to(feed.stream(), out))
    got = rows_of(spark, out).orderBy("subject").collect()
    assert [r.subject for r in got] == ["one", "three", "two"] and len({r.id for r in got}) == 3
    refused = spark.read.parquet(f"{out}/rejected").select("reason").collect()
    assert sorted(r.reason for r in refused) == ["date is not a time",
                                                "fromName and fromEmail are required"]


def test_mail_scheduled_after_the_start_is_delivered_once(spark, folder):
    mail = fx.table(spark, "/root/testdata/sf0.001", "mail")
    one = mail.filter("folder = 'INBOX'").limit(1).select(
        *[F.lit("late").alias(c) if c == "id" else F.lit("SCHEDULED").alias(c) if c == "folder"
          else F.lit(at(0)).cast("timestamp_ntz").alias(c) if c == "scheduled_for" else c
          for c in mail.columns])
    feed = Feed(spark, f"{folder}/t", "ts timestamp")
    out, current = f"{folder}/out", f"{folder}/mail"
    mail.write.parquet(f"{current}/1")
    versions = [f"{current}/1"]
    job = J.deliver_due_batch(lambda: spark.read.parquet(versions[-1]))
    feed.add((at(-86400 * 300),))
    finish(changes_to(feed.stream(), out, change=job))
    one.union(mail).write.parquet(f"{current}/2")
    versions.append(f"{current}/2")
    feed.add((at(10),))
    finish(changes_to(feed.stream(), out, change=job))
    done = latest_changes(spark, out, ["id"])
    assert done.filter("id = 'late'").count() == 1
    next_ = fold_back(spark.read.parquet(versions[-1]), done)
    assert next_.columns == mail.columns and next_.count() == mail.count() + 1
    row = next_.filter("id = 'late'").first()
    assert (row.folder, row.scheduled_for) == ("SENT", None)
    next_.write.parquet(f"{current}/3")
    versions.append(f"{current}/3")
    feed.add((at(20),))
    finish(changes_to(feed.stream(), f"{folder}/again", change=job))
    assert latest_changes(spark, f"{folder}/again", ["id"]).filter("id = 'late'").count() == 0


def test_views_of_links_made_after_the_start(spark, folder):
    schema = "id string, token string, expires_at timestamp_ntz, viewed_at timestamp_ntz"
    links = [spark.createDataFrame([("l1", "t1", None, None)], schema)]
    job = J.first_views_batch(lambda: links[-1])
    feed = Feed(spark, f"{folder}/v", "token string, ts timestamp")
    feed.add(("t1", at(20)), ("t2", at(21)))
    out = f"{folder}/out"
    finish(changes_to(feed.stream(), out, change=job))
    links.append(spark.createDataFrame([("l1", "t1", None, None), ("l2", "t2", None, None)], schema))
    feed.add(("t1", at(10)), ("t2", at(30)))
    finish(changes_to(feed.stream(), out, change=job))
    got = latest_changes(spark, out, ["token"], smallest="viewed_at").orderBy("token").collect()
    assert [(r.token, r.viewed_at) for r in got] == [("t1", at(10)), ("t2", at(30))]


def test_view_counts_follow_the_clock(spark, folder):
    from letterloom.operators import stats as S

    mail = fx.table(spark, "/root/testdata/sf0.001", "mail")
    feed = Feed(spark, f"{folder}/t", "ts timestamp")
    feed.add((dt.datetime(2024, 1, 10),)).add((dt.datetime(2024, 1, 30, 12),))
    out = f"{folder}/out"
    finish(changes_to(feed.stream(), out, change=J.view_counts_batch(lambda: mail)))
    got = {(r.view, r.n) for r in latest_changes(spark, out, ["view"]).collect()}
    want = S.view_counts(mail, "2024-01-30 12:00:00").collect()
    assert got == {(r.view, r.n) for r in want}
    early = {(r.view, r.n) for r in S.view_counts(mail, "2024-01-10 00:00:00").collect()}
    first = rows_of(spark, out).filter("epoch = 0").collect()
    assert {(r.view, r.n) for r in first} == early


def test_a_log_merges_its_batches_and_forgets_them(spark, folder):
    feed = Feed(spark, f"{folder}/v", "token string, ts timestamp")
    for k in range(7):
        feed.add((f"t{k}", at(k)), ("all", at(100 - k if k < 4 else 200 + k)))
    for name, smallest, wanted in (("newest", None, 206), ("first", "at", 97)):
        log = CL.ChangeLog(spark, f"{folder}/{name}", ["token"], smallest=smallest, every=2)
        assert log.read() is None
        change = lambda batch: batch.select("token", F.col("ts").cast("timestamp_ntz").alias("at"))
        finish(log.start(feed.stream(), change))
        got = {r.token: r.at for r in log.read().collect()}
        assert got == {"all": at(wanted), **{f"t{k}": at(k) for k in range(7)}}
        # Of seven batches the last generation and the one before it are left.
        assert CL._numbers(spark, f"{log.folder}/rows", "generation=") == [2, 3]
        assert CL._numbers(spark, f"{log.folder}/merged", "") == [1, 2]
        log._merge(2)  # a repeated batch merges again from what was kept
        assert {r.token: r.at for r in log.read().collect()} == got


def test_folded_changes_rewrite_only_their_slices(spark, folder):
    mail = fx.table(spark, "/root/testdata/sf0.001", "mail")
    first = versions.create(mail, f"{folder}/mail")
    one = mail.filter("folder = 'SCHEDULED'").limit(1).select("id").first().id
    done = spark.createDataFrame([(one, "SENT", None)], "id string, folder string, scheduled_for timestamp_ntz")
    second = CL.fold_into(first, done)
    kept_, new = ({r["name"] for r in v.slices().collect()} for v in (first, second))
    assert len(kept_ - new) == 1
    changed = second.read(["id", "folder", "scheduled_for"]).filter(F.col("id") == one).first()
    assert (changed.folder, changed.scheduled_for) == ("SENT", None)
    assert second.read(["id"]).count() == mail.count()


def test_view_counts_by_deltas_equal_a_recount(spark, folder):
    from letterloom.operators import stats as S

    mail = fx.table(spark, "/root/testdata/sf0.001", "mail")
    ticks = [dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 15, 6), dt.datetime(2024, 1, 15, 7),
             dt.datetime(2024, 2, 28)]
    feed = Feed(spark, f"{folder}/t", "ts timestamp")
    for tick in ticks:
        feed.add((tick,))
    deltas = J.view_deltas(mail, ticks[0])
    moments = deltas.groupBy("view", "at").count()
    assert deltas.count() == moments.count()           # one row per view and moment
    log = CL.ChangeLog(spark, f"{folder}/out", ["view"])
    finish(log.start(feed.stream(), J.view_counts_by_deltas(deltas, log.read)))
    got = {(r.as_of, r.view, r.n) for r in rows_of(spark, log.folder).collect()}
    assert got == {(tick, r.view, r.n) for tick in ticks for r in S.view_counts(mail, tick).collect()}


def test_keys_share_state_buckets(spark, folder):
    """Many messages and connections in one bucket: every one has its own snooze and name,
    and Python is called for buckets, not for each of them."""
    feed = Feed(spark, f"{folder}/z", "id string, ts timestamp, snoozed_until timestamp_ntz")
    feed.add(*[(f"m{i}", at(i % 7), at(100 + i) if i % 3 else None) for i in range(60)], (None, at(0), at(90)))
    feed.add(*[(f"m{i}", at(8), None if i % 2 else at(110)) for i in range(0, 60, 5)],
             ("m1", at(0), at(50)))          # older than what is known of m1
    feed.add(("x", at(210), None))
    out = f"{folder}/snoozed"
    finish(append_to(ST.snooze_timer(feed.stream(), buckets=2), out))
    want = {f"m{i}": at(100 + i) for i in range(60) if i % 3} | {None: at(90)}
    for i in range(0, 60, 5):
        want.pop(f"m{i}", None)
        want |= {} if i % 2 else {f"m{i}": at(110)}
    want = {k: v for k, v in want.items() if v <= at(150)}
    got = rows_of(spark, out).collect()
    assert len(got) == len(want) and {r.id: r.snoozed_until for r in got} == want
    keys = (spark.read.format("statestore").option("path", f"{out}/state")
            .option("stateVarName", "pending").load().select("key").distinct().count())
    assert keys <= 2

    feed = Feed(spark, f"{folder}/p", "conn_id string, username string, type string, ts timestamp, seq long")
    feed.add(*[(f"c{i}", f"u{i}", "join", at(1), 2 * i) for i in range(40)], (None, "n", "join", at(1), 500))
    feed.add(*[(f"c{i}", f"u{i + i % 2}", "message", at(2), 2 * i + 1) for i in range(40)],
             (None, "n", "message", at(3), 501), ("z", "", "message", at(200), 900))
    out = f"{folder}/present"
    finish(append_to(ST.presence(feed.stream(), buckets=2), out))
    got = {(r.conn_id, r.kind) for r in rows_of(spark, out).collect()}
    assert got == {(f"c{i}", "user-joined") for i in range(40)} | {
        (f"c{i}", "message") for i in range(0, 40, 2)} | {(None, "user-joined"), (None, "message")}
    keys = (spark.read.format("statestore").option("path", f"{out}/state")
            .option("stateVarName", "known").load().select("key").distinct().count())
    assert keys <= 2


def test_state_is_kept_in_stretches(spark, folder):
    """Rows go to the state store and back as stretches of a table, not one by one."""
    elements = lambda out, v: (spark.read.format("statestore").option("path", f"{out}/state")
                               .option("stateVarName", v).load().count())
    feed = Feed(spark, f"{folder}/p", "conn_id string, username string, type string, ts timestamp, seq long")
    feed.add(*[(f"c{i}", f"u{i}", "join", at(i / 100), i) for i in range(500)], ("z", "", "message", at(200), 900))
    feed.add(*[(f"c{i}", None, "leave", at(200 + i / 100), 1000 + i) for i in range(500)])
    out = f"{folder}/present"
    finish(append_to(ST.presence(feed.stream(), buckets=2), out))
    assert elements(out, "waiting") <= 6 and elements(out, "known") <= 2
    feed.add(("z", "", "message", at(400), 2000))
    finish(append_to(ST.presence(feed.stream(), buckets=2), out))
    got = {(r.seq, r.kind, r.username) for r in rows_of(spark, out).collect()}
    assert got == {(i, "user-joined", f"u{i}") for i in range(500)} | {
        (1000 + i, "user-left", f"u{i}") for i in range(500)}

    feed = Feed(spark, f"{folder}/z", "id string, ts timestamp, snoozed_until timestamp_ntz")
    feed.add(*[(f"m{i}", at(0), at(300)) for i in range(500)])
    out = f"{folder}/snoozes"
    finish(append_to(ST.snooze_timer(feed.stream(), buckets=2), out))
    assert elements(out, "pending") <= 2


def test_files_of_many_raw_messages(spark, folder):
    """The same rows whether messages have files of their own or share one."""
    raw = ["From: Ana <ana@x>\r\nSubject: One\r\n\r\nline\nand\r\nline\n", "Subject: none\r\n\r\nrefused",
           "From: Bo <bo@x>\r\n\r\n\n\n", "From: Ana <ana@x>\r\nSubject: One\r\n\r\nline\nand\r\nline\n"]
    import os
    for name, files in (("own", raw), ("shared", ["".join(m + "\0" for m in raw)])):
        os.makedirs(f"{folder}/{name}")
        for k, content in enumerate(files):
            with open(f"{folder}/{name}/{k}", "w", newline="") as out:
                out.write(content)
        finish(J.raw_messages_to(spark, f"{folder}/{name}", f"{folder}/out-{name}",
                                 separator=None if name == "own" else "\0"))
    read = lambda name, part, *c: sorted(tuple(r) for r in spark.read.parquet(
        f"{folder}/out-{name}/{part}").select("id", *c).collect())
    for part, columns in (("rows", ("from_email", "subject", "body")), ("rejected", ("reason",))):
        assert read("own", part, *columns) == read("shared", part, *columns)
    assert len(read("shared", "rows")) == 2 and len(read("shared", "rejected")) == 1
