"""Headline queries over a stored mail table; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and
BENCH_RUNS (default 3, median reported after one warm-up) steer it.
"""

from __future__ import annotations

import dataclasses
import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import fixtures as fx  # noqa: E402
from checks.registry import Tables  # noqa: E402
from letterloom import build_session  # noqa: E402
from letterloom.functions.intent import classify_intent  # noqa: E402
from letterloom.operators import briefing as B  # noqa: E402
from letterloom.operators import commitments as C  # noqa: E402
from letterloom.operators import mutate as M  # noqa: E402
from letterloom.operators import people as P  # noqa: E402
from letterloom.operators import stats as S  # noqa: E402
from letterloom.operators import threads as T  # noqa: E402
from letterloom.operators import views as V  # noqa: E402
from letterloom.operators import votes  # noqa: E402
from letterloom.operators.saved_searches import match_saved_searches  # noqa: E402
from letterloom.sources import versions  # noqa: E402
from letterloom.sources.tables import load_mail, with_hints, write_version  # noqa: E402
from letterloom.streaming.jobs import stream_inbound  # noqa: E402
from letterloom.streaming.sinks import append_to, job_dir  # noqa: E402

AS_OF, SELF = fx.AS_OF, fx.SELF


def headline(t: Tables, mail, replies) -> dict:
    """Name -> function that returns the query's DataFrame."""
    from pyspark.sql import functions as F

    docs = t.documents.repartition(16).select(
        "doc_id", F.lit("").alias("subject"), F.col("text").alias("body"),
        F.lit("x@acme.example").alias("from_email"), F.col("source").alias("from_name"))
    return {
        "A1_totals": lambda: S.totals(mail, self_email=SELF),
        "A2_top_correspondents": lambda: S.top_correspondents(mail, self_email=SELF),
        "J2_volume_by_day": lambda: S.volume_by_day(mail, AS_OF, self_email=SELF),
        "A6_folder_counts": lambda: S.folder_counts(mail),
        "A7_W1_view_summary": lambda: S.view_summary(mail, AS_OF, self_email=SELF),
        "A8_label_counts": lambda: S.label_counts(mail),
        "A9_conversations": lambda: T.conversations(mail, self_email=SELF),
        "A13_contacts": lambda: P.contacts(mail, self_email=SELF),
        "A14_majority_vote": lambda: votes.majority_vote(replies),
        "A22_thread_transcript": lambda: T.thread_transcript(mail, 1200, 6000, 30),
        "J1_overdue_commitments": lambda: C.overdue_commitments(mail, AS_OF, self_email=SELF),
        "J6_bulk_update": lambda: M.bulk_update(mail, t.updates),
        "J16_100_saved_searches": lambda: match_saved_searches(t.saved_searches, mail),
        "J16_10000_saved_searches": lambda: match_saved_searches(many_searches(t), mail),
        "J6_change_of_10_ids": lambda: versions_of(mail).change(
            t.updates.limit(10), lambda part: M.bulk_update(part, t.updates.limit(10))).slices(),
        "O1_newest": lambda: V.newest(mail),
        "W8_thread_position": lambda: T.thread_position(mail),
        "X1_classify_mail": lambda: classify_intent(mail, self_email=SELF),
        "X1_classify_documents": lambda: classify_intent(
            docs, self_email=SELF, snippet=None, labels=None),
        "W7_briefing_sections": lambda: B.briefing_sections(mail, AS_OF, self_email=SELF),
        "A16_briefing_counts": lambda: B.briefing_counts(mail, self_email=SELF),
        "X4_commitments": lambda: C.commitments(mail, self_email=SELF),
    }


def many_searches(t: Tables):
    """The saved searches a hundred times; copies ask for longer words."""
    from pyspark.sql import functions as F

    word = F.col("field").isin("text", "subject", "from", "to") & (F.col("copy") > 0)
    return t.saved_searches.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(99)))).select(
        (F.col("query_id") + 1000 * F.col("copy")).alias("query_id"), "field",
        F.when(word, F.concat("value", "copy")).otherwise(F.col("value")).alias("value"), "term_no")


VERSIONS = {}


def versions_of(mail):
    """The stored mail table cut into slices, made once."""
    if not VERSIONS:
        VERSIONS["first"] = versions.create(mail, job_dir(mail.sparkSession, "versions"), hints=True)
    first = VERSIONS["first"]
    VERSIONS["n"] = VERSIONS.get("n", 1) + 1
    return dataclasses.replace(first, number=VERSIONS["n"] - 1)


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench", spark__master=f"local[{cpus}]", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("OFF")
    t = Tables(spark, sf_dir)
    folder = job_dir(spark, "bench")
    # Spread before writing, so that the stored table has enough files for all cores.
    spread = with_hints(t.mail.repartition(4 * int(cpus)))
    write_version(spread, f"{folder}/mail", sort_by_date=False)
    mail = load_mail(spark, f"{folder}/mail", hints=True)
    t.model_replies.repartition(4 * int(cpus)).write.parquet(f"{folder}/replies")
    replies = spark.read.parquet(f"{folder}/replies")

    results = {}
    for name, query in headline(t, mail, replies).items():
        sink = lambda: query().write.format("noop").mode("overwrite").save()  # noqa: B023,E731
        timed(sink)
        results[name] = round(statistics.median(timed(sink) for _ in range(runs)), 4)

    from pyspark.sql import functions as F
    posts = fx.stream_of(fx.event_stream(spark, sf_dir), "inbound").withColumn(
        "arrived", F.lit(AS_OF).cast("timestamp"))
    stream = timed(lambda: append_to(stream_inbound(posts, self_email=SELF),
                                     f"{folder}/inbound").awaitTermination())
    results["T1_stream_inbound"] = round(stream, 4)
    n_mail = mail.count()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(results.values()), 4),
        "unit": "sec", "queries": results, "sf": sf_dir.rsplit("sf", 1)[-1],
        "mail_rows": n_mail, "stream_rows_per_sec": round(t.events.count() / stream),
        "cpus": int(cpus), "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
