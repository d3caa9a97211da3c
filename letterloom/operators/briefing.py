"""The daily briefing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from letterloom.functions.dates import age_days
from letterloom.functions.lists import label_mentions, unnest
from letterloom.operators import views as V
from letterloom.operators.commitments import detect_commitments
from letterloom.schema import DEFAULT_SELF

# Sections of the briefing in order, and their lengths.
SECTIONS = {"needs_reply": 6, "waiting": 4, "commitments": 5, "receipts": 4}
ACTION_CHARS = 120

# Fixed value: the headline of an empty briefing.
CAUGHT_UP = "You're all caught up — nothing needs your attention right now."


def _items(df: DataFrame, self_email: str, age: Column) -> DataFrame:
    """Correspondence with the array ``items``: what each message adds to the sections."""
    mail = detect_commitments(df.filter(V.in_correspondence()), self_email=self_email)
    own = V.is_own(self_email)
    question = F.col("has_question") if "has_question" in df.columns else None
    rules = {
        "needs_reply": (~own & (F.col("intent") == "REQUIRES_REPLY")
                        & V.in_folders("INBOX", "ARCHIVE")),
        "waiting": own & (F.col("folder") == "SENT") & V.awaits_answer(question),
        "receipts": F.col("intent").isin(V.PURCHASE_INTENTS) | (
            F.lower("body").contains("invoice") & label_mentions(F.col("labels"), "finance")),
    }

    def item(section, pos, title, who, detail, age_days):
        return F.struct(F.lit(section).alias("section"), pos.cast("int").alias("pos"),
                        title.alias("title"), who.alias("who"), detail.alias("detail"),
                        age_days.cast("bigint").alias("age_days"))

    none = F.lit(None)
    single = [F.when(rule, item(
        name, F.lit(0), F.col("subject"),
        F.col("to_emails" if name == "waiting" else "from_name"), F.col("snippet"),
        age if name == "waiting" else none)) for name, rule in rules.items()]
    promised = F.transform("signals", lambda s: item(
        "commitments", s["pos"], F.left(s["action"], F.lit(ACTION_CHARS)),
        F.when(s["direction"] == "outgoing", "You").otherwise(F.col("from_name")),
        s["due_date"], none))
    kept = F.array_compact(F.array(*single))
    return mail.withColumn("items", F.when(F.col("signals").isNull(), kept)
                           .otherwise(F.concat(kept, promised)))


def briefing_sections(df: DataFrame, as_of, *, self_email: str = DEFAULT_SELF) -> DataFrame:
    """Rows (section, rank, title, who, detail, age_days), newest first.

    One scan: every message yields its items, and each section is a top-k over them whose
    limit also runs before the shuffle.  Only the length of a section is limited.
    """
    items = unnest(_items(df, self_email, age_days(F.col("date"), as_of)), "items", "i",
                   "date", "id").select("date", "id", "i.*")
    newest = Window.partitionBy("section").orderBy(F.desc("date"), "id", "pos")
    limits = F.create_map(*[F.lit(x) for pair in SECTIONS.items() for x in pair])
    return (items.withColumn("rank", F.row_number().over(newest))
            .filter(F.col("rank") <= max(SECTIONS.values()))
            .filter(F.col("rank") <= F.element_at(limits, F.col("section")))
            .select("section", "rank", "title", "who", "detail", "age_days"))


def briefing_counts(df: DataFrame, *, self_email: str = DEFAULT_SELF) -> DataFrame:
    """One row: all commitments, and of the other sections as many as they show."""
    def size_of(section: str) -> Column:
        return F.size(F.filter("items", lambda i: i["section"] == section)).alias(section)

    sizes = _items(df, self_email, F.lit(None)).select(*[size_of(s) for s in SECTIONS])
    total = {s: F.coalesce(F.sum(s), F.lit(0)) for s in SECTIONS}
    return sizes.agg(*[(total[s] if s == "commitments" else F.least(F.lit(n), total[s]))
                       .cast("bigint").alias(s) for s, n in SECTIONS.items()])


def _plural(n, singular: str):
    return F.concat(n.cast("string"), F.lit(" " + singular), F.when(n == 1, "").otherwise("s"))


def briefing_headline(sections: DataFrame) -> DataFrame:
    """One row: the headline and the suggested first action."""
    lead = (F.col("section") == "needs_reply") & (F.col("rank") == 1)
    row = sections.agg(
        *[F.count_if(F.col("section") == s).alias(s) for s in SECTIONS],
        F.max(F.when(lead, F.struct("who", "title"))).alias("lead"))
    count = sum((F.col(s) for s in SECTIONS), F.lit(0))
    some = F.concat(
        _plural(count, "item"), F.lit(" need a look: "),
        F.col("needs_reply").cast("string"), F.lit(" to reply, "),
        F.col("waiting").cast("string"), F.lit(" waiting, "),
        _plural(F.col("commitments"), "commitment"), F.lit(", "),
        _plural(F.col("receipts"), "receipt"), F.lit("."))
    return row.select(
        F.when(count == 0, CAUGHT_UP).otherwise(some).alias("headline"),
        F.concat(F.lit("Reply to "), F.col("lead.who"), F.lit(' — "'),
                 F.col("lead.title"), F.lit('".')).alias("first_action"))
