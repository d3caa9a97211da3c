"""Intent and category rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.functions import lexicon as lx
from letterloom.functions.lists import label_mentions

# Outcome of each rule as (intent, confidence, reason), strongest first.
OUTCOMES = {
    "security": ("SECURITY_ALERT", 0.85, "security keywords detected"),
    "newsletter": ("NEWSLETTER", 0.8, "newsletter markers"),
    "promotion": ("PROMOTION", 0.75, "promotion markers"),
    "social": ("SOCIAL", 0.7, "social sender"),
    "invoice": ("INVOICE", 0.8, "invoice keywords"),
    "receipt": ("RECEIPT", 0.75, "receipt keywords"),
    "shipment": ("SHIPMENT", 0.75, "shipment keywords"),
    "order": ("ORDER", 0.7, "order keywords"),
    "meeting": ("MEETING", 0.7, "scheduling intent"),
    "commitment": ("COMMITMENT", 0.65, "commitment language detected"),
    "question": ("REQUIRES_REPLY", 0.6, "question directed at user"),
    "personal": ("PERSONAL", 0.55, "personal label"),
    "work": ("BUSINESS", 0.5, "work label"),
    "none": ("FYI", 0.4, "no strong signal"),
}

# Display names of the intents.
INTENT_NAMES = {
    "REQUIRES_REPLY": "Needs reply", "FYI": "FYI", "INVOICE": "Invoice",
    "RECEIPT": "Receipt", "ORDER": "Order", "SHIPMENT": "Shipment",
    "COMMITMENT": "Commitment", "MEETING": "Meeting", "NEWSLETTER": "Newsletter",
    "PROMOTION": "Promotion", "NOTIFICATION": "Notification",
    "SECURITY_ALERT": "Security", "SOCIAL": "Social", "PERSONAL": "Personal",
    "BUSINESS": "Business",
}


def joined(*parts: Column) -> Column:
    """Lower-cased parts with single spaces between, NULL read as empty."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))


def _outcome(rule: str) -> Column:
    intent, confidence, reason = OUTCOMES[rule]
    return F.struct(F.lit(intent).alias("intent"), F.lit(confidence).alias("confidence"),
                    F.lit(reason).alias("reason"))


def says(text: Column, *patterns: str) -> Column:
    """Does lower-cased ``text`` contain one of the phrases as whole words?

    A regex costs several times a substring test, and most texts contain none of a
    rule's phrases: the regex runs only where a text that every match needs occurs.
    """
    phrases = "|".join(patterns)
    match = text.rlike(lx.whole_words(phrases))
    hints = [text.contains(t) for t in lx.required_texts(phrases)]
    return reduce(lambda a, b: a | b, hints) & match if hints else match


def intent_rules(text: Column, sender: Column, labels: Column, own: Column) -> Column:
    """The rule chain over prepared inputs: ``text`` and ``sender`` lower-cased,
    ``own`` true when the mailbox owner wrote the message."""
    labelled = lambda word: label_mentions(labels, word)
    rules = [
        ("security", says(text, lx.SECURITY)),
        ("newsletter", labelled("newsletter") | says(text, lx.NEWSLETTER)),
        ("promotion", sender.rlike(lx.PROMO_ANYWHERE) | says(text, lx.PROMOTION)),
        ("social", labelled("social") | sender.rlike(lx.SOCIAL_ANYWHERE)),
        ("invoice", labelled("finance") | says(text, lx.INVOICE)),
        ("receipt", says(text, lx.RECEIPT)),
        ("shipment", says(text, lx.SHIPMENT)),
        ("order", says(text, lx.ORDER)),
        ("meeting", says(text, lx.MEETING)),
        ("commitment", says(text, lx.COMMITMENT, lx.INCOMING_COMMITMENT)),
        ("question", ~own & says(text, lx.QUESTION)),
        ("personal", labelled("personal")),
        ("work", labelled("work")),
    ]
    chain = F
    for rule, condition in rules:
        chain = chain.when(condition, _outcome(rule))
    return chain.otherwise(_outcome("none"))


def classify_intent(df: DataFrame, *, self_email: str, subject: str = "subject",
                    snippet: str | None = "snippet", body: str = "body",
                    from_email: str = "from_email", from_name: str | None = "from_name",
                    labels: str | None = "labels", into: str = "signal") -> DataFrame:
    """Add ``into`` = struct(intent, confidence, reason).

    The lower-cased text is built in its own projection: the rules name it many
    times, which keeps Catalyst from inlining it into each of them.
    """
    part = lambda name: F.col(name) if name else F.lit("")
    prepared = df.withColumns({
        "_text": joined(part(subject), part(snippet), part(body)),
        "_sender": joined(part(from_email), part(from_name)),
    })
    own = F.lower(F.coalesce(part(from_email), F.lit(""))) == self_email.lower()
    signal = intent_rules(F.col("_text"), F.col("_sender"), part(labels), own)
    return prepared.withColumn(into, signal).drop("_text", "_sender")


def derive_category(labels: Column, from_email: Column, from_name: Column,
                    subject: Column, snippet: Column) -> Column:
    """Inbox tab: labels first, then sender, then subject and preview."""
    sender, text = joined(from_email, from_name), joined(subject, snippet)
    hit = lambda pattern: sender.rlike(pattern) | text.rlike(pattern)
    return (F.when(label_mentions(labels, "newsletter"), "PROMOTIONS")
            .when(label_mentions(labels, "social"), "SOCIAL")
            .when(label_mentions(labels, "finance"), "UPDATES")
            .when(hit(lx.PROMO_ANYWHERE), "PROMOTIONS")
            .when(hit(lx.SOCIAL_ANYWHERE), "SOCIAL")
            .when(hit(lx.UPDATES_ANYWHERE), "UPDATES")
            .otherwise("PRIMARY"))


def with_category(df: DataFrame, into: str = "category") -> DataFrame:
    cols = [F.col(c) for c in ("labels", "from_email", "from_name", "subject", "snippet")]
    return df.withColumn(into, derive_category(*cols))


def intent_label(intent: Column) -> Column:
    """Display name; unknown intents keep their code."""
    names = F.create_map(*[F.lit(x) for pair in INTENT_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, intent), intent)


def is_purchase_like(subject: Column, snippet: Column, body: Column,
                     labels: Column) -> Column:
    text = joined(subject, snippet, body)
    return (label_mentions(labels, "finance")
            | says(text, lx.INVOICE, lx.RECEIPT, lx.ORDER, lx.SHIPMENT))


def is_subscription_like(subject: Column, snippet: Column, from_email: Column,
                         from_name: Column, labels: Column) -> Column:
    text, sender = joined(subject, snippet), joined(from_email, from_name)
    return (label_mentions(labels, "newsletter")
            | sender.rlike(lx.PROMO_ANYWHERE)
            | says(text, lx.NEWSLETTER, lx.PROMOTION))
