"""Rule-based priority."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Points of the priority score and the lower bound of each level.
BASE_POINTS = 30
IMPORTANT_POINTS = 25
ATTACHMENT_POINTS = 10
INTENT_POINTS = {
    "REQUIRES_REPLY": 30, "COMMITMENT": 20, "MEETING": 20, "SECURITY_ALERT": 40,
    "INVOICE": 5, "RECEIPT": 5, "NEWSLETTER": -15, "PROMOTION": -15,
}
LEVELS = [(86, "urgent"), (61, "high"), (31, "medium"), (0, "low")]


def priority_score(intent: Column, is_important: Column, has_attachment: Column) -> Column:
    by_intent = F.lit(0)
    for points in sorted(set(INTENT_POINTS.values())):
        names = [name for name, p in INTENT_POINTS.items() if p == points]
        by_intent = F.when(intent.isin(names), points).otherwise(by_intent)
    raw = (F.lit(BASE_POINTS)
           + F.when(is_important, IMPORTANT_POINTS).otherwise(0)
           + F.when(has_attachment, ATTACHMENT_POINTS).otherwise(0)
           + by_intent)
    return F.least(F.lit(100), F.greatest(F.lit(0), raw))


def priority_level(score: Column) -> Column:
    level = F.lit(LEVELS[-1][1])
    for bound, name in reversed(LEVELS[:-1]):
        level = F.when(score >= bound, name).otherwise(level)
    return level
