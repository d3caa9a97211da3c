"""Subjects of replies and forwards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _prefixed(subject: Column, prefix: str) -> Column:
    present = F.lower(subject).startswith(prefix.lower())
    return F.when(present, subject).otherwise(F.concat(F.lit(prefix + " "), subject))


def reply_subject(subject: Column) -> Column:
    return _prefixed(subject, "Re:")


def forward_subject(subject: Column) -> Column:
    return _prefixed(subject, "Fwd:")
