"""Comma lists kept in a string: labels and recipients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.functions.text import csv_to_array


def unnest(df: DataFrame, array: Column | str, into: str, *keep) -> DataFrame:
    """One row per (non-null) element, with the ``keep`` columns.

    For a plain ``explode`` Spark adds a "not empty" filter below it, which computes
    the array a second time; the outer form has no such filter.
    """
    return (df.select(*keep, F.explode_outer(array).alias(into))
            .filter(F.col(into).isNotNull()))


def has_label(labels: Column, label: str, exact: bool = False) -> Column:
    """Substring match as the list views do it, or membership with ``exact``."""
    if exact:
        return F.array_contains(csv_to_array(labels), label)
    return labels.contains(label)


def label_mentions(labels: Column, word: str) -> Column:
    """Case-insensitive substring test used by the rules."""
    return F.lower(F.coalesce(labels, F.lit(""))).contains(word.lower())


def add_label(labels: Column, label: str) -> Column:
    """Append ``label`` unless present; order kept, repeats dropped."""
    return F.array_join(
        F.array_distinct(F.concat(csv_to_array(labels), F.array(F.lit(label)))), ",")


def remove_label(labels: Column, label: str) -> Column:
    return F.array_join(F.filter(csv_to_array(labels), lambda x: x != label), ",")


def distinct_addresses(addresses: Column) -> Column:
    """First spelling of each address, compared without case."""
    keys = F.transform(addresses, F.lower)
    return F.filter(
        addresses, lambda a, i: F.array_position(keys, F.lower(a)) == i + F.lit(1))


def reply_all_recipients(from_email: Column, to_emails: Column, self_email: str) -> Column:
    """Sender plus the To list, without the mailbox owner."""
    everyone = F.concat(F.array(from_email), csv_to_array(to_emails))
    others = F.filter(everyone, lambda a: (a != "") & (F.lower(a) != self_email.lower()))
    return F.array_join(distinct_addresses(others), ", ")
