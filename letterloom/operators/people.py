"""Contacts and recipient suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from letterloom.functions import lexicon as lx
from letterloom.functions.lists import reply_all_recipients, unnest
from letterloom.functions.text import (csv_to_array, display_name_from_address, stretch_at,
                                       stretch_places)
from letterloom.operators.views import by_name
from letterloom.schema import DEFAULT_SELF
from letterloom.session import kept


def address_union(df: DataFrame, *keep: str) -> DataFrame:
    """Every address occurrence: sender, To and Cc entries, with when it was seen.

    ``source`` orders occurrences inside one message: sender, then To, then Cc.
    """
    def entry(source: int, email, name=None):
        return F.struct(F.lit(source).alias("source"), email.alias("email"),
                        F.lit(None).cast("string").alias("name") if name is None
                        else name.alias("name"))

    def listed_in(source: int, column: str):
        return F.transform(csv_to_array(F.col(column)), lambda e: entry(source, e))

    listed = [listed_in(1, "to_emails"), listed_in(2, "cc_emails")]
    sender = F.array(entry(0, F.col("from_email"), F.col("from_name")))
    found = unnest(df, F.concat(sender, *[F.coalesce(x, F.array().cast(
        "array<struct<source:int,email:string,name:string>>")) for x in listed]),
        "a", *keep, "date", "id")
    return found.select(*keep, "date", "id", "a.*").filter(F.col("email") != "")


def contacts(df: DataFrame, *, self_email: str = DEFAULT_SELF) -> DataFrame:
    """Distinct addresses by name.  The first occurrence decides the name: the
    sender's own, or one made of the address."""
    seen = address_union(df).filter(F.lower("email") != self_email.lower())
    return by_name(named_addresses(seen), "email")


def named_addresses(seen: DataFrame, *keep: str) -> DataFrame:
    """One row per address (and ``keep``) with the name of its first occurrence."""
    first = F.min_by("name", F.struct("date", "id", "source")).alias("name")
    return seen.groupBy(*keep, "email").agg(first).select(
        *keep, "email", F.coalesce("name", display_name_from_address(F.col("email"))).alias("name"))


def last_token(typed):
    """What is being typed: the text after the last comma or space."""
    parts = F.filter(F.split(F.lower(typed), lx.SPACE_OR_COMMA + "+"), lambda p: p != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))


def _stretches(text, *lengths: int):
    """Distinct stretches of ``text`` with the given numbers of letters (1 to 3)."""
    places = F.concat(*[stretch_places(text, n) for n in lengths])
    return F.array_distinct(F.transform(places, lambda at: stretch_at(text, at)))


def _postings(people: DataFrame, *keep: str) -> DataFrame:
    """One row per contact and ``key``: its stretches of one to three letters, and the
    empty one. Their number does not depend on what is typed."""
    keys = F.array_distinct(F.concat(F.array(F.lit("")), *[_stretches(F.col(c), 1, 2, 3) for c in ("e", "n")]))
    return unnest(people, keys, "key", *keep)


def suggest_contacts(people: DataFrame, typed: DataFrame, k: int = 6) -> DataFrame:
    """The first ``k`` contacts (by name) whose address or name contains each token.

    ``typed`` has ``text``.  A "contains" join would compare every token with every
    contact; here contacts are posted under their short stretches of letters. A token of up
    to three letters is such a stretch; a longer one is looked up under the rarest of its
    own and then compared. The limit runs on both sides of the shuffle. The contacts are
    computed once.
    """
    order = ["name", "email"]
    stored = kept(people.select(*order, F.lower("email").alias("e"), F.lower("name").alias("n")), "contacts")
    tokens = kept(typed.select("text", last_token(F.col("text")).alias("token")), "typed")
    long = F.char_length("token") > 3
    keys = F.when(long, _stretches(F.col("token"), 3)).otherwise(F.array("token"))
    # Spark takes what is unnested for as small as its source and would broadcast it, so
    # these are written first: joins then go by true sizes. A semi-join sends its right side only.
    wanted = kept(unnest(tokens.select("token").distinct(), keys, "key", "token"), "wanted")
    sizes = _postings(stored).join(wanted.select("key").distinct(), "key", "left_semi").groupBy(
        "key").agg(F.count("*").alias("size"))
    filed = kept(wanted.join(sizes, "key", "left").groupBy("token").agg(
        F.min(F.struct(F.coalesce("size", F.lit(0)), "key"))["key"].alias("key")), "filed")
    posted = kept(_postings(stored, *order, "e", "n").join(
        filed.select("key").distinct(), "key", "left_semi"), "posted")
    found = posted.join(filed, "key").filter(F.contains("e", "token") | F.contains("n", "token"))
    top = Window.partitionBy("token").orderBy(*order)
    best = found.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k)
    return tokens.join(best, "token").select("text", "token", "rank", "email", "name")


def reply_all_to(df: DataFrame, *, self_email: str = DEFAULT_SELF) -> DataFrame:
    return df.select("id", reply_all_recipients(
        F.col("from_email"), F.col("to_emails"), self_email).alias("to_emails"))
