"""Many stored searches against the whole mail table (J16): an index of the searches.

Instead of asking every message about every search, a message is asked which keys it
has: its flags, its folder and the three-letter pieces of its words. Every search is filed
under one key that all its matches have, the rarest of its own, so a message meets only
searches whose key it has, by equality.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.functions.lists import unnest
from letterloom.functions.text import stretch_at, stretch_places
from letterloom.operators.views import FREE_TEXT_COLUMNS
from letterloom.schema import FOLDERS
from letterloom.session import kept

GRAM = 3          # letters of a piece; shorter words are their own piece
LONG = 64         # letters of a word; longer ones are cut into stretches that overlap
SLOTS = 1 << 18   # bits of the sieve: 32 KB whatever the number of searches
SAMPLE = 64       # one message in so many is asked how frequent the keys are

TEXT_FIELDS = {"from": ["from_email", "from_name"], "to": ["to_emails"],
               "subject": ["subject"], "label": ["labels"], "text": FREE_TEXT_COLUMNS}
LOWERED = sorted({c for columns in TEXT_FIELDS.values() for c in columns})
# Flags of a message and the keys they give. Keys that are no piece of text begin with a
# mark, which is white space where it stands in texts.
MARK = "\x01"
FLAGS = {"read": ("is_read", True), "unread": ("is_read", False), "starred": ("is_starred", True),
         "important": ("is_important", True), "attachment": ("has_attachment", True)}
ALWAYS = f"{MARK}any"   # the key of a search for an empty word


def _spaced(text: Column) -> Column:
    return F.replace(text, F.lit(MARK), F.lit(" "))


def _words(marks: list[Column], text: Column) -> Column:
    """The marks and the different words of a text, long ones in stretches that share every
    piece."""
    cut = F.regexp_replace(text, rf"(\S{{{LONG - GRAM + 1}}})(?=(\S{{{GRAM - 1}}}))", "$1$2 ")
    short = F.when(text.rlike(rf"(^|\s)\S{{{LONG}}}"), cut).otherwise(text)
    return F.array_distinct(F.split(F.concat_ws(" ", *marks, short), r"\s+"))


def compiled(searches: DataFrame) -> DataFrame:
    """One row per search: wanted flags and folder, and its words by field. Terms that
    say nothing are left out; a search of only such terms has no row. Of several folders
    the last counts, by ``term_no`` (without that column by name)."""
    bare = F.lower("field") == "hasattachment"
    order = F.col("term_no") if "term_no" in searches.columns else F.lit(0)
    terms = searches.select(
        "query_id", order.alias("term_no"), F.when(bare, "has").otherwise(F.lower("field")).alias("field"),
        F.when(bare, "attachment").otherwise(F.lower("value")).alias("value")).distinct()
    says = (F.when(F.col("field") == "is",
                   F.col("value").isin("unread", "read", "starred", "important"))
            .when(F.col("field") == "has", F.col("value") == "attachment")
            .when(F.col("field") == "in", F.upper("value").isin(FOLDERS))
            .otherwise(F.col("field").isin(list(TEXT_FIELDS))))
    wants = lambda f, v: F.max((F.col("field") == f) & (F.col("value") == v)).alias(v)
    grouped = terms.filter(says).groupBy("query_id").agg(
        *[wants("has" if flag == "attachment" else "is", flag) for flag in FLAGS],
        F.max(F.when(F.col("field") == "in", F.struct("term_no", F.upper("value").alias("f"))))
        ["f"].alias("folder"),
        F.collect_set(F.when(F.col("field").isin(list(TEXT_FIELDS)),
                             F.struct("field", "value"))).alias("words"))
    # A message is read or not: a contradiction matches nothing.
    return grouped.filter(~(F.coalesce("read", F.lit(False)) & F.coalesce("unread", F.lit(False))))


def _keys_of_search() -> Column:
    """Keys that every match of a search has. Pieces are taken from the words of a phrase,
    shorter ones only where no word of it has three letters."""
    def pieces(word):
        return F.transform(stretch_places(word, GRAM), lambda at: stretch_at(word, at))

    def of_phrase(w):
        parts = F.filter(F.split(_spaced(w["value"]), r"\s+"), lambda x: x != "")
        long = F.filter(parts, lambda x: F.length(x) >= GRAM)
        return F.when(F.size(parts) == 0, F.array(F.lit(ALWAYS))).when(
            F.size(long) == 0, parts).otherwise(F.flatten(F.transform(long, pieces)))

    flags = [F.when(F.col(flag), F.lit(f"{MARK}{flag}")) for flag in FLAGS]
    named = F.filter("words", lambda w: w["value"].isNotNull())
    return F.array_distinct(F.array_compact(F.concat(
        F.array(*flags, F.concat(F.lit(f"{MARK}in:"), F.col("folder"))),
        F.flatten(F.transform(named, of_phrase)))))


def _keyed(mail: DataFrame, short: Column, *keep) -> DataFrame:
    """One row per message and ``key``; a piece that stands in several words comes as often.
    Pieces of one and two letters come only where ``short`` has their number.

    Words, and places in them, are rows of their own, so that all but the splitting of the
    text is compiled."""
    flags = [F.when(F.coalesce(F.col(column), F.lit(False)) == wanted, F.lit(f"{MARK}{flag}"))
             for flag, (column, wanted) in FLAGS.items()]
    marks = [F.lit(ALWAYS), *flags, F.concat(F.lit(f"{MARK}in:"), F.col("folder"))]
    texts = mail.withColumn("_text", _spaced(F.concat_ws("\n", *LOWERED)))
    rows = unnest(texts, _words(marks, F.col("_text")), "word", *keep)
    kept_columns = [c for c in rows.columns if c != "word"]
    word, none = F.col("word"), F.array().cast("array<int>")
    places = F.concat(stretch_places(word, GRAM), *[
        F.when(F.array_contains(short, n), stretch_places(word, n)).otherwise(none) for n in range(1, GRAM)])
    placed = unnest(rows, F.when(word.startswith(MARK), F.array(F.lit(0))).otherwise(places), "at",
                    *kept_columns, "word")
    key = F.when(F.col("at") == 0, word).otherwise(stretch_at(word, F.col("at")))
    return placed.select(*kept_columns, key.alias("key"))


def _short(keys: DataFrame) -> Column:
    """Numbers of letters below ``GRAM`` that keys have, as a value."""
    return keys.filter(F.length("key") < GRAM).agg(F.collect_set(F.length("key"))).scalar()


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLOTS))


def _sieve(keys: DataFrame) -> Column:
    """One bit for every slot that one of the ``key``s has, as an array of a fixed size: a
    value of a row, not a table."""
    slot = _slot(F.col("key"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))
    words = keys.groupBy(F.shiftright(slot, 6).cast("int").alias("id")).agg(F.bit_or(bit).alias("bits"))
    return words.agg(F.map_from_entries(F.collect_list(F.struct("id", "bits"))).alias("m")).select(
        F.transform(F.sequence(F.lit(0), F.lit(SLOTS // 64 - 1)),
                    lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("long")))).scalar()


def filed(searches: DataFrame, mail: DataFrame) -> DataFrame:
    """Compiled searches with the ``key`` they are filed under: of the keys that all their
    matches have the rarest in a sample of the mail. The sample decides how much work
    there is, never what is found. A search whose words are null has no key: it matches
    nothing."""
    rows = kept(compiled(searches).withColumn("keys", _keys_of_search()), "searches")
    wanted = unnest(rows, "keys", "key", "query_id")
    some = mail.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0)
    seen = _keyed(some, _short(wanted)).groupBy("key").agg(F.count("*").alias("n"))
    rarest = wanted.join(seen, "key", "left").groupBy("query_id").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)), "key"))["key"].alias("key"))
    return rows.drop("keys").join(rarest, "query_id")


def match_saved_searches(searches: DataFrame, df: DataFrame) -> DataFrame:
    """(query_id, id) for every message that satisfies all terms of a search; ids name
    messages.

    One plan for any number of searches. The mail is read once (and a sample of it
    before). Keys that no search is filed under fall at the sieve, so the join with the
    searches sees few rows; whether that join is a broadcast is left to Spark and the
    size of the stored searches, one row each. Only then the words are looked for.
    """
    mail = df.select("id", "folder", *sorted({c for c, _ in FLAGS.values()}),
                     *[F.lower(c).alias(c) for c in LOWERED])
    index = kept(filed(searches, mail), "searches")
    columns = [c for c in mail.columns if c != "folder"]
    rows = _keyed(mail, _short(index), *columns, F.col("folder").alias("mail_folder"))
    slot = _slot(F.col("key"))
    bits = F.get(_sieve(index), F.shiftright(slot, 6).cast("int"))
    pairs = rows.filter(F.bit_get(bits, slot.bitwiseAND(63).cast("int")) == 1).join(index, "key")
    found = lambda w: reduce(
        lambda out, f: F.when(w["field"] == f, reduce(
            lambda a, b: a | b, [F.contains(F.col(c), w["value"]) for c in TEXT_FIELDS[f]])).otherwise(out),
        TEXT_FIELDS, F.lit(False))
    flags = [~F.coalesce(F.col(flag), F.lit(False)) | (F.coalesce(F.col(column), F.lit(False)) == wanted)
             for flag, (column, wanted) in FLAGS.items()]
    in_folder = F.col("folder").isNull() | (F.col("mail_folder") == F.col("folder"))
    hits = pairs.filter(reduce(lambda a, b: a & b, [*flags, in_folder, F.forall("words", found)]))
    return hits.select("query_id", "id").distinct()
