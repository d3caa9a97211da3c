"""Secrets: fixed patterns, and Markov models that tell random strings from names."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.llm.common import let, sample, whole_text
from letterloom.llm.spans import matches, no_spans, tagged

BASE = ("assign", "access", "hex")
EXTRA = ("random",)

# The contract's patterns, with possessive repetitions where only one reading exists.
ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*+[:=]\x20*+["']?"""
          r"""([A-Za-z0-9+/_.=-]++)""")
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
# Strings that the models judge: long runs of these characters.
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
SYMBOLS = len(ALPHABET) + 1  # 0: any other character


def base_spans(text: Column) -> Column:
    """Spans of the fixed kinds, in the order of ``BASE``, then by start."""
    low = F.lower(text)
    named = low.contains(KEYWORDS[0])
    for word in KEYWORDS[1:]:
        named = named | low.contains(word)
    sure = lambda m: F.lit(1.0)
    # The value must have 8 characters; a shorter one uses up its match.
    assign = F.filter(matches(text, ASSIGN),
                      lambda m: F.char_length(F.regexp_extract(m.hit, ASSIGN, 2)) >= 8)
    return F.concat(
        F.when(named, tagged("assign", assign, sure)).otherwise(no_spans()),
        F.when(text.contains("AKIA"), tagged("access", matches(text, ACCESS), sure))
        .otherwise(no_spans()),
        F.when(text.rlike("[0-9a-f]{32}"), tagged("hex", matches(text, HEX), sure))
        .otherwise(no_spans()))


def transitions(token: Column) -> Column:
    """``first * SYMBOLS + second`` of neighbouring characters."""
    symbols = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return let(symbols, lambda s: F.zip_with(
        F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))),
        F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))),
        lambda a, b: a * SYMBOLS + b))


def labelled_strings(docs: DataFrame, text: str = "text", random_docs: int = 40_000,
                     ordinary_docs: int = 2_000) -> DataFrame:
    """``(token, random)``: values that the fixed patterns found are random strings, words
    without such a value are ordinary names. At most about ``random_docs`` and
    ``ordinary_docs`` documents are read for either (the bounds of the training sample).
    """
    total = docs.count()
    body = F.col(text)
    body_docs = docs.select(body.alias("t")).where("t IS NOT NULL")
    values = sample(body_docs, random_docs, "t", total=total).select(F.explode(F.concat(
        F.regexp_extract_all("t", F.lit(ASSIGN), 2), F.regexp_extract_all("t", F.lit(ACCESS), 0),
        F.regexp_extract_all("t", F.lit(HEX), 0))).alias("token"))
    names = sample(body_docs, ordinary_docs, "t", total=total).select(F.explode(
        F.regexp_extract_all("t", F.lit("[A-Za-z_-]{4,}"), 0)).alias("token"))
    return (values.where("char_length(token) >= 8").select("token", F.lit(True).alias("random"))
            .union(names.select("token", F.lit(False).alias("random"))))


def train_markov(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratio of every character pair, random against ordinary, from
    ``(token, random)`` rows. Counts are made by Spark; the result has a fixed size
    (one number for every pair of ``SYMBOLS``). Each count is raised by a half, so a
    class without samples is the uniform model.
    """
    counted = labelled.where("token IS NOT NULL AND random IS NOT NULL").select(
        "random", F.explode(transitions(F.col("token"))).alias("pair")).groupBy(
        "random", "pair").count().collect()
    counts = {True: [0.5] * SYMBOLS ** 2, False: [0.5] * SYMBOLS ** 2}
    for r in counted:
        counts[r["random"]][r["pair"]] += r["count"]
    out = []
    for first in range(SYMBOLS):
        rows = {k: v[first * SYMBOLS:(first + 1) * SYMBOLS] for k, v in counts.items()}
        sums = {k: sum(v) for k, v in rows.items()}
        out += [math.log(rows[True][i] / sums[True]) - math.log(rows[False][i] / sums[False])
                for i in range(SYMBOLS)]
    return out


def find_secrets(df: DataFrame, model: list[float], text: str = "text", out: str = "secrets",
                 min_ratio: float = 1.0) -> DataFrame:
    """Adds ``out``: spans (kind, start, end, score) of each whole text in code points,
    end exclusive, by start and then kind (``BASE``, then ``EXTRA``).

    ``random`` spans are runs of 20 or more characters with letters and digits, outside
    the base spans, whose mean log-likelihood ratio is ``min_ratio`` or more (the score).
    A null or empty text has no spans; rows are independent, so repeated rows, ties and
    other columns do not matter; an existing column ``out`` is replaced.
    """
    body = whole_text(text)
    ratios = F.from_json(F.lit(json.dumps([round(x, 6) for x in model])), "array<double>")

    def ratio(m):
        return let(transitions(m.hit), lambda pairs: F.aggregate(
            pairs, F.lit(0.0), lambda acc, p: acc + F.get(ratios, p)) / F.size(pairs))

    def with_random(base):
        runs = F.filter(
            matches(body, RUN),
            lambda m: m.hit.rlike("[0-9]") & m.hit.rlike("[A-Za-z]") & ~F.exists(
                base, lambda b: (b.start < m.end) & (m.start < b.end)))
        judged = F.filter(tagged("random", runs, ratio), lambda s: s.score >= min_ratio)
        return F.concat(base, F.when(body.rlike("[A-Za-z0-9+/_=-]{20}"), judged)
                        .otherwise(no_spans()))

    kinds = F.array(*[F.lit(k) for k in BASE + EXTRA])
    ordered = F.array_sort(let(base_spans(body), with_random), lambda a, b: F.when(
        a.start != b.start, a.start - b.start).otherwise(
        F.array_position(kinds, a.kind).cast("int") - F.array_position(kinds, b.kind).cast("int")))
    return df.withColumn(out, ordered)
