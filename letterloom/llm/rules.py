"""Quality rules as a cascade that stops at the first rejection."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.llm.common import let, sample, stored, whole_text, words_of

WINDOW = 8


def repeated_words(words: Column) -> Column:
    """Words inside 8-word windows that occur twice or more in the text, the first
    occurrence included. Windows are compared by 64-bit hashes; only texts with an equal
    pair sort them, and the covered words are summed along the sorted positions."""
    last = F.size(words) - WINDOW

    def windows(hashes):
        return F.transform(F.sequence(F.lit(1), last + 1),
                           lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))

    def covered(found):
        def of(ordered):
            # A window is repeated when a neighbour in hash order has the same hash.
            twice = F.filter(ordered, lambda w, i: (F.get(ordered, i - 1).h == w.h)
                             .__or__(F.get(ordered, i + 1).h == w.h))
            places = F.sort_array(F.transform(twice, lambda w: w.p))
            return let(places, lambda at: F.aggregate(
                F.transform(at, lambda p, i: F.least(
                    F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW)))),
                F.lit(0), lambda a, n: a + n))
        return let(F.sort_array(F.transform(found, lambda h, i: F.struct(
            h.alias("h"), i.alias("p")))), of)

    return F.when(last < 1, F.lit(0)).otherwise(let(
        F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: let(
            windows(hashes), lambda found: F.when(
                F.size(F.array_distinct(found)) == F.size(found), F.lit(0))
            .otherwise(covered(found)))))


def text_counts(df: DataFrame, text: str = "text", out: str = "counts") -> DataFrame:
    """Adds the struct ``out``: n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words, all long, of each whole text.

    A null text counts as empty (all zero). Rows are independent; an existing column
    ``out`` is replaced, other columns stay.
    """
    body = whole_text(text)
    words = words_of(body)
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = let(F.struct(words.alias("w"), lines.alias("l")), lambda s: F.struct(
        F.size(s.w).cast("long").alias("n_words"),
        F.char_length(F.array_join(s.w, "")).cast("long").alias("word_chars"),
        (F.char_length(body) - F.char_length(F.translate(body, "#*$%&|<>", "")))
        .cast("long").alias("n_symbols"),
        F.size(s.l).cast("long").alias("n_lines"),
        (F.size(s.l) - F.size(F.array_distinct(s.l))).cast("long").alias("n_dup_lines"),
        repeated_words(s.w).cast("long").alias("n_repeat_words")))
    return df.withColumn(out, counted)


def stuttered(words: Column) -> Column:
    """Words equal to the one before."""
    return let(words, lambda w: F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))))


@dataclass(frozen=True)
class Rule:
    """A text is rejected where ``fails`` is true."""
    name: str
    fails: Column


def base_rule(c: str = "counts") -> Column:
    return F.expr(f"{c}.n_words < 20 OR 100 * {c}.n_repeat_words > 30 * {c}.n_words")


def standard_rules(text: str = "text", counts: str = "counts") -> list[Rule]:
    """Rules beside the base rule. Their limits are wide: they aim at markup, tables,
    boilerplate and noise, not at style."""
    c, body = counts, whole_text(text)
    return [
        Rule("symbols", F.expr(f"10 * {c}.n_symbols > {c}.n_words")),
        Rule("word_length", F.expr(f"{c}.word_chars < 2 * {c}.n_words OR "
                                   f"{c}.word_chars > 15 * {c}.n_words")),
        Rule("dup_lines", F.expr(f"2 * {c}.n_dup_lines > {c}.n_lines")),
        Rule("stutter", 5 * stuttered(words_of(body)) > F.col(f"{c}.n_words")),
        Rule("bullets", F.expr("10 * size(filter(split(coalesce(%s, ''), '\\n'), x -> "
                               "x rlike '^[ ]*[-*•]')) > 9 * %s.n_lines" % (text, c))),
        Rule("letters", F.char_length(F.regexp_replace(body, r"[^\p{L}]", "")) * 2
             < F.col(f"{c}.word_chars")),
        Rule("shouting", F.char_length(F.regexp_replace(body, r"[^\p{Lu}]", "")) * 2
             > F.char_length(F.regexp_replace(body, r"[^\p{L}]", ""))),
    ]


def ranked(df: DataFrame, rules: list[Rule], bound: int = 2_000,
           key: str = "text") -> list[tuple[Rule, float, float]]:
    """``(rule, seconds, rejected share)`` by rejection per second, best first, measured
    on a sample of about ``bound`` rows at most. Only the order depends on the sample and
    on the clock, never a verdict."""
    probe = stored(sample(df, bound, key).repartition(2), "rules")
    total = probe.count()
    measured = []
    for rule in rules:
        began = time.perf_counter()
        hit = probe.agg(F.count_if(rule.fails)).first()[0]
        measured.append((rule, time.perf_counter() - began, (hit or 0) / max(total, 1)))
    return sorted(measured, key=lambda m: (-m[2] / max(m[1], 1e-6), m[1], m[0].name))


def cascade(df: DataFrame, rules: list[Rule], out: str = "kept") -> DataFrame:
    """Adds boolean ``out``: no rule rejects the row. ``CASE`` tests the rules in the
    given order and stops at the first that rejects, so later rules cost nothing there.
    A rule that is null for a row (a null column) does not reject it."""
    verdict = F.lit(True)
    for rule in reversed(rules):
        verdict = F.when(rule.fails, F.lit(False)).otherwise(verdict)
    return df.withColumn(out, verdict)
