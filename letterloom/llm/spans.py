"""Where a pattern matches, in code points, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from letterloom.llm.common import let

SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"
_BLOCK = 64


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, n: a + n)


def running_starts(lengths: Column) -> Column:
    """For every element the sum of those before it, by blocks, so that the work grows
    almost linearly with the number of matches in a text."""
    def per_item(items, bases):
        return F.transform(items, lambda n, i: F.get(bases, F.shiftright(i, 6)) + _total(
            F.slice(items, i - i.bitwiseAND(_BLOCK - 1) + 1, i.bitwiseAND(_BLOCK - 1))))

    def per_block(items):
        sums = F.transform(
            F.sequence(F.lit(0), F.shiftright(F.greatest(F.size(items) - 1, F.lit(0)), 6)),
            lambda b: _total(F.slice(items, b * _BLOCK + 1, F.lit(_BLOCK))))
        return let(sums, lambda blocks: let(
            F.transform(blocks, lambda n, i: _total(F.slice(blocks, F.lit(1), i))),
            lambda bases: per_item(items, bases)))
    return let(lengths, per_block)


def matches(text: Column, pattern: str, context: int = 48) -> Column:
    """``array<struct<hit, start, end, before, after>>`` of the leftmost non-overlapping
    matches; ``before`` and ``after`` are the nearest ``context`` characters between
    this match and its neighbours. The text between matches gives the positions."""
    def placed(s):
        steps = F.zip_with(F.slice(s.parts, F.lit(1), F.size(s.hits)), s.hits,
                           lambda p, h: F.char_length(p) + F.char_length(h))
        return let(running_starts(steps), lambda starts: F.transform(
            s.hits, lambda h, i: let(
                F.get(starts, i) + F.char_length(F.get(s.parts, i)), lambda at: F.struct(
                    h.alias("hit"), at.alias("start"), (at + F.char_length(h)).alias("end"),
                    F.right(F.get(s.parts, i), F.lit(context)).alias("before"),
                    F.left(F.get(s.parts, i + 1), F.lit(context)).alias("after")))))
    return let(F.struct(F.split(text, pattern, -1).alias("parts"),
                        F.regexp_extract_all(text, F.lit(pattern), 0).alias("hits")), placed)


def matches_anywhere(text: Column, pattern: str, passes, context: int = 48) -> Column:
    """Like ``matches``, for the matches that ``passes(hit)`` accepts: the pattern is tried
    at every start, so one that is refused hides none that begins inside it. Of accepted
    matches that overlap the first stays."""
    at = f"(?=({pattern}))"

    def placed(s):  # the mark in front keeps a match at the very start apart
        return let(running_starts(F.transform(s.parts, lambda p: F.char_length(p))),
                   lambda starts: F.transform(s.hits, lambda h, i: let(
                       F.get(starts, i + 1) - 1, lambda start: F.struct(
                           h.alias("hit"), start.alias("start"),
                           (start + F.char_length(h)).alias("end"),
                           F.right(F.get(s.parts, i), F.lit(context)).alias("before"),
                           F.substr(F.get(s.parts, i + 1), F.char_length(h) + 1,
                                    F.lit(context)).alias("after")))))

    def apart(found):
        return F.filter(found, lambda m, i: (i == 0) | (
            F.array_max(F.transform(F.slice(found, F.lit(1), i), lambda p: p.end)) <= m.start))
    marked = F.concat(F.lit("\n"), text)
    return let(F.filter(let(F.struct(
        F.split(marked, at, -1).alias("parts"),
        F.regexp_extract_all(marked, F.lit(at), 1).alias("hits")), placed),
        lambda m: passes(m.hit)), apart)


def tagged(kind: str, found: Column, score) -> Column:
    """Spans of ``matches``; ``score(match)`` is a number."""
    return F.transform(found, lambda m: F.struct(
        F.lit(kind).alias("kind"), m.start.alias("start"), m.end.alias("end"),
        score(m).cast("double").alias("score")))


def no_spans() -> Column:
    return F.array().cast(SPAN)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
