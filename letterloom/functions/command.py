"""Keyword routing of command-bar texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from letterloom.functions import lexicon as lx
from letterloom.functions.text import strip_space


def _route(action: str, view: str | None, query: Column, confidence: float) -> Column:
    return F.struct(F.lit(action).alias("action"), F.lit(view).cast("string").alias("view"),
                    query.alias("query"), F.lit(confidence).alias("confidence"))


def route_command(text: Column) -> Column:
    """struct(action, view, query, confidence); the first rule that fits wins."""
    command = strip_space(text)
    lower = F.lower(command)
    none = F.lit(None).cast("string")
    routed = F.when(lower.rlike(f"^(?:{lx.COMMAND_COMPOSE})"),
                    _route("compose", None, none, 0.9))
    for words, view, confidence in lx.COMMAND_VIEWS:
        routed = routed.when(lower.rlike(lx.whole_words(words)),
                             _route("view", view, none, confidence))
    rest = strip_space(F.regexp_replace(
        command, rf"(?i)^(?:{lx.COMMAND_VERB}){lx.SPACE}+", ""))
    routed = routed.when(lower.rlike(lx.whole_words(lx.COMMAND_SEARCH)),
                         _route("search", None, rest, 0.6))
    return routed.otherwise(_route("search", None, command, 0.3))
