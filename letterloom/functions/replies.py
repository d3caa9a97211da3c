"""Reading model replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from letterloom.functions import lexicon as lx
from letterloom.schema import REPLY_JSON

JSON_OPTIONS = {"mode": "PERMISSIVE"}


def without_fences(text: Column) -> Column:
    opened = F.regexp_replace(text, f"```(?:json|JSON)?{lx.SPACE}*", "")
    return F.replace(opened, F.lit("```"), F.lit(""))


def outer_object(text: Column) -> Column:
    """The text from the first ``{`` to the last ``}``; '' without such a pair. Found by
    what is before and after, each looked for once: a pattern that runs to the end and
    back is several times slower."""
    before, after = F.substring_index(text, "{", 1), F.substring_index(text, "}", -1)
    return F.substring(text, F.length(before) + 1, F.greatest(
        F.length(text) - F.length(before) - F.length(after), F.lit(0)))


def parse_model_reply(raw: Column, schema: str | StructType = REPLY_JSON) -> Column:
    """JSON reply as a struct; prose or fences around the object are skipped.

    Cutting to the outermost braces is a no-op for a bare object, which is most replies and
    is not cut, so one parse covers both forms. Fences hold no brace, so they may go after
    the cut. Fields that ``schema`` does not name are skipped, which is much of the time.
    """
    cut = F.when(raw.startswith("{") & raw.endswith("}"), raw).otherwise(outer_object(raw))
    return F.from_json(F.when(raw.contains("```"), without_fences(cut)).otherwise(cut), schema, JSON_OPTIONS)
