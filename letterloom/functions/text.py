"""Text functions over HTML and plain bodies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from letterloom.functions import lexicon as lx

WORD_START = "(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])"
LOWER_ASCII = "abcdefghijklmnopqrstuvwxyz"


def strip_space(text: Column) -> Column:
    """Drop white space (of any Unicode kind) at both ends."""
    return F.btrim(text, F.lit(lx.SPACE_CHARS))


def trim_or_empty(text: Column) -> Column:
    return strip_space(F.coalesce(text, F.lit("")))


def csv_to_array(text: Column) -> Column:
    """'a, b,,c' -> [a, b, c]."""
    parts = F.split(F.coalesce(text, F.lit("")), ",")
    return F.filter(F.transform(parts, strip_space), lambda part: part != "")


def has_markup(text: Column) -> Column:
    return text.contains("<") & text.contains(">")


def collapse_space(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, lx.SPACE + "+", " "))


def drop_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", " ")


def _decode_entities(text: Column) -> Column:
    for entity, plain in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def visible_text(html: Column) -> Column:
    """The words of an HTML body on one line."""
    return collapse_space(_decode_entities(drop_tags(html)))


def strip_html(html: Column, max_chars: int | None = None) -> Column:
    text = visible_text(html)
    return text if max_chars is None else F.left(text, F.lit(max_chars))


def make_snippet(body: Column, max_chars: int = 140) -> Column:
    """Preview line: visible text without style blocks, cut with an ellipsis."""
    text = visible_text(F.regexp_replace(body, r"(?i)<style[^>]*>[\s\S]*?</style>", ""))
    return F.when(F.char_length(text) <= max_chars, text).otherwise(
        F.concat(F.left(text, F.lit(max_chars)), F.lit("…")))


def text_to_html(text: Column) -> Column:
    """Plain text as HTML: escaped, links live, line breaks kept."""
    out = text
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"),
                         ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    link = lx.LINK_MARKUP.replace("{url}", "$1")
    out = F.regexp_replace(out, f"(https?://{lx.NOT_SPACE_OR_LT}+)", link)
    return F.replace(out, F.lit("\n"), F.lit("<br/>"))


def normalize_body(text: Column) -> Column:
    """HTML stays as it is, anything else becomes HTML."""
    return F.when(has_markup(text), text).otherwise(text_to_html(text))


def word_count(html: Column) -> Column:
    words = F.split(collapse_space(drop_tags(html)), " ")
    return F.size(F.filter(words, lambda word: word != ""))


def reading_time(html: Column, words_per_minute: int = 200) -> Column:
    minutes = word_count(html) / F.lit(float(words_per_minute))
    whole = F.floor(minutes + 0.5).cast("string")
    return (F.when(minutes < 0.5, "<1 min").when(minutes < 1, "1 min")
            .otherwise(F.concat(whole, F.lit(" min"))))


def sanitize_html(html: Column) -> Column:
    """Remove active content: script and style blocks, embedding tags, event
    handlers and script URLs."""
    tags = "|".join(lx.DANGEROUS_TAGS)
    steps = [
        (r"(?i)<script(?![A-Za-z0-9_])[^>]*>[\s\S]*?</script>", ""),
        (r"(?i)<style(?![A-Za-z0-9_])[^>]*>[\s\S]*?</style>", ""),
        (rf"(?i)<({tags})(?![A-Za-z0-9_])[^>]*>[\s\S]*?</\1>", ""),
        (rf"(?i)<(?:{tags})(?![A-Za-z0-9_])[^>]*/?>", ""),
        (rf"""(?i){lx.SPACE}+on\w+{lx.SPACE}*={lx.SPACE}*"""
         rf"""(?:"[^"]*"|'[^']*'|{lx.NOT_SPACE_OR_GT}+)""", ""),
        (rf'(?i)({lx.URL_ATTRIBUTE}){lx.SPACE}*={lx.SPACE}*"(?:{lx.SCRIPT_URL})[^"]*"',
         '$1="#"'),
        (rf"(?i)({lx.URL_ATTRIBUTE}){lx.SPACE}*={lx.SPACE}*'(?:{lx.SCRIPT_URL})[^']*'",
         "$1='#'"),
    ]
    out = F.coalesce(html, F.lit(""))
    for pattern, replacement in steps:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def display_name_from_address(address: Column) -> Column:
    """'ana.ruiz@x' -> 'Ana Ruiz'; letters after the first of a word stay as they are."""
    local = F.regexp_replace(F.split_part(address, F.lit("@"), F.lit(1)), "[._-]+", " ")
    words = F.split(local, WORD_START)
    capital = lambda w: F.concat(
        F.translate(F.left(w, F.lit(1)), LOWER_ASCII, LOWER_ASCII.upper()),
        F.substr(w, F.lit(2)))
    return F.array_join(F.transform(words, capital), "")


def stretch_places(word: Column, letters: int) -> Column:
    """Where the stretches of so many (1 to 3) letters are in a word, as start * 4 + letters."""
    first, last = 4 + letters, (F.length(word) - letters + 1) * 4 + letters
    return F.when(last >= first, F.sequence(F.lit(first), last, F.lit(4))).otherwise(
        F.array().cast("array<int>"))


def stretch_at(word: Column, place: Column) -> Column:
    """The stretch at a place of ``stretch_places``."""
    return F.substring(word, F.shiftright(place, 2), place.bitwiseAND(3))
