"""Phrase patterns of the rules, and how they are bounded.

The same pattern text is used on Spark (Java regex) and by the SQL checks
(RE2).  ``\\b`` differs between the two outside ASCII, so whole-word patterns are
kept without it here and bounded explicitly in :func:`whole_words`.
"""

from __future__ import annotations

import re

# White space as mail clients treat it, spelled out because the
# shorthand class differs between regex engines.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
SPACE = (
    r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}"
    r"\x{3000}\x{FEFF}]"
)
SPACE_OR_COMMA = "[," + SPACE[1:]
NOT_SPACE_OR_LT = "[^<" + SPACE[1:]
NOT_SPACE_OR_GT = "[^>" + SPACE[1:]

# Phrases of the intent rules, matched as whole words.
QUESTION = (
    r"can you|could you|would you|will you|please" + SPACE + r"+\w+|"
    r"what|when|where|who|why|how|"
    r"are you|do you|did you|have you|is there|let me know|please confirm|"
    r"please advise|please review|please send|please share|looking forward|"
    r"your thoughts|feedback\?"
)
COMMITMENT = (
    r"i'?ll|i will|we'?ll|we will|i'?m going to|i plan to|i'?m planning to|expect to|"
    r"aim to|schedule to|promise|commit(?:ted)?|deliver(?:ing)? by|"
    r"send (?:you|it|the) (?:by|on|before|tomorrow)|follow up"
)
INCOMING_COMMITMENT = (
    r"we will|we'?ll|expect to|aim to|will deliver|will send|will provide|will share|"
    r"will follow up|will have .* ready|"
    r"by (?:monday|tuesday|wednesday|thursday|friday|next week|tomorrow|eod|"
    r"end of (?:day|week))"
)
REQUEST = r"please (?:send|share|provide|review|confirm|forward|sign|return)"
INVOICE = (
    r"invoice|amount due|payment due|balance due|total:?|subtotal|tax|net total|"
    r"pay (?:by|before|now)|billing statement|past due"
)
RECEIPT = (
    r"receipt|payment received|thank you for your (?:payment|purchase|order)|"
    r"order confirmed|charged|transaction id"
)
ORDER = (
    r"order (?:#|number|id|confirmation)|your order|order placed|order status|"
    r"tracking (?:number|#)"
)
SHIPMENT = (
    r"shipped|shipment|delivery|tracking|carrier|estimated delivery|out for delivery|"
    r"package|ups|fedex|dhl|usps"
)
MEETING = (
    r"(?:can|could|would) (?:we|you) meet|schedule a (?:meeting|call)|"
    r"available (?:on|tomorrow|next)|free (?:on|tomorrow|next)|let'?s meet|"
    r"book (?:a|the) (?:room|call)|calendar invite|zoom|google meet|teams meeting|"
    r"appointment"
)
SECURITY = (
    r"password reset|verify your (?:identity|account|email)|security alert|"
    r"suspicious (?:activity|login)|2fa|two-factor|"
    r"account (?:compromised|locked|suspended)|verify it'?s you|unusual sign-in|"
    r"recovery code"
)
NEWSLETTER = (
    r"newsletter|this week in|weekly digest|unsubscribe|view in browser|"
    r"forward to a friend"
)
PROMOTION = (
    r"\d+% off|sale ends|limited time|free shipping|deal of the day|shop now|"
    r"order today|save (?:up to )?\d+%?"
)

# Sender and category patterns, matched anywhere in the text.
PROMO_ANYWHERE = (
    r"newsletter|digest|weekly|substack|promo|promotion|deals?|offers?|sale|coupon|"
    r"unsubscribe|mailing"
)
SOCIAL_ANYWHERE = (
    r"github|goodreads|facebook|twitter|x\.com|linkedin|instagram|tiktok|snapchat|"
    r"discord|slack|notifications?@"
)
UPDATES_ANYWHERE = (
    r"invoice|receipt|billing|payment|order|shipping|delivery|tracking|statement|bank|"
    r"tax|receipt|confirm|verification|security|alert|reminder|no-?reply"
)

# Due phrases.  The first group must start at a word boundary, the
# second must end at one.
DUE_BY = (
    r"by (?:monday|tuesday|wednesday|thursday|friday|saturday|sunday|tomorrow|"
    r"next week|eod|end of (?:day|week|month)|\d{1,2}(?:st|nd|rd|th)?(?:" + SPACE + r"+\w+)?)"
)
DUE_SOON = r"tomorrow|today|next week|this week|by friday|by monday"

# The mark-up removed or defused before a body is shown.
DANGEROUS_TAGS = ["iframe", "object", "embed", "form", "meta", "link", "base", "applet"]
SCRIPT_URL = r"javascript:|vbscript:|data:text/html"
URL_ATTRIBUTE = r"href|src|xlink:href"
LINK_MARKUP = (
    '<a href="{url}" target="_blank" rel="noreferrer" '
    'class="text-rose-600 hover:underline">{url}</a>'
)

# Command words, in the order they are tried.
COMMAND_COMPOSE = r"compose|new email|write|reply|draft"
COMMAND_VIEWS = [
    (r"waiting|waiting on|waiting for", "waiting", 0.85),
    (r"needs? reply|needs? a reply|unanswered|reply|respond", "reply", 0.85),
    (r"now|today|attention|urgent|priority", "now", 0.8),
    (r"commitments?", "commitments", 0.85),
    (r"receipts?|invoices?|purchases?|orders?", "receipts", 0.85),
    (r"subscriptions?|newsletters?|mailing", "subscriptions", 0.85),
    (r"people|contacts?|senders?", "people", 0.85),
    (r"inbox|all mail", "inbox", 0.85),
    (r"starred|important", "starred", 0.85),
]
COMMAND_SEARCH = r"find|search|show|where|which"
COMMAND_VERB = r"find|search|show|where is|which|get me"

_WORD = "[A-Za-z0-9_]"
_BEFORE = f"(?<!{_WORD})"
_AFTER = f"(?!{_WORD})"
# An ASCII word boundary in either direction, for phrases that do not begin or
# end with a word character.
BOUNDARY = f"(?:{_BEFORE}(?={_WORD})|(?<={_WORD}){_AFTER})"


def whole_words(phrases: str) -> str:
    """Java regex: ``phrases`` between ASCII word boundaries.

    Every phrase starts with a word character, so the left boundary is one
    look-behind, which rejects most positions at once.
    """
    return f"{_BEFORE}(?:{phrases}){BOUNDARY}"


def starts_word(phrases: str) -> str:
    return f"{_BEFORE}(?:{phrases})"


def ends_word(phrases: str) -> str:
    return f"(?:{phrases}){_AFTER}"


DUE = f"{starts_word(DUE_BY)}|{ends_word(DUE_SOON)}"


def alternatives(phrases: str) -> list[str]:
    """The phrases of a pattern: its parts between ``|`` outside of groups."""
    parts, depth, start, i = [], 0, 0, 0
    while i < len(phrases):
        if phrases[i] == "\\":
            i += 1
        elif phrases[i] in "()":
            depth += 1 if phrases[i] == "(" else -1
        elif phrases[i] == "|" and depth == 0:
            parts.append(phrases[start:i])
            start = i + 1
        i += 1
    return parts + [phrases[start:]]


_GROUP = re.compile(r"\([^()]*\)[?*+]?")
# Classes, escapes and wildcards with their repeat mark, or a character that may be
# absent.
_NOT_FIXED = re.compile(r"\\[a-zA-Z][?*+]?|\[[^\]]*\][?*+]?|\.[?*+]?|.[?*]")


def required_text(phrase: str) -> str:
    """The longest text every match of ``phrase`` contains ('' if unknown)."""
    runs, before = phrase, None
    while runs != before:
        runs, before = _GROUP.sub("\0", runs), runs
    runs = re.sub(r"\\([^a-zA-Z])", lambda m: f"\x01{m.group(1)}", runs)
    runs = _NOT_FIXED.sub("\0", runs).replace("\x01", "")
    return max(runs.split("\0"), key=len)


def required_texts(phrases: str) -> list[str]:
    """Texts of which every match of the pattern contains at least one; empty when
    some phrase has none."""
    found = {required_text(p) for p in alternatives(phrases)}
    if "" in found:
        return []
    return sorted(t for t in found if not any(o != t and o in t for o in found))
