"""Personal data: patterns propose spans, checksums confirm them, context scores them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.llm.common import let, whole_text
from letterloom.llm.spans import matches, matches_anywhere, no_spans, tagged

BASE = ("email", "ip", "card", "phone")
EXTRA = ("iban", "ssn")

# The contract's patterns. Repetitions that can only be read one way are possessive, so
# that the matcher neither recurses nor tries again in very long runs, and a match
# begins where a run begins or where the match before it ended (\G).
EMAIL = (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++"
         r"(?:\.[A-Za-z0-9-]++)++")
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
# A chain of digits is read whole: only chains of 16 to 19 digits can pass.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Characters of an account number without spaces, by country. Other countries have runs
# of any length that end where the capitals and digits do.
IBAN_LENGTH = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "IR IS TR",
    27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
IBAN = r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:%s|(?!%s)[A-Z0-9]{4}%s)(?![A-Za-z0-9])" % (
    "|".join(r"(?:%s)[0-9]{2}(?:\x20?[A-Z0-9]){%d}" % (c.replace(" ", "|"), n - 4)
             for n, c in IBAN_LENGTH.items()),
    "|".join(" ".join(IBAN_LENGTH.values()).split()), r"(?:\x20?[A-Z0-9]){11,30}+")
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

CONTEXT = {
    "email": r"\b(e-?mail|mail|contact|write to|address)\b",
    "ip": r"\b(ip|host|server|address|login)\b",
    "card": r"\b(card|credit|debit|visa|mastercard|payment|cvv)\b",
    "phone": r"\b(phone|call|tel|mobile|fax|whatsapp)\b",
    "iban": r"\b(iban|account|bank|transfer|konto)\b",
    "ssn": r"\b(ssn|social security|tax id)\b",
}


def mod_97(account: Column) -> Column:
    """Remainder of an account number, its first four characters moved to the end and
    letters read as 10 to 35."""
    plain = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    return F.aggregate(
        F.split(turned, ""), F.lit(0),
        lambda acc, c: let(
            F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1,
            lambda v: F.when(v < 0, acc).otherwise(
                F.pmod(acc * F.when(v < 10, 10).otherwise(100) + v, F.lit(97)))))


def _digits(m) -> Column:
    return F.regexp_replace(m.hit, "[^0-9]", "")


def _score(kind: str, confirmed: float):
    def of(m):
        near = F.lower(F.concat_ws(" ", m.before, m.after)).rlike(CONTEXT[kind])
        return F.when(near, F.lit(min(1.0, confirmed + 0.3))).otherwise(F.lit(confirmed))
    return of


def pii_spans(text: Column, min_score: float = 0.6) -> Column:
    """Spans of one text, by kind (``BASE``, then ``EXTRA``) and start.

    Base kinds are kept whenever their check passes; the score tells how sure they are.
    Extra kinds are kept with ``min_score`` or more: an account number that passes
    mod 97 is sure enough alone, three groups of digits need a context word.
    """
    def kind(name, pattern, may, passes, confirmed, found=None):
        found = F.filter(matches(text, pattern), passes) if found is None else found
        return F.when(may, tagged(name, found, _score(name, confirmed))).otherwise(no_spans())

    def parts_ok(m):
        return F.forall(F.split(m.hit, r"\."), lambda p: let(
            F.ltrim(p, F.lit("0")), lambda v: (F.char_length(v) <= 3)
            & (F.lpad(v, 3, "0") <= "255")))

    extra = F.concat(
        kind("iban", IBAN, text.rlike("[A-Z]{2}[0-9]{2}"), None, 0.7,
             matches_anywhere(text, IBAN, lambda hit: mod_97(hit) == 1)),
        kind("ssn", SSN, text.rlike("[0-9]{3}-[0-9]{2}-"), lambda m: F.lit(True), 0.4))
    return F.concat(
        kind("email", EMAIL, text.contains("@"), lambda m: F.lit(True), 0.7),
        kind("ip", IP, text.rlike(r"[0-9]\.[0-9]"), parts_ok, 0.5),
        kind("card", CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
             lambda m: F.call_function("luhn_check", _digits(m)), 0.7),
        kind("phone", PHONE, text.rlike(r"\+[0-9]"),
             lambda m: F.char_length(_digits(m)).between(8, 15), 0.5),
        F.filter(extra, lambda s: s.score >= min_score))


def find_pii(df: DataFrame, text: str = "text", out: str = "pii",
             min_score: float = 0.6) -> DataFrame:
    """Adds ``out``: spans (kind, start, end, score) of each whole text, in code points,
    end exclusive.

    A null or empty text has no spans; rows are independent, so repeated rows and other
    columns (also one named like a helper) are kept as they are; an existing column
    ``out`` is replaced. An empty table gives an empty table.
    """
    return df.withColumn(out, pii_spans(whole_text(text), min_score))


def masked(df: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """``text`` with every span's characters replaced by ``*`` (line ends stay)."""
    def blot(done, s):
        return F.concat(F.substring(done, F.lit(1), s.start),
                        F.regexp_replace(F.substring(done, s.start + 1, s.end - s.start),
                                         r"[^\n]", "*"),
                        F.substr(done, s.end + 1))
    return df.withColumn(text, F.when(F.col(text).isNotNull(), F.aggregate(
        F.col(spans), F.col(text), blot)))
