"""SQL forms of the text rules, for DuckDB (RE2, where ``\\b`` is ASCII)."""

from letterloom.functions import lexicon as lx
from letterloom.functions.intent import OUTCOMES

from checks.registry import SELF


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(text: str, phrases: str) -> str:
    return f"regexp_matches({text}, {q(chr(92) + 'b(?:' + phrases + ')' + chr(92) + 'b')})"


def anywhere(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {q(pattern)})"


LABELS = "lower(coalesce(labels, ''))"
TEXT = "lower(concat(subject, ' ', snippet, ' ', body))"
SENDER = "lower(concat(from_email, ' ', from_name))"
SUBJECT_TEXT = "lower(concat(subject, ' ', snippet))"


def label(word: str) -> str:
    return f"contains({LABELS}, '{word}')"


PURCHASE_TEXT = " OR ".join([label("finance")] + [
    words(TEXT, p) for p in (lx.INVOICE, lx.RECEIPT, lx.ORDER, lx.SHIPMENT)])
SUBSCRIPTION_TEXT = " OR ".join([
    label("newsletter"), words(SUBJECT_TEXT, lx.NEWSLETTER),
    anywhere(SENDER, lx.PROMO_ANYWHERE), words(SUBJECT_TEXT, lx.PROMOTION)])


def _either(pattern: str) -> str:
    return f"({anywhere(SENDER, pattern)} OR {anywhere(SUBJECT_TEXT, pattern)})"


CATEGORY = f"""CASE WHEN {label('newsletter')} THEN 'PROMOTIONS' WHEN {label('social')} THEN 'SOCIAL'
  WHEN {label('finance')} THEN 'UPDATES' WHEN {_either(lx.PROMO_ANYWHERE)} THEN 'PROMOTIONS'
  WHEN {_either(lx.SOCIAL_ANYWHERE)} THEN 'SOCIAL'
  WHEN {_either(lx.UPDATES_ANYWHERE)} THEN 'UPDATES' ELSE 'PRIMARY' END"""


def rule_case(text: str = TEXT, sender: str = SENDER, own: str | None = None,
              with_labels: bool = True) -> str:
    """The name of the rule that decides the intent."""
    own = own or f"lower(from_email) = '{SELF}'"
    lab = label if with_labels else (lambda w: "false")
    return f"""CASE WHEN {words(text, lx.SECURITY)} THEN 'security'
  WHEN {lab('newsletter')} OR {words(text, lx.NEWSLETTER)} THEN 'newsletter'
  WHEN {words(text, lx.PROMOTION)} OR {anywhere(sender, lx.PROMO_ANYWHERE)} THEN 'promotion'
  WHEN {lab('social')} OR {anywhere(sender, lx.SOCIAL_ANYWHERE)} THEN 'social'
  WHEN {lab('finance')} OR {words(text, lx.INVOICE)} THEN 'invoice'
  WHEN {words(text, lx.RECEIPT)} THEN 'receipt' WHEN {words(text, lx.SHIPMENT)} THEN 'shipment'
  WHEN {words(text, lx.ORDER)} THEN 'order' WHEN {words(text, lx.MEETING)} THEN 'meeting'
  WHEN {words(text, lx.COMMITMENT)} OR {words(text, lx.INCOMING_COMMITMENT)} THEN 'commitment'
  WHEN NOT ({own}) AND {words(text, lx.QUESTION)} THEN 'question'
  WHEN {lab('personal')} THEN 'personal' WHEN {lab('work')} THEN 'work' ELSE 'none' END"""


def outcome(rule: str, field: int) -> str:
    """Intent (0), confidence (1) or reason (2) of a rule name."""
    arms = " ".join(f"WHEN '{name}' THEN " + (
        f"CAST({o[field]} AS DOUBLE)" if field == 1 else q(o[field]))
        for name, o in OUTCOMES.items())
    return f"CASE {rule} {arms} END"


SPACE = lx.SPACE


def collapse(text: str) -> str:
    return f"trim(regexp_replace({text}, {q(SPACE + '+')}, ' ', 'g'))"


def strip(text: str) -> str:
    codes = [9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
             0x202F, 0x205F, 0x3000, 0xFEFF]
    return f"trim({text}, concat({', '.join(f'chr({c})' for c in codes)}))"


def tags(text: str) -> str:
    return f"regexp_replace({text}, '<[^>]+>', ' ', 'g')"


def visible(text: str) -> str:
    out = tags(text)
    for entity, plain in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        out = f"replace({out}, '{entity}', '{plain}')"
    return collapse(out)


def snippet(text: str, size: int = 140) -> str:
    plain = visible(f"regexp_replace({text}, '<style[^>]*>(?s:.*?)</style>', '', 'gi')")
    return (f"(SELECT CASE WHEN length(p) <= {size} THEN p ELSE concat(left(p, {size}), '…') END "
            f"FROM (SELECT {plain} AS p))")


def to_html(text: str) -> str:
    out = text
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"),
                         ("''", "&#39;")):
        out = f"replace({out}, '{char}', '{entity}')"
    link = lx.LINK_MARKUP.replace("{url}", chr(92) + "1")
    out = f"regexp_replace({out}, {q('(https?://' + lx.NOT_SPACE_OR_LT + '+)')}, {q(link)}, 'g')"
    return f"replace({out}, chr(10), '<br/>')"


def normal_body(text: str) -> str:
    return (f"CASE WHEN contains({text}, '<') AND contains({text}, '>') THEN {text} "
            f"ELSE {to_html(text)} END")


def sanitize(text: str) -> str:
    out = text

    def drop(pattern, flags="gi", by=""):
        nonlocal out
        out = f"regexp_replace({out}, {q(pattern)}, {q(by)}, '{flags}')"

    for tag in ("script", "style"):
        drop(rf"<{tag}\b[^>]*>(?s:.*?)</{tag}>")
    # RE2 has no back-references: one step per tag.  Equal as long as these
    # elements are not nested in each other.
    for tag in lx.DANGEROUS_TAGS:
        drop(rf"<{tag}\b[^>]*>(?s:.*?)</{tag}>")
    drop(r"<(?:" + "|".join(lx.DANGEROUS_TAGS) + r")\b[^>]*/?>")
    drop(rf"""{SPACE}+on\w+{SPACE}*={SPACE}*(?:"[^"]*"|'[^']*'|{lx.NOT_SPACE_OR_GT}+)""")
    drop(rf'({lx.URL_ATTRIBUTE}){SPACE}*={SPACE}*"(?:{lx.SCRIPT_URL})[^"]*"', by=r'\1="#"')
    drop(rf"({lx.URL_ATTRIBUTE}){SPACE}*={SPACE}*'(?:{lx.SCRIPT_URL})[^']*'", by=r"\1='#'")
    return out


def csv(text: str) -> str:
    return (f"list_filter(list_transform(string_split({text}, ','), lambda x: trim(x)), "
            "lambda x: x <> '')")


def display_name(address: str) -> str:
    local = f"regexp_replace(split_part({address}, '@', 1), '[._-]+', ' ', 'g')"
    marked = rf"regexp_replace({local}, '\b(\w)', concat(chr(1), '\1'), 'g')"
    upper = ("lambda w: concat(CASE WHEN regexp_matches(left(w, 1), '[a-z]') "
             "THEN upper(left(w, 1)) ELSE left(w, 1) END, substr(w, 2))")
    return f"array_to_string(list_transform(string_split({marked}, chr(1)), {upper}), '')"


def contacts_sql() -> str:
    return f"""
SELECT email, coalesce(name, {display_name('email')}) AS name FROM (
  SELECT email, first(name ORDER BY date, id, source) AS name FROM (
    SELECT date, id, 0 AS source, from_email AS email, from_name AS name FROM mail
    UNION ALL SELECT date, id, 1, unnest({csv('to_emails')}), NULL FROM mail
    UNION ALL SELECT date, id, 2, unnest({csv('cc_emails')}), NULL FROM mail) AS seen
  WHERE email <> '' AND lower(email) <> '{SELF}' GROUP BY email) AS named"""


def commitments_sql(columns: str, mail: str = "folder IN ('INBOX', 'SENT', 'ARCHIVE')") -> str:
    """Rows (email_id, pos, lower, text, direction, ...) for every distinct sentence."""
    plain = collapse(f"replace({tags('body')}, '&nbsp;', ' ')")
    parts = rf"string_split(regexp_replace({plain}, '([.!?]) +', concat('\1', chr(1)), 'g'), chr(1))"
    own = f"lower(from_email) = '{SELF}'"
    due = q(chr(92) + "b(?:" + lx.DUE_BY + ")|(?:" + lx.DUE_SOON + ")" + chr(92) + "b")
    return f"""
WITH parts AS (SELECT *, {own} AS own, {parts} AS ps FROM mail
    WHERE {mail}),
cut AS (SELECT *, unnest(ps) AS text, unnest(range(len(ps))) AS pos FROM parts),
low AS (SELECT *, lower(text) AS lower_text FROM cut WHERE length(text) > 10),
dir AS (SELECT *, CASE
    WHEN {words('lower_text', lx.COMMITMENT)} THEN CASE WHEN own THEN 'outgoing' ELSE 'incoming' END
    WHEN NOT own AND {words('lower_text', lx.INCOMING_COMMITMENT)} THEN 'incoming'
    WHEN {words('lower_text', lx.REQUEST)} THEN CASE WHEN own THEN 'incoming' ELSE 'outgoing' END
    END AS direction,
    nullif(regexp_extract(lower_text, {due}), '') AS due,
    row_number() OVER (PARTITION BY id, lower_text ORDER BY pos) AS nth FROM low),
found AS (SELECT id AS email_id, thread_id, date, from_name, subject, pos, direction, due,
    text AS evidence, left(text, 200) AS action,
    concat(id, ':', pos) AS commitment_id, concat(id, ':', left(text, 40)) AS short_id,
    CASE WHEN direction = 'outgoing' THEN 'You' ELSE from_name END AS who,
    CASE WHEN own THEN 'you' ELSE from_email END AS owner,
    CAST(0.6 AS DOUBLE) AS confidence
  FROM dir WHERE direction IS NOT NULL AND nth = 1)
{columns}"""
