"""Plain Python versions of the contracts, to check the operators against."""

import re

BLANK = r"[^\x20\x09-\x0D]+"


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def pii(text):
    text, out = text or "", []

    def add(kind, pattern, ok=lambda m: True):
        out.extend((kind, m.start(), m.end()) for m in re.finditer(pattern, text) if ok(m[0]))

    digits = lambda s: re.sub("[^0-9]", "", s)
    add("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    add("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        lambda s: all(int(p) <= 255 for p in s.split(".")))
    add("card", r"[0-9]([\x20-]?[0-9])+",
        lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s)))
    add("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15)
    return out


def secrets(text):
    text, out = text or "", []
    key = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for rank, (kind, pattern, ok) in enumerate((
            ("assign", key, lambda m: len(m[2]) >= 8),
            ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
            ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32))):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text) if ok(m)]
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def counts(text):
    text = text or ""
    words = re.findall(BLANK, text)
    lines = [x for x in text.split("\n") if re.search(BLANK, x)]
    seen, covered = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i:i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            covered.update(i + k for i in places for k in range(8))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(covered))


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
