"""Long lines without spaces, with tabs, and with scattered edits against all pairs."""

import random

import pytest

from letterloom.llm import lines
from tests.llm import test_lines

ALPHABETS = {"cjk": ([chr(c) for c in range(0x4E00, 0x5200)], ""),
             "thai": ([chr(c) for c in range(0x0E01, 0x0E2F)], ""),
             "tabs": ([f"{k * 7919 % 10007}" for k in range(900)], "\t"),
             "commas": ([f"{k * 7919 % 10007}" for k in range(900)], ","),
             "encoded": (list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), ""),
             "prose": ([f"{a}{b}" for a in ("can", "ter", "lo", "mi") for b in (
                 "de", "ring", "s", "tion", "ly", "", "ble", "ma")], " ")}


def like(a, b):
    x, y = test_lines.shingles(a), test_lines.shingles(b)
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("kind", ALPHABETS)
def test_groups_of_edited_long_lines(spark, kind):
    """Every line has an edited copy at a similarity just above the limit, its first
    character changed too."""
    letters, between = ALPHABETS[kind]
    rng, docs = random.Random(kind), []
    for k in range(60):
        line = between.join(rng.choice(letters) for _ in range(400))[:130 + 4 * k]
        copy = "#" + line[1:]
        for at in rng.sample(range(1, len(line)), len(line) - 1):
            more = copy[:at] + "#" + copy[at + 1:]
            if like(line, more) < 0.8:
                break
            copy = more
        docs += [(2 * k, line), (2 * k + 1, copy)]
    want = test_lines.brute(docs)
    got = {(r.doc_id, r.line_no): (r.first_doc, r.first_line) for r in lines.line_groups(
        spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(want[p] != p for p in want) >= 60
    assert sum(got[p] != want[p] for p in want) <= 1
