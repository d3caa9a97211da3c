"""Runs of words against brute force."""

import binascii
import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from letterloom.llm import periods, queries

DATA = "/root/testdata/sf0.001"


def runs(words, min_length=6, min_repeats=4):
    out, n = [], len(words)
    for q in range(1, n // min_repeats + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if i > start and length >= max(min_length, min_repeats * q) and not any(
                    all(words[start + k] == words[start + k + d] for k in range(length - d))
                    for d in range(1, q)):
                out.append((start, length, q))
            i = max(i, start + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def shortened(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def looped(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = binascii.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def digests(doc_id, text):
    words = looped(doc_id, text)
    found = runs(words)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(found), *best, best[1] and 1000 * best[1] // best[2],
            sha("".join("%d,%d,%d\n" % r for r in found)), sha(" ".join(shortened(words, found))))


words = st.lists(st.tuples(st.lists(st.sampled_from("abc"), max_size=7), st.integers(1, 8)),
                 max_size=6).map(lambda x: [w.encode() for part, n in x for w in part * n])


@settings(max_examples=300, deadline=None)
@given(st.lists(words, max_size=5), st.sampled_from([(6, 4), (4, 3), (12, 5)]))
def test_runs_equal_brute_force(texts, limits):
    found = periods.runs_of_texts(texts, *limits)
    assert found == [runs(w, *limits) for w in texts]
    assert [periods.collapsed(w, r) for w, r in zip(texts, found)] == [
        shortened(w, r) for w, r in zip(texts, found)]


def test_long_runs_take_no_quadratic_work():
    assert periods.runs_of_texts([[b"a"] * 300_000, [b"x", b"y", b"z"] * 100_000]) == [
        [(0, 300_000, 1)], [(0, 300_000, 3)]]
    spread = [w for i in range(30_000) for w in (str(i).encode(), *b"a b c d e f".split())]
    assert periods.runs_of_texts([spread]) == [[]]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    rows = queries.op11_periodic_runs(spark, DATA).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == {d.doc_id: digests(d.doc_id, d.text) for d in docs}
    assert sum(r.n_runs > 0 for r in rows) > 10


def test_odd_texts_ids_and_columns(spark, texts):
    done = periods.periodic_runs(texts.withColumnRenamed("counts", "runs"))
    assert done.columns == ["doc_id", "runs", "collapsed"]
    same = periods.periodic_runs(texts, out="text", short="counts")
    assert same.columns == ["doc_id", "text", "counts"]
    split = lambda t: [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    expected = sorted((runs(w), b" ".join(shortened(w, runs(w))).decode())
                      for w in map(split, (r.text for r in texts.collect())))
    assert sorted(([tuple(r) for r in x.runs], x.collapsed) for x in done.collect()) == expected
    long = spark.createDataFrame([(1, "w " * 200_000), (1, "w " * 200_000), (None, None)],
                                 "doc_id long, text string")
    assert sorted((r.doc_id or 0, [tuple(x) for x in r.runs], r.collapsed)
                  for r in periods.periodic_runs(long).collect()) == [
        (0, [], ""), (1, [(0, 200_000, 1)], "w"), (1, [(0, 200_000, 1)], "w")]


def test_empty_table_and_limits(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, `a b` int")
    assert periods.periodic_runs(empty).collect() == []
    with pytest.raises(ValueError):
        periods.periodic_runs(empty, min_repeats=2)


def test_null_ids_in_the_query_text(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g h i j"), (None, None), (7, " ")],
                                 "doc_id long, text string")
    assert sorted(r.text.split() for r in queries.looped(docs).collect()) == sorted(
        looped(r.doc_id, r.text) for r in docs.collect())
