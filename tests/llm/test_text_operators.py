"""Spans and counts of whole texts against plain Python."""

import hashlib

import pytest

from letterloom.llm import pii, queries, rules, secrets
from letterloom.llm.spans import joined
from tests.llm import brute

DATA = "/root/testdata/sf0.001"


def of_kinds(spans, kinds):
    return [(s.kind, s.start, s.end) for s in spans if s.kind in kinds]


def test_pii_equals_plain_patterns(texts):
    for r in pii.find_pii(texts).collect():
        assert of_kinds(r.pii, pii.BASE) == brute.pii(r.text), r.text


def test_pii_extra_spans_need_checksum_or_context(spark):
    rows = [("pay to iban DE89 3704 0044 0532 0130 00 ok",), ("DE88 3704 0044 0532 0130 00",),
            ("ssn 123-45-6789",), ("part 123-45-6789",)]
    found = [of_kinds(r.pii, pii.EXTRA) for r in pii.find_pii(
        spark.createDataFrame(rows, "text string")).collect()]
    assert found == [[("iban", 12, 39)], [], [("ssn", 4, 15)], []]


def test_masking_keeps_length(texts):
    for r in pii.masked(pii.find_pii(texts)).withColumnRenamed("text", "hidden").join(
            texts.withColumnRenamed("text", "text"), "counts").collect():
        assert (r.hidden is None) == (r.text is None)
        if r.text is not None:
            assert len(r.hidden) == len(r.text)
            assert all(set(r.hidden[s.start:s.end]) <= {"*"} for s in r.pii)


def test_secrets_equal_plain_patterns(texts):
    model = secrets.train_markov(secrets.labelled_strings(texts))
    for r in secrets.find_secrets(texts, model).collect():
        assert of_kinds(r.secrets, secrets.BASE) == brute.secrets(r.text), r.text


def test_markov_tells_random_from_ordinary(spark):
    labelled = spark.createDataFrame(
        [(hashlib.sha256(str(i).encode()).hexdigest()[:20], True) for i in range(300)]
        + [(w, False) for w in ("connection_manager", "the_quick_brown_fox", "getElementById",
                                "internationalisation", "parse-arguments", None)], "token string, random boolean")
    model = secrets.train_markov(labelled)
    rows = [("key 9f8e7d6c5b4a39281706f5e4d3c2b1",), ("see internationalisation2connection_manager",)]
    found = [[s.kind for s in r.secrets] for r in secrets.find_secrets(
        spark.createDataFrame(rows, "text string"), model).collect()]
    assert found == [["random"], []]


def test_counts_equal_plain_python(texts):
    got = rules.text_counts(texts.drop("counts")).collect()
    for r in got:
        c = r.counts
        assert (c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines,
                c.n_repeat_words) == brute.counts(r.text), r.text


def test_cascade_order_never_changes_a_verdict(texts):
    counted = rules.text_counts(texts)
    order = [r for r, _, _ in rules.ranked(counted, rules.standard_rules())]
    assert sorted(r.name for r in order) == sorted(r.name for r in rules.standard_rules())
    one = rules.cascade(counted, order).select("doc_id", "text", "kept")
    two = rules.cascade(counted, order[::-1]).select("doc_id", "text", "kept")
    assert one.exceptAll(two).isEmpty() and one.count() == texts.count()
    kept = {r.text: r.kept for r in one.collect()}
    assert not kept["&&& %%% ###"] and kept["one"]


@pytest.mark.parametrize("name,plain", [("op1_pii", brute.pii), ("op10_secrets", brute.secrets)])
def test_queries_equal_plain_patterns(spark, name, plain):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.QUERIES[name](spark, DATA).collect()
    assert len(rows) == len(docs)
    for r in rows:
        spans = joined_text = brute.joined(plain(docs[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(joined_text.encode()).hexdigest(), spans


def test_rules_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.op7_quality_rules(spark, DATA).collect()
    assert len(rows) == len(docs)
    for r in rows:
        c = brute.counts(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == c
        assert r.base_failed == (c[0] < 20 or 100 * c[4] > 30 * c[0])
        assert not (r.base_failed and r.kept)


@pytest.mark.parametrize("op", [
    lambda d: pii.find_pii(d), lambda d: rules.text_counts(d),
    lambda d: secrets.find_secrets(d, secrets.train_markov(secrets.labelled_strings(d)))])
def test_empty_tables(texts, op):
    assert op(texts.limit(0)).count() == 0


def test_joined_is_empty_without_spans(texts):
    assert pii.find_pii(texts.where("text = ''")).select(joined(pii.F.col("pii"))).first()[0] == ""


def test_rules_query_equals_sql(spark):
    from checks.compare import connect, differences

    df = queries.op7_quality_rules(spark, DATA)
    assert not differences(connect(DATA), df, queries.ORACLES["op7_quality_rules"])
