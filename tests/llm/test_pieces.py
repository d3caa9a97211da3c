"""Encoding against the library, brute force and exact round trips."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from letterloom.llm import pieces, queries
from tests.llm.conftest import TEXTS

DATA = "/root/testdata/sf0.001"
MODEL = queries.PIECES


@pytest.fixture(scope="module")
def vocab():
    return pieces.load_vocabulary(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def small(scores):
    names = ["<unk>"] + list(scores)
    return pieces.Vocabulary(names, np.array([0.0, *scores.values()]),
                             np.array([pieces.UNKNOWN] + [pieces.NORMAL] * len(scores)), pieces.UNIGRAM)


def test_ids_equal_the_library(spark, vocab, library, texts):
    assert vocab.model == pieces.BPE and vocab.apart
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    for df in (docs, texts.withColumnRenamed("counts", "ids").select("doc_id", "text", "ids")):
        for r in pieces.encoded(df, vocab).collect():
            assert r.ids == (None if r.text is None else library.encode(r.text)), r.text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abetin  \n▁é😀"), st.characters(exclude_categories=["Cs"])),
               max_size=60))
def test_any_text_round_trips(text):
    vocab = _cached()
    tokens = pa.array([text.split(" ") if text else []], pa.list_(pa.string()))
    found = pieces.encode_lists(tokens, vocab, (vocab.model, pieces.UNIGRAM))
    ids = found[vocab.model]
    assert ids[0].as_py() == _library().encode(text)
    assert pieces.decode_lists(ids, vocab)[0].as_py() == text.replace("▁", " ")
    assert pieces.decode_lists(found[pieces.UNIGRAM], vocab)[0].as_py() == text.replace("▁", " ")


_CACHE = {}


def _cached():
    return _CACHE.setdefault("v", pieces.load_vocabulary(MODEL))


def _library():
    return _CACHE.setdefault("l", sentencepiece.SentencePieceProcessor(model_file=MODEL))


def _python_words(text):
    import re
    return re.findall("▁*[^▁]+|▁+$", "▁" + text.replace(" ", "▁"))


def test_viterbi_equals_all_splits():
    rng = np.random.default_rng(4)
    names = sorted({"".join(rng.choice(list("abc"), k)) for k in (1, 1, 2, 2, 2, 3, 3, 3, 4) for _ in range(6)})
    vocab = small({p: float(-rng.random() * 9) for p in names})
    score = dict(zip(vocab.pieces, vocab.scores))
    bad = min(vocab.scores[1:]) - 10
    words = ["".join(rng.choice(list("abcz"), n)) for n in (1, 2, 3, 5, 7, 8, 8, 9)]
    ids, bounds = pieces.split_words(words, vocab, (pieces.UNIGRAM,))[pieces.UNIGRAM]
    for i, w in enumerate(words):
        best = max(sum(score.get(p, bad if len(p) == 1 else -1e18) for p in split)
                   for cuts in itertools.product([0, 1], repeat=len(w) - 1)
                   for split in [_cut(w, cuts)])
        got, at = 0.0, 0
        for k in ids[bounds[i]:bounds[i + 1]]:
            got += vocab.scores[k] if k else bad
            at += len(vocab.pieces[k]) if k else 1
        assert at == len(w) and got == pytest.approx(best)


def _cut(word, cuts):
    out = [word[0]]
    for c, cut in zip(word[1:], cuts):
        if cut:
            out.append(c)
        else:
            out[-1] += c
    return out


def test_viterbi_never_scores_below_merges(vocab):
    words = [w for t in TEXTS if t and len(t) < 4000 for w in _python_words(t)] + ["▁inter" * 5, "▁"]
    total = {}
    for method in (pieces.UNIGRAM, pieces.BPE):
        ids, bounds = pieces.split_words(words, vocab, (method,))[method]
        sums = np.concatenate([[0], np.cumsum(np.where(vocab.kinds[ids] == pieces.NORMAL, vocab.scores[ids], 0))])
        total[method] = np.diff(sums[bounds])
    assert (total[pieces.UNIGRAM] >= total[pieces.BPE] - 1e-6).all()


def test_long_words_by_heap_equal_rounds(vocab, monkeypatch):
    words = ["▁internationalisation" * 9, "a" * 250, "0123456789" * 20, "éßab" * 50]
    one = pieces.split_words(words, vocab, (pieces.BPE,))[pieces.BPE]
    monkeypatch.setattr(pieces, "LONG_WORD", 0)
    two = pieces.split_words(words, vocab, (pieces.BPE,))[pieces.BPE]
    assert all((a == b).all() for a, b in zip(one, two))


def test_query_round_trips(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.op9_sentencepiece(spark, DATA).collect()
    assert len(rows) == len(docs) and all(r.round_trip for r in rows)
    for r in rows:
        assert r.ids == library.encode(docs[r.doc_id]) and r.n_pieces == len(r.ids)
        assert r.viterbi_round_trip and 0 < r.n_viterbi


def test_empty_table_and_unknown_pieces(spark, vocab, texts):
    assert pieces.encoded(texts.limit(0), vocab).count() == 0
    assert pieces.decoded(pieces.encoded(texts.limit(0), vocab), vocab).count() == 0
    vocab = small({"▁a": -1.0, "b": -2.0})
    df = spark.createDataFrame([("a bz",), ("",), (None,)], "text string")
    rows = pieces.decoded(pieces.encoded(df, vocab), vocab, out="back").collect()
    assert [r.ids for r in rows] == [[1, 0, 2, 0], [], None]
    assert [r.back for r in rows] == ["a ⁇ b ⁇ ", "", None]
