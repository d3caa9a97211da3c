"""The random field against sums over all label paths, and held-out accuracy."""

import itertools

import numpy as np
import pyarrow as pa

from letterloom.llm import langid, queries

DATA = "/root/testdata/sf0.01"


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(2)
    score, tr = rng.standard_normal((5, 3)) * 3, rng.standard_normal((3, 3))
    offsets = np.array([0, 4, 4, 5, 11])
    words = rng.integers(0, 5, 11)
    p, pairs = langid.forward_backward(words, offsets, score, tr, pairs=True)
    want, want_pairs = np.zeros((11, 3)), np.zeros((3, 3))
    for lo, hi in zip(offsets, offsets[1:]):
        if lo == hi:
            continue
        paths = list(itertools.product(range(3), repeat=hi - lo))
        weight = np.array([np.exp(sum(score[words[lo + t], y] for t, y in enumerate(path))
                                  + sum(tr[a, b] for a, b in zip(path, path[1:]))) for path in paths])
        for path, x in zip(paths, weight / weight.sum()):
            for t, y in enumerate(path):
                want[lo + t, y] += x
            for a, b in zip(path, path[1:]):
                want_pairs[a, b] += x
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs)


def test_features_do_not_depend_on_neighbours():
    words = ["a", "ab", "été", "straße", "😀b", "x" * 300, "ab"]
    def of(ws, i):
        ids, values, bounds = langid.word_features(pa.array(ws))
        at = slice(bounds[i], bounds[i + 1])
        return sorted(zip(ids[at].tolist(), values[at].round(6).tolist()))
    for i, w in enumerate(words):
        assert of(words, i) == of([w], 0)
        # Affixes, pairs with both ends, triples with both ends, the word.
        assert len(of([w], 0)) == 2 * min(len(w), 3) + len(w) + 1 + len(w) + 1
    assert of(words, 1) == of(words, 6)
    assert len(langid.word_features(pa.array([], pa.string()))[0]) == 0


def test_words_of_mixed_text_get_their_language(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("text", "lang")
    model = langid.train(docs)
    assert model.labels == ["de", "en", "es", "fr"] and model.transition.shape == (4, 4)
    assert all(model.transition[i, i] == model.transition[i].max() for i in range(4))
    en = "the and of with that this the thing".split()
    fr = "est un pour dans les que avec une".split()
    ids, values, bounds = langid.word_features(pa.array(en + fr))
    p = langid.forward_backward(np.arange(16), np.array([0, 16]),
                                langid.emissions(model.weights, ids, values, bounds), model.transition)
    found = [model.labels[i] for i in p.argmax(axis=1)]
    assert found.count("en") >= 7 and found.count("fr") >= 7
    assert set(found[:7]) == {"en"} and set(found[9:]) == {"fr"}


def test_held_out_accuracy(spark):
    rows = queries.op3_language_id(spark, DATA).join(
        spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r.lang == r.lang_pred for r in rows if r.held_out and r.lang]
    assert len(rows) == 1000 and len(held) > 100 and np.mean(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark, texts):
    model = langid.train(spark.createDataFrame(
        [("ein haus und der hund", "de"), ("the house and the dog", "en"), (None, "fr"), ("zut", None),
         ("123", "it")], "text string, lang string"))
    assert model.labels == ["de", "en"]
    rows = langid.predicted(texts.withColumnRenamed("counts", "score"), model).collect()
    assert len(rows) == texts.count()
    for r in rows:
        blank = not any(ch.isalpha() for ch in r.text or "")
        assert (r.lang_pred == "und") == blank and (r.score == 0) == blank
    none = langid.train(texts.selectExpr("text", "cast(null as string) as lang"))
    assert none.labels == []
    assert {r.lang_pred for r in langid.predicted(texts, none).collect()} == {"und"}
    assert langid.predicted(texts.limit(0), model).count() == 0
