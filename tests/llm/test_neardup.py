"""Near-duplicate documents against all pairs."""

import random
import re

import corpus_pipeline
from letterloom.llm import neardup

DATA = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def near_pairs(texts, least=0.8):
    sets = [shingles(t) for t in texts]
    return [(i, j) for j in range(len(sets)) for i in range(j)
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]


def roots(n, pairs):
    low = list(range(n))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i
    for i, j in pairs:
        x, y = find(i), find(j)
        low[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"new{rng.random()}"
    return " ".join(words)


def test_stage_keeps_one_of_every_near_copy(spark):
    """Copies of 100 and 300 words with one to six changed words, around the limit."""
    rng, texts = random.Random(4), []
    for k in range(240):
        words = [f"w{rng.randrange(5000)}" for _ in range(100 if k % 2 else 300)]
        texts += [" ".join(words), edited(rng, words, 1 + k % 6)]
    pairs = near_pairs(texts)
    assert 150 < len(pairs) < 240  # some of the copies are beyond the limit
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.simhash_stage(spark, docs, DATA)
    assert out.columns == docs.columns
    want, got = set(roots(len(texts), pairs)), {r.doc_id for r in out.collect()}
    assert want <= got and len(got - want) <= 0.01 * len(pairs)


def test_keys_bring_pairs_at_the_limit_together():
    """Share of pairs at similarity 0.8 that have a key in common."""
    import numpy as np
    rng = np.random.default_rng(2)
    met = 0
    for _ in range(1500):
        both = rng.integers(0, 1 << 63, 80, np.uint64)
        sides = [np.concatenate([both, rng.integers(0, 1 << 63, 10, np.uint64)]) for _ in range(2)]
        keys = neardup.minhash_keys(np.concatenate(sides), np.array([0, 90, 180]), chunk=100)
        met += bool((keys[0] == keys[1]).any())
    assert met >= 0.996 * 1500


def test_documents_of_the_given_table(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()
    texts = [r.text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
             for r in rows]
    want = roots(len(texts), near_pairs(texts))
    got = neardup.one_of_each_group(spark.createDataFrame(rows)).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows[i].doc_id for i in set(want))
    assert {r.doc_id: r for r in got}.items() <= {r.doc_id: r for r in rows}.items()


def test_every_group_keeps_a_row_whatever_its_ids(spark):
    """Null ids, one id on two texts, and rows that repeat both."""
    rng = random.Random(8)
    texts = [[f"w{rng.randrange(5000)}" for _ in range(300)] for _ in range(6)]
    near = [edited(rng, t, 3) for t in texts]
    text = [" ".join(t) for t in texts]
    rows = [(None, text[0]), (None, near[0]), (None, text[1]),           # no ids at all
            (7, text[2]), (9, near[2]), (7, text[3]), (8, near[3]),      # 7 names two groups
            (5, text[4]), (6, near[4]), (6, text[5]), (6, text[5]), (4, near[5]),
            (None, None), (None, ""), (None, "two words"), (None, "two words")]
    group = [0, 0, 1, 2, 2, 3, 3, 4, 4, 5, 5, 5, 6, 6, 7, 7]
    df = spark.createDataFrame([(*r, k) for r, k in zip(rows, group)],
                               "doc_id long, text string, rid int")
    out = neardup.one_of_each_group(df)
    assert out.columns == df.columns
    kept = {r.rid: r.doc_id for r in out.collect()}
    assert out.count() == 8 and kept == {0: None, 1: None, 2: 7, 3: 7, 4: 5, 5: 4, 6: None, 7: None}
    assert neardup.one_of_each_group(df.limit(0)).count() == 0


def test_trie_brings_documents_with_near_fingerprints_together(spark, monkeypatch):
    """Without a single MinHash key, copies within three bits are still found, others not met."""
    import numpy as np
    rng = random.Random(6)
    texts = []
    for k in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(900)]
        texts += [" ".join(words), " ".join(words + [f"end{k}"])]
    monkeypatch.setattr(neardup, "minhash_keys", lambda values, offsets: np.arange(
        values[0] & np.uint64((1 << 62) - 1), len(offsets) - 1 + int(values[0] & np.uint64((1 << 62) - 1)),
        dtype=np.uint64)[:, None].repeat(neardup.BANDS, 1))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    signed = neardup.signed_documents(docs, "doc_id", "text").collect()
    prints = {r.doc_id: r.fp for r in signed}
    near = sum(((prints[2 * k] ^ prints[2 * k + 1]) & (1 << 64) - 1).bit_count() <= neardup.BITS for k in range(60))
    assert near > 50 and len({r.h for r in signed}) == 120
    assert neardup.one_of_each_group(docs).count() == 120 - near
