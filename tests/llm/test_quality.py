"""The classifier: its parts against plain code, and how well it does on held-out rows."""

import re

import numpy as np
from pyspark.sql import functions as F

from letterloom.llm import quality, queries

DATA = "/root/testdata/sf0.01"


def test_updates_equal_plain_ftrl():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 50, 6)) for _ in range(40)]
    labels = np.array([int(3 in r or 7 in r) for r in rows])
    ids, bounds = np.concatenate(rows), np.cumsum([0] + [len(r) for r in rows])
    values = np.ones(len(ids)) / 2
    got = quality.follow_the_leader(ids, values, bounds, labels, range(40), epochs=3)
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0)) <= quality.L1:
            return 0.0
        s = 1 if z[i] > 0 else -1
        return (s * quality.L1 - z[i]) / ((quality.BETA + n[i] ** .5) / quality.ALPHA + quality.L2)
    for _ in range(3):
        for r, y in zip(rows, labels):
            x = {int(i): .5 for i in r} | {quality.BUCKETS: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                step = ((n.get(i, 0) + g * g) ** .5 - n.get(i, 0) ** .5) / quality.ALPHA
                z[i] = z.get(i, 0) + g - step * w[i]
                n[i] = n.get(i, 0) + g * g
    assert np.allclose(got[list(z)], [weight(i) for i in z]) and np.count_nonzero(got) <= len(z)


def test_score_is_the_dot_product(spark, texts):
    w = np.random.default_rng(1).standard_normal(quality.BUCKETS + 1)
    df = texts.withColumnRenamed("counts", "score")
    ids = {(r.doc_id, r.text): r.ids for r in texts.select(
        "doc_id", "text", quality.features(quality.whole_text()).alias("ids")).collect()}
    rows = quality.scored(df, w).collect()
    assert len(rows) == texts.count()
    for r in rows:
        found, n = np.unique(ids[r.doc_id, r.text], return_counts=True)
        x = 1 + np.log(n)
        dot = w[found] @ x / np.sqrt(x @ x) + w[-1]
        assert abs(r.score - 1 / (1 + np.exp(-dot))) < 1e-9
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        assert len(ids[r.doc_id, r.text]) == len(words) * 2 + max(0, len(words) - 1) + 2


def test_held_out_accuracy(spark):
    rows = queries.op6_quality_classifier(spark, DATA).join(
        spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("held_out").collect()
    good = [r.predicted for r in rows if r.quality == 1]
    assert len(good) > 20 and np.mean(good) > 0.97
    bad = [r.score for r in rows if r.quality == 0]
    assert np.mean([a < b for a in bad for b in (r.score for r in rows if r.quality == 1)]) > 0.9


def test_without_labels_and_rows(spark, texts):
    none = spark.createDataFrame([("a", None), (None, 1), (None, None)], "text string, label int")
    assert not quality.train(none.where("label IS NULL")).any()
    assert quality.train(none).any()
    w = quality.train(texts.limit(0).withColumn("label", F.lit(1)))
    assert {r.score for r in quality.scored(texts, w).collect()} == {0.5}
    assert quality.scored(texts.limit(0), w).count() == 0


def test_rows_of_a_shard_are_made_sparse_in_parts():
    """The same rows as at once, in a fraction of the memory."""
    import tracemalloc

    rng = np.random.default_rng(3)
    lengths = rng.integers(0, 1500, 2000)
    offsets = np.append(0, np.cumsum(lengths))
    ids = rng.integers(0, quality.BUCKETS, offsets[-1]).astype(np.int32)
    made = []
    for work in (quality._sparse, quality._sparse_parts):
        tracemalloc.start()
        made.append((work(ids, offsets), tracemalloc.get_traced_memory()[1]))
        tracemalloc.stop()
    (whole, much), (parts, little) = made
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts))
    assert little < 0.6 * much, (much, little)
    empty = quality._sparse_parts(ids[:0], np.zeros(1, np.int64))
    assert [len(x) for x in empty] == [0, 0, 1]
