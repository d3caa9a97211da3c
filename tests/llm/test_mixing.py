"""Weights and realised mixes against plain Python."""

import math
from collections import Counter, defaultdict

import pytest

from letterloom.llm import mixing, queries
from letterloom.llm.mixing import Goal

DATA = "/root/testdata/sf0.01"


def weights(tokens, a):
    z = sum(t ** a for t in tokens.values())
    return {s: t ** a / z for s, t in tokens.items()}


def plain_exponent(tokens, goal, budget):
    def entropy(a):
        return -sum(w * math.log(w) for w in weights(tokens, a).values())

    def most(a):
        return max(budget * w / tokens[s] for s, w in weights(tokens, a).items())

    def bisect(ok, low, high):  # ok(low); the greatest that is ok
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if ok(mid) else (low, mid)
        return low
    wanted = goal.entropy * math.log(len(tokens))
    if len(tokens) < 2 or entropy(1) >= wanted:
        return 1.0
    a = bisect(lambda x: entropy(x) >= wanted, 0, 1)
    if most(a) <= goal.repeats or most(1) > goal.repeats:
        return a if most(a) <= goal.repeats else 1.0
    return 1 - bisect(lambda x: most(1 - x) <= goal.repeats, 0, 1 - a)


@pytest.mark.parametrize("goal", [Goal(), Goal(entropy=0.999), Goal(entropy=1.0, repeats=1.5),
                                  Goal(budget=2000.0), Goal(budget=200_000.0), Goal(entropy=0.2)])
def test_mix_follows_the_weights(spark, goal):
    sizes = {"a": 300, "b": 60, "c": 5, None: 12}
    rows = [(i, "w " * (1 + (7 * i) % 23), s, 0) for s, n in sizes.items()
            for i in range(len(s or "") * 1000, len(s or "") * 1000 + n)]
    rows += [(9, "", "empty", 0), (10, None, "empty", 0)]
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, docs int")
    tokens = defaultdict(int)
    for _, t, s, _ in rows:
        tokens[s] += len((t or "").split())
    real = {s: t for s, t in tokens.items() if t}
    budget = goal.budget or sum(real.values())
    want = weights(real, plain_exponent(real, goal, budget))
    plan = {r.source: r for r in mixing.quotas(df, goal).collect()}
    assert plan.keys() == sizes.keys() | {"empty"} and plan["empty"].epochs == 1
    for s, w in want.items():
        assert plan[s].weight == pytest.approx(w, abs=1e-6)
        assert plan[s].quota == pytest.approx(min(w * budget, goal.repeats * real[s]), rel=1e-5)
    out = mixing.mixed(df, goal, order=True).collect()
    got, per_source = Counter(r.doc_id for r in out), defaultdict(int)
    for r in out:
        per_source[r.source] += len((r.text or "").split())
    for doc_id, text, s, _ in rows:
        assert 0 <= got[doc_id] - plan[s].epochs <= 1
    for s in real:
        # The front part is the longest that fits: one more document would go over.
        assert per_source[s] <= plan[s].quota + 1e-6
        assert per_source[s] > plan[s].quota - 24 or not plan[s].quota % real[s]
    epochs = defaultdict(set)
    for r in out:
        epochs[r.source, r.mix_epoch].add(r.mix_place)
    assert len({(r.doc_id, r.mix_epoch) for r in out}) == len(out)
    assert set(mixing.mixed(df, goal).columns) == set(df.columns)


def test_blocks_do_not_change_the_mix(spark, monkeypatch):
    df = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source")
    one = sorted(map(tuple, mixing.mixed(df, columns=["doc_id"]).collect()))
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 3)
    assert sorted(map(tuple, mixing.mixed(df, columns=["doc_id"]).collect())) == one


def test_query(spark):
    rows = queries.op4_mixing(spark, DATA).collect()
    docs = {r.doc_id: r.source for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert {r.doc_id: r.source for r in rows}.items() <= docs.items()
    total = Counter(r.source for r in rows)
    assert total.keys() == set(docs.values())
    assert max(total.values()) < 0.36 * len(rows) + 40


def test_repeated_rows_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, "c", "x"), (2, "d e f", "y")],
                               "doc_id long, text string, source string")
    assert mixing.mixed(df, Goal(entropy=0.0)).exceptAll(df).isEmpty()
    assert mixing.mixed(df.limit(0)).count() == 0 and mixing.quotas(df.limit(0)).count() == 0
