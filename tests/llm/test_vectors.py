"""Vector groups against all pairs."""

import numpy as np
import pytest

from checks.compare import connect, differences
from letterloom.llm import queries, vectors

DATA = "/root/testdata/sf0.001"


def brute(rows, least):
    unit = {}
    for i, (vec_id, v, label) in enumerate(rows):
        if vec_id is None or label is None or v is None or any(x is None for x in v):
            continue
        v = np.array(v, float)
        if len(v) and np.isfinite(v).all() and v.any():
            unit[i] = v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max())
    low = {i: i for i in unit}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i
    n = dict.fromkeys(unit, 0)
    for i in unit:
        for j in unit:
            if i != j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) \
                    and unit[i] @ unit[j] >= least:
                n[i] += 1
                low[find(i)] = find(j)
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        if i not in unit:
            out.append((vec_id, 0, vec_id, True))
            continue
        root = min(rows[j][0] for j in unit if find(j) == find(i))
        out.append((vec_id, n[i], root, vec_id == root))
    return sorted(out, key=str)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def test_clusters_copies_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(3)
    rows = []
    for c, n in enumerate((120, 30, 2, 2, 1, 1)):
        centre = rng.standard_normal(12)
        for _ in range(n):
            rows.append([float(np.float32(x)) for x in centre + rng.standard_normal(12) * 0.12])
    rows += [rows[0]] * 9 + [[0.0] * 12, [float("nan")] * 12, [1e30] * 12, [2e30] * 12, [1.0] * 5, []]
    data = [(1000 - i, v, i % 2 if i > 150 else 0) for i, v in enumerate(rows)]
    data += [(2000, None, 1), (None, rows[3], 0), (2001, rows[3], None), (2002, [None, 1.0], 0),
             (999, rows[1], 0)]
    data = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], k)
            for i, v, k in data]
    df = spark.createDataFrame([(*r, "clash") for r in data], SCHEMA)
    assert collected(vectors.near_vectors(df, window=4)) == brute(data, 0.93)


def test_query_equals_sql(spark):
    df = queries.op2_embedding_neardup(spark, DATA)
    assert not differences(connect(DATA), df, queries.ORACLES["op2_embedding_neardup"])


def test_empty_and_unlinked(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert vectors.near_vectors(empty).count() == 0
    one = spark.createDataFrame([(1, [1.0, 0.0], 0, ""), (2, [0.0, 1.0], 0, "")], SCHEMA)
    assert collected(vectors.near_vectors(one)) == [(1, 0, 1, True), (2, 0, 2, True)]


@pytest.mark.parametrize("n", [100, 10_000, 10 ** 7])
def test_more_rows_take_more_passes(n):
    assert vectors.passes_needed(n, 32, 0.93) <= vectors.passes_needed(10 * n, 32, 0.93)
