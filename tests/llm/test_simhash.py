"""Fingerprints and groups against brute force."""

import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from letterloom.llm import queries, simhash

DATA = "/root/testdata/sf0.001"
A_TO_Z = str.maketrans(simhash.UPPER, simhash.LOWER)


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(A_TO_Z))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or (
        [" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, prints, budget=2):
    low = dict(zip(ids, ids))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i
    for i, a in zip(ids, prints):
        for j, b in zip(ids, prints):
            if i < j and (a ^ b).bit_count() <= budget:
                x, y = find(i), find(j)
                low[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2 ** 64 - 1), max_size=40), st.lists(st.integers(0, 9), max_size=40),
       st.integers(0, 3), st.integers(1, 64))
def test_trie_finds_every_near_pair(base, flips, budget, chunk):
    near = [b ^ (1 << (7 * f)) ^ (1 << f) for b, f in zip(base, flips)]
    a = np.unique(np.array(base + near, np.uint64))
    b = np.unique(np.array(near + base[:3], np.uint64))
    for one, two, same in ((a, a, True), (a, b, False)):
        found = sorted((int(i), int(j)) for x, y in simhash.trie_pairs(one, two, budget, same, chunk)
                       for i, j in zip(x, y))
        assert found == [(i, j) for i in range(len(one)) for j in range(len(two))
                         if (i < j or not same) and (int(one[i]) ^ int(two[j])).bit_count() <= budget]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    rows = queries.op8_simhash(spark, DATA).collect()
    prints = {d.doc_id: fingerprint(d.text) for d in docs}
    assert {r.doc_id: r.fingerprint for r in rows} == {k: f"{v:016x}" for k, v in prints.items()}
    assert {r.doc_id: r.component_id for r in rows} == components(list(prints), list(prints.values()))


def test_subtrees_join_as_one(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 20)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2 ** 63, 300, dtype=np.uint64) & np.uint64((1 << 56) - 1)
    fps = np.unique(np.concatenate([base, base ^ np.uint64(1 << 55), base ^ np.uint64(5 << 51)]))
    links = simhash.near_links(spark.createDataFrame(
        [(int(x),) for x in fps.view(np.int64)], "fp long")).collect()
    low = {int(x): int(x) for x in fps}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i
    for r in links:
        x, y = find(r.a), find(r.b)
        assert (r.a ^ r.b) >= 0
        low[max(x, y)] = min(x, y)
    assert {i: find(i) for i in low} == components([int(x) for x in fps], [int(x) for x in fps])


def test_odd_rows(texts):
    rows = simhash.near_groups(texts).collect()
    assert len(rows) == texts.count()
    blank = [r for r in rows if r.fp == 0]
    assert len(blank) >= 4 and len({r.component_id for r in blank}) == 1
    kept = simhash.one_of_each_group(texts)
    assert kept.columns == texts.columns
    groups = {r.component_id for r in rows}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(groups - {None})


def test_empty_table(texts):
    assert simhash.near_groups(texts.limit(0)).count() == 0
    assert simhash.one_of_each_group(texts.limit(0)).count() == 0


@pytest.mark.parametrize("sizes", [[0, 3, 0, 5000, 1], [1], []])
def test_majorities_over_chunks(sizes):
    rng = np.random.default_rng(1)
    hashes = rng.integers(-2 ** 63, 2 ** 63 - 1, sum(sizes), dtype=np.int64)
    offsets = np.cumsum([0] + sizes)
    got = simhash.bit_majorities(hashes, offsets, chunk=7)
    for i in range(len(sizes)):
        part = hashes[offsets[i]:offsets[i + 1]].view(np.uint64)
        want = sum(1 << b for b in range(64)
                   if 2 * sum(int(h) >> b & 1 for h in part) > len(part))
        assert int(got[i]) == want
