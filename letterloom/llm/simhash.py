"""SimHash near-duplicates: fingerprints, and a trie joined with itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.llm.arrays import flat, forest
from letterloom.llm.common import groups_of_links, let, stored, whole_text, words_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The part of the trie that deals out work: at least 2**MIN_BITS and at most 2**TOP_BITS
# leaves; between them a leaf is split only while it holds more than LEAF fingerprints,
# because every level sends each fingerprint to more pairs of leaves.
MIN_BITS, TOP_BITS, LEAF = 6, 12, 1 << 20
CHUNK = 1 << 18    # node pairs that a task expands at once


def shingle_hashes(text: Column, words: int = 3) -> Column:
    """XXH64 (UTF-8, seed 42) of every shingle of a text, A-Z lower-cased, repeats
    included; a text with fewer words has its whole sequence, one without words none."""
    def shingles(w):
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(
            F.size(w) < words, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: F.xxhash64(
                F.concat_ws(" ", *[F.get(w, i + k) for k in range(words)]))))
    return let(words_of(F.translate(text, UPPER, LOWER)), shingles)


def bit_majorities(hashes: np.ndarray, offsets: np.ndarray, chunk: int = 1 << 19) -> np.ndarray:
    """For every run of ``hashes`` the 64-bit number whose bits are set in over half."""
    ones = np.zeros((len(offsets) - 1, 64), np.int64)
    for start in range(0, len(hashes), chunk):
        stop = min(start + chunk, len(hashes))
        bits = np.unpackbits(np.ascontiguousarray(hashes[start:stop]).view(np.uint8)
                             .reshape(-1, 8), axis=1, bitorder="little")
        first = np.searchsorted(offsets, start, "right") - 1
        last = np.searchsorted(offsets, stop, "left")
        cuts = np.maximum(offsets[first:last], start) - start
        rows = np.flatnonzero(np.diff(np.append(cuts, stop - start)) > 0)
        ones[first + rows] += np.add.reduceat(bits, cuts[rows], axis=0, dtype=np.int64)
    majority = 2 * ones > np.diff(offsets)[:, None]
    return np.packbits(majority, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp)``: one row per row of ``docs``, ``fp`` the fingerprint as a long.

    Null, empty and blank texts have fingerprint 0; other columns are not looked at.
    """
    hashed = docs.select(F.col(doc_id).alias("doc_id"),
                         shingle_hashes(whole_text(text)).alias("hashes"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = flat(batch["hashes"])
            found = bit_majorities(values.to_numpy(zero_copy_only=False), offsets)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(found.view(np.int64))], ["doc_id", "fp"])

    kind = hashed.schema["doc_id"].dataType.simpleString()
    return hashed.mapInArrow(vote, f"doc_id {kind}, fp bigint")


def trie_pairs(a: np.ndarray, b: np.ndarray, budget: int, same: bool,
               chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ``a`` and ``b`` that differ in ``budget`` bits or fewer; each pair
    once if ``same`` (then ``a`` is ``b``).

    ``a`` and ``b`` are sorted, distinct and unsigned, so a trie node is a range. Node
    pairs go down together one bit at a time; a pair whose paths differ in more than
    ``budget`` bits is dropped with all below it. Wide fronts are cut in chunks and the
    deepest is expanded first, which bounds memory.
    """
    todo = [(63, np.array([[0, len(a), 0, len(b), 0]], np.int64))] if len(a) and len(b) else []
    while todo:
        bit, front = todo.pop()
        sizes = (front[:, 1] - front[:, 0]) * (front[:, 3] - front[:, 2])
        small = (sizes <= 16) | (bit < 0)
        if small.any():  # few leaves below: compare them directly
            n = sizes[small]
            which = np.repeat(np.arange(len(n)), n)
            rest = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            low = front[small][which]
            wide = low[:, 3] - low[:, 2]
            x, y = low[:, 0] + rest // wide, low[:, 2] + rest % wide
            near = np.bitwise_count(a[x] ^ b[y]) <= budget
            if same:
                near &= x < y
            if near.any():
                yield x[near], y[near]
            front = front[~small]
        if not len(front):
            continue
        a0, a1, b0, b1, diff = front.T
        one = np.uint64(1 << bit)
        low_bits = np.uint64((1 << (bit + 1)) - 1)
        am = np.searchsorted(a, (a[a0] & ~low_bits) | one)
        bm = np.searchsorted(b, (b[b0] & ~low_bits) | one)
        down = np.concatenate([
            np.stack([a0, am, b0, bm, diff], 1), np.stack([am, a1, bm, b1, diff], 1),
            np.stack([a0, am, bm, b1, diff + 1], 1), np.stack([am, a1, b0, bm, diff + 1], 1)])
        ok = (down[:, 4] <= budget) & (down[:, 0] < down[:, 1]) & (down[:, 2] < down[:, 3])
        if same:  # the mirrored half of a node with itself
            ok &= down[:, 0] <= down[:, 2]
        down = down[ok]
        todo += [(bit - 1, down[i:i + chunk]) for i in range(0, len(down), chunk)]


def _top_of_trie(counts: dict[int, int]) -> list[tuple[int, int]]:
    """Leaves ``(prefix, bits)`` that cover all fingerprints, split while they are large."""
    leaves, todo = [], [(0, 0, sorted(counts.items()))]
    while todo:
        prefix, bits, below = todo.pop()
        if not below:
            continue
        if bits == TOP_BITS or bits >= MIN_BITS and sum(n for _, n in below) <= LEAF:
            leaves.append((prefix, bits))
            continue
        shift = TOP_BITS - bits - 1
        for side in (0, 1):
            todo.append((prefix << 1 | side, bits + 1,
                         [x for x in below if x[0] >> shift & 1 == side]))
    return sorted(leaves, key=lambda x: x[0] << (TOP_BITS - x[1]))


def _leaf_pairs(leaves: list[tuple[int, int]], budget: int) -> list[tuple[int, int]]:
    """Pairs of leaves whose common bits differ in ``budget`` places or fewer."""
    prefix, bits = np.array(leaves, np.int64).reshape(-1, 2).T
    out = []
    for i in range(len(leaves)):
        short = np.minimum(bits[i], bits[i:])
        apart = (prefix[i] >> (bits[i] - short)) ^ (prefix[i:] >> (bits[i:] - short))
        out += [(i, i + int(j)) for j in np.flatnonzero(np.bitwise_count(apart) <= budget)]
    return out


def near_links(fps: DataFrame, budget: int = 2, chunk: int = CHUNK) -> DataFrame:
    """Links ``(a, b)`` that join all distinct fingerprints ``fp`` within ``budget`` bits
    into the same groups as all pairs would; not every pair is a row.

    The top of the trie (at most 2**TOP_BITS counts reach the driver) deals subtrees to
    tasks: each pair of subtrees that can hold near pairs is one group. A task joins
    its two subtrees and sends on a spanning forest of the pairs it found, at most one
    row per fingerprint, so dense groups do not grow quadratically.
    """
    spark = fps.sparkSession
    top = F.shiftrightunsigned("fp", 64 - TOP_BITS)
    counts = {r["p"]: r["n"] for r in
              fps.groupBy(top.alias("p")).agg(F.count("*").alias("n")).collect()}
    leaves = _top_of_trie(counts)
    leaf_of = [(p, i) for i, (prefix, bits) in enumerate(leaves)
               for p in range(prefix << (TOP_BITS - bits), (prefix + 1) << (TOP_BITS - bits))]
    pairs = _leaf_pairs(leaves, budget)
    sides = [(i, k, 0) for k, (i, _) in enumerate(pairs)]
    sides += [(j, k, 1) for k, (i, j) in enumerate(pairs) if i != j]
    # Both tables are bounded by TOP_BITS: 4,096 prefixes, 79 subtrees for each leaf.
    lookup = F.broadcast(spark.createDataFrame(leaf_of, "p bigint, leaf int").join(
        F.broadcast(spark.createDataFrame(sides, "leaf int, pair int, side int")), "leaf")
        .groupBy("p").agg(F.collect_list(F.struct("pair", "side")).alias("sides")))
    dealt = fps.withColumn("p", top).join(lookup, "p").select("fp", F.inline("sides"))

    def join(group: pa.Table) -> pa.Table:
        fp = group["fp"].to_numpy().view(np.uint64)
        side = group["side"].to_numpy()
        a, b = np.sort(fp[side == 0]), np.sort(fp[side == 1])
        same = not len(b)
        if same:
            b = a
        all_ = a if same else np.concatenate([a, b])
        shift = 0 if same else len(a)
        x, y, held = [], [], 0
        for i, j in trie_pairs(a, b, budget, same, chunk):
            x.append(i), y.append(j + shift)
            held += len(i)
            if held > 1 << 21:
                root = forest(len(all_), np.concatenate(x), np.concatenate(y))
                linked = np.flatnonzero(root != np.arange(len(root)))
                x, y, held = [linked], [root[linked]], len(linked)
        root = forest(len(all_), np.concatenate(x or [np.empty(0, np.int64)]),
                      np.concatenate(y or [np.empty(0, np.int64)]))
        linked = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": all_[linked].view(np.int64), "b": all_[root[linked]].view(np.int64)})

    return dealt.groupBy("pair").applyInArrow(join, "a bigint, b bigint")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                budget: int = 2) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``: documents whose
    fingerprints differ in ``budget`` bits or fewer are linked, ``component_id`` is the
    smallest doc_id reachable.

    Null and blank texts share fingerprint 0 and are linked like any other. Repeated
    ids are rows of their own; a null id has a group but never names it. No rows give
    no rows.
    """
    prints = stored(fingerprints(docs, doc_id, text), "prints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    groups = groups_of_links(near_links(classes.select("fp"), budget))
    rooted = classes.join(groups.withColumnRenamed("id", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return prints.join(rooted.join(named, "root").select("fp", "component_id"), "fp").select(
        "doc_id", "fp", "component_id")


def one_of_each_group(docs: DataFrame, budget: int = 2) -> DataFrame:
    """``docs`` with the row of each group whose doc_id names it. Ids must be unique and
    not null: a group without an id has no row here, and of rows that repeat an id only
    one stays. ``neardup.one_of_each_group`` chooses rows, whatever their ids, and is
    what the pipeline uses. Columns stay as they are."""
    groups = near_groups(docs, budget=budget)
    ids = groups.where("doc_id = component_id").select("doc_id")
    plain = ids.groupBy("doc_id").agg(F.count("*").alias("n"))
    kept = docs.join(plain.select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    if not plain.where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id"])
    return kept


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
