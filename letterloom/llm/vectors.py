"""Embedding near-duplicates: sorted passes over random hashes, windows, exact counts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterloom.llm.arrays import flat, forest
from letterloom.llm.common import groups_of_links, stored

BITS = 48           # random hashes that one pass concatenates
BLOCK = 1_024       # vectors of a large group that are compared at once
MISS = 0.002        # wanted chance that no pass brings a pair at the limit together
ITEM = "vec array<double>"


def usable(vector, label):
    """A vector that can be linked: labelled, finite, without nulls, not zero."""
    return (label.isNotNull() & vector.isNotNull() & (F.size(vector) > 0)
            & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)
                       & (F.abs(x) < F.lit(float("inf"))))
            & F.exists(vector, lambda x: x != 0))


def passes_needed(n: int, window: int, min_cosine: float) -> int:
    """Passes after which a pair at ``min_cosine`` has met with probability 1 - ``MISS``,
    if vectors are spread evenly: a pass brings a pair together when its first hashes,
    as many as it takes to leave ``window`` of ``n`` vectors, agree."""
    agree = 1 - math.acos(min_cosine) / math.pi
    together = agree ** max(1.0, math.log2(max(n, 2) / window) + 1)
    return max(4, math.ceil(math.log(MISS) / math.log(1 - min(together, 0.95))))


def _matrix(batch) -> np.ndarray:
    values, offsets = flat(batch["vec"])
    rows = max(len(offsets) - 1, 1)
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1) \
        if len(offsets) > 1 else np.empty((0, 0))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # neither overflow nor underflow
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def hashed_passes(classes: DataFrame, passes: int, seed: int = 7) -> DataFrame:
    """Every class once per pass, with ``BITS`` signs of random projections as ``key``."""
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        powers = (1 << np.arange(BITS - 1, -1, -1)).astype(np.int64)
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims):
                part = pa.RecordBatch.from_arrays(
                    [c.filter(pa.array(dims == dim)) for c in batch.columns], batch.schema.names)
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, int(dim)]).standard_normal(
                        (int(dim), passes * BITS))
                unit = _unit(_matrix(part))
                for start in range(0, len(unit), 512):
                    piece = part.slice(start, 512)
                    signs = unit[start:start + 512] @ planes[dim] > 0
                    keys = signs.reshape(len(signs), passes, BITS) @ powers
                    for p in range(passes):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(signs), p, np.int32)), piece["label"],
                             piece["dim"], pa.array(keys[:, p]), piece["cid"], piece["vec"]],
                            ["pass", "label", "dim", "key", "cid", "vec"])

    return classes.select("label", "dim", "cid", "vec").mapInArrow(
        project, f"pass int, label string, dim int, key bigint, cid bigint, {ITEM}")


def _space(table) -> np.ndarray:
    """A number per row that changes where pass, label or dimension change."""
    change = np.zeros(table.num_rows, bool)
    for name in ("pass", "label", "dim"):
        column = table[name]
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        codes = column.dictionary_encode().indices.to_numpy()
        change[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(change)


def _links(table: pa.Table, window: int, least: float, seam: int | None = None):
    """Spanning links of the pairs within ``window`` rows of a sorted table; with
    ``seam`` only pairs across that row."""
    none = np.empty(0, np.int64)
    cid, space = table["cid"].to_numpy(), _space(table)
    x, y = [none], [none]
    starts = np.flatnonzero(np.diff(space, prepend=-1))
    for lo, hi in zip(starts, np.append(starts[1:], len(cid))):
        v = _unit(_matrix(table.slice(lo, hi - lo)))
        for step in range(1, min(window, hi - lo - 1) + 1):
            i = np.arange(lo, hi - step)
            if seam is not None:
                i = i[(i < seam) & (i + step >= seam)]
            if not len(i):
                continue
            close = np.einsum("ij,ij->i", v[i - lo], v[i - lo + step]) >= least
            x.append(i[close]), y.append(i[close] + step)
    root = forest(len(cid), np.concatenate(x), np.concatenate(y))
    linked = np.flatnonzero(root != np.arange(len(root)))
    return cid[linked], cid[root[linked]]


def window_links(hashed: DataFrame, window: int, min_cosine: float) -> DataFrame:
    """Links ``(a, b)`` between classes that are at most ``window`` places apart in the
    order of one pass. A range partition holds a stretch of the order; its first and last
    rows also go to the seam with the next one."""
    ordered = hashed.repartitionByRange("pass", "label", "dim", "key", "cid") \
        .sortWithinPartitions("pass", "label", "dim", "key", "cid") \
        .withColumn("part", F.spark_partition_id())
    schema = (f"a bigint, b bigint, seam int, place int, pass int, label string, dim int, "
              f"cid bigint, {ITEM}")
    names = ["a", "b", "seam", "place", "pass", "label", "dim", "cid", "vec"]

    def rows(n, **have):
        return pa.table([have[c] if c in have else pa.nulls(n, t) for c, t in zip(names, (
            pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(),
            pa.int64(), pa.list_(pa.float64())))], names)

    def edge(t, seam, first):
        n = t.num_rows
        return rows(n, seam=pa.array(np.full(n, seam, np.int32)),
                    place=pa.array(np.arange(first, first + n, dtype=np.int32)),
                    **{c: t[c].combine_chunks() for c in ("pass", "label", "dim", "cid", "vec")})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, part = None, 0
        for batch in batches:
            now = pa.Table.from_batches([batch])
            if not now.num_rows:
                continue
            if tail is None:
                part = batch["part"][0].as_py()
                yield from edge(now.slice(0, window), part, window).to_batches()
            elif seen < window:
                yield from edge(now.slice(0, window - seen), part, window + seen).to_batches()
            seen = now.num_rows if tail is None else seen + now.num_rows
            now = now if tail is None else pa.concat_tables([tail, now])
            a, b = _links(now, window, min_cosine)
            yield from rows(len(a), a=pa.array(a), b=pa.array(b)).to_batches()
            tail = now.slice(max(0, now.num_rows - window))
        if tail is not None:
            yield from edge(tail, part + 1, 0).to_batches()

    found = stored(ordered.mapInArrow(compare, schema), "windows")

    def across(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        seam = int((group["place"].to_numpy() < window).sum())
        a, b = _links(group, window, min_cosine, seam)
        return pa.table({"a": a, "b": b})

    return found.where("a IS NOT NULL").select("a", "b").union(
        found.where("seam IS NOT NULL").groupBy("seam").applyInArrow(across, "a bigint, b bigint"))


def _count_links(v, sizes, w, other_sizes, least):
    close = v @ w.T >= least
    return (close * other_sizes).sum(axis=1), (close * sizes[:, None]).sum(axis=0)


def exact_links(members: DataFrame, min_cosine: float) -> DataFrame:
    """``(cid, n)`` for every member ``(root, cid, size, vec)``: vectors of its group with
    the cosine, itself included.

    All pairs inside a group are compared but never become rows. Groups of up to
    ``BLOCK`` members are packed into tasks; a larger one is cut into blocks, and every
    pair of blocks is a task of its own.
    """
    sizes = members.groupBy("root").agg(F.count("*").alias("m"))
    parted = members.join(sizes, "root").withColumn(
        "blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn(
        "mine", F.pmod(F.xxhash64(F.lit(3), "cid"), "blocks").cast("int"))
    small = parted.where("blocks = 1").select(
        F.pmod(F.xxhash64("root"), F.lit(4_096)).alias("unit"), F.lit(0).alias("i"),
        F.lit(0).alias("j"), F.lit(0).alias("side"), "root", "cid", "size", "vec")
    # Block p meets block q once: as (p, q) with p <= q, p on side 0.
    large = parted.where("blocks > 1").select(
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "*").select(
        F.xxhash64("root").alias("unit"), F.least("mine", "other").alias("i"),
        F.greatest("mine", "other").alias("j"),
        F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"),
        "root", "cid", "size", "vec")

    def count(group: pa.Table) -> pa.Table:
        group = group.sort_by([("root", "ascending"), ("side", "ascending")])
        root, side = group["root"].to_numpy(), group["side"].to_numpy()
        cid, size = group["cid"].to_numpy(), group["size"].to_numpy()
        n = np.zeros(len(cid), np.int64)
        starts = np.flatnonzero(np.diff(root, prepend=root[0] - 1))
        for lo, hi in zip(starts, np.append(starts[1:], len(root))):
            v = _unit(_matrix(group.slice(lo, hi - lo)))
            cut = int((side[lo:hi] == 0).sum())
            s = size[lo:hi]
            if cut == len(s):
                close = v @ v.T >= min_cosine
                np.fill_diagonal(close, True)
                n[lo:hi] = (close * s).sum(axis=1)
            else:
                n[lo:lo + cut], n[lo + cut:hi] = _count_links(
                    v[:cut], s[:cut], v[cut:], s[cut:], min_cosine)
        return pa.table({"cid": cid, "n": n})

    return small.unionByName(large).groupBy("unit", "i", "j").applyInArrow(
        count, "cid bigint, n bigint").groupBy("cid").agg(F.sum("n").alias("n"))


def near_vectors(df: DataFrame, min_cosine: float = 0.93, window: int = 32, vec_id: str = "vec_id",
                 vector: str = "embedding", label: str = "label",
                 passes: int | None = None) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row.

    Rows with equal labels and a cosine of ``min_cosine`` or more are linked. Vectors that
    are equal in every component are one class, compared once. The sorted passes find
    which classes hang together (their number follows ``passes_needed``); links are then
    counted exactly inside each group, so a dense group is whole however it was found.
    Only a group whose connecting pairs all stay ``window`` places apart in every pass
    can be missed.

    Vectors of different length are not comparable. A null label, id or vector, a null or
    non-finite component, or all zeros: no links, its own id as component. Rows that
    repeat an id are vectors of their own. An empty table gives an empty table.
    """
    v = F.col(vector).cast("array<double>")
    rows = df.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"),
        F.when(usable(v, F.col(label)) & F.col(vec_id).isNotNull(), v).alias("vec"))
    key = [F.xxhash64(F.lit(s), "label", "vec") for s in (1, 2)]  # 128 bits name a class
    keyed = rows.select("*", key[0].alias("k1"), key[1].alias("k2"))
    classes = stored(keyed.where("vec IS NOT NULL").groupBy("k1", "k2").agg(
        F.min("vec_id").alias("cid"), F.count("*").alias("size"),
        F.first("label").alias("label"), F.first("vec").alias("vec"))
        .withColumn("dim", F.size("vec")), "classes")
    largest = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    passes = passes or passes_needed(largest, window, min_cosine)
    links = window_links(hashed_passes(classes, passes), window, min_cosine)
    groups = groups_of_links(links).withColumnRenamed("id", "cid")
    counts = exact_links(classes.join(groups, "cid").select("root", "cid", "size", "vec"), min_cosine)
    linked = classes.join(groups, "cid", "left").join(counts, "cid", "left").select(
        "k1", "k2", F.coalesce("root", "cid").alias("root"),
        (F.coalesce("n", "size") - 1).alias("n_links"))
    joined = keyed.select("vec_id", F.when(F.col("vec").isNotNull(), F.col("k1")).alias("k1"),
                          "k2").join(linked, ["k1", "k2"], "left")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("root", "vec_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
