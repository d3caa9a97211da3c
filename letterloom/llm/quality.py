"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.llm.arrays import flat
from letterloom.llm.common import let, sample, whole_text, words_of

BUCKETS = 1 << 18
SHARDS = 4          # parts that learn on their own; their weights are averaged
EPOCHS = 6
TRAINING_ROWS = 16_000  # bound of the labelled sample
ALPHA, BETA, L1, L2 = 3.0, 1.0, 1e-5, 1e-6


def features(text: Column) -> Column:
    """Hash buckets of every word, and of every pair of neighbours, lower-cased; the last
    three say how long the text is and how much of it repeats."""
    def grams(w):
        n = F.greatest(F.size(w) - 1, F.lit(0))
        hashed = F.transform(w, lambda x: F.xxhash64(x))
        return let(hashed, lambda h: F.concat(
            F.transform(h, lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int")),
            F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(2), n), lambda a, b: F.pmod(
                F.xxhash64(a, b), F.lit(BUCKETS)).cast("int"))))

    def shape(w):
        # Marks count like words, so that they weigh the same in short and long texts.
        repeated = F.floor(F.lit(10) * (F.size(w) - F.size(F.array_distinct(w)))
                           / F.greatest(F.size(w), F.lit(1)))
        marks = F.array(
            F.concat(F.lit("\u0001length "), F.floor(F.log2(F.size(w) + F.lit(1.0))).cast("string")),
            F.concat(F.lit("\u0001repeats "), repeated.cast("string")))
        return F.transform(marks, lambda m: F.pmod(F.xxhash64(m), F.lit(BUCKETS)).cast("int"))

    def signs(w):
        # What the ends of words look like, apart from the words themselves.
        return F.transform(w, lambda x: F.pmod(F.xxhash64(F.lit(2), F.regexp_extract(
            x, r"[^\p{L}]*$", 0)), F.lit(BUCKETS)).cast("int"))

    return let(words_of(F.lower(text)), lambda w: F.concat(grams(w), shape(w), signs(w)))


def _sparse_parts(ids: np.ndarray, offsets: np.ndarray, rows: int = 250
                  ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_sparse`` of many rows, ``rows`` at a time: sorting the features of a whole
    shard at once would take several times their size."""
    ids_of, values, bounds = [np.zeros(0, np.int32)], [np.zeros(0)], [np.zeros(1, np.int64)]
    for lo in range(0, len(offsets) - 1, rows):
        at = offsets[lo:lo + rows + 1]
        i, x, b = _sparse(ids[at[0]:at[-1]], at - at[0])
        ids_of.append(i.astype(np.int32))
        values.append(x)
        bounds.append(bounds[-1][-1] + b[1:])
    return np.concatenate(ids_of), np.concatenate(values), np.concatenate(bounds)


def _sparse(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct features of each row with values that have norm 1 (log of counts)."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    key, count = np.unique(row * BUCKETS + ids.astype(np.int64), return_counts=True)
    row, ids = key // BUCKETS, key % BUCKETS
    value = 1 + np.log(count)
    norm = np.sqrt(np.bincount(row, value * value, len(offsets) - 1))
    bounds = np.searchsorted(row, np.arange(len(offsets)))
    return ids, value / norm[row], bounds


def follow_the_leader(ids, values, bounds, labels, order, epochs: int = EPOCHS) -> np.ndarray:
    """Weights after ``epochs`` rounds of FTRL-proximal updates, one row at a time."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(zi, ni):
        w = (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    for _ in range(epochs):
        for r in order:
            at = slice(bounds[r], bounds[r + 1])
            i = np.append(ids[at], BUCKETS)  # the last is the intercept
            x = np.append(values[at], 1.0)
            w = weights(z[i], n[i])
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - labels[r]) * x
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - step * w
            n[i] += g * g
    return weights(z, n)


def train(labelled: DataFrame, text: str = "text", label: str = "label",
          rows: int = TRAINING_ROWS) -> np.ndarray:
    """Weights (``BUCKETS`` and an intercept) from rows with a label 0 or 1.

    At most about ``rows`` rows are used, chosen by the hash of text and label (rows with
    a null label are ignored). They are dealt to ``SHARDS`` tasks by hash; each learns on
    its own part, and the driver averages the weights, whose size is fixed. Without rows
    all weights are zero, and every text scores one half.
    """
    known = labelled.where(F.col(label).isin(0, 1)).select(
        whole_text(text).alias("t"), F.col(label).cast("int").alias("y"))
    chosen = sample(known, rows, "t", "y").select(
        F.pmod(F.xxhash64(F.lit(9), "t", "y"), F.lit(SHARDS)).alias("shard"),
        F.xxhash64("t", "y").alias("place"), "y", features(F.col("t")).alias("ids"))

    def learn(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")  # an order that does not depend on the tasks
        values, offsets = flat(group["ids"])
        ids, x, bounds = _sparse_parts(values.to_numpy(zero_copy_only=False), offsets)
        n, labels = group.num_rows, group["y"].to_numpy()
        del group, values
        w = follow_the_leader(ids, x, bounds, labels, range(n))
        return pa.table({"n": pa.array([n], pa.int64()),
                         "w": pa.array([w.tobytes()], pa.binary())})

    parts = chosen.groupBy("shard").applyInArrow(learn, "n bigint, w binary").collect()
    seen = sum(r.n for r in parts)
    return sum((np.frombuffer(r.w) * (r.n / seen) for r in parts), np.zeros(BUCKETS + 1))


def scored(docs: DataFrame, weights: np.ndarray, text: str = "text", out: str = "score") -> DataFrame:
    """Adds ``out``: the probability of label 1, the logistic of a sparse dot product over
    the features of the whole text. Null and empty texts have only the length features.
    Rows are independent; an existing column ``out`` is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # BUCKETS + 1 numbers
    work = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != out],
                       features(whole_text(text)).alias("llm feature ids"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in work.schema.fields[:-1])

    def dot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            score = np.empty(batch.num_rows)
            for start in range(0, batch.num_rows, 500):  # keeps the sparse rows small
                part = batch.slice(start, 500)
                values, offsets = flat(part.column(part.num_columns - 1))
                ids, x, bounds = _sparse(values.to_numpy(zero_copy_only=False), offsets)
                total = np.concatenate([[0.0], np.cumsum(w[ids] * x)])
                dots = total[bounds[1:]] - total[bounds[:-1]] + w[-1]
                score[start:start + part.num_rows] = 1 / (1 + np.exp(-np.clip(dots, -35, 35)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(score)], [*batch.schema.names[:-1], out])

    return work.mapInArrow(dot, schema + (", " if schema else "") + f"`{out}` double")
