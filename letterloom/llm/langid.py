"""Language of words in code-switched text: a linear-chain conditional random field."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from letterloom.llm.arrays import flat
from letterloom.llm.common import stored, whole_text

BUCKETS = 1 << 17
SHARDS = 4             # parts that learn on their own; their weights are averaged
TRAINING_ROWS = 6_000  # bound of the training sample, shared out by size, but
LEAST_ROWS = 300       # so many texts of every language, or all that it has
EPOCHS = 2
SEQUENCE = 128         # words of one training sequence
BATCH = 32             # sequences of one update
RATE = 0.4
WORDS = 2_000_000      # words that a task holds at once, besides one whole text
UNKNOWN = "und"


def letters(text: Column) -> Column:
    """Lower-cased runs of letters of a text."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}]+"), lambda w: w.rlike(r"\p{L}"))


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xC4CEB9FE1A85EC53) >> np.uint64(47)  # 17 bits: BUCKETS


def word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature buckets and values of every word, and their offsets by word: prefixes and
    suffixes of one to three characters, n-grams of two and three (with marks for the
    ends, together of weight two), and the whole word (lexicon)."""
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.float32), np.zeros(1, np.int64)
    joined = "\n" + "\n".join(words.to_pylist()) + "\n\n"
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.flatnonzero(c == 10)[:-1]
    first, last = ends[:-1] + 1, ends[1:]  # word i is c[first[i]:last[i]]
    n, size = len(words), last - first
    which = np.zeros(len(c), np.int64)
    which[first] = 1
    which = np.cumsum(which) - 1
    prime = np.uint64(0x100000001B3)
    ids, values, rows = [], [], []

    def put(hashed, salt, row, value):
        ids.append(_mix(hashed, salt).astype(np.int64))
        rows.append(row)
        values.append(np.broadcast_to(value, len(row)).astype(np.float32))

    row = np.arange(n)
    head, tail = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for k in (1, 2, 3):
        has = size >= k
        head[has] = head[has] * prime + c[first[has] + k - 1]
        tail[has] = tail[has] * prime + c[last[has] - k]
        put(head[has], k, row[has], 1.0)
        put(tail[has], 3 + k, row[has], 1.0)
    # n-grams start at a word's front mark or inside it and stop at its end mark.
    pair = c[:-1] * prime + c[1:]
    at = np.arange(last[-1])
    owner = np.where(c[at] == 10, which[at] + 1, which[at]).clip(0, n - 1)
    put(pair[at], 7, owner, 1.0 / (size[owner] + 1))
    three = at[(at + 2 < len(c)) & (c[at + 1] != 10)]
    owner = np.where(c[three] == 10, which[three] + 1, which[three]).clip(0, n - 1)
    put(pair[three] * prime + c[three + 2], 8, owner, 1.0 / size[owner])
    # The whole word: a sum of mixed characters with their places.
    place = np.arange(len(c)) - first[which.clip(0, n - 1)]
    inside = (c != 10) & (which >= 0)
    mixed = (c * prime + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) \
        * np.uint64(0xFF51AFD7ED558CCD)
    mixed ^= mixed >> np.uint64(29)
    whole = np.zeros(n, np.uint64)
    np.add.at(whole, which[inside], mixed[inside])
    put(whole, 9, row, 1.0)
    rows = np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    return (np.concatenate(ids)[order], np.concatenate(values)[order],
            np.searchsorted(rows[order], np.arange(n + 1)))


def emissions(w: np.ndarray, ids, values, bounds) -> np.ndarray:
    """Score of every label for every word; every word has a feature."""
    if len(bounds) < 2:
        return np.zeros((0, w.shape[1]), np.float32)
    return np.add.reduceat(w[ids] * values[:, None], bounds[:-1], axis=0)


def forward_backward(words: np.ndarray, offsets: np.ndarray, score: np.ndarray,
                     transition: np.ndarray, pairs: bool = False):
    """Label probabilities of every word of ragged sequences ``words[offsets[i]:...]``
    (numbers into ``score``), and the expected label pairs if asked for.

    All sequences advance together, the longest first, so the ones still running are a
    front part; every step is scaled, so nothing underflows.
    """
    n_labels = score.shape[1]
    e = np.exp(score - score.max(axis=1, keepdims=True))
    a = np.exp(transition - transition.max())
    size = np.diff(offsets)
    order = np.argsort(-size, kind="stable")
    start, size = offsets[:-1][order], size[order]
    steps = int(size[0]) if len(size) else 0
    running = np.searchsorted(-size, -np.arange(steps), "left")  # of length > t
    alpha = np.empty((len(words), n_labels))
    now = np.ones((len(size), n_labels)) / n_labels
    for t in range(steps):
        n = running[t]
        at = start[:n] + t
        now = (now[:n] if t == 0 else now[:n] @ a) * e[words[at]]
        now /= now.sum(axis=1, keepdims=True)
        alpha[at] = now
    expected = np.zeros((n_labels, n_labels))
    beta = np.ones((len(size), n_labels))
    for t in range(steps - 1, -1, -1):
        n = running[t]
        at = start[:n] + t
        if t + 1 < steps and running[t + 1]:
            m = running[t + 1]
            later = e[words[at[:m] + 1]] * beta[:m]
            if pairs:
                joint = alpha[at[:m], :, None] * a * later[:, None, :]
                expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            back = later @ a.T
            beta[:m] = back / back.sum(axis=1, keepdims=True)
        gamma = alpha[at] * beta[:n]
        # alpha is needed at this place no more: keep the probabilities there.
        alpha[at] = gamma / gamma.sum(axis=1, keepdims=True)
    return (alpha, expected) if pairs else alpha


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray      # BUCKETS x labels
    transition: np.ndarray   # labels x labels


def _spliced(words, offsets, label, rng):
    """Training sequences: stretches of 8 to 40 words of different documents in random
    order, each with the label of its document, so that switches occur."""
    cuts, of = [], []
    for d in range(len(offsets) - 1):
        at = offsets[d]
        while at < offsets[d + 1]:
            stop = min(offsets[d + 1], at + int(rng.integers(8, 41)))
            cuts.append((at, stop))
            of.append(label[d])
            at = stop
    order = rng.permutation(len(cuts))
    index = np.concatenate([np.arange(*cuts[i]) for i in order] or [np.empty(0, np.int64)])
    marks = np.concatenate([np.full(cuts[i][1] - cuts[i][0], of[i]) for i in order]
                           or [np.empty(0, np.int64)])
    return words[index], marks


def learn(texts: pa.Array, label: np.ndarray, n_labels: int, epochs: int = EPOCHS,
          seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions by gradient steps on the conditional likelihood."""
    values, offsets = flat(texts)
    coded = values.dictionary_encode()
    words = coded.indices.to_numpy().astype(np.int64)
    f_ids, f_values, f_bounds = word_features(coded.dictionary)
    w, w_sq = np.zeros((BUCKETS, n_labels)), np.full((BUCKETS, n_labels), 1e-2)
    tr, tr_sq = np.zeros((n_labels, n_labels)), np.full((n_labels, n_labels), 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        sequence, marks = _spliced(words, offsets, label, rng)
        for lo in range(0, len(sequence), SEQUENCE * BATCH):
            seq, y = sequence[lo:lo + SEQUENCE * BATCH], marks[lo:lo + SEQUENCE * BATCH]
            cuts = np.append(np.arange(0, len(seq), SEQUENCE), len(seq))
            used, local = np.unique(seq, return_inverse=True)
            length = f_bounds[used + 1] - f_bounds[used]
            at = np.repeat(f_bounds[used] - np.cumsum(length) + length, length) + np.arange(length.sum())
            ids, vals = f_ids[at], f_values[at]
            bounds = np.append(0, np.cumsum(length))
            score = emissions(w, ids, vals, bounds)
            p, expected = forward_backward(local, cuts, score, tr, pairs=True)
            p[np.arange(len(y)), y] -= 1
            by_word = np.zeros((len(used), n_labels))
            np.add.at(by_word, local, p)
            touched, place = np.unique(ids, return_inverse=True)
            g = np.zeros((len(touched), n_labels))
            np.add.at(g, place, np.repeat(by_word, length, axis=0) * vals[:, None])
            g /= BATCH
            w_sq[touched] += g * g
            w[touched] -= RATE * g / np.sqrt(w_sq[touched])
            inner = np.setdiff1d(np.arange(len(seq) - 1), cuts[1:-1] - 1)
            observed = np.zeros_like(tr)
            np.add.at(observed, (y[inner], y[inner + 1]), 1)
            g = (expected - observed) / BATCH
            tr_sq += g * g
            tr -= RATE * g / np.sqrt(tr_sq)
    return w, tr


def train(labelled: DataFrame, text: str = "text", lang: str = "lang",
          rows: int = TRAINING_ROWS) -> Model:
    """A model from ``(text, lang)`` rows; rows without a lang or without letters teach
    nothing. Every language of the table is learned: texts are counted per language over
    all rows, and about ``rows`` of them in all, but ``LEAST_ROWS`` of every language,
    are chosen by hash, copies once. They are dealt to ``SHARDS`` tasks that learn on
    their own; the driver averages their weights, whose size is fixed by ``BUCKETS`` and
    the number of languages. Without rows the model has no labels."""
    known = labelled.where(F.col(text).rlike(r"\p{L}") & F.col(lang).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).alias("lang"))
    sizes = known.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("n"))
    share = F.greatest(F.lit(rows) / F.sum("n").over(Window.partitionBy()),
                       F.lit(LEAST_ROWS) / F.col("n"))
    parts = 1 << 40
    bounds = sizes.select("lang", (F.least(F.lit(1.0), share) * parts).cast("long").alias("bound"))
    texts = known.join(F.broadcast(bounds), "lang").where(
        F.pmod(F.xxhash64(F.lit(17), "text", "lang"), F.lit(parts)) < F.col("bound")).select(
        "lang", "text", F.xxhash64("text", "lang").alias("place")).dropDuplicates(["lang", "place"])
    chosen = stored(texts.select(
        F.pmod(F.xxhash64(F.lit(9), "text", "lang"), F.lit(SHARDS)).alias("shard"), "place", "lang",
        letters(F.col("text")).alias("words")).where("size(words) > 0"), "labelled")
    labels = sorted(r[0] for r in chosen.select("lang").distinct().collect())

    def fit(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        y = np.array([labels.index(x) for x in group["lang"].to_pylist()])
        w, tr = learn(group["words"], y, len(labels))
        return pa.table({"n": pa.array([group.num_rows], pa.int64()),
                         "w": pa.array([w.astype(np.float32).tobytes()], pa.binary()),
                         "tr": pa.array([tr.tobytes()], pa.binary())})

    parts = chosen.groupBy("shard").applyInArrow(fit, "n bigint, w binary, tr binary").collect() \
        if labels else []
    w, tr = np.zeros((BUCKETS, len(labels)), np.float32), np.zeros((len(labels),) * 2)
    total = sum(r.n for r in parts)
    for r in parts:
        w += np.frombuffer(r.w, np.float32).reshape(w.shape) * (r.n / total)
        tr += np.frombuffer(r.tr).reshape(tr.shape) * (r.n / total)
    return Model(labels, w, tr)


def label_shares(column, model: Model) -> np.ndarray:
    """For every text (a list of words) the expected share of words of each label."""
    values, offsets = flat(column)
    coded = values.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    score = emissions(model.weights, *word_features(coded.dictionary))
    p = forward_backward(coded.indices.to_numpy(), offsets, score, model.transition)
    total = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, axis=0)])
    return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)[:, None]


def predicted(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred",
              score: str = "score") -> DataFrame:
    """Adds ``lang``, the label with the greatest expected share of the words of the whole
    text (ties: the first in order), and ``score``, that share.

    Null texts, texts without a letter, and all texts under a model without labels are
    ``und`` with score 0. Rows are independent; existing columns of these names are
    replaced, others stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x labels numbers
    work = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (lang, score)],
                       letters(whole_text(text)).alias("llm words"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in work.schema.fields[:-1])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            words = batch.column(batch.num_columns - 1)
            offsets = flat(words)[1]
            names, shares = [], []
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + WORDS, "right")) - 1)
                empty = np.diff(offsets[lo:hi + 1]) == 0
                share = label_shares(words.slice(lo, hi - lo), m) if m.labels and not empty.all() \
                    else np.zeros((hi - lo, 1))
                best = share.argmax(axis=1)
                names += [UNKNOWN if e or not m.labels else m.labels[b] for e, b in zip(empty, best)]
                shares.append(np.clip(np.where(empty, 0.0, share[np.arange(hi - lo), best]), 0, 1))
                lo = hi
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names, pa.string()),
                 pa.array(np.concatenate(shares or [np.empty(0)]))],
                [*batch.schema.names[:-1], lang, score])

    return work.mapInArrow(label, f"{schema}`{lang}` string, `{score}` double")
