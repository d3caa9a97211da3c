"""Periodic runs of words: maximal pairs of the LCP-interval tree of a text.

A run is a stretch of words with smallest period q that no neighbouring word extends.
Its start s and s + q are a maximal pair: two places with different words before them
and different words behind their common extension. Pairs that are close together for
the length they share are exactly the runs, so nothing is extended afterwards.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
SLICE = 4 << 20   # bytes of text that a task looks at together; a longer text is alone


def shared_at_least(period: int, min_length: int, min_repeats: int) -> int:
    """Words that the two places of a run of this period share."""
    return max(min_length - period, (min_repeats - 1) * period)


def _seed(min_length: int, min_repeats: int) -> int:
    return min(shared_at_least(q, min_length, min_repeats) for q in range(1, min_length + 1))


def suffix_order(codes: np.ndarray,
                 depth: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and the ranks by 1, 2, 4, ... leading codes; with ``depth`` by
    so many codes at most.

    The last code must occur once. Prefix doubling, in which only places that still tie
    are sorted again."""
    n = len(codes)
    _, inverse, counts = np.unique(codes, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - counts)[inverse]
    levels = [rank.astype(np.int32)]
    tied = np.flatnonzero(counts[inverse] > 1)
    step = 1
    while len(tied) and (depth is None or step < depth):
        further = step if depth is None else min(step, depth - step)
        key = rank[tied] * n + rank[tied + further]
        order = np.argsort(key)
        tied, key = tied[order], key[order]
        base = key // n
        at = np.arange(len(tied))
        new = np.append(True, key[1:] != key[:-1])
        of_base = np.maximum.accumulate(np.where(np.append(True, base[1:] != base[:-1]), at, 0))
        first = np.maximum.accumulate(np.where(new, at, 0))
        rank = rank.copy()
        rank[tied] = base + first - of_base
        sizes = np.diff(np.append(np.flatnonzero(new), len(tied)))
        tied = tied[np.repeat(sizes > 1, sizes)]
        levels.append(rank.astype(np.int32))
        step += further
    return np.argsort(rank, kind="stable"), levels


def shared_words(a: np.ndarray, b: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Leading codes that the suffixes at ``a`` and ``b`` (different places) share."""
    shared = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        shared += np.where(levels[k][a + shared] == levels[k][b + shared], 1 << k, 0)
    return shared


def maximal_runs(codes: np.ndarray, min_length: int, min_repeats: int) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run of ``codes``, which begins and ends with a
    code that occurs once.

    The tree is walked from its deepest nodes up. A node keeps its places in order; when a
    child joins, its places look for partners of another left-word class no further away
    than a run allows. Places that near overlap, so they lie at equal steps and only the
    first of them can have another word before it: one look to the left and one to the
    right decide. The smaller side is always put into the larger one. Of pairs with the
    same stretch the one with the smallest distance has the smallest period.
    """
    seed = _seed(min_length, min_repeats)
    suffixes, levels = suffix_order(codes)
    near = seed.bit_length() - 1
    if len(levels) <= near:
        return []
    ranks = levels[near][suffixes]
    places = np.flatnonzero(ranks[1:] == ranks[:-1])
    shared = shared_words(suffixes[places], suffixes[places + 1], levels)
    places, shared = places[shared >= seed], shared[shared >= seed]
    left = np.append(codes[-1], codes[:-1]).tolist()
    found: dict[tuple[int, int], int] = {}

    def joined(a: list[int], b: list[int], depth: int) -> list[int]:
        small, big = (a, b) if len(a) < len(b) else (b, a)
        reach = depth // (min_repeats - 1)

        def pair(i: int, j: int) -> None:
            if depth + j - i >= min_length:
                stretch = (i, j + depth)
                found[stretch] = min(found.get(stretch, j - i), j - i)

        for i in small:
            at = bisect_left(big, i)
            if at and big[at - 1] >= i - reach:
                first = big[bisect_left(big, i - reach)]
                if left[first] != left[i]:
                    pair(first, i)
            if at < len(big) and big[at] <= i + reach and left[big[at]] != left[i]:
                for j in big[at:bisect_right(big, i + reach)]:
                    pair(i, j)
        if len(small) * 32 < len(big):
            for i in small:
                insort(big, i)
        else:
            big += small
            big.sort()
        return big

    stack: list[tuple[int, list[int]]] = []
    here: list[int] = []
    before = -2

    def closed(now: list[int], depth: int) -> list[int]:
        while stack and stack[-1][0] > depth:
            low, kept = stack.pop()
            now = joined(kept, now, low)
        return now

    for place, depth, i, j in zip(places.tolist(), shared.tolist(), suffixes[places].tolist(),
                                  suffixes[places + 1].tolist()):
        if place != before + 1:
            closed(here, -1)
            here = [i]
        here = closed(here, depth)
        if stack and stack[-1][0] == depth:
            stack[-1] = (depth, joined(stack[-1][1], here, depth))
        else:
            stack.append((depth, here))
        here, before = [j], place
    closed(here, -1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def may_have_runs(hashes: np.ndarray, starts: np.ndarray, min_length: int,
                  min_repeats: int) -> np.ndarray:
    """For every text of word hashes (``starts`` has its bounds) whether it can have a run.

    A run of period q holds many places whose next few words come again after q words or
    fewer. Never wrong about a text with a run.
    """
    seed = _seed(min_length, min_repeats)
    may = np.zeros(len(starts) - 1, bool)
    n = len(hashes) - seed + 1
    if n < 1:
        return may
    grams = np.zeros(n, np.uint64)
    for k in range(seed):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[k:k + n]
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[:n]
    grams = (grams ^ (grams >> np.uint64(29))) + text.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    whole = np.flatnonzero(np.arange(n) + seed <= starts[text + 1])
    if not len(whole):
        return may
    order = whole[np.argsort(grams[whole])]
    same = grams[order][1:] == grams[order][:-1]
    order = order[np.append(same, False) | np.append(False, same)]
    order = order[np.lexsort((order, grams[order]))]
    again = grams[order][1:] == grams[order][:-1]
    distance, text = np.diff(order)[again], text[order[1:][again]]
    by = np.lexsort((distance, text))
    distance, text = distance[by], text[by]
    known = np.arange(len(text)) - np.searchsorted(text, text) + 1
    need = np.maximum(seed, (min_repeats - 1) * distance) - seed + 1
    may[text[known >= need]] = True
    return may


def runs_of_texts(words: list[list[bytes]], min_length: int = 6,
                  min_repeats: int = 4) -> list[list[tuple[int, int, int]]]:
    """Runs of every list of words, by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    starts = np.append(0, np.cumsum([len(w) for w in words], dtype=np.int64))
    hashes = np.fromiter((hash(w) for text in words for w in text), np.int64, int(starts[-1]))
    chosen = np.flatnonzero(may_have_runs(hashes.view(np.uint64), starts, min_length, min_repeats))
    if not len(chosen):
        return out
    # Codes of the chosen texts one after the other; a code of its own before each and at
    # the end keeps texts apart.
    names: dict[bytes, int] = {}
    codes, begins = [], []
    for k in chosen.tolist():
        codes.append(-len(begins) - 1)
        begins.append(len(codes))
        codes += [names.setdefault(w, len(names)) for w in words[k]]
    codes.append(-len(begins) - 1)
    for start, length, period in maximal_runs(np.array(codes), min_length, min_repeats):
        at = bisect_right(begins, start) - 1
        out[chosen[at]].append((start - begins[at], length, period))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words without those that a run contains after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def _slices(column: pa.Array) -> Iterator[tuple[int, list[bytes | None]]]:
    texts, size, lo = column.to_pylist(), 0, 0
    for hi, text in enumerate(texts):
        size += len(text or b"")
        if size > SLICE and hi > lo:
            yield lo, texts[lo:hi]
            lo, size = hi, len(text or b"")
    yield lo, texts[lo:]


def periodic_runs(docs: DataFrame, text: str = "text", out: str = "runs", short: str = "collapsed",
                  min_length: int = 6, min_repeats: int = 4) -> DataFrame:
    """Adds ``out``, the runs of the words of every whole text as (start, length, period)
    in order of start and period, and ``short``, the words joined by one space without
    those that a run repeats.

    Words are runs of characters other than space and U+0009 to U+000D and are numbered
    from 0. A run is at least ``min_length`` words and ``min_repeats`` (3 or more) periods
    long. Null, empty and blank texts have no runs and an empty ``short``. Rows are
    independent, so repeated rows have equal results and an empty table gives an empty
    one. Other columns stay as they are, null or not; ``text`` is dropped, and columns
    named ``out`` or ``short`` are replaced.
    """
    if min_repeats < 3:
        raise ValueError("min_repeats must be 3 or more")
    kept = [f for f in docs.schema.fields if f.name not in (text, out, short)]
    work = docs.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)],
                       F.col(f"`{text}`").cast("binary").alias("text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in _slices(batch.column(batch.num_columns - 1)):
                words = [(t or b"").split() for t in texts]  # ASCII white space
                runs = runs_of_texts(words, min_length, min_repeats)
                rows = [[dict(zip(("start", "length", "period"), r)) for r in of] for of in runs]
                left = [b" ".join(collapsed(w, r)).decode("utf-8", "replace")
                        for w, r in zip(words, runs)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(lo, len(texts)).columns[:-1], pa.array(rows, kind),
                     pa.array(left, pa.string())], [*[f.name for f in kept], out, short])

    return work.mapInArrow(find, f"{schema}`{out}` {RUNS}, `{short}` string")
