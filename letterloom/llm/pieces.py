"""SentencePiece encoding and decoding in Arrow batches."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.llm.arrays import flat

SPACE = "▁"
CELLS = 1 << 18      # table cells (words x places x lengths) that are open at once
TOKENS = 1_000_000   # words that a task holds at once, besides one whole text
LONG_WORD = 256      # above, byte-pair merges go through a heap
UNIGRAM, BPE = 1, 2  # model types of the format
NORMAL, UNKNOWN, CONTROL, BYTE = 0, 1, 2, 3
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    return h * np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Vocabulary:
    """Pieces with scores and kinds; ``kind`` of the model: ``UNIGRAM`` or ``BPE``."""
    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    model: int
    keys: np.ndarray = field(init=False)      # sorted hashes of the normal pieces
    ids: np.ndarray = field(init=False)       # their ids
    may: np.ndarray = field(init=False)       # low hash bits that occur, to skip most probes
    longest: int = field(init=False)

    def __post_init__(self):
        normal = np.flatnonzero(self.kinds == NORMAL)
        by_size: dict[int, list[int]] = {}
        for i in normal:
            by_size.setdefault(len(self.pieces[i]), []).append(i)
        keys, ids = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for size, group in by_size.items():
            c = np.array([[ord(x) for x in self.pieces[i]] for i in group], np.uint64).reshape(-1, size)
            h = np.zeros(len(group), np.uint64)
            for k in range(size):
                h = h * _PRIME + c[:, k] + np.uint64(1)
            keys.append(_mixed(h))
            ids.append(np.array(group, np.int64))
        keys, ids = np.concatenate(keys), np.concatenate(ids)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ids = keys[order], ids[order]
        self.may = np.zeros(1 << 20, bool)
        self.may[keys >> np.uint64(44)] = True
        self.longest = max(by_size, default=0)
        self.unknown = int(np.flatnonzero(self.kinds == UNKNOWN)[0]) if (self.kinds == UNKNOWN).any() else 0
        self.bytes_at = np.full(256, -1, np.int64)
        for i in np.flatnonzero(self.kinds == BYTE):
            self.bytes_at[int(self.pieces[i][3:5], 16)] = i
        self.apart = all(SPACE not in self.pieces[i].lstrip(SPACE) for i in normal)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids of mixed hashes, -1 for none."""
        out = np.full(hashes.shape, -1, np.int32)
        if not len(self.keys):
            return out
        maybe = np.nonzero(self.may[hashes >> np.uint64(44)])
        h = hashes[maybe]
        at = np.searchsorted(self.keys, h).clip(0, len(self.keys) - 1)
        out[maybe] = np.where(self.keys[at] == h, self.ids[at], -1)
        return out


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of one message of the model file."""
    at = 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value
    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or number()
            yield tag >> 3, data[at:at + size]
            at += size


def load_vocabulary(path: str) -> Vocabulary:
    """A model file. Its normaliser must be the identity with a space put in front and
    no spaces removed, which is what byte-exact corpora need."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    message = list(_fields(sp.serialized_model_proto()))
    trainer = dict(_fields(next((v for k, v in message if k == 2), b"")))
    rules = dict(_fields(next((v for k, v in message if k == 3), b"")))
    if rules.get(2) or not rules.get(3, 1) or rules.get(4, 1):
        raise ValueError("only identity normalisation with a space in front is supported")
    n = sp.get_piece_size()
    kinds = np.array([BYTE if sp.is_byte(i) else CONTROL if sp.is_control(i) or sp.is_unused(i)
                      else UNKNOWN if sp.is_unknown(i) else NORMAL for i in range(n)])
    return Vocabulary([sp.id_to_piece(i) for i in range(n)],
                      np.array([sp.get_score(i) for i in range(n)]), kinds, trainer.get(3, UNIGRAM))


def _tables(c: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """``[word, start, length - 1]``: id of the piece there, -1 for none. All substrings
    of one length are hashed and probed together."""
    n, size = c.shape
    reach = max(1, min(size, vocab.longest))
    out = np.full((n, size, reach), -1, np.int32)
    h = np.zeros((n, size), np.uint64)
    for k in range(reach):
        h = h[:, :size - k] * _PRIME + c[:, k:] + np.uint64(1)
        out[:, :size - k, k] = vocab.find(_mixed(h))
    return out


def _viterbi(table: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Lengths of the pieces at their starts (0 elsewhere) of the best split: the sum of
    scores is greatest. A character that is no piece costs ten more than the worst one."""
    n, size, reach = table.shape
    gain = np.where(table >= 0, vocab.scores[table], -np.inf)
    worst = vocab.scores[vocab.ids].min() if len(vocab.ids) else 0.0
    gain[:, :, 0] = np.where(table[:, :, 0] >= 0, gain[:, :, 0], worst - 10.0)
    best = np.full((n, size + 1), -np.inf)
    best[:, 0] = 0
    back = np.zeros((n, size + 1), np.int64)
    for end in range(1, size + 1):
        lengths = np.arange(min(reach, end), 0, -1)  # ties: the longest piece
        reached = best[:, end - lengths] + gain[:, end - lengths, lengths - 1]
        pick = reached.argmax(axis=1)
        best[:, end] = reached[np.arange(n), pick]
        back[:, end] = lengths[pick]
    out = np.zeros((n, size), np.int64)
    at, rows = np.full(n, size), np.arange(n)
    while len(rows):
        step = back[rows, at[rows]]
        at[rows] -= step
        out[rows, at[rows]] = step
        rows = rows[at[rows] > 0]
    return out


def _merges(table: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Lengths of the pieces at their starts by byte-pair merges: in every round each
    word merges its neighbours with the best-scored union, the leftmost of equals."""
    n, size, reach = table.shape
    score = np.append(vocab.scores, -np.inf).astype(np.float32)[table]  # -1: the last
    flat_score = score.reshape(-1)
    length = np.ones((n, size), np.int64)
    active, part = np.arange(n), np.ones((n, size), np.int64)
    place = np.arange(size)
    while len(active) and size > 1:
        after = np.minimum(place + part, size - 1)
        rows = np.arange(len(active))
        union = part + part[rows[:, None], after]
        ok = (part > 0) & (place + part < size) & (union <= reach)
        cell = (active[:, None] * size + place) * reach + np.minimum(union, reach) - 1
        value = np.where(ok, flat_score[cell], -np.inf)
        pick = value.argmax(axis=1)
        going = value[rows, pick] > -np.inf
        length[active[~going]] = part[~going]
        rows, pick = rows[going], pick[going]
        part[rows, pick] = union[rows, pick]
        part[rows, after[rows, pick]] = 0
        active, part = active[going], part[going]
    return length


def _merges_of_long(table: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """The same for one long word, with a heap of pairs instead of rounds."""
    size, reach = table.shape
    length = np.ones(size, np.int64)
    before = np.arange(size) - 1
    heap: list[tuple[float, int, int, int]] = []

    def offer(i):
        j = i + length[i]
        if i >= 0 and j < size and length[i] + length[j] <= reach:
            piece = table[i, length[i] + length[j] - 1]
            if piece >= 0:
                heapq.heappush(heap, (-vocab.scores[piece], int(i), int(length[i]), int(length[j])))
    for i in range(size):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        if length[i] != a or length[i + a] != b:
            continue
        length[i], length[i + a] = a + b, 0
        if i + a + b < size:
            before[i + a + b] = i
        offer(before[i]) if before[i] >= 0 else None
        offer(i)
    return length


def _utf8(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of code points, ``[code point, 4]``, and how many there are."""
    c = c.astype(np.int64)
    n = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
    out = np.zeros((len(c), 4), np.int64)
    for size, lead in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
        rows = n == size
        for k in range(size):
            bits = c[rows] >> 6 * (size - 1 - k)
            out[rows, k] = lead | bits if k == 0 else 0x80 | bits & 0x3F
    return out, n


def split_words(words: list[str], vocab: Vocabulary, methods: tuple[int, ...]) -> dict:
    """Method -> piece ids of the words, end to end, and offsets by word. Words of one length
    advance together; a method is ``UNIGRAM`` (Viterbi) or ``BPE`` (merges), and all of
    them read the same tables."""
    sizes = np.array([len(w) for w in words], np.int64)
    c = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    first = np.cumsum(sizes) - sizes
    # By flat place: length and id of the piece that starts there.
    length = {m: np.zeros(len(c), np.int32) for m in methods}
    piece = {m: np.full(len(c), -1, np.int32) for m in methods}
    order = np.argsort(sizes, kind="stable")
    bounds = np.searchsorted(sizes[order], np.unique(sizes))
    for group in np.split(order, bounds[1:]):
        size = int(sizes[group[0]]) if len(group) else 0
        if size == 0:
            continue
        many = max(1, CELLS // (size * max(1, min(size, vocab.longest))))
        for lo in range(0, len(group), many):
            at = first[group[lo:lo + many]][:, None] + np.arange(size)
            table = _tables(c[at], vocab)
            for m in methods:
                if m == UNIGRAM:
                    cut = _viterbi(table, vocab)
                elif size > LONG_WORD:
                    cut = np.stack([_merges_of_long(t, vocab) for t in table])
                else:
                    cut = _merges(table, vocab)
                length[m][at] = cut
                piece[m][at] = np.take_along_axis(
                    table, np.maximum(cut - 1, 0)[:, :, None], 2)[:, :, 0]
    return {m: _pieces_of(words, c, first, length[m], piece[m], vocab) for m in methods}


def _pieces_of(words, c, first, length, piece, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids and offsets of words; characters outside the vocabulary become bytes."""
    starts = np.flatnonzero(length)
    found = piece[starts]
    bare = found < 0                      # single characters outside the vocabulary
    counts = np.ones(len(starts), np.int64)
    raw, n = _utf8(c[starts[bare]])
    in_bytes = (vocab.bytes_at >= 0).all()
    if in_bytes:
        counts[bare] = n
    at = np.cumsum(counts) - counts
    ids = np.empty(int(counts.sum()), np.int32)
    ids[at[~bare]] = found[~bare]
    if in_bytes:
        for k in range(4):
            has = n > k
            ids[at[bare][has] + k] = vocab.bytes_at[raw[has, k]]
    else:
        ids[at[bare]] = vocab.unknown
    # Empty words share their start with the next word; they own no piece.
    word_of = np.searchsorted(first, starts, "right") - 1 if len(first) else starts
    return ids, np.append(0, np.cumsum(np.bincount(word_of, counts, len(words)))).astype(np.int64)


def _marked_words(column, vocab: Vocabulary) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words (with the spaces in front of them as ``SPACE``) of texts that were cut at every
    space: distinct words, the word numbers of all texts end to end, and their offsets.

    Between single spaces every token is a word. Texts with other runs of spaces, or with
    ``SPACE`` itself, are cut again one by one.
    """
    values, offsets = flat(column)
    coded = values.dictionary_encode()
    names = [SPACE + w for w in coded.dictionary.to_pylist()]
    codes = coded.indices.to_numpy().astype(np.int64)
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)
    odd = np.array([len(w) == 1 or SPACE in w[1:] for w in names], bool)
    again = np.zeros(len(size), bool)
    if vocab.apart:
        again[row[odd[codes]]] = True
    else:
        again[size > 0] = True
    if not again.any():
        return names, codes, offsets
    special = {}
    for r in np.flatnonzero(again):
        text = "".join(names[k] for k in codes[offsets[r]:offsets[r + 1]])
        special[r] = re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+$", text) if vocab.apart else [text]
    new_size = size.copy()
    for r, words in special.items():
        new_size[r] = len(words)
    new_offsets = np.append(0, np.cumsum(new_size))
    out = np.empty(new_offsets[-1], np.int64)
    keep = ~again[row]
    out[(new_offsets[row] + np.arange(len(codes)) - offsets[row])[keep]] = codes[keep]
    for r, words in special.items():
        out[new_offsets[r]:new_offsets[r + 1]] = len(names) + np.arange(len(words))
        names += words
    return names, out, new_offsets


def _gather(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs ``rows`` of ``values`` end to end, and the end of each."""
    n = offsets[rows + 1] - offsets[rows]
    ends = np.cumsum(n)
    index = np.repeat(offsets[rows] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
    return values[index], ends


def encode_lists(column, vocab: Vocabulary, methods: tuple[int, ...]) -> dict[int, pa.Array]:
    """Method -> piece ids (``array<int>``) of texts cut at every space; null stays null."""
    names, codes, offsets = _marked_words(column, vocab)
    out = {}
    for m, (ids, bounds) in split_words(names, vocab, methods).items():
        flat_ids, ends = _gather(ids, bounds, codes)
        ends = np.append(0, ends)[offsets].astype(np.int32)
        out[m] = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat_ids), mask=column.is_null())
    return out


def _tokens(text: Column) -> Column:
    """A text cut at every space; an empty text has no token."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def _parts(batch: pa.RecordBatch, last: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``TOKENS`` list elements in column ``last`` at most."""
    offsets = flat(batch.column(last))[1]
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + TOKENS, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def encoded(docs: DataFrame, vocab: Vocabulary, text: str = "text", out: str = "ids",
            method: int | None = None) -> DataFrame:
    """Adds ``out``: piece ids (``array<int>``) of each whole text.

    ``method`` is the model's own by default: Viterbi for a unigram model, merges for a
    byte-pair model, which give the ids of the library; Viterbi on a byte-pair model
    gives the split with the greatest sum of scores instead. A null text has null ids,
    an empty one none. U+2581 in a text reads as a space, as the format has it. Rows
    are independent; an existing column ``out`` is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocab)  # its size is the vocabulary's
    method = method or vocab.model
    work = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != out],
                       _tokens(F.col(text)).alias("llm words"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in work.schema.fields[:-1])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            for part in _parts(batch, last):
                ids = encode_lists(part.column(last), sent.value, (method,))[method]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], ids], [*part.schema.names[:-1], out])

    return work.mapInArrow(encode, f"{schema}`{out}` array<int>")


def round_trips(docs: DataFrame, vocab: Vocabulary, keep: list[str], text: str = "text",
                viterbi: bool = False) -> DataFrame:
    """The columns ``keep`` with ``ids`` of the model's own method and ``round_trip``: they
    decode to the text again. With ``viterbi`` also ``n_viterbi`` and
    ``viterbi_round_trip`` for the split by Viterbi. All in one pass over the texts, which
    share tables and words. Texts with U+2581 decode to spaces there, and count as equal.
    Null texts have null ids and are equal to nothing else."""
    sent = docs.sparkSession.sparkContext.broadcast(vocab)
    work = docs.select(*[F.col(f"`{c}`") for c in keep], _tokens(F.col(text)).alias("llm words"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in work.schema.fields[:-1])
    methods = tuple(dict.fromkeys([vocab.model, UNIGRAM] if viterbi else [vocab.model]))

    def same(column, ids) -> pa.Array:
        plain = pc.replace_substring(pc.binary_join(column, " "), SPACE, " ")
        equal = pc.equal(plain, decode_lists(ids, sent.value))
        return pc.fill_null(equal, True)  # null and null

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            for part in _parts(batch, last):
                column = part.column(last)
                ids = encode_lists(column, sent.value, methods)
                new = {"ids": ids[methods[0]], "round_trip": same(column, ids[methods[0]])}
                if viterbi:
                    n = pc.fill_null(pc.list_value_length(ids[UNIGRAM]), 0)
                    new |= {"n_viterbi": n.cast(pa.int32()),
                            "viterbi_round_trip": same(column, ids[UNIGRAM])}
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], *new.values()], [*keep, *new])

    more = ", n_viterbi int, viterbi_round_trip boolean" if viterbi else ""
    return work.mapInArrow(run, f"{schema}ids array<int>, round_trip boolean{more}")


def decode_lists(column, vocab: Vocabulary) -> pa.Array:
    """Texts of lists of piece ids."""
    raw = [b"" if k == CONTROL else bytes([int(p[3:5], 16)]) if k == BYTE
           else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode("utf-8", "surrogatepass")
           for p, k in zip(vocab.pieces, vocab.kinds)]
    data = np.frombuffer(b"".join(raw), np.uint8)
    bounds = np.append(0, np.cumsum([len(r) for r in raw]))
    ids, offsets = flat(column)
    out, ends = _gather(data, bounds, ids.to_numpy(zero_copy_only=False).astype(np.int64))
    ends = np.append(0, ends)[offsets]
    whole = out.tobytes()
    texts = []
    for lo, hi, null in zip(ends, ends[1:], column.is_null().to_pylist()):
        piece = whole[lo:hi]
        texts.append(None if null else (piece[1:] if piece[:1] == b" " else piece).decode("utf-8", "replace"))
    return pa.array(texts, pa.string())


def decoded(df: DataFrame, vocab: Vocabulary, ids: str = "ids", out: str = "text") -> DataFrame:
    """Adds ``out``: the text of piece ids, the inverse of ``encoded`` for every text
    without U+2581. Null ids give null, none give an empty text; control pieces are
    silent, bytes that are no UTF-8 become U+FFFD. An existing column ``out`` is
    replaced."""
    sent = df.sparkSession.sparkContext.broadcast(vocab)
    kept = [c for c in df.columns if c != out]
    work = df.select(*[F.col(f"`{c}`") for c in kept])
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in work.schema.fields)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, kept.index(ids)):
                text = decode_lists(part.column(kept.index(ids)), sent.value)
                yield pa.RecordBatch.from_arrays([*part.columns, text], [*kept, out])

    return work.mapInArrow(decode, f"{schema}`{out}` string")
