"""Near-duplicate documents: SimHash fingerprints joined in a trie, exact Jaccard of word
shingles, one row of each group stays. Pairs beyond the reach of the trie meet by MinHash keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.llm.arrays import flat
from letterloom.llm.common import groups_of_links, stored, whole_text
from letterloom.llm.lines import row_key, similar_lines
from letterloom.llm.simhash import bit_majorities, near_links, shingle_hashes

WORDS = 5     # words of a shingle
LEAST = 0.8   # similarity that links two documents
BITS = 3      # differing bits of two fingerprints that the trie brings together
NODES = 1 << 15   # node pairs of the trie that a task expands at once
# Keys of a document and the minima that make one: a pair at LEAST shares no key with
# chance (1 - 0.8**5)**20 = 0.04 %. They are for the pairs that the trie does not reach: at
# LEAST fingerprints differ in up to 15 bits or so, and a trie join that wide compares
# nearly all pairs.
BANDS, MINIMA = 20, 5
CHUNK = 1 << 20   # shingles that are hashed at once, besides one whole document


def shingle_set(text: Column) -> Column:
    """The different shingles of a text as hashes, in order."""
    return F.sort_array(F.array_distinct(shingle_hashes(text, WORDS)))


def minhash_keys(values: np.ndarray, offsets: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """``BANDS`` keys for every run of ``values`` (runs are not empty)."""
    rng = np.random.default_rng(11)
    factors = rng.integers(0, 1 << 63, (BANDS, MINIMA), np.uint64) * np.uint64(2) + np.uint64(1)
    masks = rng.integers(0, 1 << 63, (BANDS, MINIMA), np.uint64)
    keys = np.empty((len(offsets) - 1, BANDS), np.uint64)
    lo = 0
    while lo < len(keys):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + chunk, "right")) - 1)
        part, starts = values[offsets[lo]:offsets[hi]], offsets[lo:hi] - offsets[lo]
        for b in range(BANDS):
            key = np.full(hi - lo, b, np.uint64)
            for factor, mask in zip(factors[b], masks[b]):
                low = np.minimum.reduceat((part ^ mask) * factor, starts)
                key = (key ^ low) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            keys[lo:hi, b] = key
        lo = hi
    return keys


def signed_documents(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(rid, doc_id, h, fp, keys)`` of every row; ``h`` names its set of shingles, ``fp``
    is the fingerprint of that set. A text without a word has no keys."""
    sets = docs.select(row_key(doc_id, text).alias("rid"), F.col(doc_id).alias("doc_id"),
                       shingle_set(whole_text(text)).alias("set"))
    hashed = sets.select("rid", "doc_id", F.xxhash64(F.lit(6), "set").alias("h"), "set")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = flat(batch["set"])
            values = values.to_numpy(zero_copy_only=False).view(np.uint64)
            prints = bit_majorities(values, offsets, 1 << 15)  # 2 MB of bits at once
            size = np.diff(offsets)
            keys = minhash_keys(values, np.append(offsets[:-1][size > 0], offsets[-1]))
            ends = np.append(0, np.cumsum(np.where(size > 0, BANDS, 0))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch["rid"], batch["doc_id"], batch["h"], pa.array(prints.view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.view(np.int64).ravel()))],
                ["rid", "doc_id", "h", "fp", "keys"])

    kind = hashed.schema["doc_id"].dataType.simpleString()
    return hashed.mapInArrow(sign, f"rid bigint, doc_id {kind}, h bigint, fp bigint, keys array<bigint>")


def trie_keys(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """``(key, h)`` for every row of ``(h, fp)`` whose fingerprint hangs together with
    another one by links of ``bits`` or fewer differing bits, or is that of another row."""
    rooted = groups_of_links(near_links(prints.select("fp").distinct(), bits, NODES)).withColumnRenamed("id", "fp")
    return prints.join(rooted, "fp", "left").select(
        F.xxhash64(F.lit(64), F.coalesce("root", "fp")).alias("key"), "h")


def document_groups(docs: DataFrame, least: float = LEAST, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """``(rid, doc_id, root)`` for every row: rows whose sets of 5-word shingles (A-Z
    lower-cased; a text with fewer words is one shingle) have a Jaccard similarity of
    ``least`` or more are linked, and linked rows have one ``root``.

    Equal sets are compared once; documents whose fingerprints the trie links, or that
    share a MinHash key, are compared exactly, as ``similar_lines`` says. Texts without a word are one group. ``rid`` names a row by id
    and text. No rows give no rows.
    """
    signed = stored(signed_documents(docs, doc_id, text), "signed documents")
    classes = stored(signed.groupBy("h").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"))
                     .where(F.size("keys") > 0), "classes")
    keyed = classes.select(F.explode("keys").alias("key"), "h").union(trie_keys(classes.select("h", "fp")))
    buckets = keyed.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")) \
        .where("low <> high").select("key")
    shared = stored(keyed.join(buckets, "key"), "shared documents")
    chosen = signed.select("h", "rid").join(shared.select("h").distinct(), "h").groupBy("h").agg(
        F.min("rid").alias("rid"))
    texts = docs.select(row_key(doc_id, text).alias("rid"), F.col(text).alias("t")).join(
        chosen, "rid").dropDuplicates(["h"])
    sets = stored(texts.select("h", shingle_set(F.coalesce("t", F.lit(""))).alias("line")), "sets")
    groups = similar_lines(shared, sets, least, parts=lambda s: s)
    return signed.select("rid", "doc_id", "h").join(
        groups.withColumnRenamed("id", "h"), "h", "left").select(
        "rid", "doc_id", F.coalesce("root", "h").alias("root"))


def one_of_each_group(docs: DataFrame, least: float = LEAST, doc_id: str = "doc_id",
                      text: str = "text") -> DataFrame:
    """``docs`` with one row of each of ``document_groups``: the first by doc_id (nulls
    last), then row key; of rows that repeat both id and text any one. Columns stay as
    they are, clashing names included."""
    firsts = document_groups(docs, least, doc_id, text).groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("at"),
        F.count("*").alias("n"))
    firsts = stored(firsts.select(F.col("at.rid").alias("rid"), "n"), "firsts")
    keyed = docs.select(F.struct("*").alias("row"), row_key(doc_id, text).alias("rid"))
    single = keyed.join(firsts.where("n = 1").select("rid"), "rid", "left_semi")
    # Only in groups of several rows can the chosen row be repeated.
    several = keyed.join(firsts.where("n > 1").select("rid"), "rid", "left_semi") \
        .dropDuplicates(["rid"])
    return single.union(several).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
