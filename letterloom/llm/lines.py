"""Fuzzy line dedup: MinHash keys, exact Jaccard, one line of each group stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.llm.common import forget, groups_of_links, let, stored, whole_text

SHINGLE = 5         # characters of a shingle that similarity is measured on
# A line is signed by its shingles of SHINGLE characters, or, where it has many anchors, by
# the AFTER characters behind each anchor: about a third of all places in most languages
# and every place in scripts beyond ASCII, so that long lines take little time. Lines
# with FEW to MANY anchors are signed both ways, so that similar lines share a way. Lines
# with many sparse anchors (about a twelfth of all places) are signed by those alone; what
# has none of them, such as other scripts, stays with the frequent ones. FEW_SPARSE and
# MANY_SPARSE bound those that are signed both ways.
ANCHOR, AFTER = r"[aenstAENST2-4\x{80}-\x{10FFFF}]", 8
SPARSE = r"[dlgDLG5]"
FEW, MANY = 24, 36
FEW_SPARSE, MANY_SPARSE = 16, 24
# Band keys of a signature, and the minima that make one key. Scattered edits at
# similarity 0.8 leave the longer stretches about 0.7, so that way has more keys; short
# stretches are less rare, so there more of them make a key.
KEYS, ROWS = (12, 14, 14), (4, 3, 3)
ROUNDS = 3          # leaders that a bucket is compared with before all its other pairs
SKETCH = 16         # longs of a sketch, see ``sketches``
CELL = 256          # members of a bucket that one cell compares with each other
SLOTS = 1 << 22     # bits of the sieve of keys: 0.5 MB whatever the number of keys
HAS_WORD = r"[^\x20\x09-\x0D]"


def shingles(line: Column, size: int = SHINGLE) -> Column:
    """All runs of ``size`` characters (by ``size`` shifted readings, so that long lines
    take linear time); a shorter line is its own shingle."""
    return F.when(F.char_length(line) <= size, F.array(line)).otherwise(F.concat(*[
        F.regexp_extract_all(F.substring(line, k + 1, 1 << 30), F.lit("(?s).{%d}" % size), 0)
        for k in range(size)]))


def band_keys(low: str, way: int) -> Column:
    """Keys of a set of shingle hashes given in order: neighbours hashed together from each
    of the first places. Two sets share a key when neighbours in the order of their union
    lie in both, at similarity s with chance s**ROWS each. No hashes give no keys."""
    rows, size = ROWS[way], F.coalesce(F.size(low), F.lit(0))
    return F.array_compact(F.array(*[
        F.when(F.lit(i) < F.least(size, F.greatest(size - rows + 1, F.lit(1))),
               F.xxhash64(F.lit(way), *[F.get(low, F.lit(i + k)) for k in range(rows)]))
        for i in range(KEYS[way])]))


def hashed(parts: Column) -> Column:
    return F.transform(parts, lambda x: F.xxhash64(x))


def signed_lines(lines: DataFrame) -> DataFrame:
    """Adds the band ``keys`` of every ``line``. The hashes are sorted in a column of
    their own, outside lambdas, where Spark compiles it."""
    behind = lambda anchor: F.regexp_extract_all(
        "line", F.lit("(?s)%s(?=(.{%d}))" % (anchor, AFTER)), 1)
    # A generated column is computed once, however often it is used.
    once = lambda df, x, name: df.select("*", F.explode_outer(F.array(x)).alias(name))
    anchored = once(lines, behind(SPARSE), "sparse")
    anchored = once(anchored, F.when(F.size("sparse") < MANY_SPARSE, behind(ANCHOR)).otherwise(
        F.array().cast("array<string>")), "dense")
    every = F.when((F.size("sparse") < MANY_SPARSE) & (F.size("dense") < MANY), hashed(shingles(F.col("line"))))
    longer = F.when(F.size("dense") >= FEW, hashed(F.col("dense")))
    longest = F.when(F.size("sparse") >= FEW_SPARSE, hashed(F.col("sparse")))
    for k, x in enumerate((every, longer, longest)):
        anchored = once(anchored, F.sort_array(F.array_distinct(x)), f"low_{k}")
    return anchored.select(*lines.columns, F.concat(
        *[band_keys(f"low_{k}", k) for k in range(3)]).alias("keys"))


def row_key(doc_id: str, text: str) -> Column:
    """Names a row by its id and text, so that null and repeated ids do no harm."""
    return F.xxhash64(F.lit(5), F.col(doc_id), F.col(text))


def lines_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(rid, doc_id, line_no, line)`` of every line that has a word."""
    return docs.select(row_key(doc_id, text).alias("rid"), F.col(doc_id).alias("doc_id"),
                       F.posexplode(F.split(whole_text(text), "\n")).alias("line_no", "line")) \
        .where(F.col("line").rlike(HAS_WORD))


def fixed_array(cells: DataFrame, size: int) -> Column:
    """The values ``v`` of the numbers ``i`` from 0 to ``size`` - 1 (else 0) as one array of
    that fixed size, which is a value of a row and not a table."""
    spark = cells.sparkSession
    whole = spark.range(size).select(F.col("id").cast("int").alias("i")).join(cells, "i", "left")
    return whole.agg(F.transform(F.sort_array(F.collect_list(F.struct(
        "i", F.coalesce("v", F.lit(0).cast("long")).alias("v")))), lambda c: c.v)).scalar()


def sieved(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``column`` no row of ``wanted`` has, by a bit
    for every slot. Where the slots are nearly all taken it only lets more through."""
    slot = F.pmod(F.xxhash64(F.lit(9), column), F.lit(SLOTS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))
    words = wanted.groupBy(F.shiftright(slot, 6).cast("int").alias("i")).agg(
        F.bit_or(bit).alias("v"))
    at = F.get(fixed_array(words, SLOTS // 64), F.shiftright(slot, 6).cast("int"))
    return rows.where(F.bit_get(at, (slot % 64).cast("int")) == 1)


def line_texts(wanted: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """``(h, line)`` of the wanted line keys ``h``. Repeats become one before the shuffle."""
    lines = docs.select(F.explode(F.split(whole_text(text), "\n")).alias("line")).select(
        F.xxhash64("line").alias("h"), "line")
    one = sieved(lines, "h", wanted).groupBy("h").agg(F.first("line").alias("line"))
    return one.join(wanted, "h", "left_semi")


def hashed_shingles(line: Column) -> Column:
    return F.array_distinct(hashed(shingles(line)))


def sketches(lines: DataFrame, parts) -> DataFrame:
    """``(h, n, sketch)`` of every line: the number of its ``parts`` (different hashes), and
    for each of 64 * ``SKETCH`` slots whether an odd number of them falls into it."""
    v = lines.select("h", F.explode(parts(F.col("line"))).alias("v"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("v").bitwiseAND(63).cast("int"))
    word = F.shiftright("v", 6).bitwiseAND(SKETCH - 1)
    found = v.groupBy("h").agg(F.count("*").alias("n"), *[
        F.bit_xor(F.when(word == k, bit)).alias(f"w{k}") for k in range(SKETCH)])
    return found.select("h", "n", F.array(*[F.coalesce(f"w{k}", F.lit(0).cast("long"))
                                            for k in range(SKETCH)]).alias("sketch"))


def may_be_similar(n_a: Column, n_b: Column, a: Column, b: Column, least: float) -> Column:
    """False only for pairs below ``least``: each slot in which two sketches differ has an
    element that one set lacks, and similar sets lack few."""
    apart = sum((F.bit_count(F.get(a, k).bitwiseXOR(F.get(b, k))) for k in range(1, SKETCH)),
                F.bit_count(F.get(a, 0).bitwiseXOR(F.get(b, 0))))
    return (F.least(n_a, n_b) >= F.lit(least) * F.greatest(n_a, n_b)) & (
        apart <= (n_a + n_b) * F.lit((1 - least) / (1 + least)) + 1e-6)


def similar(pairs: DataFrame, lines: DataFrame, known: DataFrame, least: float, parts) -> DataFrame:
    """The pairs ``(a, b)`` of line keys whose lines have a Jaccard similarity of ``least``
    or more, computed exactly on their ``parts``. Sizes and sketches (``known``) rule most
    others out before any text is fetched."""
    def side(table: DataFrame, x: str, *columns: str) -> DataFrame:
        return table.select(*[F.col(c).alias(x if c == "h" else f"{c}_{x}") for c in ("h", *columns)])
    met = pairs.join(side(known, "a", "n", "sketch"), "a").join(side(known, "b", "n", "sketch"), "b")
    near = met.where(may_be_similar(*map(F.col, ("n_a", "n_b", "sketch_a", "sketch_b")), least)) \
        .drop("sketch_a", "sketch_b")
    met = near.join(side(lines, "a", "line"), "a").join(side(lines, "b", "line"), "b")
    both = F.size(F.array_intersect(parts(F.col("line_a")), parts(F.col("line_b"))))
    # One use of the intersection, which a filter computes anew for every use.
    return met.where(both >= (F.col("n_a") + F.col("n_b")) * F.lit(least / (1 + least)) - 1e-6).select("a", "b")


def cell_pairs(members: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """``(a, b)`` of all members ``h`` of a ``key`` in different groups ``root`` that may be
    similar. The members of a key are dealt to blocks and two blocks meet in a cell of
    bounded size, so that pairs which sketches rule out are no rows; those of a large
    bucket are spread over many tasks. Lines that share several keys are a pair at the
    smallest of them only, so a pair is one row."""
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / CELL).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64(F.lit(13), "h"), F.col("blocks")).cast("int")
    own = members.groupBy("h").agg(F.collect_set("key").alias("keys")).join(known, "h")  # keys of a line are few
    dealt = members.join(sizes, "key").join(own, "h").withColumn("block", block).select(
        "key", F.struct("h", "root", "n", "sketch", "block", "keys").alias("m"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = dealt.groupBy("key", F.least("m.block", "other").alias("low"),
                          F.greatest("m.block", "other").alias("high")).agg(F.collect_list("m").alias("m"))

    def partners(x: Column, i: Column) -> Column:
        fits = lambda y: (x.root != y.root) & ((x.block != y.block) | (F.col("low") == F.col("high"))) \
            & may_be_similar(x.n, y.n, x.sketch, y.sketch, least) \
            & (F.array_min(F.array_intersect(x["keys"], y["keys"])) == F.col("key"))
        return F.transform(F.filter(F.slice("m", i + 2, F.size("m")), fits), lambda y: F.struct(
            F.greatest(x.h, y.h).alias("a"), F.least(x.h, y.h).alias("b")))
    return cells.select(F.explode(F.flatten(F.transform("m", partners))).alias("p")).select("p.*")


def similar_lines(shared: DataFrame, lines: DataFrame, least: float, parts=hashed_shingles) -> DataFrame:
    """``(id, root)`` of lines ``h`` that share a ``key`` and hang together by similar pairs.

    In each of ``ROUNDS`` rounds every bucket that still holds several groups has a leader
    (the smallest under the round's own order), and all members outside its group are
    compared with it. That joins most families of near-equal lines with few comparisons.
    At last all pairs of one bucket in different groups are compared by their sketches, in
    cells, and those left by their texts, so no link between two groups is lost.
    """
    spark = shared.sparkSession
    known = stored(sketches(lines, parts), "sketches")
    nothing = spark.createDataFrame([], "a bigint, b bigint")
    tested, groups = nothing, spark.createDataFrame([], "id bigint, root bigint")
    for turn in range(ROUNDS + 1):
        rooted = shared.join(groups.withColumnRenamed("id", "h"), "h", "left").select(
            "key", "h", F.coalesce("root", "h").alias("root"))
        heads = rooted.groupBy("key").agg(
            F.min("root").alias("r"), F.max("root").alias("s"),
            F.min_by(F.struct("h", "root"), F.xxhash64(F.lit(turn), "h")).alias("head")) \
            .where("r <> s").select("key", F.col("head.h").alias("g"), F.col("head.root").alias("groot"))
        open_ = stored(rooted.join(heads, "key"), "open")
        if turn == ROUNDS:
            pairs = cell_pairs(open_.select("key", "h", "root"), known, least)
        else:
            pairs = open_.where("root <> groot").select(
                F.greatest("h", "g").alias("a"), F.least("h", "g").alias("b")).distinct()
        pairs = stored(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        forget(open_)
        if pairs.isEmpty():
            continue
        found = stored(similar(pairs, lines, known, least, parts), "links")
        tested = tested.union(pairs)
        if not found.isEmpty():
            groups = stored(groups_of_links(groups.toDF("a", "b").union(found)), "groups")
    forget(known)
    return groups


def line_groups(docs: DataFrame, least: float = 0.8, doc_id: str = "doc_id",
                text: str = "text") -> DataFrame:
    """``(rid, doc_id, line_no, first_doc, first_line, kept)`` for every line with a word.

    Lines whose sets of 5-character shingles have a Jaccard similarity of ``least`` or
    more are linked; equal lines are one line. Of each group the first line by doc_id
    (nulls last), then row, then line number is kept, and named by first_doc and
    first_line. Lines that share a band key are compared as ``similar_lines`` says.

    Null and empty texts and blank lines have no rows. Rows that repeat both doc_id and
    text count as one document. Lines are named by a 64-bit hash. No rows give no rows.
    """
    lines = lines_of(docs, doc_id, text)
    signed = stored(signed_lines(lines).select(
        "rid", "doc_id", "line_no", F.xxhash64("line").alias("h"), "keys"), "signed")
    keyed = signed.select(F.explode("keys").alias("key"), "h")
    buckets = keyed.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")) \
        .where("low <> high").select("key")
    buckets = stored(buckets, "buckets")
    shared = stored(sieved(keyed, "key", buckets).join(buckets, "key").distinct(), "shared")
    places = stored(signed.drop("keys"), "places")
    forget(signed, buckets)
    lines = stored(line_texts(stored(shared.select("h").distinct(), "wanted"), docs, text), "lines")
    groups = similar_lines(shared, lines, least)
    forget(shared, lines)
    rooted = places.join(
        groups.withColumnRenamed("id", "h"), "h", "left").select(
        "rid", "doc_id", "line_no", F.coalesce("root", "h").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "line_no")).alias("at"))
    return rooted.join(firsts, "root").select(
        "rid", "doc_id", "line_no", F.col("at.doc_id").alias("first_doc"),
        F.col("at.line_no").alias("first_line"),
        ((F.col("rid") == F.col("at.rid")) & (F.col("line_no") == F.col("at.line_no"))).alias("kept"))


def without_repeated_lines(docs: DataFrame, least: float = 0.8, doc_id: str = "doc_id",
                           text: str = "text") -> DataFrame:
    """``docs`` with each group of similar lines kept once. Lines without a word stay;
    a document that loses all its words goes. Columns stay as they are, clashing names
    included; null texts stay null."""
    gone = line_groups(docs, least, doc_id, text).groupBy("rid").agg(
        F.collect_list(F.when(~F.col("kept"), F.col("line_no"))).alias("gone"),
        F.count_if("kept").alias("left"))
    keyed = docs.select(F.struct("*").alias("row"), F.col(text).alias("t"),
                        row_key(doc_id, text).alias("rid"))
    joined = keyed.join(gone, "rid", "left").where("left IS NULL OR left > 0")
    lines = F.split("t", "\n")
    kept = F.when(F.coalesce(F.size("gone"), F.lit(0)) < 1, F.col("t")).otherwise(F.array_join(
        let(lines, lambda x: F.transform(
            F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone")),
            lambda i: F.get(x, i))), "\n"))
    return joined.select(*[(kept if c == text else F.col("row").getField(c)).alias(c)
                           for c in docs.columns])
