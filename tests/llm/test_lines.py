"""Line groups against all pairs of lines."""

import random
import re
import string

from letterloom.llm import lines, queries

DATA = "/root/testdata/sf0.001"


def shingles(line, n=lines.SHINGLE):
    return {line[i:i + n] for i in range(max(1, len(line) - n + 1))}


def brute(docs, least=0.8):
    """{(doc_id, line_no): first} for docs [(doc_id, text)] with distinct ids, none null."""
    places, sets, low = {}, {}, {}
    for doc_id, text in docs:
        for k, line in enumerate((text or "").split("\n")):
            if re.search(lines.HAS_WORD, line):
                places.setdefault(line, []).append((doc_id, k))
    for line in places:
        sets[line], low[line] = shingles(line), line

    def find(x):
        while low[x] != x:
            x = low[x]
        return x
    ordered = sorted(sets, key=lambda x: len(sets[x]))
    for i, a in enumerate(ordered):
        for b in ordered[i + 1:]:
            if len(sets[a]) < least * len(sets[b]):
                break
            both = len(sets[a] & sets[b])
            if both >= least * (len(sets[a]) + len(sets[b]) - both):
                low[find(a)] = find(b)
    first = {}
    for line, at in places.items():
        first[find(line)] = min(first.get(find(line), at[0]), *at)
    return {p: first[find(line)] for line, at in places.items() for p in at}


def test_query_finds_the_groups_of_all_pairs(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    want = brute(docs)
    rows = queries.op5_line_dedup(spark, DATA).collect()
    got = {(r.doc_id, r.line_no): (r.first_doc, r.first_line) for r in rows}
    assert got.keys() == want.keys() and len(rows) == len(got)
    assert all(r.kept == ((r.doc_id, r.line_no) == (r.first_doc, r.first_line)) for r in rows)
    # Nothing is merged that all pairs keep apart; high recall for what they merge.
    of_got = {}
    for p, g in got.items():
        assert want[of_got.setdefault(g, p)] == want[p]
    merged = [p for p in want if want[p] != p]
    assert sum(got[p] == want[p] for p in merged) >= 0.98 * len(merged)


def test_small_cases(spark):
    long = "a line of many words that is long enough to be signed at its word starts and not everywhere " * 2
    rows = [(2, f"Keep me\n\nshort line here\n{long}"), (1, f"short line here\n{long}x"),
            (3, "short line here"), (4, None), (5, ""), (6, " \n\t"), (7, "x\nx\nx y"), (None, "x"),
            (8, "ab\nabc")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, lines int")
    assert {(r.doc_id, r.line_no): (r.first_doc, r.first_line)
            for r in lines.line_groups(df.where("doc_id IS NOT NULL")).collect()} == brute(rows[:7] + rows[8:])
    out = {r.doc_id: r.text for r in lines.without_repeated_lines(df).collect()}
    assert out == {2: "Keep me\n", 1: f"short line here\n{long}x", 4: None, 5: "", 6: " \n\t",
                   7: "x\nx y", 8: "ab\nabc"}
    assert lines.without_repeated_lines(df).columns == df.columns
    assert lines.without_repeated_lines(df.limit(0)).count() == 0


def test_members_that_only_meet_through_others(spark):
    """A chain: each line resembles the next, the ends do not resemble each other."""
    words = [f"w{i:03d}word" for i in range(120)]
    rows = [(k, " ".join(words[3 * k:3 * k + 40])) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert len(set(want.values())) == 1
    got = {(r.doc_id, r.line_no): (r.first_doc, r.first_line) for r in lines.line_groups(df).collect()}
    assert got == want


def test_sketches_rule_out_no_similar_pair_and_most_others(spark):
    """A family of lines mostly under the limit: few of its pairs are rows after the cells."""
    from pyspark.sql import functions as F
    rng = random.Random(3)
    base = [rng.choice(string.ascii_lowercase) for _ in range(300)]
    family = []
    for k in range(600):
        line = list(base)
        for at in rng.sample(range(300), 8 if k % 60 else 2):
            line[at] = rng.choice(string.ascii_uppercase)
        family.append((k, "".join(line)))
    table = spark.createDataFrame(family, "h long, line string")
    known = lines.sketches(table, lines.hashed_shingles).persist()
    assert {r.h: r.n for r in known.collect()} == {h: len(shingles(x)) for h, x in family}
    members = table.select(F.lit(1).alias("key"), "h", F.col("h").alias("root"))
    found = {(r.a, r.b) for r in lines.cell_pairs(members, known, 0.8).collect()}
    sets = [shingles(x) for _, x in family]
    near = {(a, b) for a in range(600) for b in range(a)
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert near and near <= found and len(found) < 0.1 * 600 * 599 / 2
    close = {(r.a, r.b) for r in lines.similar(spark.createDataFrame(list(found), "a long, b long"), table,
                                               known, 0.8, lines.hashed_shingles).collect()}
    assert close == near


def test_a_pair_that_shares_many_keys_is_one_row(spark):
    """Near copies share most of their keys; each pair leaves the cells once, none is lost."""
    from pyspark.sql import functions as F
    rng = random.Random(5)
    base = [rng.choice(string.ascii_lowercase) for _ in range(200)]
    family = []
    for k in range(300):
        line = list(base)
        line[rng.randrange(200)] = rng.choice(string.ascii_uppercase)
        family.append((k, "".join(line)))
    table = spark.createDataFrame(family, "h long, line string")
    known = lines.sketches(table, lines.hashed_shingles).persist()
    keys = [(key, h) for h in range(300) for key in range(12) if (h + key) % 4]
    members = spark.createDataFrame(keys, "key long, h long").withColumn("root", F.col("h"))
    pairs = lines.cell_pairs(members, known, 0.8)
    found = [(r.a, r.b) for r in pairs.collect()]
    # No aggregate stands above the generator, so what it makes are these rows.
    above = pairs._jdf.queryExecution().optimizedPlan().toString().split("Generate explode(flatten")[0]
    assert "Aggregate" not in above and len(found) == len(set(found))
    sets = [shingles(x) for _, x in family]
    near = {(a, b) for a in range(300) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert len(near) > 40_000 and near <= set(found)
