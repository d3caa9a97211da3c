"""Every stage of the pipeline against a brute-force version on its own input."""

from collections import Counter

import sentencepiece

import corpus_pipeline
from letterloom.llm import mixing, quality, queries
from tests.llm import test_lines, test_simhash

DATA = "/root/testdata/sf0.001"


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{folder}/{k}")
        done = spark.read.parquet(f"{folder}/{k}")
        out = done.collect()
        assert out, name
        if name != "pieces":
            assert done.columns == corpus_pipeline.COLUMNS
        if name == "quality":
            w = quality.train(queries.labelled_documents(
                docs, spark.read.parquet(f"{DATA}/labels.parquet")))
            keep = {r.doc_id for r in quality.scored(docs, w).collect() if r.score >= 0.3}
            assert {r.doc_id for r in out} == keep and all(r == rows[r.doc_id] for r in out)
        elif name == "lines":
            first = test_lines.brute([(i, r.text) for i, r in rows.items()])
            want = {}
            for i, r in rows.items():
                lines = (r.text or "").split("\n")
                left = [x for n, x in enumerate(lines) if first.get((i, n), (i, n)) == (i, n)]
                if any((i, n) == first.get((i, n)) for n in range(len(lines))):
                    want[i] = "\n".join(left)
            got = {r.doc_id: r.text for r in out}
            same = sum(got.get(i) == t for i, t in want.items())
            assert same >= 0.98 * len(want) and len(got.keys() - want.keys()) <= 0.02 * len(want)
            assert all(r.n_chars == len(r.text) for r in out)
        elif name == "simhash":
            groups = test_simhash.components(
                list(rows), [test_simhash.fingerprint(r.text) for r in rows.values()])
            assert sorted(r.doc_id for r in out) == sorted(set(groups.values()))
        elif name == "mixing":
            plan = {r.source: r for r in mixing.quotas(docs).collect()}
            times = Counter(r.doc_id for r in out)
            assert all(0 <= times[i] - plan[r.source].epochs <= 1 for i, r in rows.items())
        else:
            assert all(r.ids == library.encode(rows[r.doc_id].text) and r.intact for r in out)
            assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in docs.collect())
        docs, rows = done, {r.doc_id: r for r in out}


def test_run_is_the_chain(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 10 and "ids" in out.columns


def test_odd_and_empty_tables(spark, folder):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", None, "a", 0),
         (2, "", None, "a", 0), (3, "one line\nand one more", "en", None, 21)], schema)
    for start in (odd, odd.limit(0)):
        docs = start
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            at = f"{folder}/{start is odd}-{k}"
            stage(spark, docs, DATA).write.parquet(at)
            docs = spark.read.parquet(at)
        assert (docs.count() > 0) == (start is odd)
