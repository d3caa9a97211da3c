"""The queries of the operators over whole tables, and SQL where it can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.llm import (langid, lines, mixing, pages, periods, pieces, pii, quality,
                            rules, secrets, simhash, turns, vectors)
from letterloom.llm.common import held_out, in_sample, let, stored, table, whole_text, words_of
from letterloom.llm.spans import joined

# Vocabulary file of a public tokenizer.
PIECES = os.environ.get("PIECES_MODEL", "/opt/tokenizers/piece_bpe_32k.model")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def _of(spans: str, *kinds: str):
    return F.filter(spans, lambda s: s.kind.isin(*kinds))


def _count(spans: str, kind: str):
    return F.size(_of(spans, kind)).cast("long").alias(f"n_{kind}")


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find_pii(docs).select(
        "doc_id", *[_count("pii", k) for k in pii.BASE],
        F.sha2(joined(_of("pii", *pii.BASE)), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: F.format_number(s.score, 2)), ",")
        .alias("scores"))


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, the base rule and the verdict of the cascade."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    order = [r for r, _, _ in rules.ranked(rules.text_counts(docs), rules.standard_rules())]
    counted = rules.text_counts(docs).withColumn("base_failed", rules.base_rule())
    done = rules.cascade(counted, [rules.Rule("base", F.col("base_failed")), *order])
    return done.select("doc_id", *[f"counts.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "base_failed", "kept")


@query
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = secrets.train_markov(secrets.labelled_strings(docs))
    return secrets.find_secrets(docs, model).select(
        "doc_id", *[_count("secrets", k) for k in secrets.BASE],
        F.sha2(joined(_of("secrets", *secrets.BASE)), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"))


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"),
                         "component_id")


@query
def op2_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of near-equal vectors."""
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


ORACLES["op2_embedding_neardup"] = """
WITH RECURSIVE ok AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach(id, root) AS (
  SELECT vec_id, vec_id FROM embeddings WHERE vec_id IS NOT NULL
  UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.id),
low AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(low.root, e.vec_id) AS component_id,
       coalesce(e.vec_id = low.root, true) AS kept
FROM embeddings e LEFT JOIN low ON low.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with a word: the first line of its group, and whether it stays."""
    return lines.line_groups(table(spark, sf_dir, "documents")).drop("rid")


def labelled_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts with the quality label of their document, held-out documents left out: about
    ``quality.TRAINING_ROWS`` at most, chosen by id on both sides before they are joined."""
    known = labels.where(~held_out() & F.col("quality").isin(0, 1)).select(
        "doc_id", F.col("quality").alias("label"))
    share = min(1.0, quality.TRAINING_ROWS / max(known.count(), 1))
    chosen = (~held_out()) & (in_sample(share, "doc_id") if share < 1 else F.lit(True))
    return docs.select("doc_id", "text").where(chosen).join(known.where(chosen), "doc_id").select(
        "text", "label")


@query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.train(labelled_documents(docs, table(spark, sf_dir, "labels")))
    return quality.scored(docs, weights).select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, from the languages of its words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~held_out()).select("text", "lang"))
    return langid.predicted(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: a row for every time that a document is read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mixed(docs, columns=["doc_id", "source"], order=True)


@query
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document by the model's own method and by Viterbi, each decoded
    again and compared with the text."""
    done = pieces.round_trips(table(spark, sf_dir, "documents"), pieces.load_vocabulary(PIECES),
                              ["doc_id"], viterbi=True)
    return done.withColumn("n_pieces", F.coalesce(F.size("ids"), F.lit(0)))


def looped(docs: DataFrame) -> DataFrame:
    """``docs`` in which every tenth text repeats a few of its words from some word on, as
    the crc32 of its id (null: of an empty text) asks for."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def repeated(w):
        def from_word(a):
            tail = F.size(w) - a
            p = (1 + F.floor(tail / (3 + F.pmod(g, F.lit(8))))).cast("int")
            loop = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil(tail / p).cast("int")))
            return F.array_join(F.slice(F.concat(F.slice(w, F.lit(1), a), loop), F.lit(1), F.size(w)), " ")
        return F.when(F.size(w) > 0, let(F.pmod(g, F.size(w)).cast("int"), from_word)).otherwise("")

    return docs.withColumn("text", F.when(h % 10 == 0, let(words_of(whole_text()), repeated))
                           .otherwise(whole_text()))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words in every document, a tenth of which is made periodic."""
    docs = looped(table(spark, sf_dir, "documents").select("doc_id", "text"))
    done = periods.periodic_runs(docs)
    longer = lambda x, y: x.length * y.period > y.length * x.period
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    best = F.aggregate("runs", none, lambda b, r: F.when(b.isNull() | longer(r, b), r).otherwise(b))
    listed = F.transform("runs", lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","),
                                                    r.period, F.lit("\n")))
    return done.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length",
        "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period"))
        .alias("exponent_milli"), F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def damaged(convs: DataFrame) -> DataFrame:
    """Conversations with faults put in by the crc32 of ``conv_id:turn`` (nulls: one
    space): ``copies`` says how often a turn stands there."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = space("text")
    return convs.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(space("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"))


@query
def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, and its cheapest repair."""
    convs = damaged(table(spark, sf_dir, "conversations"))
    return turns.repaired_digests(convs, stored(turns.audits(convs, "copies"), "audits"), "copies").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@query
def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    done = pages.main_texts(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return done.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


ORACLES["op7_quality_rules"] = r"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)),
                lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM words WHERE len(w) >= 8),
windows AS (SELECT doc_id, p, array_to_string(w[p:p + 7], ' ') AS g FROM places),
twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n
  FROM windows) AS x WHERE n > 1),
covered AS (SELECT doc_id, sum(least(8, coalesce(after - p, 8)))::BIGINT AS n FROM (
  SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS after FROM twice) AS x
  GROUP BY doc_id),
counted AS (
  SELECT words.doc_id, t, w, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN covered ON covered.doc_id = words.doc_id),
judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR 2 * n_dup_lines > n_lines
    OR 5 * len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) > n_words
    OR 10 * len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '^[ ]*[-*•]')))
       > 9 * n_lines
    OR length(regexp_replace(t, '[^\p{L}]', '', 'g')) * 2 < word_chars
    OR length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) * 2
       > length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS rejected FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT rejected AS kept FROM judged
"""
