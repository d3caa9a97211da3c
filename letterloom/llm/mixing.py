"""Mixing sources: tempered weights under limits, realised as block permutations."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from letterloom.llm.common import stored, whole_text, words_of

BLOCK_DOCS = 4_096   # documents of one block of a permutation, about
GRID = 32            # exponents tried by one job: five halvings
SPAN = float(1 << 63)


@dataclass(frozen=True)
class Goal:
    """``entropy``: wanted entropy of the mix as a share of the greatest possible (the
    logarithm of the number of sources). ``repeats``: no source is read more often; it
    comes first where both cannot hold. ``budget``: tokens of the mix, by default as
    many as there are."""
    entropy: float = 0.95
    repeats: float = 4.0
    budget: float | None = None


def _place(doc_id: str, text: str, epoch, seed: int) -> Column:
    """Place of a document in the permutation of an epoch, 0 to 2**63 - 1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch, F.col(doc_id), F.col(text)), 1)


def _measures(sources: DataFrame, exponents: list[float], budget: float) -> dict:
    """Exponent -> (entropy, most repeats); ``sources`` has a token share ``p`` each."""
    tried = sources.select("p", F.explode(F.array(*map(F.lit, exponents))).alias("a"))
    x = F.pow("p", "a")
    rows = tried.groupBy("a").agg(
        F.sum(x).alias("z"), F.sum(x * F.ln("p")).alias("s"),
        F.max(F.pow("p", F.col("a") - 1)).alias("m")).collect()
    return {r.a: (math.log(r.z) - r.a * r.s / r.z, budget * r.m / r.z) for r in rows}


def _bisect(good, low: float, high: float, measure) -> float:
    """The greatest exponent in [low, high] with ``good(measures)``, which holds at the
    lower end and below a limit; each round tries ``GRID`` exponents in one job."""
    while high - low > 1e-9:
        step = (high - low) / GRID
        grid = [low + i * step for i in range(1, GRID)]
        found = measure(grid)
        low = max((a for a in found if good(found[a])), default=low)
        high = min((a for a in found if a > low), default=high)
    return low


def exponent(sources: DataFrame, goal: Goal, budget_share: float) -> float:
    """The exponent for token shares ``p`` of ``sources``: 1 leaves the shares, 0 makes
    them equal. The greatest one that reaches the entropy; if a source would be read
    more than ``repeats`` times, the smallest one that keeps to that limit."""
    n = sources.count()
    wanted = goal.entropy * math.log(max(n, 1))
    measure = lambda grid: _measures(sources, grid, budget_share)
    ends = measure([0.0, 1.0])
    if n < 2 or ends[1.0][0] >= wanted:
        return 1.0
    a = _bisect(lambda m: m[0] >= wanted, 0.0, 1.0, measure)
    if measure([a])[a][1] <= goal.repeats:
        return a
    if ends[1.0][1] > goal.repeats:
        return 1.0  # the budget is too large for the limit: quotas are cut below
    # Repeats fall as the exponent grows, so the search runs over 1 - exponent.
    return 1.0 - _bisect(lambda m: m[1] <= goal.repeats, 0.0, 1.0 - a,
                         lambda grid: {1.0 - x: m for x, m in measure([1.0 - g for g in grid]).items()})


def quotas(docs: DataFrame, goal: Goal = Goal(), doc_id: str = "doc_id", text: str = "text",
           source: str = "source", seed: int = 11) -> DataFrame:
    """One row per source: ``(source, docs, tokens, weight, quota, epochs, cutoff, blocks)``.

    ``weight``: normalised tempered share. ``quota``: tokens to take, ``weight`` times the
    budget and at most ``repeats`` times the source. A source is read ``epochs`` times in
    full; of the next permutation documents up to place ``cutoff`` (null: none) are taken,
    the longest front part that fits. Blocks are equal ranges of places: whole blocks are
    added up first, and only the block in which the quota ends is sorted, so no task
    holds a source. Tokens are words. A null source is a source; one without tokens has
    weight 0 and is read once. No documents give no rows.
    """
    narrow = stored(docs.select(F.col(source).alias("source"), F.col(doc_id).alias("doc_id"),
                                F.xxhash64(text).alias("t"),
                                F.size(words_of(whole_text(text))).cast("long").alias("n")), "tokens")
    sources = stored(narrow.groupBy("source").agg(
        F.count("*").alias("docs"), F.sum("n").alias("tokens")), "sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    budget = float(goal.budget if goal.budget is not None else total)
    shares = sources.where("tokens > 0").select((F.col("tokens") / float(total or 1)).alias("p"))
    a = exponent(shares, goal, budget / (total or 1)) if total else 1.0
    tempered = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / float(total or 1), F.lit(a))) \
        .otherwise(0.0)
    z = sources.agg(F.sum(tempered)).first()[0] or 1.0
    planned = stored(sources.withColumn("weight", tempered / z).withColumn(
        "quota", F.least(F.col("weight") * budget, F.col("tokens") * float(goal.repeats)))
        .withColumn("epochs", F.when(F.col("tokens") == 0, 1).otherwise(
            F.floor(F.col("quota") / F.col("tokens") + 1e-9)).cast("int"))
        .withColumn("rest", F.greatest(F.col("quota") - F.col("epochs") * F.col("tokens"), F.lit(0.0)))
        .withColumn("blocks", F.ceil(F.col("docs") / BLOCK_DOCS)), "planned")
    placed = narrow.join(planned.select(F.col("source").alias("s"), "epochs", "blocks", "rest"),
                         F.col("source").eqNullSafe(F.col("s"))).where("rest > 0").select(
        "source", "blocks", "rest", "n", _place("doc_id", "t", F.col("epochs"), seed).alias("place"))
    placed = placed.withColumn("block", block_of(F.col("place"), F.col("blocks")))
    sums = placed.groupBy("source", "block", "rest").agg(F.sum("n").alias("n"), F.max("place").alias("place"))
    before = Window.partitionBy("source").orderBy("block")
    sums = stored(sums.withColumn("upto", F.sum("n").over(before)), "blocks")
    whole = sums.where("upto <= rest").groupBy("source").agg(F.max("place").alias("cutoff"))
    # The first block that does not fit as a whole.
    ends = sums.where("upto > rest").groupBy("source").agg(
        F.min_by(F.struct("block", (F.col("upto") - F.col("n")).alias("base")), "block").alias("at"))
    ends = ends.select(F.col("source").alias("s"), F.col("at.block").alias("end"), "at.base")
    inside = placed.join(ends, F.col("source").eqNullSafe(F.col("s"))
                         & (F.col("block") == F.col("end"))).select("source", "place", "n", "base", "rest")
    # Documents with the same place come in together or not at all.
    run = F.sum("n").over(Window.partitionBy("source").orderBy("place")) + F.col("base")
    part = inside.withColumn("run", run).where("run <= rest").groupBy("source").agg(
        F.max("place").alias("cutoff"))
    cut = whole.union(part).groupBy("source").agg(F.max("cutoff").alias("cutoff"))
    return planned.join(cut.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")),
                        "left").select("source", "docs", "tokens", "weight", "quota", "epochs",
                                       "cutoff", "blocks")


def block_of(place: Column, blocks: Column) -> Column:
    return F.least(F.floor(place / F.lit(SPAN) * blocks), blocks - 1)


def mixed(docs: DataFrame, goal: Goal = Goal(), doc_id: str = "doc_id", text: str = "text",
          source: str = "source", seed: int = 11, columns: list[str] | None = None,
          order: bool = False) -> DataFrame:
    """``docs``, each row as often as its source's quota says (see ``quotas``).

    With ``order`` the columns ``mix_epoch``, ``mix_block`` and ``mix_place`` are added: a
    reader that takes epoch by epoch, block by block, in order of place, reads each
    source in a fresh permutation every time. Rows that repeat both id and text share a
    place and a fate. Other columns stay as they are (``columns`` names those wanted).
    """
    plan = stored(quotas(docs, goal, doc_id, text, source, seed), "quotas").select(
        F.col("source").alias("mix source"), F.col("epochs").alias("mix epochs"),
        F.col("cutoff").alias("mix cutoff"), F.col("blocks").alias("mix blocks"))
    names = columns or docs.columns
    keyed = docs.withColumn("mix text", F.xxhash64(text))
    joined = keyed.join(plan, F.col(source).eqNullSafe(F.col("mix source")))
    place = lambda e: _place(doc_id, "mix text", e, seed)
    more = F.coalesce(place(F.col("mix epochs")) <= F.col("mix cutoff"), F.lit(False))
    copies = F.col("mix epochs") + more.cast("int")
    each = joined.withColumn("mix_epoch", F.explode(F.when(copies > 0, F.sequence(F.lit(0), copies - 1))))
    out = [F.col(f"`{c}`") for c in names]
    if order:
        at = place(F.col("mix_epoch"))
        out += ["mix_epoch", block_of(at, F.col("mix blocks")).alias("mix_block"), at.alias("mix_place")]
    return each.select(*out)
