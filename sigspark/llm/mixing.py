"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Source token shares are exponentiated; the exponent is bisected until the mixture has a target
entropy, or until no source is repeated more than a limit. The normalised weights become token
budgets, and every source's budget is filled by whole passes over its documents and one partial pass,
each pass in an order of its own: a permutation of blocks, and of the documents inside each block.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, numbered, read_table, scoped, scratch

GRID = 32
#: Blocks whose totals are summed up in one task.
RUN = 1000
DRAWN = "mixing_row"


@dataclass(frozen=True)
class Settings:
    """Give ``entropy`` (in nats) or leave it None for the limit ``most_repeats``.

    ``budget``: tokens of the mixture; None is the least budget that passes over every source once,
    so that no document is lost. ``block_docs``: documents of a block, on average.
    """

    most_repeats: float = 2.0
    entropy: float | None = None
    budget: int | None = None
    block_docs: int = 1000
    seed: int = 7
    rounds: int = 4


def word_count(text: Column) -> Column:
    """Words of a text, one at least: the measure of tokens unless another is given."""
    words = F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+")
    blank = F.when(words[0] == "", 1).otherwise(0) + F.when((F.size(words) > 1) & (F.element_at(words, -1) == ""), 1).otherwise(0)
    return F.greatest(F.size(words) - blank, F.lit(1)).cast("long")


def curve(sources: DataFrame, exponents: list[float]) -> dict[float, tuple[float, float]]:
    """Of each exponent: the entropy, and how much more often the rarest source is repeated than the commonest."""
    grid = sources.select(F.explode(F.array(*map(F.lit, exponents))).alias("a"), F.log("tokens").alias("x"))
    weight = F.exp(F.col("a") * F.col("x"))
    repeat = (F.col("a") - 1) * F.col("x")
    rows = grid.groupBy("a").agg(
        F.log(F.sum(weight)).alias("z"), (F.sum(weight * F.col("a") * F.col("x")) / F.sum(weight)).alias("mean"),
        (F.max(repeat) - F.min(repeat)).alias("spread"),
    )
    return {r.a: (r.z - r["mean"], math.exp(r.spread)) for r in rows.collect()}


def bisect_exponent(sources: DataFrame, settings: Settings) -> float:
    """The exponent in 0..1; each round cuts the interval into ``GRID`` parts in one small job.

    Entropy and spread both fall as the exponent rises. The answer is the least exponent of the last
    grid whose entropy is at most the target, or whose spread is within the repetition limit; 1 if none is.
    """
    low, high = 0.0, 1.0
    for _ in range(settings.rounds):
        points = [round(low + (high - low) * i / GRID, 9) for i in range(GRID + 1)]
        at = curve(sources, points)
        fits = [p for p in points if p in at and (at[p][0] <= settings.entropy + 1e-12 if settings.entropy is not None else at[p][1] <= settings.most_repeats + 1e-9)]
        if not fits or fits[0] == points[0]:
            return fits[0] if fits else high
        low, high = points[points.index(fits[0]) - 1], fits[0]
    return high


def budgets(sources: DataFrame, settings: Settings) -> DataFrame:
    """(source, docs, tokens, weight, budget, passes, rest) from (source, docs, tokens)."""
    exponent = bisect_exponent(sources, settings)
    power = F.exp(F.lit(exponent) * F.log("tokens"))
    total = sources.agg(F.sum(power).alias("z"), F.max(F.col("tokens") / power).alias("c")).first()
    whole = settings.budget if settings.budget is not None else (total.c or 0.0) * (total.z or 0.0)
    weight = power / F.lit(total.z or 1.0)
    return (
        sources.withColumn("weight", weight)
        .withColumn("budget", F.round(F.lit(float(whole)) * F.col("weight")).cast("long"))
        .withColumn("passes", F.floor(F.col("budget") / F.col("tokens")).cast("int"))
        .withColumn("rest", F.col("budget") - F.col("passes") * F.col("tokens"))
        .withColumn("blocks", F.ceil(F.col("docs") / settings.block_docs).cast("long"))
    )


@dataclass(frozen=True)
class Plan:
    """``rows``: (doc_id, source, tokens, own), each with a number of its own. ``sources``: (source, passes, rest, blocks). ``starts``:
    (source, block, start, size), the tokens before a block in its source's partial pass, and those in it."""

    rows: DataFrame
    sources: DataFrame
    starts: DataFrame


def block_of(epoch: Column | str, settings: Settings) -> Column:
    return F.pmod(F.xxhash64("own", F.lit(settings.seed), epoch), F.col("blocks"))


def key_of(epoch: Column | str, settings: Settings) -> Column:
    """Orders a block's documents."""
    return F.xxhash64(epoch, F.lit(settings.seed), "own")


def planned(docs: DataFrame, settings: Settings, tokens: Column | None) -> Plan:
    measure = word_count(F.col("text")) if tokens is None else tokens
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("source"), measure.alias("tokens"))
    narrow = materialise(narrow)
    rows, ids = narrow.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    narrow = narrow.withColumn("own", F.col("doc_id")) if rows == ids else numbered(narrow, "doc_id", "source", "tokens", name="own")
    sources = materialise(narrow.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens")))
    plan = materialise(budgets(sources, settings).select("source", "passes", "rest", "blocks"))
    last = narrow.join(plan.filter("rest > 0"), "source").withColumn("block", block_of("passes", settings))
    totals = last.groupBy("source", "block").agg(F.sum("tokens").alias("size"))
    # Blocks are placed in two levels, so that no task has all blocks of a source.
    totals = totals.withColumn("run", F.floor(F.col("block") / RUN))
    upto = lambda w: F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    runs = totals.groupBy("source", "run").agg(F.sum("size").alias("size")).withColumn("before_run", upto(Window.partitionBy("source").orderBy("run")))
    within = totals.withColumn("in_run", upto(Window.partitionBy("source", "run").orderBy("block")))
    starts = within.join(runs.drop("size"), ["source", "run"]).select("source", "block", (F.col("before_run") + F.col("in_run")).alias("start"), "size")
    return Plan(narrow, plan, starts)


def before_in(order: Window) -> Column:
    return F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens")


@scoped
def mix(docs: DataFrame, settings: Settings = Settings(), tokens: Column | None = None) -> DataFrame:
    """One row per drawn copy of a document: doc_id, source, tokens, epoch, block, place.

    (epoch, block, place) orders a source's draws. Epochs from 0 are whole passes; the last takes
    documents in its order while the tokens before them are under the rest of the budget. Null and
    empty sources are one source, ''. Empty texts weigh one token. Rows that repeat an id, or have a
    null one, are documents of their own: where there are any, all rows are numbered by id, source and tokens, and dealt
    out to blocks by these numbers, so that no id, and not the null ids together, are one block. An empty table gives no row.

    Sources are as many as they are: their table is never collected, and a hot source is dealt out by
    its blocks. Only totals of runs of blocks are ranked within a source.
    """
    p = planned(docs, settings, tokens)
    drawn = (
        p.rows.join(p.sources, "source")
        .withColumn("epoch", F.explode(F.expr("sequence(0, if(rest > 0, passes, passes - 1))")))
        .filter("epoch >= 0 and (epoch < passes or rest > 0)")
        .withColumn("block", block_of("epoch", settings))
        .withColumn("key", key_of("epoch", settings))
    )
    inside = Window.partitionBy("source", "epoch", "block").orderBy("key", "own")
    placed = drawn.withColumn("place", F.row_number().over(inside).cast("long")).withColumn("before", before_in(inside))
    wanted = ["doc_id", "source", "tokens", "epoch", "block", "place"]
    partial = placed.filter("epoch = passes").join(p.starts, ["source", "block"]).filter("start + before < rest")
    return placed.filter("epoch < passes").select(*wanted).unionByName(partial.select(*wanted))


def repeated(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with each row as often as ``mix`` draws it; rows that repeat an id, or have none, are drawn one by one.

    A row knows how often from its source's passes and its block, which comes before the end of the partial pass or behind it;
    only rows of the block that the pass ends in, one a source, are listed. So texts meet two small tables, and aren't dealt out anew
    as long as Spark finds these small enough to send.
    """
    rows, ids = docs.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    named = docs.withColumn(DRAWN, F.col("doc_id")) if rows == ids else materialise(docs.withColumn(DRAWN, F.monotonically_increasing_id()))
    with scratch(docs.sparkSession) as keep:
        p = planned(named.select(F.col(DRAWN).alias("doc_id"), "source", "text"), settings, None)
        whole = p.sources.join(p.starts, "source").filter("start + size <= rest").groupBy("source").agg(F.max("block").alias("last"))
        plan = keep(p.sources.join(whole, "source", "left").select("source", "passes", "rest", "blocks", "last"))
        cut = p.sources.join(p.starts, "source").filter("start < rest and start + size > rest")
        near = p.rows.join(cut, "source").filter(block_of("passes", settings) == F.col("block"))
        inside = Window.partitionBy("source").orderBy(key_of("passes", settings), "own")
        listed = keep(near.withColumn("before", before_in(inside)).filter("start + before < rest").select("own"))
    own = named.select(F.col(DRAWN).cast("long").alias("own"), F.coalesce(F.col("source"), F.lit("")).alias(DRAWN + "_source"), F.struct(*docs.columns).alias("row"))
    both = own.join(plan.withColumnRenamed("source", DRAWN + "_source"), DRAWN + "_source").join(listed.withColumn("listed", F.lit(1)), "own", "left")
    extra = F.when(F.col("rest") > 0, F.coalesce((block_of("passes", settings) <= F.col("last")).cast("int"), F.lit(0)) + F.coalesce("listed", F.lit(0))).otherwise(0)
    times = both.withColumn("times", (F.col("passes") + extra).cast("int")).filter("times > 0")
    return times.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))
