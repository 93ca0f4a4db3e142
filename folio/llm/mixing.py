"""Mixing sources to target weights: repetition rates per source and hash-seeded copies.

1. Sizes are summed per source (one partial-plus-final aggregation; a source with a third of
   all rows costs one partial row per task).
2. Targets: the budget is shared by weight; a target stops at ``max_rate`` times its source's
   size, and the excess goes to the others by weight until none is above. Each step is one
   aggregate over the table of sources that returns two numbers.
3. ``rate = target / size`` of the source. A document is emitted ``floor(rate)`` times, plus one
   Bernoulli copy with probability equal to the fraction, drawn from a hash of the document and
   a seed. Of ``seeds`` candidate seeds each source uses the one whose total comes nearest its
   target (one sum per seed in one aggregation): every copy is still a hash-seeded draw
   with the same probability, and the total's error shrinks with the number of seeds.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a
null id is hashed like any other value; rows of one id and text draw each for itself, by their place in the scan (a
large group of them would else be taken whole or not at all); an
empty table gives no rows; a source of size 0 has target and rate 0; the documents' columns travel
in one struct, so no name can clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.summary import numbered
from ._common import WORD_JAVA, packed, stored, unpacked

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_RATE = 2.0
SEEDS = 64
_UNIT = float(2**53)


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_JAVA)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_rate: float = MAX_RATE
) -> DataFrame:
    """``sizes(source, source_size)``, one row per source, with ``target`` and ``rate``.

    Sources in code point order (null last) take the weights in turn; their numbers come from range partitions.
    """
    turn = F.col("_turn") % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    placed = numbered(sizes, [], [F.col("source").asc_nulls_last()], "_turn")
    table = stored(placed.withColumn("weight", weight).drop("_turn"), "sources")
    cap = F.col("source_size") * max_rate
    budget = (table.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0  # target per unit of weight
    while True:
        fixed = cap <= F.col("weight") * level
        full, free = table.agg(
            F.sum(F.when(fixed, cap).otherwise(0.0)), F.sum(F.when(fixed, 0.0).otherwise(F.col("weight")))
        ).first()
        raised = (budget - full) / free if free else level
        if raised <= level:
            break
        level = raised
    target = F.least(cap, F.col("weight") * level)
    size = F.col("source_size")
    rate = F.when(size > 0, F.col("target") / size).otherwise(0.0)
    return table.withColumn("target", target).withColumn("rate", rate).drop("weight")


def _uniform(seed: Column) -> Column:
    """A number in [0, 1) from the document's hash and a seed."""
    return F.shiftrightunsigned(F.xxhash64(F.col("key"), seed), 11) / F.lit(_UNIT)


def repetitions(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    max_rate: float = MAX_RATE,
    seeds: int = SEEDS,
) -> DataFrame:
    """``row`` (a document's columns), ``size``, ``source_size``, ``target``, ``rate`` and ``copies``."""
    sized = packed(
        docs, size=word_count(F.col(text)), source=F.col(source), key=F.xxhash64(F.col(doc_id), F.col(text))
    ).withColumn("place", F.monotonically_increasing_id())
    keys = stored(sized.drop("row"), "sizes")
    again = stored(keys.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select(F.col("key").alias("_again")), "again")
    repeated = not again.isEmpty()

    def drawing(rows: DataFrame) -> DataFrame:
        """``key`` is what a row draws by: rows of one id and text get one each, by their place."""
        if not repeated:
            return rows
        own = F.when(F.col("_again").isNotNull(), F.xxhash64("key", "place")).otherwise(F.col("key"))
        return rows.join(again, F.col("key") == F.col("_again"), "left").withColumn("key", own).drop("_again")

    sources = source_targets(keys.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_rate)
    sources = sources.withColumnRenamed("source", "of")
    fraction = F.col("rate") - F.floor("rate")
    of_source = ["source_size", "target", "rate"]
    drawn = (
        drawing(keys)
        .join(sources, F.col("source").eqNullSafe(F.col("of")))
        .groupBy("of", *of_source)
        .agg(*[
            F.sum(F.when(_uniform(F.lit(s)) < fraction, F.col("size")).otherwise(0)).alias(f"extra{s}") for s in range(seeds)
        ])
    )
    off = [F.abs(F.col("source_size") * F.floor("rate") + F.col(f"extra{s}") - F.col("target")) for s in range(seeds)]
    best = F.array_min(F.array(*[F.struct(o.alias("off"), F.lit(s).alias("seed")) for s, o in enumerate(off)]))["seed"]
    chosen = stored(drawn.select("of", best.alias("seed"), *of_source), "rates")
    copies = F.floor("rate") + F.when(_uniform(F.col("seed")) < fraction, 1).otherwise(0)
    return (
        drawing(sized)
        .join(chosen, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("copies", copies.cast("long"))
        .select("row", "size", *of_source, "copies")
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each document so many times, with the documents' own columns."""
    rows = repetitions(docs, **options).where(F.col("copies") > 0)
    return unpacked(rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))), docs)
