"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

DataFrame operations only. Each source gets a target number of words. It runs
through a fixed random order of its documents as often as the target asks for,
and that run is cut into blocks of equal words. The blocks are dealt to output
shards by a tree: at each node, the urn of all blocks of all sources is drawn
from without replacement, half of it for either side, so each side's quota of
each source is multivariate hypergeometric and the quotas add up exactly. A
shard's quota of a source is a range of the run, disjoint from all other
shards' ranges, and documents of a shard are put in an order of its own.

Edge cases: a null or empty text has size 0 and is never taken; a source without
words has the target 0; a null source is a source, last in order; an empty table
gives an empty result. Equal rows are told apart by their order only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segeval.scratch import materialize

#: Weights of the sources in their order, repeating (fixed values of the query).
WEIGHTS = (5, 2, 1)

#: Documents of one part of a source's run, about.
PART_ROWS = 4096
LEAST_PARTS = 256

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """``share`` of all words to take, at most ``most`` times each source; ``2 ** levels`` shards."""

    weights: tuple[int, ...] = WEIGHTS
    share: float = 1.5
    most: float = 2.0
    levels: int = 4
    blocks_a_shard: int = 256
    seed: int = 20


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """``source, source_size, target``, one row per source, from rows of ``source, source_size``.

    Targets go by weight; those above ``most`` times their source stop there, and
    the rest is shared again until none is above. That is one level of words per
    weight, found by going through the sources in the order of their limits.
    Only one row per source passes through one task.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    turn = (F.row_number().over(order) - 1) % len(mix.weights)
    weight = F.get(F.array(*[F.lit(float(w)) for w in mix.weights]), turn)
    limit = F.lit(mix.most) * F.col("source_size")
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("limit") / F.col("weight"), F.asc_nulls_last("source"))
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    weighed = sizes.withColumn("weight", weight).withColumn("limit", limit)
    # If the sources before this one stop at their limits, the others get so many words per weight.
    left = F.lit(mix.share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    weights_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = weighed.withColumn("level", left / weights_left)
    stopped = F.col("limit") <= F.col("level") * F.col("weight")
    final = F.max(F.when(~stopped, F.col("level"))).over(everything)
    target = F.when(stopped, F.col("limit")).otherwise(F.least("limit", final * F.col("weight")))
    return level.select("source", "source_size", target.alias("target"))


def _priority(level: int, mix: Mix) -> Column:
    return F.xxhash64(F.lit(mix.seed), F.lit(level), "source", "block")


def split_quotas(quotas: DataFrame, mix: Mix) -> DataFrame:
    """``source, shard, first, past``: the range of its blocks that each source gives each shard.

    ``quotas`` holds ``source, blocks``. The urn has at most ``blocks_a_shard``
    blocks for each shard and one more for each source, for any size of the data.
    """
    urn = quotas.where("blocks > 0").select("source", F.explode(F.sequence(F.lit(1), F.col("blocks"))).alias("block"))
    urn = urn.withColumn("node", F.lit(0))
    for level in range(mix.levels):
        node = Window.partitionBy("node")
        drawn = F.row_number().over(node.orderBy(_priority(level, mix), F.asc_nulls_last("source"), "block"))
        right = (drawn > F.ceil(F.count("*").over(node) / 2)).cast("int")
        urn = urn.select("source", "block", (2 * F.col("node") + right).alias("node"))
    shares = urn.groupBy("source", F.col("node").alias("shard")).agg(F.count("*").alias("quota"))
    past = F.sum("quota").over(Window.partitionBy("source").orderBy("shard"))
    return shares.select("source", "shard", (past - F.col("quota")).alias("first"), past.alias("past"))


def _runs(docs: DataFrame, keys: list[str], mix: Mix) -> DataFrame:
    """Rows with ``size`` and ``start``, the words of their source before them in its random order."""
    spread = F.xxhash64(F.lit(mix.seed), *keys)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    narrow = materialize(docs.select(*keys, "source", size.alias("size"), spread.alias("spread")), "sizes")
    parts, least = narrow.count() // PART_ROWS, LEAST_PARTS
    while least < parts:
        least *= 2
    # The high bits of the order number a part, so that parts follow one another in the run.
    part = F.shiftright(F.col("spread"), 64 - (least.bit_length() - 1))
    rows = narrow.withColumn("part", part)
    totals = rows.groupBy("source", "part").agg(F.sum("size").alias("words"))
    ahead = F.sum("words").over(Window.partitionBy("source").orderBy("part")) - F.col("words")
    totals = totals.select(F.struct("source", "part").alias("of"), ahead.alias("ahead"))
    inside = Window.partitionBy("source", "part").orderBy("spread", *keys, "size")
    within = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    rows = rows.withColumn("within", within).withColumn("of", F.struct("source", "part"))
    joined = rows.join(totals.withColumnRenamed("of", "__of"), F.col("of").eqNullSafe(F.col("__of")))
    return joined.select(*keys, "source", "size", "spread", (F.col("ahead") + F.col("within")).alias("start"))


def mix_documents(docs: DataFrame, keys: list[str], mix: Mix = Mix()) -> DataFrame:
    """What the mix takes of each document.

    ``keys`` name a document. Returns them with ``source``, ``size`` (words),
    ``source_size``, ``target`` (words the mix takes of the source), ``taken`` (words
    of this document, repeats counted) and ``draws``: for each time it is taken,
    the shard, the place in the shard's order, and the number of words. Only the
    last document of a source's run is taken in part.
    """
    runs = materialize(_runs(docs, keys, mix), "runs")
    goals = targets(runs.groupBy("source").agg(F.sum("size").alias("source_size")), mix)
    goals = materialize(goals.withColumn("goal", F.round("target").cast("long")), "targets")
    shards = 1 << mix.levels
    whole = goals.agg(F.coalesce(F.sum("goal"), F.lit(0))).first()[0]
    block = max(1, -(-whole // (shards * mix.blocks_a_shard)))
    quotas = goals.select("source", F.ceil(F.col("goal") / block).cast("int").alias("blocks"))
    ranges = split_quotas(quotas, mix).groupBy("source").agg(F.sort_array(F.collect_list(F.struct("past", "shard"))).alias("ranges"))
    plan = goals.join(ranges.withColumnRenamed("source", "__of"), F.col("source").eqNullSafe(F.col("__of")), "left")
    plan = materialize(plan.select(F.col("source").alias("__source"), "source_size", "target", "goal", "ranges"), "plan")

    def draw(turn: int) -> Column:
        start = F.col("start") + turn * F.col("source_size")
        words = F.least(F.col("size"), F.greatest(F.col("goal") - start, F.lit(0).cast("long")))
        at = F.floor(start / F.lit(block))
        shard = F.get(F.filter("ranges", lambda r: r["past"] > at), F.lit(0))["shard"]
        place = F.xxhash64(F.lit(mix.seed), F.lit("place"), shard, F.lit(turn), "spread")
        return F.struct(shard.alias("shard"), place.alias("place"), words.alias("words"))

    draws = F.array(*[draw(t) for t in range(int(-(-mix.most // 1)))])
    drawn = F.filter(draws, lambda d: d["words"] > 0)
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda total, d: total + d["words"])
    joined = runs.join(plan, F.col("source").eqNullSafe(F.col("__source"))).withColumn("draws", drawn)
    return joined.select(*keys, "source", "size", "source_size", "target", taken.alias("taken"), "draws")
