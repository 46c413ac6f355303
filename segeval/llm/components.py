"""Connected components of a graph in a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segeval.scratch import materialize


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b``, both long, not null).

    Each round, every node hooks onto the neighbour that comes first in a random
    order of that round, or onto itself if it comes first; then links join the
    hooks' ends. A constant share of the nodes goes each round, so the rounds
    grow with the logarithm of the number of nodes whatever the shape of the
    graph. Tables are written between rounds, which cuts the lineage. Rows per
    key are summed up before they are shuffled; joins meet written tables, so
    that Spark can split a hub with many links.
    """
    links = materialize(links.where("a != b").select("a", "b").distinct(), "links")
    hooks: list[DataFrame] = []
    while links.take(1):
        turn = F.lit(len(hooks))
        either = links.select("a", "b").union(links.select("b", "a")).toDF("node", "other")
        first = either.groupBy("node").agg(F.min(F.struct(F.xxhash64(turn, "other").alias("order"), "other")).alias("first"))
        own = F.struct(F.xxhash64(turn, "node").alias("order"), F.col("node").alias("other"))
        hooks.append(materialize(first.select("node", F.least("first", own)["other"].alias("hook")), "hooks"))
        left = hooks[-1].toDF("a", "left")
        right = hooks[-1].toDF("b", "right")
        moved = links.join(left, "a").join(right, "b").select(F.col("left").alias("a"), F.col("right").alias("b"))
        links = materialize(moved.where("a != b").distinct(), "links")
    if not hooks:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = hooks[-1].withColumnRenamed("hook", "root")
    for hook in reversed(hooks[:-1]):
        known = roots.toDF("hook", "root")
        # A hook that no later round saw has no link left: it is its own root.
        roots = materialize(hook.join(known, "hook", "left").select("node", F.coalesce("root", "hook").alias("root")), "roots")
    return roots
