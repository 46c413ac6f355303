"""Agreement of metric scores with human scores: Pearson, Spearman and Kendall per metric.

Input is a long table ``(metric, score, human)``. Pairs with a missing or
infinite value are dropped first, and a metric with fewer than two pairs or a
constant side gets NULL.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segeval.functions.expr import finite
from segeval.functions.significance import kendall_p_value, t_test_p_value
from segeval.operators.grouped import per_group
from segeval.operators.order import rank_table
from segeval.scratch import materialize

COEFFICIENTS = ("pearson", "spearman", "kendall")
RESULT_COLUMNS = (
    "metric",
    "n",
    "pearson",
    "spearman",
    "kendall",
    "p_value_pearson",
    "p_value_spearman",
    "p_value_kendall",
)


# Pairs per bin of a metric; beyond MAX_BINS * ROWS_PER_BIN pairs, bins grow with the data.
ROWS_PER_BIN = 1 << 17
MAX_BINS = 16384

# Pairs of a group that are summed up in one task.
GROUP_ROWS = 1 << 17

# Per-metric statistics and sums from which all coefficients follow.
STATS = ("n", "x_min", "x_max", "y_min", "y_max")
SUMS = (
    *("sxx", "syy", "sxy", "rxx", "ryy", "rxy"),
    *("x_ties", "y_ties", "both_ties", "x_var", "y_var", "x_cube", "y_cube"),
)


def finite_pairs(scores: DataFrame, metric: str = "metric", score: str = "score", human: str = "human") -> DataFrame:
    """``(metric, x, y)`` for the rows on which both scores are finite."""
    x, y = F.col(score).cast("double"), F.col(human).cast("double")
    return scores.where(finite(x) & finite(y)).select(F.col(metric).alias("metric"), x.alias("x"), y.alias("y"))


def _unit_range(value: Column) -> Column:
    return F.when(value > 1, 1.0).when(value < -1, -1.0).otherwise(value)


def _guarded(value: Column) -> Column:
    varies = (F.col("n") >= 2) & (F.col("x_min") < F.col("x_max")) & (F.col("y_min") < F.col("y_max"))
    return F.when(varies, value)


def pearson(scores: DataFrame) -> DataFrame:
    """``(metric, n, pearson)`` in one aggregation."""
    # `corr` raises on a constant side under ANSI, hence the explicit quotient.
    ratio = F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))
    return (
        finite_pairs(scores)
        .groupBy("metric")
        .agg(
            F.count("*").alias("n"),
            ratio.alias("r"),
            *[f(c).alias(f"{c}_{name}") for c in "xy" for name, f in (("min", F.min), ("max", F.max))],
        )
        .select("metric", "n", _guarded(_unit_range(F.col("r"))).alias("pearson"))
    )


def _ranks(pairs: DataFrame) -> DataFrame:
    """``(metric, axis, value, weight, before, n, mean, bin)``: the rank table of both sides of the pairs.

    Bins hold about ``ROWS_PER_BIN`` pairs. A value with more than that has a bin of its own, with an odd number.
    """
    side = F.explode(F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).alias("value")) for c in "xy"]))
    values = pairs.select("metric", "w", side.alias("s")).select("metric", "w", "s.*")
    ranked = rank_table(values.groupBy("metric", "axis", "value").agg(F.sum("w").alias("weight")), "metric", "axis")
    size = F.greatest(F.lit(float(ROWS_PER_BIN)), F.ceil(F.col("n") / MAX_BINS))
    bin_ = 2 * F.floor(F.col("before") / size) + F.when(F.col("weight") >= size, 1).otherwise(0)
    return ranked.withColumn("bin", bin_.cast("int"))


def _side(ranks: DataFrame, axis: str) -> DataFrame:
    """The rank table of one axis, to be joined to the pairs."""
    columns = ("before", "weight", "n", "mean", "bin")
    return ranks.where(F.col("axis") == axis).select("metric", F.col("value").alias(axis), *[F.col(c).alias(f"{axis}_{c}") for c in columns])


def _side_sums(ranks: DataFrame, axis: str, **more: Column) -> DataFrame:
    """Per metric: what follows from the distinct values of one side, and sums of ``more``."""
    w = t = F.col("weight")
    d, r = F.col("value") - F.col("mean"), _centred_rank()
    terms = {f"s{axis}{axis}": d * d, f"r{axis}{axis}": r * r, f"{axis}_ties": (t - 1) / 2}
    terms |= {f"{axis}_var": (t - 1) * (2 * t + 5), f"{axis}_cube": (t - 1) * (t - 2)}
    return ranks.groupBy("metric").agg(
        F.min("n").alias("n"),
        F.min("value").alias(f"{axis}_min"),
        F.max("value").alias(f"{axis}_max"),
        *[F.sum(w * term).alias(name) for name, term in terms.items()],
        *[F.sum(c).alias(name) for name, c in more.items()],
    )


def _centred_rank() -> Column:
    """Average rank of a rank table's value, less the mean rank, so that sums of products keep their digits."""
    return F.col("before") + (F.col("weight") + 1) / 2 - (F.col("n") + 1) / 2


def _rank_sums(scores: DataFrame) -> DataFrame:
    """``STATS`` and the sums of values and ranks, one row per metric.

    Ranks of ``x`` come from its histogram and join the pairs. The histogram of ``y`` then carries the sums of
    those ranks, so the ranks of ``y`` are never joined to pairs.
    """
    pairs = finite_pairs(scores)
    one = F.count("*").cast("double").alias("weight")
    x = rank_table(pairs.groupBy("metric", F.col("x").alias("value")).agg(one), "metric")
    ranks = x.select("metric", F.col("value").alias("x"), _centred_rank().alias("x_rank"), (F.col("value") - F.col("mean")).alias("x_off"))
    of_x = [F.sum("x_rank").alias("x_ranks"), F.sum("x_off").alias("x_offs")]
    y = rank_table(pairs.join(ranks, ["metric", "x"]).groupBy("metric", F.col("y").alias("value")).agg(one, *of_x), "metric")
    products = {"rxy": _centred_rank() * F.col("x_ranks"), "sxy": (F.col("value") - F.col("mean")) * F.col("x_offs")}
    return _side_sums(x, "x").join(_side_sums(y, "y", **products).drop("n"), "metric")


def _cells(ranked: DataFrame) -> DataFrame:
    """Per metric and pair of bins: the number of pairs, and sums over them."""
    w = F.col("w")
    # Ranks are centred beforehand, so that the sum of products keeps its digits.
    x_rank, y_rank = ((F.col(f"{c}_before") + (F.col(f"{c}_weight") + 1) / 2 - (F.col("x_n") + 1) / 2) for c in "xy")
    return ranked.groupBy("metric", "x_bin", "y_bin").agg(
        F.sum("w").alias("c"),
        F.sum(w * (F.col("x") - F.col("x_mean")) * (F.col("y") - F.col("y_mean"))).alias("sxy"),
        F.sum(w * x_rank * y_rank).alias("rxy"),
        F.sum(w * (w - 1) / 2).alias("both_ties"),
    )


def inversions(first: np.ndarray, second: np.ndarray, weight: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Per block, the sum of ``w_i * w_j`` over pairs with ``first`` rising and ``second`` falling.

    Blocks are numbered from 0. Radix counting: pairs are split by the highest bit in
    which the ranks of ``second`` differ, so each bit needs one pass of cumulative sums
    over the rows of all blocks together.
    """
    blocks = int(block.max()) + 1 if len(block) else 0
    order = np.lexsort((second, first, block))
    weight = weight[order].astype(np.float64)
    _, rank = np.unique(second[order], return_inverse=True)
    bits = int(rank.max()).bit_length() if len(rank) else 0
    key = (block[order].astype(np.int64) << bits) | rank
    total = np.zeros(blocks)
    for bit in range(bits - 1, -1, -1):
        one = ((key >> bit) & 1).astype(bool)
        starts = np.flatnonzero(np.diff(key >> (bit + 1), prepend=-1))
        sizes = np.diff(starts, append=len(key))
        ones = np.cumsum(np.where(one, weight, 0.0))
        seen = ones - np.repeat(np.concatenate(([0.0], ones))[starts], sizes)
        total += np.bincount(key[~one] >> bits, weights=seen[~one] * weight[~one], minlength=blocks)
        # Move the zeros of every run before its ones, both in their old order.
        count = np.cumsum(one)
        before = np.concatenate(([0], count))[starts]
        ones_before = count - np.repeat(before, sizes)
        in_run = np.arange(len(key)) - np.repeat(starts, sizes)
        zeros = sizes - (count[starts + sizes - 1] - before)
        place = np.where(one, np.repeat(starts + zeros, sizes) + ones_before - 1, np.repeat(starts, sizes) + in_run - ones_before)
        moved_key, moved_weight = np.empty_like(key), np.empty_like(weight)
        moved_key[place], moved_weight[place] = key, weight
        key, weight = moved_key, moved_weight
    return total


def inversion_weight(first: np.ndarray, second: np.ndarray, weight: np.ndarray, block: np.ndarray) -> float:
    """The same over all blocks."""
    _, number = np.unique(block, return_inverse=True)
    return float(inversions(first, second, weight, number).sum())


def _sums(scores: DataFrame) -> DataFrame:
    """``STATS``, ``SUMS`` and the discordant weight, one row per metric."""
    pairs = finite_pairs(scores).groupBy("metric", "x", "y").agg(F.count("*").cast("double").alias("w"))
    pairs = materialize(pairs, "pairs")
    ranks = _ranks(pairs)
    ranked = pairs.join(_side(ranks, "x"), ["metric", "x"]).join(_side(ranks, "y"), ["metric", "y"])
    ranked = materialize(ranked, "ranked-pairs")
    cells = materialize(_cells(ranked), "cells")
    of_pairs = cells.groupBy("metric").agg(*[F.sum(c).alias(c) for c in ("sxy", "rxy", "both_ties")])
    sides = [_side_sums(ranks.where(F.col("axis") == axis), axis) for axis in "xy"]
    table = sides[0].join(sides[1].drop("n"), "metric").join(of_pairs, "metric")
    return table.join(_discordant(ranked, cells), "metric").select("metric", *STATS, *SUMS, "discordant")


def _discordant_in_bins(rows: pa.Table, group: np.ndarray) -> dict[str, np.ndarray]:
    """Discordant weight inside bins of one axis, leaving out pairs that share the other bin if ``other`` is set."""
    own, cross, weight, other = (rows.column(c).to_numpy() for c in ("own", "cross", "w", "other"))
    total = inversions(own, cross, weight, group)
    # Within a group, rows of the same other bin are a block of their own.
    inner = other >= 0
    if inner.any():
        _, block = np.unique(np.stack([group[inner], other[inner]]), axis=1, return_inverse=True)
        block = block.reshape(-1)
        owner = np.zeros(int(block.max()) + 1, dtype=np.int64)
        owner[block] = group[inner]
        total -= np.bincount(owner, weights=inversions(own[inner], cross[inner], weight[inner], block), minlength=len(total))
    return {"discordant": total}


def _discordant_in_blocks(rows: pa.Table, group: np.ndarray) -> dict[str, np.ndarray]:
    """Discordant weight between cells of one block that differ in both bins."""
    return {"discordant": inversions(*(rows.column(c).to_numpy() for c in ("x_bin", "y_bin", "c")), group)}


def _discordant(binned: DataFrame, cells: DataFrame) -> DataFrame:
    """``(metric, discordant)``: weight of pairs ordered differently by the two scores.

    Pairs in different bins on both axes are counted from the table of bin
    sizes, block by block of the first axis: sums over the blocks to the right
    for cells of different blocks, and a count over the cells of one block. Pairs
    that share a bin are counted bin by bin. Bins of one value hold no discordant
    pair on their own axis.
    """
    size = cells.groupBy("metric").agg(F.max("x_bin").alias("x_last"), F.max("y_bin").alias("y_last"))
    # As many blocks as bins in a block: the grid of blocks and bins stays far below that of all bins.
    size = size.withColumn("width", F.ceil(F.sqrt(F.col("x_last") + 1)).cast("int"))
    cells = cells.join(size.select("metric", "width"), "metric").withColumn("block", F.floor(F.col("x_bin") / F.col("width")).cast("int"))
    sums = cells.groupBy("metric", "block", "y_bin").agg(F.sum("c").alias("c"))
    last_block = F.floor(F.col("x_last") / F.col("width")).cast("int")
    grid = (
        size.select("metric", "y_last", F.explode(F.sequence(F.lit(0), last_block)).alias("block"))
        .select("metric", "block", F.explode(F.sequence(F.lit(0), "y_last")).alias("y_bin"))
        .join(sums, ["metric", "block", "y_bin"], "left")
        .withColumn("c", F.coalesce("c", F.lit(0.0)))
    )
    lower = Window.partitionBy("metric", "block").orderBy("y_bin").rowsBetween(Window.unboundedPreceding, -1)
    right = Window.partitionBy("metric", "y_bin").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    below = grid.withColumn("below", F.sum("c").over(lower)).withColumn("below_right", F.sum("below").over(right))
    across = below.select("metric", (F.col("c") * F.coalesce("below_right", F.lit(0.0))).alias("discordant"))
    in_block = per_group(cells, ["metric", "block"], _discordant_in_blocks, "discordant double").select("metric", "discordant")
    one_axis = F.explode(
        F.array(
            F.struct(F.lit("x").alias("axis"), F.col("x_bin").alias("bin"), F.col("x").alias("own"), F.col("y").alias("cross"), F.lit(-1).alias("other")),
            F.struct(F.lit("y").alias("axis"), F.col("y_bin").alias("bin"), F.col("y").alias("own"), F.col("x").alias("cross"), F.col("x_bin").alias("other")),
        )
    )
    sided = binned.select("metric", "w", one_axis.alias("side")).select("metric", "w", "side.*").where(F.col("bin") % 2 == 0)
    within = per_group(sided, ["metric", "axis", "bin"], _discordant_in_bins, "discordant double").select("metric", "discordant")
    return across.unionByName(in_block).unionByName(within).groupBy("metric").agg(F.sum("discordant").alias("discordant"))


def _spearman_column() -> Column:
    return _guarded(_unit_range(F.try_divide(F.col("rxy"), F.sqrt("rxx") * F.sqrt("ryy"))))


def _pearson_column() -> Column:
    return _guarded(_unit_range(F.try_divide(F.col("sxy"), F.sqrt("sxx") * F.sqrt("syy"))))


def _kendall_columns(df: DataFrame) -> DataFrame:
    """Add the pair counts, tau-b and the normal deviate of Kendall's test."""
    n = F.col("n")
    pairs = n * (n - 1) / 2
    s = pairs - F.col("x_ties") - F.col("y_ties") + F.col("both_ties") - 2 * F.col("discordant")
    ordered = n * (n - 1)
    variance = (
        (ordered * (2 * n + 5) - F.col("x_var") - F.col("y_var")) / 18
        + F.try_divide(2 * F.col("x_ties") * F.col("y_ties"), ordered)
        + F.coalesce(F.try_divide(F.col("x_cube") * F.col("y_cube"), 9 * ordered * (n - 2)), F.lit(0.0))
    )
    tau = F.try_divide(s, F.sqrt(pairs - F.col("x_ties")) * F.sqrt(pairs - F.col("y_ties")))
    return df.withColumn("concordant_minus_discordant", s).select(
        "*",
        _guarded(_unit_range(tau)).alias("kendall"),
        _guarded(F.try_divide(F.col("concordant_minus_discordant"), F.sqrt(variance))).alias("kendall_z"),
    )


def spearman(scores: DataFrame) -> DataFrame:
    """``(metric, n, spearman)``: Pearson's coefficient of the average ranks."""
    sums = _rank_sums(scores)
    return sums.select("metric", F.col("n").cast("long").alias("n"), _spearman_column().alias("spearman"))


def kendall(scores: DataFrame) -> DataFrame:
    """``(metric, n, discordant, kendall, kendall_z)``: tau-b and its normal deviate."""
    return _kendall_columns(_sums(scores)).select(
        "metric", F.col("n").cast("long").alias("n"), F.col("discordant").cast("long").alias("discordant"), "kendall", "kendall_z"
    )


def _coefficients(sums: DataFrame) -> DataFrame:
    """``RESULT_COLUMNS`` from ``STATS``, ``SUMS`` and the discordant weight."""
    table = _kendall_columns(sums)
    untied = (F.col("x_ties") == 0) & (F.col("y_ties") == 0)
    return table.select(
        "metric",
        F.col("n").cast("long").alias("n"),
        _pearson_column().alias("pearson"),
        _spearman_column().alias("spearman"),
        "kendall",
        "kendall_z",
        "discordant",
        untied.alias("untied"),
    ).select(
        "metric",
        "n",
        *COEFFICIENTS,
        t_test_p_value(F.col("pearson"), F.col("n"), F.lit(1.0)).alias("p_value_pearson"),
        t_test_p_value(F.col("spearman"), F.col("n"), F.lit(None).cast("double")).alias("p_value_spearman"),
        kendall_p_value(F.col("kendall_z"), F.col("n"), F.col("discordant"), F.col("untied")).alias("p_value_kendall"),
    )


def correlations(scores: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """All three coefficients and their p-values, one row per metric.

    ``metrics`` (a column ``metric``) lists metrics that must appear even if
    they have no usable pair; their values are NULL. The distinct pairs are
    written and binned when this is called.
    """
    result = _coefficients(_sums(scores))
    if metrics is not None:
        result = metrics.select("metric").distinct().join(result, "metric", "left")
    return result.select(*RESULT_COLUMNS)


def _tied(value: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Average rank of every value in its group, and how many values of the group equal it."""
    order = np.lexsort((value, group))
    v, g = value[order], group[order]
    starts = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (g[1:] != g[:-1])]))
    sizes = np.diff(starts, append=len(v))
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    before = starts - np.repeat(first, np.diff(first, append=len(v)))[starts]
    rank, tied = np.empty(len(v)), np.empty(len(v))
    rank[order] = np.repeat(before + (sizes + 1) / 2, sizes)
    tied[order] = np.repeat(sizes, sizes)
    return rank, tied


def _group_sums(rows: pa.Table, group: np.ndarray) -> dict[str, np.ndarray]:
    """``STATS``, ``SUMS`` and the discordant pairs of many small groups at once."""
    x, y = rows.column("x").to_numpy(), rows.column("y").to_numpy()
    n = np.bincount(group).astype(np.float64)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))

    def total(values: np.ndarray) -> np.ndarray:
        return np.bincount(group, weights=values, minlength=len(n))

    out = {"n": n, "discordant": inversions(x, y, np.ones(len(x)), group)}
    off, rank = {}, {}
    for axis, value in (("x", x), ("y", y)):
        out |= {f"{axis}_min": np.minimum.reduceat(value, starts), f"{axis}_max": np.maximum.reduceat(value, starts)}
        off[axis] = value - (total(value) / n)[group]
        mean_rank, t = _tied(value, group)
        rank[axis] = mean_rank - ((n + 1) / 2)[group]
        out |= {f"{axis}_ties": total((t - 1) / 2), f"{axis}_var": total((t - 1) * (2 * t + 5)), f"{axis}_cube": total((t - 1) * (t - 2))}
    for a, b in ("xx", "yy", "xy"):
        out |= {f"s{a}{b}": total(off[a] * off[b]), f"r{a}{b}": total(rank[a] * rank[b])}
    # Equal pairs are found by numbering the values of one side within the groups.
    _, number = np.unique(np.stack([group, x]), axis=1, return_inverse=True)
    out["both_ties"] = total((_tied(y, number.reshape(-1))[1] - 1) / 2)
    return out


def group_correlations(scores: DataFrame, by: list[str]) -> DataFrame:
    """The columns ``by``, ``n``, all three coefficients and their p-values: one row per group with a usable pair.

    For many groups, such as raters or documents per metric: one shuffle by the group, and small groups are summed up
    together, an Arrow table at a time. A group of more than ``GROUP_ROWS`` pairs goes through the rank tables of
    ``correlations`` instead, so none has to fit a task. ``scores`` is read for the sizes of the groups first;
    write it beforehand if it is costly to compute.
    """
    pairs = finite_pairs(scores.withColumn("__group", F.struct(*by)), metric="__group")
    large = materialize(pairs.groupBy("metric").count().where(F.col("count") > GROUP_ROWS).select("metric"), "large-groups")
    schema = ", ".join(f"{name} double" for name in (*STATS, *SUMS, "discordant"))
    some = not large.isEmpty()
    small = pairs.join(large, "metric", "left_anti") if some else pairs
    found = _coefficients(per_group(small, ["metric"], _group_sums, schema))
    if some:
        pairs = pairs.join(large, "metric", "left_semi")
        found = found.unionByName(_coefficients(_sums(pairs.select("metric", F.col("x").alias("score"), F.col("y").alias("human")))))
    return found.select("metric.*", *RESULT_COLUMNS[1:])
