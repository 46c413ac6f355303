"""Resharding by minimum-cost flow.

Documents lie in old shards of any sizes. A flow from old shard sizes to the new
shards' capacities says how many bytes go where, so that as few bytes as possible
leave their shard; shard ``i`` stays where it is if there is a new shard ``i``. The
flow is carried out in blocks: fixed sets of documents of one old shard. Where the
flow would cut a block, the block goes to the shard with the most room left.

Copies of one row would all meet in one block. Copies that outweigh a block get a salt,
drawn once and written with them, and are dealt by it as well.

What reaches the driver is one row per block, ``BLOCKS`` in expectation for any
size of the data; documents meet the finished plan in one join, and the shards that
gain or lose rows are written with their texts.

Edge cases: a null text has no bytes; each row counts 16 bytes besides. Repeated
rows are placed each. A null ``doc_id`` is a value like any other. An empty table
gives an empty result.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from segeval.llm.flow import min_cost_transfers
from segeval.scratch import materialize

SHARDS = 40
OLD_SHARDS = 32

#: Blocks in all, about; each old shard has a number of them in proportion to its bytes.
BLOCKS = 32_768

#: Bytes that a row takes besides its text.
ROW_BYTES = 16

#: Rows of one file of a shard, about, and bytes of its texts.
FILE_ROWS = 100_000
FILE_BYTES = 1 << 27


def row_size() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES


def text_crc32() -> Column:
    return F.crc32(F.coalesce("text", F.lit("")).cast("binary"))


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def plan_blocks(blocks: list[tuple[int, int, int]], capacities: list[int]) -> dict[tuple[int, int], int]:
    """New shard of each block ``(old shard, block, bytes)``.

    Each transfer of the flow takes the largest blocks that fit it. A block that fits none goes where most room is left.
    """
    by_old: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for old, block, size in blocks:
        by_old[old].append((size, block))
    names = sorted(by_old)
    sizes = [sum(s for s, _ in by_old[o]) for o in names]
    cost = [[int(o != j) for j in range(len(capacities))] for o in names]
    flow: dict[int, dict[int, int]] = defaultdict(dict)
    for (i, j), amount in min_cost_transfers(sizes, capacities, cost).items():
        flow[names[i]][j] = amount
    placed: dict[tuple[int, int], int] = {}
    room = list(capacities)
    rest: list[tuple[int, int, int]] = []
    for old in names:
        # What stays first, then the other shards by number.
        goals = [[amount, j] for j, amount in sorted(flow[old].items(), key=lambda x: (x[0] != old, x[0]))]
        for size, block in sorted(by_old[old], key=lambda b: (-b[0], b[1])):
            for goal in goals:
                if size <= goal[0]:
                    goal[0] -= size
                    room[goal[1]] -= size
                    placed[old, block] = goal[1]
                    break
            else:
                rest.append((size, old, block))
    most = [(-r, j) for j, r in enumerate(room)]
    heapq.heapify(most)
    for size, old, block in sorted(rest, key=lambda x: (-x[0], x[1], x[2])):
        r, j = heapq.heappop(most)
        placed[old, block] = j
        heapq.heappush(most, (r + size, j))
    return placed


@dataclass(frozen=True)
class Moves:
    """A finished plan: ``blocks``, the number of blocks by old shard, ``table``, one row per block, the shards that gain or lose rows, and copies with a salt."""

    keys: list[str]
    old_shard: Column
    blocks: DataFrame
    table: DataFrame
    affected: list[int]
    split: tuple[DataFrame, DataFrame] | None


def _dealt(rows: DataFrame, keys: list[str], blocks: DataFrame) -> DataFrame:
    """``rows`` with ``__block``, the row's block in its old shard."""
    salt = ["__salt"] if "__salt" in rows.columns else []
    lot = F.xxhash64(F.lit("lot"), *keys, "__crc", *salt)
    dealt = rows.join(F.broadcast(blocks), F.col("__old").eqNullSafe(F.col("__of")))
    return dealt.withColumn("__block", F.pmod(lot, "__blocks").cast("int")).drop("__of", "__blocks")


def _alike(keys: list[str], heavy: DataFrame) -> Column:
    return reduce(and_, [F.col(c).eqNullSafe(F.col(h)) for c, h in zip([*keys, "__crc", "__size", "__old"], heavy.columns)])


def _heavy_copies(rows: DataFrame, keys: list[str], counts: DataFrame, found: list, total: int) -> DataFrame | None:
    """What copies of a row have in common, for those that outweigh a block; None if there are none. They are fewer than the blocks."""
    large = [(o, b) for o, b, size, n in found if n > 1 and size * BLOCKS > 2 * total]
    if not large:
        return None
    spark = rows.sparkSession
    # Heavy copies make a heavy block: only rows of such blocks are compared.
    large = spark.createDataFrame(large, "__in int, __number int")
    same = F.col("__old").eqNullSafe(F.col("__in")) & (F.col("__block") == F.col("__number"))
    alike = [*keys, "__crc", "__size", "__old"]
    met = _dealt(rows, keys, counts).join(F.broadcast(large), same, "left_semi").groupBy(*alike).agg(F.sum("__size").alias("__weight"), F.count("*").alias("__n"))
    met = met.where((F.col("__n") > 1) & (F.col("__weight") * BLOCKS > total)).select(*[F.col(c).alias(f"__heavy_{i}") for i, c in enumerate(alike)])
    met = materialize(met, "heavy")
    return None if met.isEmpty() else met


def _rows(docs: DataFrame, keys: list[str], old_shard: Column, split: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    """Measured rows of ``docs``. With ``split`` they have ``__salt``, a number for heavy copies and 0 for all others."""
    rows = _measured(docs, keys, old_shard)
    if split is None:
        return rows
    heavy, copies = split
    others = rows.join(F.broadcast(heavy), _alike(keys, heavy), "left_anti")
    return others.withColumn("__salt", F.lit(0).cast("long")).unionByName(copies)


def _salted(docs: DataFrame, keys: list[str], old_shard: Column, heavy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``heavy`` and its copies, written with their salts: every reader finds the same ones, also after the loss of an executor."""
    copies = _measured(docs, keys, old_shard).join(F.broadcast(heavy), _alike(keys, heavy), "left_semi")
    return heavy, materialize(copies.withColumn("__salt", F.monotonically_increasing_id()), "salted")


def plan_moves(docs: DataFrame, keys: list[str], old_shard: Column, shards: int = SHARDS, capacities: list[int] | None = None) -> Moves:
    """The new shard of each block of rows and the places its rows take there."""
    spark = docs.sparkSession
    columns = [*keys, "__size", "__crc", "__old"]
    rows = materialize(_measured(docs, keys, old_shard).select(*columns), "rows")
    old = {r[0]: r[1] for r in rows.groupBy("__old").agg(F.sum("__size")).collect()}
    total = sum(old.values())
    # Numbers of blocks by old shard are a small table of their own.
    counts = spark.createDataFrame([(o, max(1, round(BLOCKS * s / total))) for o, s in old.items()], "__of int, __blocks int")
    found = _block_sizes(rows, keys, counts)
    split = None
    heavy = _heavy_copies(rows, keys, counts, found, total)
    if heavy is not None:
        split = _salted(docs, keys, old_shard, heavy)
        rows = rows.join(F.broadcast(heavy), _alike(keys, heavy), "left_anti").withColumn("__salt", F.lit(0).cast("long"))
        found = _block_sizes(rows.unionByName(split[1].select(*columns, "__salt")), keys, counts)
    # A row without an old shard has no place to stay in.
    blocks = [(-1 if o is None else o, b, s) for o, b, s, _ in found]
    placed = plan_blocks(blocks, capacities or even_capacities(total, shards))
    # Rows ahead by shard, and the number, rows and bytes of its last file.
    before: dict[int, int] = defaultdict(int)
    files: dict[int, tuple[int, int, int]] = defaultdict(lambda: (0, 0, 0))
    plan, affected = [], set()
    for (o, b, size, n), (name, _, _) in sorted(zip(found, blocks), key=lambda x: x[1]):
        shard = placed[name, b]
        file, held, weight = files[shard]
        if held and (held + n > FILE_ROWS or weight + size > FILE_BYTES):
            file, held, weight = file + 1, 0, 0
        files[shard] = file, held + n, weight + size
        plan.append((o, b, shard, before[shard], file))
        before[shard] += n
        affected |= {name, shard} if name != shard else set()
    table = spark.createDataFrame(plan, "__of int, __number int, __shard int, __ahead long, __range int")
    return Moves(keys, old_shard, counts, table, sorted(affected - {-1}), split)


def _block_sizes(rows: DataFrame, keys: list[str], counts: DataFrame) -> list:
    """Old shard, block, bytes and rows of every block."""
    return _dealt(rows, keys, counts).groupBy("__old", "__block").agg(F.sum("__size"), F.count("*")).collect()


def _measured(docs: DataFrame, keys: list[str], old_shard: Column) -> DataFrame:
    return docs.withColumns({"__size": row_size(), "__crc": text_crc32(), "__old": old_shard.cast("int")})


def _placed(docs: DataFrame, moves: Moves, *only: Column) -> DataFrame:
    """Rows of ``docs`` with ``__size``, ``__crc``, ``__old``, ``__shard`` and ``__slot``, those of shards that ``only`` lets pass.

    Rows are dealt once, to ranges of a shard's places that hold whole blocks.
    """
    # One row per block: bounded as the number of blocks is.
    same = F.col("__old").eqNullSafe(F.col("__of")) & (F.col("__block") == F.col("__number"))
    rows = _dealt(_rows(docs, moves.keys, moves.old_shard, moves.split), moves.keys, moves.blocks)
    rows = rows.join(F.broadcast(moves.table), same).drop("__of", "__number", "__block")
    for passes in only:
        rows = rows.where(passes)
    rows = rows.repartition("__shard", "__range")
    # The places ahead of a block name it within its shard.
    block = Window.partitionBy("__shard", "__range", "__ahead").orderBy(*moves.keys, "__crc", "__size")
    slot = F.col("__ahead") + F.row_number().over(block) - 1
    return rows.withColumn("__slot", slot.cast("long")).drop("__range", "__ahead")


def reshard(docs: DataFrame, keys: list[str], old_shard: Column, shards: int = SHARDS, capacities: list[int] | None = None) -> DataFrame:
    """``keys`` with ``size``, ``text_crc32``, ``old_shard``, ``shard`` and ``slot``, the row's place in its shard.

    ``old_shard`` numbers the shards that the rows lie in. ``capacities`` are bytes
    per new shard, equal ones if not given.
    """
    return _assigned(_placed(docs, plan_moves(docs, keys, old_shard, shards, capacities)), keys)


def _assigned(placed: DataFrame, keys: list[str]) -> DataFrame:
    names = {"__size": "size", "__crc": "text_crc32", "__old": "old_shard", "__shard": "shard", "__slot": "slot"}
    return placed.select(*keys, *[F.col(c).alias(name) for c, name in names.items()])


def carry_out(docs: DataFrame, moves: Moves, path: str) -> DataFrame:
    """Write the affected shards of ``docs`` as ``path/shard=<n>`` (``new_shard`` beside a column ``shard``) and give what ``reshard`` gives, as read from there.

    Rows of other shards stay where they are and are read there. Texts are dealt once.
    """
    touched = F.col("__shard").isin(moves.affected)
    stayed = _assigned(_placed(docs, moves, ~touched), moves.keys)
    if not moves.affected:
        return stayed
    shard, slot = (_free_name(name, docs) for name in ("shard", "slot"))
    rows = _placed(docs, moves, touched).select(*docs.columns, F.col("__shard").alias(shard), F.col("__slot").alias(slot))
    rows.sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
    kinds = StructType([*docs.schema.fields, StructField(slot, LongType()), StructField(shard, IntegerType())])
    written = _measured(docs.sparkSession.read.schema(kinds).parquet(path), moves.keys, moves.old_shard)
    return _assigned(written.withColumnsRenamed({shard: "__shard", slot: "__slot"}), moves.keys).union(stayed)


def _free_name(name: str, docs: DataFrame) -> str:
    """``name``, or a longer one if the table has a column of that name; Spark does not tell cases apart."""
    while name.lower() in (c.lower() for c in docs.columns):
        name = f"new_{name}"
    return name


def _write(rows: DataFrame, path: str) -> None:
    """Write rows with ``shard`` and ``slot`` as ``path/shard=<n>``. A lost executor's tasks run again; the write is committed as a whole."""
    dealt = rows.repartition("shard", F.floor(F.col("slot") / FILE_ROWS))
    dealt.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def rewrite_shards(docs: DataFrame, assigned: DataFrame, keys: list[str], path: str) -> None:
    """Write the new content of every shard that gains or loses rows, as ``path/shard=<n>``; others stay as they are.

    ``assigned`` is what ``reshard`` gave for ``docs``. Null keys match each other, and
    rows of equal keys, size and checksum take their places in turn, one each.
    """
    moved = assigned.where(~F.col("old_shard").eqNullSafe(F.col("shard")))
    affected = moved.select("shard").union(moved.select("old_shard")).distinct()
    alike = [*keys, "__size", "__crc"]
    places = assigned.withColumnsRenamed({"size": "__size", "text_crc32": "__crc"})
    places = places.withColumn("__turn", F.row_number().over(Window.partitionBy(*alike).orderBy("shard", "slot")))
    places = places.join(affected, "shard", "left_semi").select(*[F.col(c).alias(f"__of_{i}") for i, c in enumerate([*alike, "__turn"])], "shard", "slot")
    rows = docs.withColumn("__size", row_size()).withColumn("__crc", text_crc32())
    # Copies may differ in what is no key; any of them may come first.
    rows = rows.withColumn("__turn", F.row_number().over(Window.partitionBy(*alike).orderBy(F.lit(0))))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__of_{i}")) for i, c in enumerate([*alike, "__turn"])])
    _write(rows.join(places, same).select(*docs.columns, "shard", "slot"), path)
