"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

How many rows of each partition go to each shard is drawn before any row moves: a matrix whose rows sum to the
partitions' counts and whose columns sum to the shards' sizes, with the law that dealing all rows at random has.
Each partition then permutes its rows' shards by itself, rows are exchanged once, and each shard permutes what it got.

The matrix is never held as a whole. Partitions are the leaves of a binary tree; a node splits the room that its
partitions have in each shard between its two halves by a multivariate hypergeometric draw, seeded by the node. A task
goes down the tree to its own row, so all tasks agree without talking to each other, and a lost one draws the same again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strophe.llm import common

#: numpy draws from populations below this; larger ones are split first.
LARGEST_DRAW = 10**9
#: Rows of a shard that are sorted together, about; shards of more rows are dealt to more cells.
ROWS_A_CELL = 8_192
#: Bits that count rows within a partition in Spark's monotonically increasing ids.
ROW_BITS = 33


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """Good items among the first ``sample`` of a random order of good and bad ones, for populations of any size.

    The place of the middle good item of a random order is known in law: the share of bad items before it is beta
    distributed, their number binomial. It tells which side the end of the sample lies on, and halves the good items.
    """
    found = 0
    while good + bad >= LARGEST_DRAW:
        if not good or not sample:
            return found
        middle = (good + 1) // 2
        before = int(rng.binomial(bad, rng.beta(middle, good - middle + 1)))
        if middle + before <= sample:
            found, good, bad, sample = found + middle, good - middle, bad - before, sample - middle - before
        else:
            good, bad = middle - 1, before
    return found + int(rng.hypergeometric(good, bad, sample))


def split_room(rng: np.random.Generator, room: list[int], n: int) -> list[int]:
    """How much of each shard's ``room`` ``n`` rows take, out of the rows that fill all of it at random."""
    rest, out = sum(room), []
    for r in room:
        rest -= r
        out.append(hypergeometric(rng, r, rest, n))
        n -= out[-1]
    return out


def even_rooms(n: int, shards: int) -> list[int]:
    """Sizes of shards for ``n`` rows, at most one apart."""
    return [n // shards + (s < n % shards) for s in range(shards)]


def tree_sums(counts: list[int]) -> list[list[int]]:
    """Sums of 1, 2, 4, ... neighbouring partitions, up to all of them."""
    levels = [list(counts) or [0]]
    while len(levels[-1]) > 1:
        low = levels[-1] + [0] * (len(levels[-1]) % 2)
        levels[-1] = low
        levels.append([a + b for a, b in zip(low[::2], low[1::2], strict=True)])
    return levels


def matrix_row(part: int, levels: list[list[int]], room: list[int], seed: int) -> list[int]:
    """The rows of partition ``part`` that go to each shard."""
    for level in range(len(levels) - 1, 0, -1):
        node = part >> level
        rng = np.random.default_rng([seed, 0, level, node])
        left = split_room(rng, room, levels[level - 1][2 * node])
        room = [a - b for a, b in zip(room, left, strict=True)] if part >> (level - 1) & 1 else left
    return room


def _fingerprint(rows: DataFrame, row: Column) -> Column:
    """A hash of a row's number and its columns of fixed width, which are cheap to read."""
    fixed = [f.name for f in rows.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType))]
    return F.xxhash64(row, *[F.col(f"`{c}`") for c in fixed])


def dealt(rows: DataFrame, shards: int, seed: int, shard: str, key: str, row: str) -> tuple[DataFrame, int]:
    """``rows`` with their shard, a random key below 2**63 and their number, and how many they are. Only numbers go to Python."""
    numbered = rows.withColumn(row, F.monotonically_increasing_id())
    (mark,) = common.free_names(numbered, "mark")
    numbered = numbered.withColumn(mark, _fingerprint(rows, F.col(row)))
    part = F.shiftright(row, ROW_BITS).alias("part")
    # one row a partition, as the scheduler's own task list
    seen = {r.part: (r.n, r.mark) for r in numbered.groupBy(part).agg(F.count("*").alias("n"), F.bit_xor(mark).alias("mark")).collect()}
    counts = [seen.get(p, (0, 0))[0] for p in range(max(seen, default=0) + 1)]
    marks = [seen.get(p, (0, 0))[1] for p in range(len(counts))]
    levels, room = tree_sums(counts), even_rooms(sum(counts), shards)
    kind = np.min_scalar_type(shards)

    @F.pandas_udf("shard int, key long")
    def deal(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        labels, part, done, check = None, 0, 0, 0
        for ids, mark in batches:
            if labels is None and len(ids):
                part = int(ids.iloc[0]) >> ROW_BITS
                if part >= len(counts):
                    raise RuntimeError("the rows have more partitions now than when they were counted; give a table or a checkpoint")
                labels = np.repeat(np.arange(shards, dtype=kind), matrix_row(part, levels, room, seed))
                np.random.default_rng([seed, 1, part]).shuffle(labels)
                keys = np.random.PCG64([seed, 2, part])
            at = ids.to_numpy() & ((1 << ROW_BITS) - 1)
            if len(at) and at[-1] >= len(labels):
                raise RuntimeError("a partition has more rows now than when it was counted; give a table or a checkpoint")
            done, check = done + len(at), check ^ int(np.bitwise_xor.reduce(mark.to_numpy(), initial=0))
            yield pd.DataFrame({"shard": labels[at].astype(np.int32), "key": (keys.random_raw(len(at)) >> np.uint64(1)).astype(np.int64)} if len(at) else {"shard": np.array([], np.int32), "key": np.array([], np.int64)})
        if labels is not None and (done != counts[part] or check != marks[part]):
            raise RuntimeError("a partition holds other rows now than when it was counted; give a table or a checkpoint")

    (both,) = common.free_names(numbered, "both")
    out = numbered.withColumn(both, deal(row, mark)).withColumns({shard: F.col(both)["shard"], key: F.col(both)["key"]})
    return out.drop(both, mark), sum(counts)


def shuffle(rows: DataFrame, shards: int = 8, seed: int = 0) -> DataFrame:
    """``rows`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in its shard), in uniformly random order.

    Shards differ by at most one row, the first ones are the longer. Which rows a shard holds depends on ``seed`` and on where rows
    stand, not on what they hold: nulls, empty and very long texts, ties and repeated rows are rows like others, and
    equal rows spread like different ones. An empty table gives no rows; with more shards than rows some stay empty.
    All columns pass through, but callers' own ``shard`` and ``slot`` give way.

    ``rows`` are read three times (counted, counted by cells, moved), in the same partitions and order, as tables and
    checkpoints give them; a partition whose count or fixed-width columns changed meanwhile raises a RuntimeError.
    Rows move once, to cells of a shard: a cell takes a range of random keys, so that no task sees a whole shard, and a slot
    is the rank in the cell after all cells before it.
    """
    rows = rows.drop("shard", "slot")
    shard, slot, key, row, cell, start = common.free_names(rows, "shard", "slot", "key", "row", "cell", "start")
    out, n = dealt(rows, shards, seed, shard, key, row)
    cells = max(1, -(-n // (shards * ROWS_A_CELL)))
    out = out.withColumn(cell, F.shiftright(F.shiftright(key, 31) * cells, 32))
    sizes = out.groupBy(shard, cell).agg(F.count("*").alias(start))
    before = F.sum(start).over(Window.partitionBy(shard).orderBy(cell)) - F.col(start)  # one row a cell
    starts = sizes.select(shard, cell, before.alias(start))
    rank = F.row_number().over(Window.partitionBy(shard, cell).orderBy(key, row))
    placed = out.withColumn(slot, rank - 1).join(starts, [shard, cell])
    return placed.select(*[F.col(f"`{c}`") for c in rows.columns], F.col(shard), (F.col(start) + F.col(slot)).alias(slot))


def write_shards(rows: DataFrame, folder: str, shards: int = 8, seed: int = 0) -> None:
    """``shuffle`` written as Parquet below ``folder``, a folder for each shard; slots ascend within a file."""
    out = shuffle(rows, shards, seed)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
