"""Crossings between the layers of a drawing, and orders that have fewer.

Crossings of two layers are inversions: pairs of edges whose ends stand in opposite orders.  Rows
are cut into blocks of one end's order, then of the other's.  Pairs within a block of either kind
are counted there; the others are pairs of blocks, few rows with weights, counted the same way.
Every row is dealt twice, and no pairs are formed.

Orders improve in rounds that move every other layer while its neighbours stand still: by the
mean position of the nodes next to them, then by swaps of neighbours that do not share a
node.  A round that does not lower the number of crossings is not taken, so it only falls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from orrery.operators.ranks import scanned
from orrery.session import checkpoint, map_arrow, remove_path, scratch_path, write_table

#: Rows that are counted in one task.
BLOCK_ROWS = 1 << 18


def inverted(q: np.ndarray, w: np.ndarray) -> int:
    """The sum of ``w * w'`` over the pairs of a sequence whose earlier ``q`` is greater, bit by bit of its ranks."""
    rank, total = np.unique(q, return_inverse=True)[1], 0
    for bit in range(int(rank.max(initial=0)).bit_length() - 1, -1, -1):
        # Here the rows stand by their higher bits, otherwise in the order of the sequence.
        one = w * ((rank >> bit) & 1)
        ones, starts = np.cumsum(one), np.diff(rank >> (bit + 1), prepend=-1) > 0
        before = (ones - one)[starts][np.cumsum(starts) - 1]
        total += int(np.sum(np.where((rank >> bit) & 1, 0, w * (ones - before))))
        order = np.argsort(rank >> bit, kind="stable")
        rank, w = rank[order], w[order]
    return total


def _counted(rows: DataFrame, merged: bool) -> DataFrame:
    """``rows(key, p, q, w, at)`` of one block a task, sorted by the order of pairs then ``q``, and rows ``(key, n)`` with the pairs inside.

    If ``merged``, only the sums of ``w`` by ``(key, p, at)`` are kept of the rows, ``at`` as their ``q``.
    """
    fields = to_arrow_schema(rows.schema)
    made = [T.StructField(f.name, f.dataType) for f in rows.schema.fields]
    schema = T.StructType([*made, T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), fields)
        if not table.num_rows:
            return
        key, p, q, w, at = (table.column(c).combine_chunks() for c in ("key", "p", "q", "w", "at"))
        places, ps, qs, ws = key.to_numpy(zero_copy_only=False), p.to_numpy(), q.to_numpy(), w.to_numpy()
        starts = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
        ends = np.r_[starts[1:], len(places)]
        pairs = pa.array([inverted(qs[s:e], ws[s:e]) for s, e in zip(starts, ends)], pa.int64())
        if merged:
            first = np.flatnonzero(np.r_[True, (places[1:] != places[:-1]) | (ps[1:] != ps[:-1])])
            key, p, q, at, w = key.take(pa.array(first)), p.take(pa.array(first)), at.take(pa.array(first)), at.take(pa.array(first)), pa.array(np.add.reduceat(ws, first))
        none = lambda a: pa.nulls(len(starts), a.type)
        yield from pa.Table.from_arrays([key, p, q, w, at, pa.nulls(len(key), pa.int64())], names=schema.names).to_batches()
        yield from pa.Table.from_arrays([table.column("key").combine_chunks().take(pa.array(starts)), none(p), none(q), none(w), none(at), pairs], names=schema.names).to_batches()

    return map_arrow(rows, run, schema)


def inversions(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(key, n)``: pairs of ``rows(key, p, q)`` of one key with ``p < p'`` and ``q > q'``.

    ``block_rows`` decides how many rows a task holds at once, not the result.
    """
    folder = scratch_path(rows.sparkSession, "inversions")
    cells = rows.select("key", F.col("p").cast("long").alias("p"), F.col("q").cast("long").alias("q")).groupBy("key", "p", "q").agg(F.count("*").alias("w"))
    found, k = rows.select("key", F.lit(0).cast("long").alias("n")).limit(0), 0
    while True:
        cells = write_table(cells, f"{folder}/cells-{k}")
        blocks = max(1, -(-cells.count() // block_rows))
        block = F.spark_partition_id().cast("long").alias("at")
        # Equal rows are in one block, so those of different blocks are in order by them.
        ahead = cells.repartitionByRange(blocks, "key", "p", "q").sortWithinPartitions("key", "p", "q").select("key", "p", "q", "w", block)
        ahead = write_table(_counted(ahead, False), f"{folder}/ahead-{k}")
        found = found.unionByName(ahead.where("n IS NOT NULL").select("key", "n"))
        if blocks == 1:
            break
        # Pairs of different blocks of ``p``: those of one block of ``q`` here, the others as pairs of blocks next.
        left = ahead.where("n IS NULL").select("key", F.col("at").alias("x"), "p", "q", "w")
        up = left.repartitionByRange(blocks, "key", "q", "p").sortWithinPartitions("key", "x", "q").select("key", F.col("x").alias("p"), "q", "w", block)
        up = write_table(_counted(up, True), f"{folder}/up-{k}")
        found = found.unionByName(up.where("n IS NOT NULL").select("key", "n"))
        cells = up.where("n IS NULL").groupBy("key", "p", "q").agg(F.sum("w").alias("w"))
        k += 1
    out = checkpoint(found.groupBy("key").agg(F.sum("n").alias("n")))
    remove_path(rows.sparkSession, folder)
    return out


def spans(order: DataFrame, edges: DataFrame) -> DataFrame:
    """``(low, high, layer, p, q)`` of the edges between neighbouring layers, the lower end first."""
    a = order.select(F.col("id").alias("source"), F.col("layer").alias("la"), F.col("pos").alias("pa"))
    b = order.select(F.col("id").alias("target"), F.col("layer").alias("lb"), F.col("pos").alias("pb"))
    met = edges.join(a, "source").join(b, "target").where("abs(la - lb) = 1")
    up = F.col("la") < F.col("lb")
    pick = lambda x, y: F.when(up, F.col(x)).otherwise(F.col(y))
    return met.select(pick("source", "target").alias("low"), pick("target", "source").alias("high"), F.least("la", "lb").alias("layer"), pick("pa", "pb").alias("p"), pick("pb", "pa").alias("q"))


def layer_crossings(order: DataFrame, edges: DataFrame) -> DataFrame:
    """``(layer, crossings)`` between each layer and the next, of ``order(id, layer, pos)`` and ``edges(source, target)``.

    Edges count in either direction and as often as they occur; those over no or several layers do not count.
    """
    return inversions(spans(order, edges).select(F.col("layer").alias("key"), "p", "q")).select(F.col("key").alias("layer"), F.col("n").alias("crossings"))


def crossings(order: DataFrame, edges: DataFrame) -> int:
    return layer_crossings(order, edges).agg(F.coalesce(F.sum("crossings"), F.lit(0))).first()[0]


def renumbered(order: DataFrame, by: str) -> DataFrame:
    """``order`` with ``pos`` from 0 in every layer, by ``by``, then the old position."""
    run = scanned(order, [F.col("layer"), F.col(by), F.col("pos")], number="__n")
    first = run.groupBy("layer").agg(F.min("__n").alias("__first"))
    return run.join(F.broadcast(first), "layer").select("id", "layer", (F.col("__n") - F.col("__first")).alias("pos"))


def by_barycentre(order: DataFrame, edges: DataFrame, parity: int) -> DataFrame:
    """``order`` with every layer of this parity sorted by the mean position of the nodes next to it; nodes without any keep theirs."""
    ends = spans(order, edges)
    near = ends.select(F.col("low").alias("id"), F.col("q").alias("at")).unionByName(ends.select(F.col("high").alias("id"), F.col("p").alias("at")))
    means = near.groupBy("id").agg(F.avg("at").alias("mean"))
    moved = order.join(means, "id", "left").withColumn("mean", F.when(F.col("layer") % 2 == parity, F.coalesce("mean", F.col("pos").cast("double"))).otherwise(F.col("pos").cast("double")))
    return renumbered(moved, "mean")


def swap_gains(order: DataFrame, edges: DataFrame, parity: int, odd: int) -> DataFrame:
    """``(layer, pair, gain)`` of neighbours at positions ``2 * pair + odd`` and the next: crossings less once they swap.

    The layers of this parity are looked at; those next to them stand still.
    """
    ends = spans(order, edges)
    sides = ends.select(F.col("layer").alias("layer"), F.col("p").alias("pos"), (F.col("layer") + 1).alias("other"), F.col("q").alias("at")).unionByName(
        ends.select((F.col("layer") + 1).alias("layer"), F.col("q").alias("pos"), F.col("layer").alias("other"), F.col("p").alias("at"))
    )
    own = sides.where((F.col("layer") % 2 == parity) & (F.col("pos") >= odd)).withColumn("pair", F.expr(f"(pos - {odd}) DIV 2"))
    right = F.expr(f"(pos - {odd}) % 2")
    places = own.groupBy("layer", "pair", "other", "at").agg(F.sum(1 - right).alias("l"), F.sum(right).alias("r"))
    w = Window.partitionBy("layer", "pair", "other")
    below = F.coalesce(F.sum("l").over(w.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A place of the right node crosses the left node's places above it now, and those below it after the swap.
    gain = F.col("r") * (F.sum("l").over(w) - F.col("l") - 2 * below)
    return places.withColumn("gain", gain).groupBy("layer", "pair").agg(F.sum("gain").alias("gain"))


def by_swaps(order: DataFrame, edges: DataFrame, parity: int, odd: int) -> DataFrame:
    """``order`` after all swaps of such neighbours that gain; they share no node, so gains add up."""
    better = swap_gains(order, edges, parity, odd).where("gain > 0").select("layer", "pair", F.lit(True).alias("swap"))
    widths = order.groupBy("layer").agg(F.max("pos").alias("last"))
    paired = order.withColumn("pair", F.when((F.col("layer") % 2 == parity) & (F.col("pos") >= odd), F.expr(f"(pos - {odd}) DIV 2")))
    met = paired.join(better, ["layer", "pair"], "left").join(F.broadcast(widths), "layer")
    left = F.expr(f"(pos - {odd}) % 2 = 0")
    moved = F.when(F.col("swap") & left, F.least(F.col("pos") + 1, F.col("last"))).when(F.col("swap"), F.col("pos") - 1).otherwise(F.col("pos"))
    return met.select("id", "layer", moved.alias("pos"))


def reduce_crossings(order: DataFrame, edges: DataFrame, rounds: int = 8) -> tuple[DataFrame, list[int]]:
    """A better order of ``order(id, layer, pos)``, and the crossings before and after each step taken.

    Stops after ``rounds`` rounds, or when one round takes no step.  Positions count from 0 in
    each layer, ties go to the older order.
    """
    folder = scratch_path(order.sparkSession, "crossings")
    edges = write_table(edges.select("source", "target"), f"{folder}/edges")
    best = write_table(renumbered(order.select("id", "layer", "pos"), "pos"), f"{folder}/start")
    seen, steps = [crossings(best, edges)], [(by_barycentre, (0,)), (by_barycentre, (1,)), *[(by_swaps, (p, o)) for p in (0, 1) for o in (0, 1)]]
    for k in range(rounds):
        before = seen[-1]
        for n, (step, how) in enumerate(steps):
            if not seen[-1]:
                break
            tried = write_table(step(best, edges, *how), f"{folder}/{k}-{n}")
            now = crossings(tried, edges)
            if now < seen[-1]:
                best = tried
                seen.append(now)
        if seen[-1] == before:
            break
    best = checkpoint(best)
    remove_path(order.sparkSession, folder)
    return best, seen
