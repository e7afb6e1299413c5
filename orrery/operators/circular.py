"""Orders of nodes on a circle, the crossings of the chords between them, and orders that have fewer.

A chord spans an interval of places; two chords cross if their intervals overlap and neither
holds the other.  Overlaps follow from three counts: starts inside an interval by running
counts, less the intervals nested in it (inversions), less those that end where it ends.

Two steps improve an order.  Neighbours swap where that gains; of swaps whose nodes are linked
only the locally best are made, so gains add up exactly.  Sifting takes one node past all others:
what it gains at each depends on that node's chords alone, and running sums give its best place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.crossings import inversions
from orrery.operators.ranks import scanned
from orrery.operators.trees import rooted_forest, spanning_forest, undirected
from orrery.session import checkpoint, remove_path, scratch_path, write_table

#: The radius of a circle is RADIUS plus RADIUS_STEP times the root of its nodes.
RADIUS, RADIUS_STEP = 40.0, 28.0


def chords(order: DataFrame, edges: DataFrame) -> DataFrame:
    """``(src, dst, a, b)`` with the places of both ends of every distinct link of ``edges(src, dst)`` between nodes of ``order(node, pos)``."""
    first, second = order.toDF("src", "a"), order.toDF("dst", "b")
    return undirected(edges).join(first, "src").join(second, "dst").select("src", "dst", "a", "b")


def crossing_count(order: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (links, crossings): chords, and pairs of them without a common end whose ends alternate.

    ``order(node, pos)`` has places from 0 without gaps.
    """
    spans = checkpoint(chords(order, edges).select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")))
    starts = spans.groupBy(F.col("lo").alias("pos")).agg(F.count("*").alias("n"))
    run = scanned(order.select("pos").join(starts, "pos", "left").na.fill(0, ["n"]), [F.col("pos")], sums={"upto": F.col("n")}).select("pos", "upto")
    below, above = run.select(F.col("pos").alias("lo"), F.col("upto").alias("x")), run.select((F.col("pos") + 1).alias("hi"), F.col("upto").alias("y"))
    total = lambda rows, value, name: rows.agg(F.coalesce(F.sum(value), F.lit(0)).alias(name))
    inside = total(spans.join(below, "lo").join(above, "hi"), F.col("y") - F.col("x"), "inside")
    nested = total(inversions(spans.select(F.lit(0).alias("key"), F.col("lo").alias("p"), F.col("hi").alias("q"))), F.col("n"), "nested")
    met = total(spans.groupBy("hi").agg(F.count("*").alias("n")), F.expr("n * (n - 1) DIV 2"), "met")
    one = spans.agg(F.count("*").alias("links")).join(inside, F.lit(True)).join(nested, F.lit(True)).join(met, F.lit(True))
    return one.select("links", (F.col("inside") - F.col("nested") - F.col("met")).alias("crossings"))


def chord_crossings(order: DataFrame, edges: DataFrame) -> int:
    return crossing_count(order, edges).first()["crossings"]


def visit_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, pos)``: each tree of a spanning forest in preorder, trees by root, then nodes without links by id."""
    tree = rooted_forest(spanning_forest(edges))
    known = nodes.select("node").distinct()
    seen = known.join(tree.select("node", "pre"), "node", "left")
    return scanned(seen, [F.asc_nulls_last("pre"), F.col("node")], number="pos").select("node", "pos")


def _ends(order: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, pos, other, at)``: every chord from both of its ends."""
    both = chords(order, edges)
    return both.select(F.col("src").alias("node"), F.col("a").alias("pos"), F.col("dst").alias("other"), F.col("b").alias("at")).unionByName(
        both.select(F.col("dst").alias("node"), F.col("b").alias("pos"), F.col("src").alias("other"), F.col("a").alias("at"))
    )


def _paired(ends: DataFrame, n: int, odd: int, column: str, name: str) -> DataFrame:
    """``ends`` with the number of the pair that holds a place; the last of an odd number of places is in none."""
    turned = F.pmod(F.col(column) - odd, F.lit(n))
    return ends.withColumns({name: F.when(turned < n - n % 2, F.expr(f"pmod({column} - {odd}, {n}) DIV 2")), f"{name}_right": turned % 2})


def swap_gains(order: DataFrame, edges: DataFrame, n: int, odd: int) -> DataFrame:
    """``(pair, gain)`` of the neighbours at places ``2 * pair + odd`` and the next, around the circle: crossings less once they swap."""
    ends = _paired(_ends(order, edges), n, odd, "pos", "pair").where("pair IS NOT NULL")
    # How far round an end lies from the left node; the two themselves are 0 and 1.
    around = ends.withColumn("far", F.pmod(F.col("at") - F.col("pair") * 2 - odd, F.lit(n))).where("far > 1")
    places = around.groupBy("pair", "far").agg(F.sum(1 - F.col("pair_right")).alias("l"), F.sum("pair_right").alias("r"))
    run = scanned(places, [F.col("pair"), F.col("far")], sums={"ls": F.col("l")})
    whole = run.groupBy("pair").agg(F.min(F.col("ls") - F.col("l")).alias("base"), F.sum("l").alias("all"))
    # Now a right end crosses the left ends nearer than it, after the swap those that are farther.
    nearer = F.col("ls") - F.col("l") - F.col("base")
    return run.join(whole, "pair").groupBy("pair").agg(F.sum(F.col("r") * (2 * nearer + F.col("l") - F.col("all"))).alias("gain"))


def by_swaps(order: DataFrame, edges: DataFrame, n: int, odd: int) -> DataFrame:
    """``order`` after swaps of such neighbours that gain; of linked pairs, those that no better one is linked to."""
    better = checkpoint(swap_gains(order, edges, n, odd).where("gain > 0"))
    touching = _paired(_paired(_ends(order, edges), n, odd, "pos", "pair"), n, odd, "at", "next").where("pair <> next")
    rank = lambda pair: better.select(F.col("pair").alias(pair), F.struct("gain", "pair").alias(f"{pair}_rank"))
    beaten = touching.join(rank("pair"), "pair").join(rank("next"), "next").where("next_rank > pair_rank").select("pair").distinct()
    taken = better.join(beaten, "pair", "left_anti").select("pair", F.lit(True).alias("swap"))
    moved = _paired(order, n, odd, "pos", "pair").join(taken, "pair", "left")
    to = F.when(F.col("swap"), F.pmod(F.col("pos") + 1 - 2 * F.col("pair_right"), F.lit(n))).otherwise(F.col("pos"))
    return moved.select("node", to.cast("long").alias("pos"))


def sift_gains(order: DataFrame, edges: DataFrame, n: int, batch: list[int]) -> DataFrame:
    """``(mover, node, far, gain)``: crossings less if ``mover`` leaves its place and stands right behind ``node``, ``far`` places on.

    Every node of ``batch`` (a bounded list) is tried against all others, the rest standing still.
    """
    ends = checkpoint(_ends(order, edges))
    chosen = F.explode(F.array(*[F.lit(b).cast("long") for b in batch]))
    theirs = ends.where(F.col("node").isin(batch)).select(F.col("node").alias("mover"), F.col("at").alias("pos"), F.lit(1).alias("own"))
    every = order.withColumn("mover", chosen).join(theirs, ["mover", "pos"], "left").na.fill(0, ["own"])
    run = scanned(every, [F.col("mover"), F.col("pos")], sums={"c": F.col("own")})
    base = run.groupBy("mover").agg(F.min(F.col("c") - F.col("own")).alias("base"), F.sum("own").alias("degree"), F.max(F.when(F.col("mover") == F.col("node"), F.col("pos"))).alias("home"))
    known = checkpoint(run.join(F.broadcast(base), "mover").select("mover", "node", "pos", "own", (F.col("c") - F.col("base")).alias("c"), "degree", "home"))
    # A chord of a passed node is crossed by the mover's chords to the places between its ends, before; afterwards by the others.
    other = known.select("mover", F.col("node").alias("other"), F.col("own").alias("own_o"), F.col("c").alias("c_o"))
    met = ends.where("other <> node").withColumn("mover", chosen).where("node <> mover AND other <> mover")
    met = met.join(known.drop("pos"), ["mover", "node"]).join(other, ["mover", "other"])
    near = F.col("c_o") - F.col("own_o") - F.col("c") + F.when(F.col("at") > F.col("pos"), 0).otherwise(F.col("degree"))
    each = met.groupBy("mover", "node").agg(F.sum(2 * near - (F.col("degree") - F.col("own") - F.col("own_o"))).alias("g"))
    passed = known.where("node <> mover").join(each, ["mover", "node"], "left").na.fill(0, ["g"]).withColumn("far", F.pmod(F.col("pos") - F.col("home"), F.lit(n)))
    total = scanned(passed, [F.col("mover"), F.col("far")], sums={"gain": F.col("g")})
    start = total.groupBy("mover").agg(F.min_by(F.col("gain") - F.col("g"), "far").alias("start"))
    return total.join(F.broadcast(start), "mover").select("mover", "node", "far", (F.col("gain") - F.col("start")).alias("gain"))


def by_sifting(order: DataFrame, edges: DataFrame, n: int, batch: list[int]) -> DataFrame:
    """``order`` after the move of the batch that gains most (ties: smallest node, nearest place), if one gains."""
    best = sift_gains(order, edges, n, batch).where("gain > 0").orderBy(F.desc("gain"), "mover", "far").select("mover", "node").first()
    if best is None:
        return order
    behind = order.where(F.col("node") == best["node"]).select((F.col("pos") + 0.5).alias("to"))
    moved = order.join(F.broadcast(behind), F.lit(True)).withColumn("to", F.when(F.col("node") == best["mover"], F.col("to")).otherwise(F.col("pos").cast("double")))
    return scanned(moved.select("node", "to"), [F.col("to")], number="at").select("node", F.col("at").alias("pos"))


def reduce_chord_crossings(order: DataFrame, edges: DataFrame, rounds: int = 8, sifts: int = 8, batch: int = 16) -> tuple[DataFrame, list[int]]:
    """A better circle for ``order(node, pos)``, and the crossings before and after each step taken.

    At most ``rounds`` rounds of swaps, then up to ``sifts`` moves; each tries the next ``batch`` nodes by hash,
    and a whole turn without a gain ends them.  Crossings only fall.  Nodes are BIGINT.
    """
    spark, folder = order.sparkSession, scratch_path(order.sparkSession, "circle")
    edges = write_table(undirected(edges), f"{folder}/edges")
    best = write_table(scanned(order.select("node", "pos"), [F.col("pos"), F.col("node")], number="at").select("node", F.col("at").alias("pos")), f"{folder}/start")
    n, seen = best.count(), [chord_crossings(best, edges)]
    if n < 4:
        rounds = sifts = 0

    def take(tried: DataFrame, name: str) -> bool:
        nonlocal best
        tried = write_table(tried, f"{folder}/{name}")
        now = chord_crossings(tried, edges)
        if now < seen[-1]:
            best = tried
            seen.append(now)
            return True
        return False

    for k in range(rounds):
        gained = [seen[-1] > 0 and take(by_swaps(best, edges, n, odd), f"swap-{k}-{odd}") for odd in (0, 1)]
        if not any(gained):
            break
    parts, idle = max(1, -(-n // batch)), 0
    hashed = F.pmod(F.xxhash64("node"), F.lit(parts))
    for k in range(sifts):
        if not seen[-1] or idle == parts:
            break
        chosen = [r["node"] for r in best.where(hashed == k % parts).orderBy("node").limit(4 * batch).collect()]
        idle = 0 if chosen and take(by_sifting(best, edges, n, chosen), f"sift-{k}") else idle + 1
    best = checkpoint(best)
    remove_path(spark, folder)
    return best, seen


def circular_layout(nodes: DataFrame, edges: DataFrame, rounds: int = 8, sifts: int = 8) -> DataFrame:
    """``(node, x, y)`` on one circle from the top on, in an order of few crossings.

    ``nodes(node)`` and ``edges(src, dst)`` are BIGINT; edges to other nodes, loops and repeated edges do not count.
    """
    known = nodes.select("node").where("node IS NOT NULL").distinct()
    inner = undirected(edges).join(known.toDF("src"), "src", "left_semi").join(known.toDF("dst"), "dst", "left_semi").select("src", "dst")
    order, _ = reduce_chord_crossings(visit_order(known, inner), inner, rounds, sifts)
    sized = order.join(F.broadcast(order.agg(F.count("*").alias("n"))), F.lit(True))
    angle = F.col("pos") * F.lit(2.0) * F.pi() / F.col("n") - F.pi() / 2
    radius = RADIUS + F.sqrt(F.col("n")) * RADIUS_STEP
    return sized.select("node", (radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y"))
