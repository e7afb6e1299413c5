"""Sparse stress layout: distances to a few pivots and along edges pull nodes into place.

Stress is the weighted square error of drawn distances.  All pairs would be a table of n squared
rows; here a pair counts if it is an edge or if one of the two is a pivot, so there are at most
``m + n * pivots`` terms.  Pivot distances come from one breadth-first search with all pivots as
sources at once.

A step is one join and one aggregation: each node goes half-way to the weighted mean of the
places where its terms want it.  Half-way, since twice the diagonal of the weights' Laplacian is
never below the Laplacian itself; so a step is that of a majorant, and stress never rises.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.components import connected_components
from orrery.operators.graph import grown
from orrery.operators.ranks import top_k
from orrery.operators.trees import undirected
from orrery.session import checkpoint, movable, remove_path, scratch_path, write_table

PIVOTS, STEPS = 8, 30
#: Distance of two linked nodes in the drawing.
UNIT = 60.0


def pivot_distances(edges: DataFrame, pivots: DataFrame) -> DataFrame:
    """``(pivot, node, hops)`` of all nodes that ``pivots(pivot)`` reach over ``edges(src, dst)`` in either direction."""
    both = checkpoint(edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("next"))))
    start = pivots.select("pivot", F.col("pivot").alias("node"), F.lit(0).alias("hops"))
    step = lambda fresh: fresh.join(both, "node").select("pivot", F.col("next").alias("node"), (F.col("hops") + 1).alias("hops"))
    return grown(start, step, ["pivot", "node"], "pivots")


def stress_terms(edges: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """``(a, b, d, w)`` in both directions: edges with distance 1 and pivot pairs with their hops, weighted by the inverse square.

    Every component has pivots of its own, those of the lowest hashes.
    """
    links = checkpoint(undirected(edges))
    labels = connected_components(links)
    chosen = top_k(labels.withColumn("h", F.xxhash64("node")), ["component"], [F.col("h"), F.col("node")], pivots).select(F.col("node").alias("pivot"))
    far = pivot_distances(links, chosen).where("hops > 1").select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b"), F.col("hops").cast("double").alias("d")).distinct()
    one = links.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1.0).alias("d")).unionByName(far).withColumn("w", 1 / (F.col("d") * F.col("d")))
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "d", "w"))


def placed_terms(terms: DataFrame, places: DataFrame) -> DataFrame:
    """``terms`` with the places of both ends and their distance ``r``."""
    met = terms
    for end in "ab":
        met = met.join(places.select(F.col("node").alias(end), F.col("x").alias(f"x{end}"), F.col("y").alias(f"y{end}")).select(movable(end), f"x{end}", f"y{end}"), end)
    return met.withColumn("r", F.hypot(F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb")))


def stress_of(terms: DataFrame, places: DataFrame, unit: float = UNIT) -> float:
    error = F.col("r") - F.col("d") * unit
    return placed_terms(terms, places).agg(F.coalesce(F.sum(F.col("w") * error * error) / 2, F.lit(0.0))).first()[0]


def stress_step(terms: DataFrame, places: DataFrame, unit: float = UNIT) -> DataFrame:
    """``places(node, x, y)`` after one step; nodes on the same spot are pushed along the x axis, by order of id."""
    near = F.col("r") < 1e-9
    side = F.when(F.col("a") < F.col("b"), -1.0).otherwise(1.0)
    met = placed_terms(terms, places).withColumns(
        {
            "wx": F.col("xb") + F.col("d") * unit * F.when(near, side).otherwise((F.col("xa") - F.col("xb")) / F.col("r")),
            "wy": F.col("yb") + F.col("d") * unit * F.when(near, 0.0).otherwise((F.col("ya") - F.col("yb")) / F.col("r")),
        }
    )
    want = met.groupBy(F.col("a").alias("node")).agg(*[(F.sum(F.col("w") * F.col(f"w{c}")) / F.sum("w")).alias(f"t{c}") for c in "xy"])
    moved = places.join(want.select(movable("node"), "tx", "ty"), "node", "left")
    return moved.select("node", *[F.coalesce((F.col(c) + F.col(f"t{c}")) / 2, F.col(c)).alias(c) for c in "xy"])


def stress_layout(nodes: DataFrame, edges: DataFrame, pivots: int = PIVOTS, steps: int = STEPS, unit: float = UNIT) -> tuple[DataFrame, list[float]]:
    """``(node, x, y)`` of ``nodes(node)`` and ``edges(src, dst)`` (BIGINT), and the stress before and after every step.

    The start is a disc by the hash of the ids, so a layout is the same for every run.  Nodes
    without edges stay where they start; loops and parallel edges pull like none and one.
    """
    folder = scratch_path(edges.sparkSession, "stress")
    all_nodes = nodes.select("node").unionByName(edges.select(F.explode(F.array("src", "dst")).alias("node"))).distinct()
    terms = write_table(stress_terms(edges, pivots), f"{folder}/terms")
    share = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(1 << 20)) / float(1 << 20)
    radius = unit * F.sqrt(share(1)) * max(1.0, all_nodes.count() ** 0.5)
    places = write_table(all_nodes.select("node", (radius * F.cos(share(2) * 6.283185307179586)).alias("x"), (radius * F.sin(share(2) * 6.283185307179586)).alias("y")), f"{folder}/0")
    seen = [stress_of(terms, places, unit)]
    for k in range(1, steps + 1):
        places = write_table(stress_step(terms, places, unit), f"{folder}/{k}")
        seen.append(stress_of(terms, places, unit))
    out = checkpoint(places)
    remove_path(edges.sparkSession, folder)
    return out, seen
