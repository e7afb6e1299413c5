"""Orders, layers, rings, communities and coordinates of a graph.

The iterations are joins over ``(source, target)`` edges; coordinates follow from the rank
of a node within its layer, ring or community.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.components import connected_components
from orrery.operators.graph import grown, simple_edges, strong_components
from orrery.operators.ranks import scanned
from orrery.session import checkpoint, remove_path, scratch_path, write_table

#: Fixed value: rounds of label propagation.
ROUNDS = 24


def longest_path_layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, layer)``: 0 for nodes that depend on nothing, else one above the highest dependency.

    ``edges`` must have no cycle; a loop that does not end within as many rounds as there are
    nodes is an error.
    """
    folder, limit, rounds = scratch_path(nodes.sparkSession, "layers"), nodes.count() + 1, 0
    arcs = write_table(edges.select("source", "target").distinct(), f"{folder}/edges")
    layers = write_table(nodes.select("id").distinct().withColumns({"layer": F.lit(0), "rose": F.lit(True)}), f"{folder}/0")
    while not layers.where("rose").isEmpty():
        rounds += 1
        if rounds > limit:
            raise ValueError("the graph has a cycle")
        rising = layers.where("rose").select(F.col("id").alias("target"), "layer")
        up = arcs.join(rising, "target").groupBy(F.col("source").alias("id")).agg((F.max("layer") + 1).alias("need"))
        rose = F.coalesce(F.col("need") > F.col("layer"), F.lit(False))
        met = layers.drop("rose").join(up, "id", "left")
        layers = write_table(met.select("id", F.greatest("layer", "need").alias("layer"), rose.alias("rose")), f"{folder}/{rounds}")
    out = checkpoint(layers.select("id", "layer"))
    remove_path(nodes.sparkSession, folder)
    return out


def partition_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, idx)``: foundations first, members of a cycle side by side.

    Components are ordered by their layer in the condensed graph, then by smallest member;
    within a component by fan-in, then id.
    """
    plain = checkpoint(simple_edges(edges, nodes))
    parts = checkpoint(strong_components(plain, nodes).select("id", "component"))
    a, b = parts.select(F.col("id").alias("source"), F.col("component").alias("s")), parts.select(F.col("id").alias("target"), F.col("component").alias("t"))
    between = plain.join(a, "source").join(b, "target").where("s <> t").select(F.col("s").alias("source"), F.col("t").alias("target")).distinct()
    layers = longest_path_layers(parts.select(F.col("component").alias("id")), checkpoint(between)).withColumnRenamed("id", "component")
    fan_in = plain.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("fan_in"))
    placed = parts.join(layers, "component").join(fan_in, "id", "left").na.fill(0, ["fan_in"])
    order = [F.col("layer"), F.col("component"), F.desc("fan_in"), F.col("id")]
    return scanned(placed, order, number="idx").select("id", F.col("idx").cast("int").alias("idx"))


def bfs_rings(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``(id, depth)`` by breadth-first search over either direction; unreached nodes have depth null."""
    both = checkpoint(edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct())
    start = roots.select("id").distinct().withColumn("depth", F.lit(0))
    seen = grown(start, lambda fresh: fresh.join(both.withColumnRenamed("source", "id"), "id").select(F.col("target").alias("id"), (F.col("depth") + 1).alias("depth")), ["id"], "rings")
    return nodes.select("id").distinct().join(seen, "id", "left")


def communities(nodes: DataFrame, edges: DataFrame, rounds: int | None = ROUNDS) -> DataFrame:
    """``(id, community)`` by label propagation: the commonest label next door, the own one included, ties to the smallest.

    All nodes take their labels at once.  ``rounds`` is part of the definition, since labels of
    some graphs swing for ever; with None it goes on until no label changes.
    """
    spark, folder, k = nodes.sparkSession, scratch_path(nodes.sparkSession, "communities"), 0
    both = write_table(edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).where("source <> target"), f"{folder}/edges")
    labels = write_table(nodes.select("id", F.col("id").alias("community"), F.lit(True).alias("changed")).distinct(), f"{folder}/0")
    while (rounds is None or k < rounds) and not labels.where("changed").isEmpty():
        votes = both.join(labels.select(F.col("id").alias("source"), "community"), "source").groupBy(F.col("target").alias("id"), "community").agg(F.count("*").alias("n"))
        own = labels.select("id", "community", F.lit(1).cast("long").alias("n"))
        tally = votes.unionByName(own).groupBy("id", "community").agg(F.sum("n").alias("n"))
        best = tally.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "community")).alias("m")).select("id", F.col("m.community").alias("new"))
        k += 1
        labels = write_table(labels.join(best, "id").select("id", F.col("new").alias("community"), (F.col("new") != F.col("community")).alias("changed")), f"{folder}/{k}")
    out = checkpoint(labels.select("id", "community"))
    remove_path(spark, folder)
    return out


def file_cohesion(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """``(file, symbols, components, cohesion)`` of ``symbols(id, file)`` over same-file edges."""
    from orrery.functions.metrics import cohesion

    ids = symbols.select(F.xxhash64("file", "id").alias("node"), "file", "id")
    a, b = ids.select("file", F.col("id").alias("source"), F.col("node").alias("a")), ids.select("file", F.col("id").alias("target"), F.col("node").alias("b"))
    inner = edges.join(a, "source").join(b, ["file", "target"]).select("a", "b")
    labels = connected_components(inner, "a", "b")
    marked = ids.join(labels, "node", "left").withColumn("part", F.coalesce("component", "node"))
    out = marked.groupBy("file").agg(F.count("*").alias("symbols"), F.countDistinct("part").alias("components"))
    return out.withColumn("cohesion", F.round(cohesion(F.col("symbols"), F.col("components")), 6))


def place_in_rows(ranked: DataFrame, row: str, gap: float = 120.0) -> DataFrame:
    """``(id, x, y)`` with a line per value of ``row``, centred, by id."""
    w = Window.partitionBy(row)
    x = (F.row_number().over(w.orderBy("id")) - 1 - (F.count("*").over(w) - 1) / 2.0) * gap
    return ranked.select("id", x.cast("float").alias("x"), (F.coalesce(F.col(row), F.lit(-1)) * gap).cast("float").alias("y"))


def place_on_rings(ranked: DataFrame, ring: str, gap: float = 160.0) -> DataFrame:
    """``(id, x, y)`` with a circle per value of ``ring``, by id."""
    w = Window.partitionBy(ring)
    angle = 2 * math.pi * (F.row_number().over(w.orderBy("id")) - 1) / F.count("*").over(w)
    radius = F.coalesce(F.col(ring), F.lit(0)) * gap
    return ranked.select("id", (radius * F.cos(angle)).cast("float").alias("x"), (radius * F.sin(angle)).cast("float").alias("y"))


def _greedy(weights: np.ndarray, bus: np.ndarray) -> np.ndarray:
    """Cluster numbers after merging the best pair again and again while the cost drops; a bus stays alone."""
    n = len(weights)
    cluster = np.arange(n)
    linked = (weights > 0) & ~bus[None, :]

    def cost(c: np.ndarray) -> float:
        size = np.bincount(c, minlength=n)
        return float(np.where(c[:, None] == c[None, :], (size[c] ** 2)[:, None], n * n)[linked].sum())

    best = cost(cluster)
    while True:
        tried = [(cost(np.where(cluster == b, a, cluster)), a, b) for a in np.unique(cluster[~bus]) for b in np.unique(cluster[~bus]) if a < b and _touch(linked, cluster, a, b)]
        if not tried or min(tried)[0] >= best - 1e-9:
            return cluster
        best, a, b = min(tried)
        cluster = np.where(cluster == b, a, cluster)


def _touch(linked: np.ndarray, cluster: np.ndarray, a: int, b: int) -> bool:
    """Whether any dependency runs between two clusters; only such merges can save anything."""
    x, y = cluster == a, cluster == b
    return bool(linked[np.ix_(x, y)].any() or linked[np.ix_(y, x)].any())


def greedy_clusters(cells: DataFrame, elements: DataFrame, buses: DataFrame) -> DataFrame:
    """``(id, cluster)`` of a matrix of bounded size (150 elements), merged in one group."""
    nodes = elements.select(F.col("idx").alias("i"), F.lit(-1).alias("j"), F.col("id"), F.lit(0).cast("long").alias("w"))
    marks = buses.select(F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.col("target").alias("id"), F.lit(1).cast("long").alias("w"))
    arcs = cells.select(F.col("row_idx").alias("i"), F.col("col_idx").alias("j"), F.lit("").alias("id"), F.col("weight").cast("long").alias("w"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        named = rows[(rows.i >= 0) & (rows.j < 0)].sort_values("i")
        if len(named):
            weights, bus = np.zeros((len(named), len(named))), named.id.isin(rows[rows.i < 0].id).to_numpy()
            arc = rows[rows.j >= 0]
            weights[arc.i.to_numpy(int), arc.j.to_numpy(int)] = arc.w
            yield pd.DataFrame({"id": named.id.to_numpy(), "cluster": _greedy(weights, bus)})

    from orrery.session import ship_package

    ship_package(cells.sparkSession)
    return nodes.unionByName(marks).unionByName(arcs).coalesce(1).mapInPandas(run, "id string, cluster int")
