"""Connected components of an undirected graph, by repeated local contraction.

Node ids are relabelled with a bijective 64-bit hash, which gives every node a random
rank.  A round sends each node to the lowest rank in its closed neighbourhood and
rewrites the edges between the images; the edge count falls geometrically, also on
long paths.  Every step is a pre-aggregated ``groupBy`` or a plain equi-join, so a hub
node is split by skew-join handling and never collected into one task.

Rounds are written as tables, not checkpointed: a checkpoint inherits the estimated size of
its plan, and a product of such estimates over joined rounds has exponentially many digits.
A table has the size of its files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.session import checkpoint, dealt, movable, remove_path, scratch_path, write_table


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Label each node of ``edges`` (two BIGINT columns) with its component.

    Returns ``(node, component)``; ``component`` is the smallest node id of the component.
    Self-loops and edges with a null end are ignored, so an empty input gives an empty
    result.  Parallel edges and either orientation are allowed.
    """
    spark = edges.sparkSession
    folder = scratch_path(spark, "components")
    clean = edges.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst")).where("src <> dst")
    clean = clean.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    clean = write_table(clean, f"{folder}/edges")
    nodes = clean.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    live = clean.select(F.xxhash64("src").alias("a"), F.xxhash64("dst").alias("b"))

    hops: list[DataFrame] = []
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hop = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("to"))
        hop = write_table(hop, f"{folder}/hop-{len(hops)}")
        hops.append(hop)
        moved = (
            live.join(dealt(hop.select("a", F.col("to").alias("x"))), "a")
            .join(dealt(hop.select(F.col("a").alias("b"), F.col("to").alias("y"))), "b")
            .where("x <> y")
        )
        moved = moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        live = write_table(moved, f"{folder}/live-{len(hops)}")

    label = nodes.select("node", F.xxhash64("node").alias("at"))
    for hop in hops:
        step = hop.select(F.col("a").alias("at"), "to")
        label = label.join(dealt(step.select(movable("at"), "to")), "at", "left").select("node", F.coalesce("to", "at").alias("at"))
    # The checkpoint outlives the tables of the rounds; Spark's cleaner removes it.
    label = checkpoint(write_table(label, f"{folder}/label"))
    remove_path(spark, folder)
    lowest = label.groupBy("at").agg(F.min("node").alias("component"))
    return label.join(dealt(lowest.select(movable("at"), "component")), "at").select("node", "component")
