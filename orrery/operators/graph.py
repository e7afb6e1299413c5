"""Directed-graph operators over ``(source, target)`` edges.

Iterations are driver loops over DataFrames: each round is an equi-join and a distinct, its
result is written as a table below the shared folder, and only a row count comes back.  What
rounds add up to is the union of their tables, so nothing is written twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.session import checkpoint, dealt, remove_path, scratch_path, write_table

#: Elements of a matrix, elements whose propagation is measured, the share of a bus.
MAX_ELEMENTS, PROPAGATION_ELEMENTS, BUS_SHARE = 150, 80, 0.1
#: Rows of a counted table that are sent to every executor; with more, a join deals both sides.
FEW_ROWS = 200_000


def simple_edges(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Distinct edges without self-loops, both ends among ``nodes`` (column ``id``) if given."""
    out = edges.select("source", "target").where("source <> target")
    if nodes is not None:
        out = out.join(nodes.select(F.col("id").alias("source")), "source", "left_semi").join(nodes.select(F.col("id").alias("target")), "target", "left_semi")
    return out.select("source", "target").distinct()


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(id, out_degree, in_degree, role)`` of every node; parallel edges count each."""
    ends = edges.select(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        edges.select(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    sums = ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    joined = nodes.select("id").join(sums, "id", "left").na.fill(0, ["out_degree", "in_degree"])
    return joined.withColumn("role", role(F.col("out_degree"), F.col("in_degree")))


def role(out_degree: Column, in_degree: Column, hub: int = 3) -> Column:
    """``independent`` without edges, ``hub`` with enough of either kind, else ``withDependencies``."""
    return F.when(out_degree + in_degree == 0, "independent").when(F.greatest(out_degree, in_degree) >= hub, "hub").otherwise("withDependencies")


def neighbourhood(edges: DataFrame, centre: str) -> DataFrame:
    """``(id, direction)`` of the nodes next to ``centre``."""
    out = edges.where(F.col("source") == centre).select(F.col("target").alias("id"), F.lit("uses").alias("direction"))
    into = edges.where(F.col("target") == centre).select(F.col("source").alias("id"), F.lit("used by").alias("direction"))
    return out.unionByName(into).where(F.col("id") != centre).distinct()


def grown(start: DataFrame, step, keys: list[str], name: str) -> DataFrame:
    """All rows of ``start`` and of ``step(rows of the last round)`` again and again, each of ``keys`` once.

    A row found by several rounds keeps the columns of the first.
    """
    spark, folder = start.sparkSession, scratch_path(start.sparkSession, name)
    fresh = write_table(start.distinct(), f"{folder}/0")
    rounds = 1
    while not fresh.isEmpty():
        seen = spark.read.schema(fresh.schema).parquet(*[f"{folder}/{k}" for k in range(rounds)])
        fresh = write_table(step(fresh).distinct().join(seen.select(*keys), keys, "left_anti"), f"{folder}/{rounds}")
        rounds += 1
    out = checkpoint(spark.read.schema(fresh.schema).parquet(*[f"{folder}/{k}" for k in range(rounds)]))
    remove_path(spark, folder)
    return out


def closure(edges: DataFrame) -> DataFrame:
    """All pairs ``(source, target)`` joined by a path of at least one edge; semi-naive."""
    plain = checkpoint(edges.select("source", "target").distinct())
    on = plain.select(F.col("source").alias("target"), F.col("target").alias("next"))
    return grown(plain, lambda fresh: fresh.join(on, "target").select("source", F.col("next").alias("target")), ["source", "target"], "closure")


def _colours(nodes: DataFrame, edges: DataFrame, folder: str) -> DataFrame:
    """``(id, label)``: the greatest id that reaches each node; only nodes whose label grew send it on."""
    labels = write_table(nodes.select("id", F.col("id").alias("label"), F.lit(True).alias("grew")), f"{folder}/0")
    k = 1
    while not labels.where("grew").isEmpty():
        sent = labels.where("grew").join(edges.withColumnRenamed("source", "id"), "id").select(F.col("target").alias("id"), "label")
        best = sent.groupBy("id").agg(F.max("label").alias("new"))
        grew = F.coalesce(F.col("new") > F.col("label"), F.lit(False))
        labels = write_table(labels.join(best, "id", "left").select("id", F.when(grew, F.col("new")).otherwise(F.col("label")).alias("label"), grew.alias("grew")), f"{folder}/{k}")
        k += 1
    return labels.select("id", "label")


def _kernel_components(edges: DataFrame, folder: str) -> DataFrame:
    """``(id, component)`` by colouring: a node that keeps its own id is a root, what its colour reaches it with is its component.

    All roots of a round are pivots at once; components are taken out and the rest goes on.
    """
    rest_edges, found_all, k = edges, [], 0
    while not rest_edges.isEmpty():
        nodes = rest_edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
        colours = _colours(nodes, rest_edges, f"{folder}/colours-{k}")
        same = (
            rest_edges.join(colours.select(F.col("id").alias("source"), F.col("label").alias("ls")), "source")
            .join(colours.select(F.col("id").alias("target"), F.col("label").alias("lt")), "target")
            .where("ls = lt")
            .select(F.col("target").alias("id"), F.col("source").alias("next"))
        )
        back = write_table(same, f"{folder}/back-{k}")
        found = grown(colours.where("id = label"), lambda fresh: fresh.join(back, "id").select(F.col("next").alias("id"), "label"), ["id", "label"], "component")  # noqa: B023
        found_all.append(found.select("id", F.col("label").alias("component")))
        for end in ("source", "target"):
            rest_edges = rest_edges.join(found.select(F.col("id").alias(end)), end, "left_anti")
        rest_edges = write_table(rest_edges, f"{folder}/rest-{k}")
        k += 1
    out = found_all[0]
    for more in found_all[1:]:
        out = out.unionByName(more)
    return out


def _fit(df: DataFrame, rows: int) -> DataFrame:
    """One side of a join with a table that is larger: sent to the executors while its ``rows`` are few, else both are dealt."""
    return F.broadcast(df) if rows <= FEW_ROWS else dealt(df)


def _simple_nodes(live: DataFrame) -> DataFrame:
    """``(id, on)`` of the nodes without an edge in or out (``on`` is null) or with edges out to one node ``on`` only."""
    ends = live.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("to")), F.struct(F.col("target").alias("id"), F.lit(None).alias("to")))).alias("e")).select("e.*")
    seen = ends.groupBy("id").agg(F.min("to").alias("low"), F.max("to").alias("high"), F.max(F.isnull("to")).alias("led"))
    alone = F.isnull("low") | ~F.col("led")
    return seen.where(alone | (F.col("low") == F.col("high"))).select("id", F.when(~alone, F.col("low")).alias("on"))


def _taken(simple: DataFrame, rows: int, k: int) -> DataFrame:
    """``(id, on)``: of the nodes of ``_simple_nodes`` all without ``on``; of the rest no two neighbours, those of the locally highest hash.

    A node before one without ``on`` waits, for that one has no edges afterwards.
    """
    single = simple.where("on IS NOT NULL").withColumn("h", F.xxhash64("id", F.lit(k)))
    into = single.groupBy(F.col("on").alias("id")).agg(F.max("h").alias("before"))
    beyond = simple.select(F.col("id").alias("on"), F.when(F.isnotnull("on"), F.xxhash64("id", F.lit(k))).otherwise(F.lit(2**63 - 1)).alias("after"))
    highest = single.join(_fit(into, rows), "id", "left").join(_fit(beyond, rows), "on", "left").where("coalesce(h > before, TRUE) AND coalesce(h > after, TRUE)")
    return simple.where("on IS NULL").unionByName(highest.select("id", "on"))


def _named(into: DataFrame, found: DataFrame) -> DataFrame:
    """``(id, component)`` of the nodes ``via`` whose edges ``into(source, target, via)`` lead from their target's component to it."""
    rows = into.count()
    ends = into.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    known = found.select("id", "component").join(_fit(ends, 2 * rows), "id", "left_semi")
    both = into.join(_fit(known.select(F.col("id").alias("target"), F.col("component").alias("c")), 2 * rows), "target", "left")
    both = both.join(_fit(known.select(F.col("id").alias("source"), F.col("component").alias("d")), 2 * rows), "source", "left")
    both = both.select(F.col("via").alias("id"), F.coalesce("c", "target").alias("component"), F.coalesce("d", "source").alias("d"))
    return both.where("component = d").select("id", "component").distinct()


def strong_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(id, component, size, cyclic)``; a component is named after its smallest node.

    A component is cyclic if it has two nodes or a loop.  The graph is shrunk first:

    * Trim: a node without edges in or out is a component of its own and goes.
    * Contract: a node with edges out to one node only is taken off its paths, which go straight on to its target, a
      third of a chain in a round.  Afterwards it belongs to its target's component if one of those that led to
      it does, else it is alone.

    What is left, where every node has a choice, is coloured from many pivots at once.

    ``edges`` is evaluated once.  A round's table holds the edges left, and the node ``via`` that was taken off
    those made straight, so that names come back without the rounds' joins; parallel edges stay until the end.
    """
    spark, folder = edges.sparkSession, scratch_path(edges.sparkSession, "strong")
    given = write_table(edges.select("source", "target").distinct(), f"{folder}/given")
    live, rounds = given.where("source <> target"), []
    for end in ("source", "target"):
        live = live.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    live = write_table(live.select("source", "target"), f"{folder}/edges-0")
    while True:
        simple, k = checkpoint(_simple_nodes(live)), len(rounds) + 1
        few = simple.count()
        if not few:
            break
        gone = _taken(simple, few, k)
        onward = live.join(_fit(gone.select(F.col("id").alias("source")), few), "source", "left_anti")
        onward = onward.join(_fit(gone.select(F.col("id").alias("target"), "on", F.lit(True).alias("off")), few), "target", "left").where("off IS NULL OR on IS NOT NULL")
        onward = onward.select("source", F.coalesce("on", "target").alias("target"), F.when(F.col("off"), F.col("target")).alias("via"))
        rounds.append(write_table(onward, f"{folder}/edges-{k}"))
        live = rounds[-1].where("source <> target").select("source", "target")
    found = nodes.select("id", F.col("id").alias("component")).limit(0)
    if not live.isEmpty():
        kernel = write_table(live.distinct(), f"{folder}/kernel-edges")
        found = write_table(_kernel_components(kernel, f"{folder}/kernel"), f"{folder}/kernel-found")
    for k in range(len(rounds), 0, -1):
        more = _named(rounds[k - 1].where("via IS NOT NULL"), found)
        found = found.unionByName(write_table(more, f"{folder}/found-{k}"))
    loops = given.where("source = target").select(F.col("source").alias("id"), F.lit(True).alias("loop"))
    lone = nodes.select("id").distinct().join(found, "id", "left").join(loops, "id", "left")
    # The checkpoint outlives the tables of the rounds; Spark's cleaner removes it.
    lone = checkpoint(lone.select("id", F.coalesce("component", "id").alias("at"), F.coalesce("loop", F.lit(False)).alias("loop")))
    remove_path(spark, folder)
    sizes = lone.groupBy("at").agg(F.min("id").alias("component"), F.count("*").alias("size"))
    return lone.join(sizes, "at").select("id", "component", "size", (F.col("loop") | (F.col("size") > 1)).alias("cyclic"))


def matrix_elements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(idx, id, group, capped)`` by (group, id); beyond the limit the best connected stay."""
    n = nodes.count()
    kept = nodes.select("id", "group")
    if n > MAX_ELEMENTS:
        weight = degrees(simple_edges(edges, nodes), nodes)
        kept = kept.join(weight, "id").orderBy(F.desc(F.col("out_degree") + F.col("in_degree")), "id").limit(MAX_ELEMENTS).select("id", "group")
    order = F.row_number().over(Window.orderBy("group", "id")) - 1
    return kept.withColumn("idx", order).withColumn("capped", F.lit(n > MAX_ELEMENTS))


def matrix_cells(edges: DataFrame, elements: DataFrame) -> DataFrame:
    """Sparse cells ``(row_idx, col_idx, weight)`` with the group and index of both ends."""
    a = elements.select(F.col("id").alias("source"), F.col("idx").alias("row_idx"), F.col("group").alias("row_group"))
    b = elements.select(F.col("id").alias("target"), F.col("idx").alias("col_idx"), F.col("group").alias("col_group"))
    counted = edges.where("source <> target").groupBy("source", "target").agg(F.count("*").alias("weight"))
    return counted.join(F.broadcast(a), "source").join(F.broadcast(b), "target")


def propagation(edges: DataFrame, elements: DataFrame) -> DataFrame:
    """One row: the share of pairs within the first elements that are joined by a path."""
    first = elements.where(F.col("idx") < PROPAGATION_ELEMENTS)
    pairs = closure(simple_edges(edges, first)).where("source <> target").agg(F.count("*").alias("p"))
    n = first.agg(F.count("*").alias("m"))
    return pairs.join(n, F.lit(True)).select(F.when(F.col("m") == 0, 0.0).otherwise((F.col("p") + F.col("m")) / (F.col("m") * F.col("m"))).alias("propagation"))


def bus_ids(cells: DataFrame, n: int) -> DataFrame:
    """Targets of at least a tenth of all elements, ten elements or more provided."""
    limit = max(2, -(-n // 10))
    if n < 10 or -(-n // 10) < 2:
        return cells.select("target").limit(0)
    return cells.groupBy("target").agg(F.count("*").alias("fan_in")).where(F.col("fan_in") >= limit).select("target")


def clustered_cost(cells: DataFrame, elements: DataFrame, buses: DataFrame) -> DataFrame:
    """One row (deps, cost, normalised): 1 towards a bus, the square of the group's size inside it, n squared between groups."""
    n = elements.agg(F.count("*").alias("n"))
    sizes = elements.groupBy("group").agg(F.count("*").alias("size"))
    marked = cells.join(F.broadcast(buses.withColumn("bus", F.lit(True))), "target", "left").join(F.broadcast(sizes.withColumnRenamed("group", "row_group")), "row_group")
    priced = marked.join(F.broadcast(n), F.lit(True)).select(
        F.when(F.col("bus"), F.lit(1)).when(F.col("row_group") == F.col("col_group"), F.col("size") * F.col("size")).otherwise(F.col("n") * F.col("n")).alias("c"), "n"
    )
    total = priced.agg(F.count("*").alias("deps"), F.coalesce(F.sum("c"), F.lit(0)).cast("double").alias("cost"), F.max("n").alias("n"))
    share = F.when(F.col("deps") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("cost") / (F.col("deps") * F.col("n") * F.col("n"))))
    return total.select("deps", "cost", share.alias("normalised"))


def density(cells: DataFrame, elements: DataFrame) -> DataFrame:
    """One row (n, upper, coupling)."""
    n = elements.agg(F.count("*").alias("n"))
    c = cells.agg(F.count_if(F.col("row_idx") < F.col("col_idx")).alias("u"), F.count("*").alias("k"))
    slots = F.col("n") * (F.col("n") - 1)
    return c.join(n, F.lit(True)).select(
        "n",
        F.when(slots == 0, 0.0).otherwise(F.col("u") / (slots / 2)).alias("upper"),
        F.when(slots == 0, 0.0).otherwise(F.col("k") / slots).alias("coupling"),
    )


def health(n: Column, cyclic: Column, cycles: Column, upper: Column, prop: Column, cost: Column, coupling: Column) -> Column:
    ring = F.when(n == 0, 0.0).otherwise(45.0 * cyclic / n + 2.0 * F.least(cycles, F.lit(10)))
    return F.least(F.greatest(100.0 - ring - 20.0 * upper - 15.0 * prop - 15.0 * cost - 5.0 * coupling, F.lit(0.0)), F.lit(100.0))


def dsm_report(nodes: DataFrame, edges: DataFrame, partitioned: bool = False) -> DataFrame:
    """One row of all matrix metrics of ``nodes(id, group)`` and ``edges``.

    Elements stand by (group, id), or foundations first if ``partitioned``.  Where no node has
    a group, clusters are merged greedily.
    """
    from orrery.operators import layering

    elements = checkpoint(matrix_elements(nodes, edges))
    inner = checkpoint(simple_edges(edges, elements))
    if partitioned:
        elements = checkpoint(elements.drop("idx").join(layering.partition_order(elements, inner), "id"))
    cells = checkpoint(matrix_cells(edges, elements))
    parts = strong_components(inner, elements).where("cyclic")
    rings = parts.agg(F.count("*").alias("cyclic_nodes"), F.countDistinct("component").alias("cycles"))
    size = elements.count()
    buses = checkpoint(bus_ids(cells, size))
    one = density(cells, elements).join(rings, F.lit(True)).join(propagation(inner, elements), F.lit(True))
    grouped = elements
    if elements.where(F.col("group").isNotNull()).isEmpty():
        merged = layering.greedy_clusters(cells, elements, buses)
        grouped = checkpoint(elements.drop("group").join(merged, "id").withColumnRenamed("cluster", "group"))
    priced = matrix_cells(edges, grouped)
    one = one.join(clustered_cost(priced, grouped, buses), F.lit(True)).join(buses.agg(F.count("*").alias("buses")), F.lit(True))
    score = health(*[F.col(c) for c in ("n", "cyclic_nodes", "cycles", "upper", "propagation", "normalised", "coupling")])
    rounded = {c: F.round(c, 6) for c in ("upper", "coupling", "propagation", "normalised")}
    return one.withColumn("health", F.round(score, 6)).withColumns(rounded)


def prefix_owner(paths: DataFrame, owners: DataFrame, path: str = "path", owner: str = "owner") -> DataFrame:
    """``paths`` plus the longest owner that equals or holds the path, ``.`` if there is none.

    Paths are exploded to their ancestors, so the match is an equi-join; each distinct path
    is matched once.
    """
    from orrery.functions.paths import ancestors

    distinct = paths.select(F.col(path).alias("__path")).distinct()
    steps = distinct.select("__path", F.explode(F.concat(F.array("__path"), ancestors(F.col("__path")))).alias("__at"))
    known = owners.select(F.col(owner).alias("__at")).where("__at <> '.'").distinct()
    best = steps.join(known, "__at").groupBy("__path").agg(F.max_by("__at", F.length("__at")).alias("__owner"))
    out = paths.join(best, paths[path] == best["__path"], "left")
    return out.withColumn("owner", F.coalesce("__owner", F.lit("."))).drop("__path", "__owner")
