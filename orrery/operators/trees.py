"""Spanning forests, Euler tours and what follows from them: bridges, tree layouts.

A forest is found by contraction: every round each node hooks onto its neighbour of least
random rank, the trees of hooks shrink to their roots, and the hooks' original edges are tree
edges.  Layouts and bridges shed leaves first, round after round while that takes a good part of
the graph; what a leaf holds goes to its neighbour, so a shed row is dealt a fixed number of times
and only the rest, long paths among it, is toured.  A tour walks every tree edge both ways; its order comes from pointer jumping, so a path of
10,000 nodes takes fifteen rounds.  Everything else is a running sum along the tour.

Rounds are written as tables below the shared folder.  Hubs are cut by ranges of a sorted order,
never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.components import connected_components
from orrery.operators.ranks import scanned
from orrery.session import checkpoint, movable, remove_path, scratch_path, write_table

#: The distances between neighbours in a row, and between rows.
X_GAP, Y_GAP = 56.0, 72.0
#: Leaves are shed while a round takes one edge in so many.
SHED_SHARE = 8


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct ``(src, dst)`` with ``src < dst``; loops and edges with a null end are left out."""
    clean = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return clean.where("src <> dst").distinct()


def shed_leaves(links: DataFrame, folder: str, fold, marks: DataFrame | None = None, upward: bool = False, roots: DataFrame | None = None) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """``(rounds, rest, kept)``: rows ``(node, parent, v)`` of the leaves shed in each round, the links left over, ``(node, v)`` of the other nodes.

    ``v`` folds the ``marks(node, v)`` of a node and what its shed leaves held; ``upward`` counts leaves instead, one for
    a leaf that holds nothing.  With ``upward`` a leaf goes only if its neighbour is smaller and it is none of ``roots(node)``,
    so the root of its tree stays; otherwise both ends of a lone link are shed.  ``links`` is a written table of distinct links.
    """
    kept = links.select(F.col("src").alias("node"), F.lit(None).cast("long").alias("v")).limit(0) if marks is None else marks
    rounds, rest, left = [], links, links.count()
    while left:
        k = len(rounds)
        both = rest.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(rest.select(F.col("dst").alias("node"), F.col("src").alias("other")))
        ends = both.withColumn("v", F.lit(None).cast("long")).unionByName(kept.select("node", F.lit(None).cast("long").alias("other"), "v"))
        found = write_table(ends.groupBy("node").agg(F.count("other").alias("n"), F.min("other").alias("parent"), fold("v").alias("v")), f"{folder}/ends-{k}")
        leaf = found.where("n = 1 AND node > parent") if upward else found.where("n = 1")
        if roots is not None:
            leaf = leaf.join(roots.select("node").distinct(), "node", "left_anti")
        if leaf.count() * SHED_SHARE < left:
            return rounds, rest, found.select("node", "v")
        gone = leaf.select(F.least("node", "parent").alias("src"), F.greatest("node", "parent").alias("dst"))
        rest = write_table(rest.join(gone, ["src", "dst"], "left_anti"), f"{folder}/rest-{k}")
        own = F.coalesce("v", F.lit(1)) if upward else F.col("v")
        leaf = leaf.select("node", "parent", own.alias("v"))
        stays = found.join(leaf.select("node"), "node", "left_anti") if roots is not None else found.where("NOT (n = 1 AND node > parent)" if upward else "n <> 1")
        # One row a node: the leaves of a hub are added up before anything moves.
        given = leaf.groupBy(F.col("parent").alias("node")).agg(fold("v").alias("v"))
        kept = write_table(stays.select("node", "v").unionByName(given), f"{folder}/kept-{k}")
        rounds.append(leaf)
        left = rest.count()
    return rounds, rest, kept.groupBy("node").agg(fold("v").alias("v"))


def _rooted(hooks: DataFrame, folder: str) -> DataFrame:
    """``(a, to)`` with every hook followed to its root; ranks fall along hooks, so chains are short."""
    step = 0
    while True:
        far = hooks.select(F.col("a").alias("to"), F.col("to").alias("on"))
        after = write_table(hooks.join(far.select(movable("to"), "on"), "to", "left").select("a", F.coalesce("on", "to").alias("to"), F.col("on").isNotNull().alias("moved")), f"{folder}-{step}")
        hooks, step = after.select("a", "to"), step + 1
        if after.where("moved").isEmpty():
            return hooks


def spanning_forest(edges: DataFrame) -> DataFrame:
    """``(src, dst)``: edges of ``edges(src, dst)`` (BIGINT, any direction, parallel edges and loops allowed) that form a spanning forest.

    No edges give an empty forest.
    """
    folder = scratch_path(edges.sparkSession, "forest")
    out = _forest(write_table(undirected(edges), f"{folder}/links"), folder)
    remove_path(edges.sparkSession, folder)
    return out


def _forest(links: DataFrame, folder: str) -> DataFrame:
    """The spanning forest of a written table of distinct links."""
    live = links.select("src", "dst", F.col("src").alias("a"), F.col("dst").alias("b"))
    picked, k = [], 0
    while not live.isEmpty():
        both = live.unionByName(live.select("src", "dst", F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(k)).alias("r"), F.col(c).alias("to"))  # noqa: B023, E731
        best = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("rank"), "src", "dst")).alias("m"))
        hooks = best.where(F.col("m.rank") < rank("a")).select("a", "m.rank.to", "m.src", "m.dst")
        hooks = write_table(hooks, f"{folder}/hooks-{k}")
        picked.append(hooks.select("src", "dst"))
        root = _rooted(hooks.select("a", "to"), f"{folder}/roots-{k}")
        for end in ("a", "b"):
            live = live.join(root.select(movable("a").alias(end), "to"), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        live = write_table(live.where("a <> b"), f"{folder}/live-{k}")
        k += 1
    # Hooks fall in rank, and their ends are one node afterwards: no edge is picked twice.
    out = links.select("src", "dst").limit(0)
    for part in picked:
        out = out.unionByName(part)
    return checkpoint(out)


def tour_places(arcs: DataFrame, folder: str) -> DataFrame:
    """``arcs(n, next)`` plus ``left``, the number of steps to the end of the list, by pointer jumping."""
    state = write_table(arcs.select("n", "next", F.col("next").isNotNull().cast("long").alias("left")), f"{folder}/jump")
    k = 0
    while not state.where("next IS NOT NULL").isEmpty():
        on = state.select(F.col("n").alias("next"), F.col("next").alias("then"), F.col("left").alias("more"))
        jumped = state.join(on.select(movable("next"), "then", "more"), "next", "left")
        state = write_table(jumped.select("n", F.col("then").alias("next"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")), f"{folder}/jump-{k}")
        k += 1
    return state.select("n", "left")


def rooted_forest(forest: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """``(node, parent, root, depth, pre, size, pos, up)`` of every node of ``forest(src, dst)``.

    Trees hang from their smallest node, or from the smallest of ``roots(node)`` where they hold one; the
    parent of a root is null.  ``pre`` numbers all nodes in preorder, tree after tree, ``size`` counts
    the nodes of the subtree, so a subtree is the range ``[pre, pre + size)``.  ``pos`` and ``up`` are
    the tour's places where it enters and leaves the node.
    """
    folder = scratch_path(forest.sparkSession, "tour")
    labels = write_table(connected_components(forest), f"{folder}/labels")
    top = labels.groupBy("component").agg(F.min("node").alias("root"))
    if roots is not None:
        asked = labels.join(roots.select("node"), "node", "left_semi").groupBy("component").agg(F.min("node").alias("asked"))
        top = top.join(asked, "component", "left").select("component", F.coalesce("asked", "root").alias("root"))
    both = forest.select("src", "dst").unionByName(forest.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    arcs = write_table(scanned(both, [F.col("src"), F.col("dst")], number="n"), f"{folder}/arcs")

    ends = arcs.groupBy("src").agg(F.min("n").alias("first"), F.max("n").alias("last"))
    after = arcs.join(ends.select(movable("src"), "first", "last"), "src")
    after = after.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.when(F.col("n") < F.col("last"), F.col("n") + 1).otherwise(F.col("first")).alias("next"))
    starts = top.join(ends.withColumnRenamed("src", "root"), "root").select(F.col("first").alias("next"), F.lit(True).alias("ends"))
    listed = arcs.join(after, ["src", "dst"]).join(starts.select(movable("next"), "ends"), "next", "left")
    listed = listed.select("n", "src", "dst", F.when(F.col("ends").isNull(), F.col("next")).alias("next"))
    listed = write_table(listed, f"{folder}/listed")
    left = tour_places(listed, folder)

    placed = listed.select("n", "src", "dst").join(left, "n").join(labels.select(F.col("node").alias("src"), "component"), "src").join(top, "component")
    down, up = placed.select("src", "dst", "root", F.col("left").alias("down")), placed.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("left").alias("back"))
    kids = down.join(up, ["src", "dst"]).where("down > back").select(F.col("dst").alias("node"), F.col("src").alias("parent"), "root", "down", "back")
    kids = write_table(kids, f"{folder}/kids")
    sizes = write_table(labels.join(top, "component").groupBy("root").agg(F.count("*").alias("nodes")), f"{folder}/sizes")
    whole = kids.join(sizes, "root").select(
        "node", "parent", "root", (2 * F.col("nodes") - 3 - F.col("down")).alias("pos"), (2 * F.col("nodes") - 3 - F.col("back")).alias("up"), F.expr("(down - back + 1) DIV 2").alias("size")
    )
    heads = sizes.select(F.col("root").alias("node"), F.lit(None).cast("long").alias("parent"), "root", F.lit(-1).cast("long").alias("pos"), (2 * F.col("nodes") - 2).alias("up"), F.col("nodes").alias("size"))
    nodes = write_table(whole.unionByName(heads), f"{folder}/nodes")
    depth = along_tour(nodes, {"depth": F.lit(1)})
    out = scanned(depth.withColumn("depth", F.col("depth") - 1), [F.col("root"), F.col("pos")], number="pre")
    out = checkpoint(out.select("node", "parent", "root", "depth", "pre", "size", "pos", "up"))
    remove_path(forest.sparkSession, folder)
    return out


def along_tour(nodes: DataFrame, values: dict) -> DataFrame:
    """``nodes`` plus, for each of ``values``, its sum over the path from the root to the node, both included.

    Values are added where the tour enters a node and taken back where it leaves.
    """
    enter = nodes.withColumns({"__at": F.col("pos"), "__in": F.lit(True), **{f"__{k}": v.cast("double") if k not in ("depth",) else v.cast("long") for k, v in values.items()}})
    leave = enter.withColumns({"__at": F.col("up"), "__in": F.lit(False), **{f"__{k}": -F.col(f"__{k}") for k in values}})
    run = scanned(enter.unionByName(leave), [F.col("root"), F.col("__at"), F.col("__in")], sums={k: F.col(f"__{k}") for k in values})
    return run.where("__in").select(*nodes.columns, *values)


def subtree_totals(tree: DataFrame, sums: dict | None = None, xors: dict | None = None) -> DataFrame:
    """``tree`` plus totals over every node's subtree, of expressions over ``tree``."""
    sums, xors = sums or {}, xors or {}
    own = tree.withColumns({f"__{k}": v for k, v in {**sums, **xors}.items()})
    run = checkpoint(scanned(own, [F.col("pre")], {f"__s{k}": F.col(f"__{k}") for k in sums}, {f"__s{k}": F.col(f"__{k}") for k in xors}))
    last = run.select(F.col("pre").alias("__end"), *[F.col(f"__s{k}").alias(f"__e{k}") for k in {**sums, **xors}])
    met = run.withColumn("__end", F.col("pre") + F.col("size") - 1).join(last, "__end")
    made = {k: F.col(f"__e{k}") - F.col(f"__s{k}") + F.col(f"__{k}") for k in sums}
    made |= {k: F.col(f"__e{k}").bitwiseXOR(F.col(f"__s{k}")).bitwiseXOR(F.col(f"__{k}")) for k in xors}
    return met.select(*tree.columns, *[v.alias(k) for k, v in made.items()])


def bridges(edges: DataFrame) -> DataFrame:
    """``(src, dst)``, ``src < dst``: the edges whose removal parts a component of the simple graph of ``edges(src, dst)``.

    The only edge of a node is a bridge; such nodes are shed.  Every edge outside a spanning forest has 64 random bits at both ends.  The xor over a
    subtree holds those that leave it, so a tree edge is a bridge if the xor below it is
    zero; another edge has one chance in 2**64 to look like one.  Leaves of the forest hand their bits on.  Parallel edges count as one,
    loops are ignored, no edges give no bridges.
    """
    folder = scratch_path(edges.sparkSession, "bridges")
    links = write_table(undirected(edges), f"{folder}/links")
    ends = lambda rows: rows.select(F.least("node", "parent").alias("src"), F.greatest("node", "parent").alias("dst"))
    pendant, rest, _ = shed_leaves(links, f"{folder}/pendant", F.bit_xor)
    found = [ends(leaves) for leaves in pendant]
    forest = write_table(_forest(rest, f"{folder}/forest").select("src", "dst"), f"{folder}/tree")
    cross = rest.join(forest, ["src", "dst"], "left_anti").withColumn("v", F.xxhash64(F.lit("bridge"), "src", "dst"))
    bits = cross.select(F.explode(F.array("src", "dst")).alias("node"), "v")
    raked, core, kept = shed_leaves(forest, f"{folder}/raked", F.bit_xor, marks=bits)
    found += [ends(leaves.where("coalesce(v, 0) = 0")) for leaves in raked]
    if not core.isEmpty():
        tree = rooted_forest(core)
        marked = tree.join(kept.select(movable("node"), F.col("v").alias("bits")), "node", "left").withColumn("bits", F.coalesce("bits", F.lit(0)))
        below = subtree_totals(marked, xors={"below": F.col("bits")})
        found.append(ends(below.where("parent IS NOT NULL AND below = 0")))
    out = links.limit(0)
    for part in found:
        out = out.unionByName(part)
    out = checkpoint(out.distinct())
    remove_path(edges.sparkSession, folder)
    return out


def bridge_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, cluster)``: components once all bridges are taken out, by smallest node; lone nodes are their own."""
    links = undirected(edges)
    inner = links.join(bridges(links), ["src", "dst"], "left_anti")
    found = connected_components(inner)
    return nodes.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("component", "node").alias("cluster"))


def tree_layout(nodes: DataFrame, edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """``(node, parent, depth, width, x, y)`` of a spanning forest of ``edges``, children from left to right by id.

    A leaf is one ``X_GAP`` wide, a parent as wide as its children and above their middle, a level ``Y_GAP``
    deep.  Trees stand side by side by root, nodes without edges on the right, as trees of their own.
    """
    folder = scratch_path(edges.sparkSession, "layout")
    links = write_table(undirected(edges), f"{folder}/links")
    rounds, rest, kept = shed_leaves(links, folder, F.sum, upward=True, roots=roots)
    kept = write_table(kept, f"{folder}/kept")
    null = F.lit(None).cast("long")
    top = kept.select("node", null.alias("parent"), F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"), F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("up"), F.coalesce("v", F.lit(1)).alias("width"))
    if not rest.isEmpty():
        tree = rooted_forest(spanning_forest(rest), roots).join(kept.select(movable("node"), "v"), "node", "left")
        own = F.coalesce("v", (F.col("size") == 1).cast("long"))
        tree = checkpoint(subtree_totals(tree, sums={"width": own}).select(*top.columns))
        top = checkpoint(tree.unionByName(top.join(tree.select(movable("node")), "node", "left_anti")))
    every = top.select("node", "parent", "width", F.lit(len(rounds)).alias("round"))
    for k, leaves in enumerate(rounds):
        every = every.unionByName(leaves.select("node", "parent", F.col("v").alias("width"), F.lit(k).alias("round")))
    # Children stand beside each other by id, trees by root: both are offsets among the rows of one parent.
    among = scanned(every, [F.asc_nulls_first("parent"), F.col("node")], sums={"upto": F.col("width")})
    among = checkpoint(among.withColumn("upto", F.col("upto") - F.col("width")))
    start = checkpoint(among.groupBy("parent").agg(F.min("upto").alias("start")))
    first = among.where(F.col("round") == len(rounds)).select(movable("node"), F.col("parent").alias("of"), "upto")
    first = first.join(start.withColumnRenamed("parent", "__of"), F.col("of").eqNullSafe(F.col("__of"))).select("node", (F.col("upto") - F.col("start")).alias("offset"))
    placed = along_tour(top.join(first, "node"), {"left": F.col("offset")}).select("node", "parent", "depth", "width", "left")
    out, parents = checkpoint(placed), None
    for k in range(len(rounds) - 1, -1, -1):
        new = out if parents is None else placed
        new = new.join(start.select(F.col("parent").alias("node"), "start"), "node").select(F.col("node").alias("parent"), "depth", (F.col("left") - F.col("start")).alias("from"))
        parents = checkpoint(new if parents is None else parents.unionByName(new))
        placed = among.where(F.col("round") == k).join(parents.select(movable("parent"), "depth", "from"), "parent")
        placed = placed.select("node", "parent", (F.col("depth") + 1).alias("depth"), "width", (F.col("from") + F.col("upto")).alias("left"))
        out = out.unionByName(placed)
    wide = top.where("parent IS NULL").agg(F.coalesce(F.sum("width"), F.lit(0)).alias("wide"))
    wide = checkpoint(wide)
    remove_path(edges.sparkSession, folder)
    lone = nodes.select("node").distinct().join(among.select(movable("node")), "node", "left_anti")
    out = out.select("node", "parent", "depth", "width", ((F.col("left") + F.col("width") / 2) * X_GAP).alias("x"), (F.col("depth") * Y_GAP).alias("y"))
    beside = scanned(lone, [F.col("node")], number="n").join(F.broadcast(wide))
    alone = beside.select("node", F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(1).cast("long").alias("width"), ((F.col("wide") + F.col("n") + 0.5) * X_GAP).alias("x"), F.lit(0.0).alias("y"))
    return out.unionByName(alone)
