"""The cycle rule over several graphs, its labelled groups, and where a drawing shows them."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.paths import ancestors, immediate_child
from orrery.operators.graph import simple_edges, strong_components
from orrery.operators.ranks import top_k
from orrery.operators.reports import PATH_NODES, SAMPLE_GROUPS, component_walks
from orrery.session import checkpoint

#: What the graphs are called, the size from which a group is only previewed, the nodes of a preview.
KINDS = {"file_imports": "file imports", "package_imports": "package imports", "symbol_references": "symbol references"}
LARGE, PREVIEW = 12, 5
_GROUP = ("kind", "nodes", "path", "label", "node_count")


def cycle_label(name: Column, size: Column, nodes: Column, path: Column) -> Column:
    """One line a group: its path, or how many nodes it has and the first of them."""
    head = F.concat(F.lit("["), name, F.lit("] "))
    group = F.concat(head, F.lit("strongly connected group ("), size.cast("string"), F.lit(" files): "))
    preview = F.concat(group, F.array_join(F.slice(nodes, 1, PREVIEW), ", "), F.lit(" …"))
    return F.when(size > LARGE, preview).otherwise(F.concat(head, F.array_join(path, " → ")))


def cycle_groups(parts: DataFrame, edges: DataFrame, kind: str, sample: int = SAMPLE_GROUPS) -> DataFrame:
    """``(kind, nodes, path, label, node_count)`` of the first ``sample`` components by smallest member.

    ``parts(id, component, size)`` are the members of cyclic components.  At most ``PATH_NODES`` nodes, by id, and steps of a
    walk are listed; ``node_count`` is the size where nodes are left out, else null.
    """
    first = parts.select("component").distinct().orderBy("component").limit(sample)
    chosen = checkpoint(parts.join(F.broadcast(first), "component", "left_semi"))
    listed = top_k(chosen.select("component", "id"), ["component"], [F.col("id")], PATH_NODES).groupBy("component").agg(F.array_sort(F.collect_list("id")).alias("nodes"))
    met = component_walks(chosen, edges).join(listed, "component")
    label = cycle_label(F.lit(KINDS[kind]), F.col("size"), F.col("nodes"), F.col("path"))
    left_out = F.when(F.col("size") > PATH_NODES, F.col("size"))
    return met.select(F.lit(kind).alias("kind"), "nodes", F.slice("path", 1, PATH_NODES).alias("path"), label.alias("label"), left_out.cast("long").alias("node_count"))


def circular_rule(graphs: Mapping[str, tuple[DataFrame, DataFrame]], sample: int = SAMPLE_GROUPS) -> DataFrame:
    """One row (rule_id, rule_name, status, message, affected, cycle_groups) over ``{kind: (nodes, edges)}``, kinds of ``KINDS``.

    All groups are counted; each graph is sampled, then labels (sorted, distinct) and groups (files, packages, symbols)
    are cut to ``sample`` once more.  A group of files fails, any other warns.
    """
    totals, groups = [], []
    for rank, kind in enumerate(KINDS):
        if kind not in graphs:
            continue
        nodes, edges = graphs[kind]
        parts = checkpoint(strong_components(edges, nodes).where("cyclic").select("id", "component", "size"))
        totals.append(parts.agg(F.countDistinct("component").alias("n")))
        groups.append(cycle_groups(parts, simple_edges(edges, nodes), kind, sample).withColumn("rank", F.lit(rank)))
    total = reduce(DataFrame.unionByName, totals).agg(F.sum("n").alias("total"))
    rows = reduce(DataFrame.unionByName, groups)
    every = rows.agg(F.array_sort(F.collect_set("label")).alias("labels"), F.array_sort(F.collect_list(F.struct("rank", F.element_at("nodes", 1).alias("first"), *_GROUP))).alias("g"))
    shown = F.slice("g", 1, sample) if sample else F.slice("g", 1, 0)
    one = every.select(F.slice("labels", 1, sample).alias("affected"), F.transform(shown, lambda x: F.struct(*[x[c].alias(c) for c in _GROUP])).alias("cycle_groups")).join(total, F.lit(True))
    symbols = "symbol_references" in graphs and not graphs["symbol_references"][1].isEmpty()
    source = "import graph and LSP symbol references" if symbols else "import graph"
    status = F.when(F.col("total") == 0, "pass").when(F.exists("cycle_groups", lambda x: x["kind"] == "file_imports"), "fail").otherwise("warn")
    cut = F.when(F.col("total") > F.size("affected"), F.lit(" (list truncated)")).otherwise(F.lit(""))
    message = F.when(F.col("total") == 0, F.lit(f"No circular dependencies detected in {source}")).otherwise(F.concat(F.col("total").cast("string"), F.lit(" circular dependency group(s) found"), cut))
    return one.select(F.lit("circular_dependencies").alias("rule_id"), F.lit("Circular Dependencies").alias("rule_name"), status.alias("status"), message.alias("message"), "affected", "cycle_groups")


def parsed_labels(rows: DataFrame, label: str = "affected") -> DataFrame:
    """``rows`` plus ``kind``, ``nodes`` and ``path`` read from a label; other texts than labels go."""
    text = F.trim(F.col(label))
    name, body = F.lower(F.regexp_extract(text, r"^\[([^\]]+)\]\s+.+$", 1)), F.regexp_extract(text, r"^\[[^\]]+\]\s+(.+)$", 1)
    kind = F.when(F.contains(name, F.lit("package")), "package_imports").when(F.contains(name, F.lit("symbol")), "symbol_references").otherwise("file_imports")
    parts = lambda value, by: F.filter(F.transform(F.split(value, by), lambda x: F.trim(x)), lambda x: x != "")
    large = F.contains(body, F.lit("strongly connected group"))
    path = F.when(large, parts(F.regexp_extract(body, r":\s*(.+?)\s*…$", 1), ",")).otherwise(parts(body, "→"))
    found = rows.withColumns({"kind": kind, "path": path, "__large": large}).where((body != "") & (F.col("__large") | (F.size("path") > 0)))
    return found.withColumn("nodes", F.when(F.col("__large"), F.col("path")).otherwise(F.array_distinct("path"))).drop("__large")


def view_plan(groups: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """``(group_id, level, scope, node_ids, edge_keys)``: the view that shows each of ``groups(group_id, kind, nodes, path)``.

    Package cycles are shown among the packages, symbol cycles in the file of their first symbol, file
    cycles in their package if they lie in one that is not ``.``, else among the packages.  A member stands
    for itself where the view has it, else for the child or package above it; others are left out.  Edge keys
    follow the path, ``a->b``, and close it if it has over two nodes.  ``files(path, package)``, ``symbols(id, file)``.
    """
    members = F.when(F.size("nodes") > 0, F.col("nodes")).otherwise(F.col("path"))
    steps = F.when(F.size("path") >= 2, F.col("path")).otherwise(members)
    whole = groups.withColumns({"__members": members, "__steps": steps})
    each = whole.select("group_id", "kind", F.lit(0).alias("part"), F.posexplode("__members").alias("at", "entity")).unionByName(
        whole.select("group_id", "kind", F.lit(1).alias("part"), F.posexplode("__steps").alias("at", "entity"))
    )
    known = files.select("path", "package").dropDuplicates(["path"])
    owner = symbols.groupBy(F.col("id").alias("entity")).agg(F.min("file").alias("sfile"))
    each = each.join(owner, "entity", "left")
    each = each.withColumn("file", F.when(F.col("kind") == "symbol_references", F.col("sfile")).otherwise(F.col("entity")))
    each = each.join(known.withColumnRenamed("path", "file"), "file", "left")
    top = F.when(F.contains("file", F.lit("/")), F.split_part("file", F.lit("/"), F.lit(1))).otherwise(F.lit("."))
    each = checkpoint(each.withColumn("package", F.coalesce("package", top)))

    held = known.select("package").distinct().withColumn("held", F.lit(True))
    own = each.where("part = 0").groupBy("group_id", "kind").agg(F.min("package").alias("low"), F.max("package").alias("high"), F.min_by("sfile", "at").alias("first_file"))
    own = own.join(held.withColumnRenamed("package", "low"), "low", "left")
    inside = F.expr("kind = 'file_imports' AND low = high AND low <> '.' AND held")
    in_file = F.expr("kind = 'symbol_references' AND first_file IS NOT NULL")
    views = own.select("group_id", F.when(in_file, "file").when(inside, "package").otherwise("packages").alias("level"), F.when(in_file, F.col("first_file")).when(inside, F.col("low")).otherwise(F.lit(".")).alias("scope"))

    placed = each.join(views, "group_id").withColumn("key", F.monotonically_increasing_id())
    placed = checkpoint(placed)
    # At package level the child of the scope; among packages the package itself, else the longest one above.
    children = known.select(F.col("package").alias("scope"), immediate_child(F.col("path"), F.col("package")).alias("shown")).where("shown IS NOT NULL").distinct()
    in_package = placed.where("level = 'package'").withColumn("shown", immediate_child(F.col("entity"), F.col("scope"))).join(children, ["scope", "shown"], "left_semi")
    in_files = placed.where("level = 'file' AND sfile = scope").withColumn("shown", F.col("entity"))
    above = F.when(F.col("kind") == "file_imports", F.concat(F.array("package", "entity"), ancestors(F.col("entity")))).when(F.col("kind") == "package_imports", F.array("entity")).otherwise(F.array("package"))
    steps_up = placed.where("level = 'packages' AND (kind <> 'symbol_references' OR sfile IS NOT NULL)").select("*", F.posexplode(above).alias("up", "shown"))
    among = steps_up.join(held.withColumnRenamed("package", "shown"), "shown", "left_semi").groupBy("key").agg(F.min_by("shown", "up").alias("shown"))
    among = placed.join(among, "key")
    columns = ["group_id", "part", "at", "shown"]
    shown = in_package.select(columns).unionByName(in_files.select(columns)).unionByName(among.select(columns))
    ordered = lambda part: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == part, F.struct("at", "shown")))), lambda x: x["shown"]))
    lists = shown.groupBy("group_id").agg(ordered(0).alias("node_ids"), ordered(1).alias("walk"))
    out = views.join(lists, "group_id", "left").withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("node_ids", "walk")})
    n = F.size("walk")
    key = lambda a, b: F.concat(a, F.lit("->"), b)
    keys = F.transform(F.slice("walk", 2, F.greatest(n - 1, F.lit(0))), lambda x, i: key(F.get("walk", i), x))
    closing = F.when(n > 2, F.array(key(F.get("walk", n - 1), F.get("walk", F.lit(0))))).otherwise(F.array().cast("array<string>"))
    return out.select("group_id", "level", "scope", "node_ids", F.concat(keys, closing).alias("edge_keys"))
