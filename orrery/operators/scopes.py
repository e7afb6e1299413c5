"""Scope graphs, package graphs and navigation over files and file imports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.paths import ancestors, basename, once, package_label
from orrery.operators.graph import MAX_ELEMENTS, degrees
from orrery.operators.views import manifest_edges, mention_edges


def package_edges(files: DataFrame, imports: DataFrame) -> DataFrame:
    """Distinct ``(source, target)`` between the packages of importing and imported files."""
    a = files.select(F.col("path").alias("source"), F.col("package").alias("sp"))
    b = files.select(F.col("path").alias("target"), F.col("package").alias("tp"))
    return imports.join(a, "source").join(b, "target").where("sp <> tp").select(F.col("sp").alias("source"), F.col("tp").alias("target")).distinct()


def _chain_of(path: str) -> Column:
    """Structs (scope, child, leaf) of every folder above the path in column ``path``."""
    chain = F.concat(F.array(path), ancestors(F.col(path)), F.array(F.lit(".")))
    steps = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.struct(F.get(c, i).alias("scope"), F.get(c, i - 1).alias("child"), (i == 1).alias("leaf")))
    return once(chain, steps)


def _steps(files: DataFrame) -> DataFrame:
    """``(path, loc, scope, child, kind)``: every folder above a file, and what stands for the file in it."""
    return files.select("path", "loc", F.explode(_chain_of("path")).alias("s")).select("path", "loc", "s.scope", "s.child", F.when(F.col("s.leaf"), "file").otherwise("package").alias("kind"))


def scope_nodes(files: DataFrame) -> DataFrame:
    """``(scope, id, label, loc, kind)``: files and sub-folders right below every folder, with summed lines."""
    out = _steps(files).groupBy("scope", F.col("child").alias("id"), "kind").agg(F.sum("loc").cast("long").alias("loc"))
    return out.select("scope", "id", package_label(F.col("id")).alias("label"), "loc", "kind")


def scope_edges(files: DataFrame, imports: DataFrame) -> DataFrame:
    """``(scope, source, target)``: imports between different children of a folder.

    The folders above both ends meet in the import's row; files are only asked whether they are there.
    """
    paths = files.select("path")
    known = imports.select("source", "target").join(paths.toDF("source"), "source", "left_semi").join(paths.toDF("target"), "target", "left_semi")

    def met(ends: Column) -> Column:
        apart = lambda x: F.filter(ends["b"], lambda y: (y["scope"] == x["scope"]) & (y["child"] != x["child"]))
        edge = lambda x: F.transform(apart(x), lambda y: F.struct(x["scope"].alias("scope"), x["child"].alias("source"), y["child"].alias("target")))
        return F.flatten(F.transform(ends["a"], edge))

    both = F.struct(_chain_of("source").alias("a"), _chain_of("target").alias("b"))
    return known.select(F.explode(once(both, met)).alias("s")).select("s.*").distinct()


def scope_peers(files: DataFrame, imports: DataFrame) -> DataFrame:
    """``(scope, source, target)``: imports that leave a folder, towards the folder beside it that holds the target.

    The target is named by the child of the nearest common folder.
    """
    steps = _steps(files)
    a = steps.where("scope <> '.'").select(F.col("path").alias("source"), "scope", F.col("child").alias("sc"))
    out = imports.join(a, "source").where(~F.startswith("target", F.concat("scope", F.lit("/"))))
    parts, other = F.split("scope", "/"), F.split("target", "/")
    shared = F.size(F.filter(F.sequence(F.lit(1), F.size(parts)), lambda n: F.slice(parts, F.lit(1), n) == F.slice(other, F.lit(1), n)))
    return out.select("scope", F.col("sc").alias("source"), F.array_join(F.slice(other, F.lit(1), shared + 1), "/").alias("target")).distinct()


def navigation(files: DataFrame, imports: DataFrame, symbols: DataFrame, level: str, scope: str = ".", symbol_edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one view: ``packages``, the files of a ``package``, or the symbols of a ``file``.

    A file's edges are those of ``symbol_edges(source, target)`` with both ends in it; a symbol
    that refers to itself has one, and without a table there are none.
    """
    if level == "packages":
        nodes = files.groupBy(F.col("package").alias("id")).agg(F.sum("loc").cast("long").alias("loc"))
        return nodes, package_edges(files, imports)
    if level == "package":
        inside = files.where(F.col("package") == scope)
        own = inside.select("path")
        edges = imports.join(own.withColumnRenamed("path", "source"), "source", "left_semi").join(own.withColumnRenamed("path", "target"), "target", "left_semi")
        return inside.select(F.col("path").alias("id"), "loc"), edges.select("source", "target").distinct()
    found = symbols.where(F.col("file") == scope).select("id").distinct()
    known = imports.where(F.lit(False)) if symbol_edges is None else symbol_edges
    for end in ("source", "target"):
        known = known.join(found.withColumnRenamed("id", end), end, "left_semi")
    return found.withColumn("loc", F.lit(0).cast("long")), known.select("source", "target").distinct()


def package_graph(files: DataFrame, imports: DataFrame, manifests: DataFrame, contents: DataFrame, core: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(id, label, loc, kind)`` and edges ``(source, target, kind)`` of all packages.

    Edges come from ``manifests(package, line)``, from imports between files, and from texts
    (``contents(package, text)``) that mention a spelling of ``core``.  A pair of packages has
    one edge, of the first of these kinds that has it.
    """
    nodes = files.groupBy(F.col("package").alias("id")).agg(F.sum("loc").cast("long").alias("loc"))
    found = [
        manifest_edges(manifests),
        package_edges(files, imports).withColumn("kind", F.lit("import")),
        mention_edges(contents, nodes.select(F.col("id").alias("package")), core),
    ]
    edges = reduce(DataFrame.unionByName, [e.withColumn("rank", F.lit(k)) for k, e in enumerate(found)])
    best = edges.groupBy("source", "target").agg(F.min_by("kind", "rank").alias("kind"))
    return nodes.select("id", package_label(F.col("id")).alias("label"), "loc", F.lit("package").alias("kind")), best


def matrix_scope(files: DataFrame, imports: DataFrame, edges: DataFrame, level: str = "package", scope: str | None = None) -> tuple[DataFrame, DataFrame, bool]:
    """Elements ``(id, label, group)`` and edges ``(source, target)`` of a dependency matrix, and whether it was cut.

    * ``package`` without a scope: the packages and their ``edges(source, target)``, without groups.
    * ``package`` with a scope, or where there is one package: the children of that folder (of the
      first package, ``.`` without any), grouped under it.
    * ``file``: the files of the package ``scope`` or all, grouped by package; beyond
      ``MAX_ELEMENTS`` those with most imports in either direction, over all files, ties to the smaller path.

    ``files(path, package, loc)``, ``imports(source, target)``.  An unknown scope has no elements.
    """
    if level == "file":
        nodes = files.where(F.col("package") == scope) if scope is not None else files
        nodes = nodes.select(F.col("path").alias("id"), basename(F.col("path")).alias("label"), F.col("package").alias("group")).distinct()
        if cut := nodes.limit(MAX_ELEMENTS + 1).count() > MAX_ELEMENTS:
            most = degrees(imports, nodes).select("id", (F.col("out_degree") + F.col("in_degree")).alias("n"))
            nodes = nodes.join(most, "id").orderBy(F.desc("n"), "id").limit(MAX_ELEMENTS).drop("n")
        return nodes, between(imports, nodes), cut
    packages = [r["package"] for r in files.select("package").distinct().orderBy("package").limit(2).collect()]
    if scope is None and len(packages) > 1:
        nodes = files.select(F.col("package").alias("id"), package_label(F.col("package")).alias("label"), F.lit(None).cast("string").alias("group")).distinct()
        return nodes, between(edges, nodes), False
    at = scope or (packages or ["."])[0]
    nodes = scope_nodes(files).where(F.col("scope") == at).select("id", "label", F.col("scope").alias("group"))
    return nodes, between(scope_edges(files, imports).where(F.col("scope") == at), nodes), False


def between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ``(source, target)`` whose two ends are different ones of ``nodes(id)``, as often as they occur."""
    ids = nodes.select("id").distinct()
    inside = edges.where("source <> target").join(ids.toDF("source"), "source", "left_semi").join(ids.toDF("target"), "target", "left_semi")
    return inside.select("source", "target")


def from_graph(nodes: DataFrame) -> DataFrame:
    """``files(path, label, loc, package)`` of graph nodes: the first path segment is the package."""
    top = F.when(F.contains("path", F.lit("/")), F.split_part("path", F.lit("/"), F.lit(1))).otherwise(F.lit("."))
    return nodes.select("path", "label", "loc", top.alias("package"))
