"""Operators behind the views: edges by file, highlights, listings, verdicts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import paths as P

#: Bounds of a text search and hops of the automatic descent.
GREP_DEFAULT, GREP_MOST, HOPS = 50, 200, 8
#: Files that mark the root of a language.
MARKERS = {
    "typescript": ("tsconfig.json", "jsconfig.json", "package.json"),
    "rust": ("Cargo.toml",),
    "python": ("pyproject.toml", "setup.cfg", "setup.py"),
    "go": ("go.mod",),
    "java": ("pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts"),
}


def symbol_edge_files(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """``(source, target, source_file, target_file)``: edges of symbols with the files of both ends.

    A symbol id that several files hold counts for the greatest; edges with an unknown end go.
    """
    held = symbols.groupBy("id").agg(F.max("file").alias("file"))
    for end in ("source", "target"):
        edges = edges.join(held.select(F.col("id").alias(end), F.col("file").alias(f"{end}_file")), end)
    return edges.select("source", "target", "source_file", "target_file")


def coupling_counts(imports: DataFrame, placed: DataFrame) -> DataFrame:
    """``(path, internal_calls, cbo)`` from file imports and ``symbol_edge_files``.

    Calls inside a file are internal; the coupling of a file counts the distinct files it
    imports and those joined to it by a symbol edge in either direction.
    """
    inside = placed.where("source_file = target_file").groupBy(F.col("source_file").alias("path")).agg(F.count("*").alias("internal_calls"))
    across = placed.where("source_file <> target_file").select(F.col("source_file").alias("a"), F.col("target_file").alias("b")).distinct()
    pairs = across.unionByName(across.select(F.col("b").alias("a"), F.col("a").alias("b")))
    pairs = pairs.unionByName(imports.where("source <> target").select(F.col("source").alias("a"), F.col("target").alias("b"))).distinct()
    neighbours = pairs.groupBy(F.col("a").alias("path")).agg(F.count("*").alias("cbo"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return inside.join(neighbours, "path", "full_outer").select("path", zero("internal_calls"), zero("cbo"))


def highlighted(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges whose ends are both among ``ids(id)``."""
    for end in ("source", "target"):
        edges = edges.join(ids.select(F.col("id").alias(end)), end, "left_semi")
    return edges


def cell_violations(cells: DataFrame, violations: DataFrame) -> DataFrame:
    """``cells(source, target)`` plus ``violated``: a violation's ends are those of the cell, or end with them.

    The ends of ``violations(from, to)`` are all their suffixes on one side, so sources meet
    them in an equi-join, and targets are compared only where the sources fit.
    """
    ends = violations.select(F.col("from"), F.col("to").alias("__to")).where("length(from) > 0").distinct()
    suffix = F.explode(F.expr("transform(sequence(1, length(from)), i -> substring(from, i))"))
    places = cells.select("source", "target").distinct()
    hit = places.join(ends.select(suffix.alias("source"), "__to"), "source").where(F.endswith("__to", F.col("target")))
    hit = hit.select("source", "target", F.lit(True).alias("__hit")).distinct()
    return cells.join(hit, ["source", "target"], "left").select(*cells.columns, F.coalesce("__hit", F.lit(False)).alias("violated"))


def with_issues(files: DataFrame, issues: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``files(path, ...)`` with the issue ``columns`` of their path, 0 where there are none."""
    met = files.join(issues.select("path", *columns), "path", "left")
    return met.select(*files.columns, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in columns])


def bounding_box(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Smallest and greatest ``x`` and ``y``."""
    return points.groupBy(*keys).agg(*[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))])


def grep(lines: DataFrame, pattern: str, order: Sequence[str], limit: int | None = None) -> DataFrame:
    """The first matching ``line``s and ``truncated``, whether there are more; ``limit`` is kept within 1 and 200."""
    most = min(max(GREP_DEFAULT if limit is None else limit, 1), GREP_MOST)
    found = lines.where(F.regexp_like("line", F.lit(pattern))).orderBy(*order).limit(most + 1)
    ranked = found.withColumn("__k", F.row_number().over(Window.orderBy(*order)))  # at most 201 rows
    cut = ranked.withColumn("truncated", F.count("*").over(Window.partitionBy()) > most)
    return cut.where(F.col("__k") <= most).drop("__k")


def context(packages: DataFrame, files: DataFrame, items: DataFrame, top: tuple[int, int, int] = (40, 25, 20)) -> DataFrame:
    """``(part, name)`` of a review's context: first packages by name, largest files, first prior items."""
    named = packages.select("package").distinct().orderBy("package").limit(top[0]).select(F.lit("package").alias("part"), F.col("package").alias("name"))
    large = files.orderBy(F.desc("loc"), "path").limit(top[1]).select(F.lit("file").alias("part"), F.col("path").alias("name"))
    prior = items.orderBy("item").limit(top[2]).select(F.lit("item").alias("part"), F.col("item").cast("string").alias("name"))
    return named.unionByName(large).unionByName(prior)


def diagnostics_verdict(findings: DataFrame, warnings: bool = True, sample: int = 10) -> DataFrame:
    """One row ``(rule_id, status, message, affected)`` over ``(path, line, severity, source, message)``."""
    kept = findings.where(F.col("severity").isin("error", *(["warning"] if warnings else [])))
    entry = F.concat("path", F.lit(":"), F.col("line").cast("string"), F.lit(" — "), "message")
    counts = findings.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if((F.col("severity") == "warning") & F.lit(warnings)).alias("warned"), F.count("*").alias("n"))
    first = kept.select(entry.alias("e")).distinct().orderBy("e").limit(sample).agg(F.array_sort(F.collect_list("e")).alias("affected"))
    source = findings.where("severity = 'warning'").agg(F.min_by("source", F.struct("path", "line", "message")).alias("source"))
    number = lambda c: F.col(c).cast("string")
    message = (
        F.when(F.col("errors") > 0, F.concat(number("errors"), F.lit(" error(s), "), number("warned"), F.lit(" warning(s) from language servers")))
        .when(F.col("warned") > 0, F.concat(number("warned"), F.lit(" warning(s) from language servers ("), F.coalesce("source", F.lit("lsp")), F.lit(")")))
        .when(F.col("n") == 0, "No language-server diagnostics (servers missing or still indexing)")
        .otherwise("No errors or warnings from language servers")
    )
    one = counts.join(F.broadcast(first), F.lit(True)).join(F.broadcast(source), F.lit(True))  # one row each
    status = F.when(F.col("errors") > 0, "fail").when(F.col("warned") > 0, "warn").otherwise("pass")
    return one.select(F.lit("lsp_diagnostics").alias("rule_id"), status.alias("status"), message.alias("message"), "affected")


def manifest_edges(manifests: DataFrame) -> DataFrame:
    """Package edges from ``(package, line)`` of manifests: a line with ``file:`` that starts with a quoted name leads to it."""
    name = F.regexp_extract(F.trim("line"), r'^"([^"]*)"', 1)
    found = manifests.where(F.contains("line", F.lit("file:"))).select(F.col("package").alias("source"), F.regexp_replace(name, "^(file:)+", "").alias("target"), name.alias("__name"))
    return found.where("__name <> ''").select("source", P.normalize_path(F.col("target")).alias("target"), F.lit("manifest").alias("kind")).distinct()


def mention_edges(contents: DataFrame, packages: DataFrame, core: Sequence[str], kind: str = "wasm") -> DataFrame:
    """Edges from every package with a text that mentions one of the spellings of ``core`` to the first package of that name.

    ``contents(package, text)``, ``packages(package)``; no edges if there is no such package.
    """
    named = packages.where(F.contains("package", F.lit(core[0]))).agg(F.min("package").alias("target"))
    mentions = contents.where(F.exists(F.array(*map(F.lit, core)), lambda c: F.contains(F.col("text"), c))).select(F.col("package").alias("source")).distinct()
    return mentions.join(F.broadcast(named), F.lit(True)).where("target IS NOT NULL").select("source", "target", F.lit(kind).alias("kind"))


def reference_edges(symbols: DataFrame, references: DataFrame) -> DataFrame:
    """``(source, target, kind)`` from ``symbols(file, id, line)`` and ``references(file, id, line)``.

    A reference leads to the symbol on its line or else the nearest before it; references of
    a symbol's own line and to itself go.  Both sides are sorted together, nothing is paired.
    """
    from orrery.operators.joins import asof_backward

    own = symbols.groupBy("file", "id").agg(F.min("line").alias("own"))
    outside = references.join(own, ["file", "id"]).where("line <> own").select("file", "line", F.col("id").alias("source"))
    met = asof_backward(outside, symbols.select("file", "line", F.col("id").alias("target")), ["file"], "line", "target")
    return met.where("target IS NOT NULL AND target <> source").select("source", "target", F.lit("reference").alias("kind")).distinct()


def language_roots(files: DataFrame, markers: DataFrame) -> DataFrame:
    """``(path, language, root)``: the nearest directory at or above each file that holds a marker of its language.

    ``files(path)``, ``markers(path)``: marker files anywhere in the tree.  Without one the root is ``.``.
    """
    kinds = F.create_map(*[F.lit(x) for language, names in MARKERS.items() for n in names for x in (n, language)])
    held = markers.select(P.parent_dir(F.col("path")).alias("dir"), F.element_at(kinds, P.basename(F.col("path"))).alias("language")).where("language IS NOT NULL").distinct()
    known = files.select("path", P.language_of(F.col("path")).alias("language")).where(F.col("language").isin(*MARKERS))
    places = known.select("path", "language", F.explode(F.array_append(P.ancestors(F.col("path")), F.lit("."))).alias("dir"))
    depth = F.when(F.col("dir") == ".", 0).otherwise(F.length("dir"))
    found = places.join(held, ["dir", "language"]).groupBy("path", "language").agg(F.max_by("dir", depth).alias("root"))
    return known.join(found, ["path", "language"], "left").select("path", "language", F.coalesce("root", F.lit(".")).alias("root"))


def descend(folders: DataFrame) -> DataFrame:
    """``(id, end)``: where each folder leads while it holds exactly one folder and nothing else, at most eight steps.

    ``folders(id, parent, files, edges)`` has one row a folder.
    """
    children = folders.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n"), F.min("id").alias("only"))
    step = folders.where("files = 0 AND edges = 0").join(children.where("n = 1"), "id").select(F.col("id").alias("end"), F.col("only").alias("__next"))
    at = folders.select("id", F.col("id").alias("end"))
    for _ in range(HOPS):
        at = at.join(step, "end", "left").select("id", F.coalesce("__next", "end").alias("end"))
    return at


def suggested_layers(elements: DataFrame) -> DataFrame:
    """One ``layers`` rule from the (at most 150) elements ``(idx, id)`` in their order, the lowest first."""
    listed = elements.agg(F.array_sort(F.collect_list(F.struct("idx", "id"))).alias("e"))
    return listed.select(F.lit("layers").alias("kind"), F.transform("e", lambda x: x["id"]).alias("layers"), F.lit(True).alias("enabled"))


def circular_verdict(graphs: Mapping[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """One row over ``{kind: (nodes, edges)}``: cyclic groups by kind and in all, ``fail`` for cycles of files, else ``warn``."""
    from orrery.operators import graph, reports

    total = None
    for kind, (nodes, edges) in graphs.items():
        found = graph.strong_components(edges, nodes).where("cyclic").agg(F.countDistinct("component").alias(kind))
        total = found if total is None else total.join(F.broadcast(found), F.lit(True))  # one row each
    others = [F.col(k) for k in graphs if k != "file_imports"]
    files = F.col("file_imports") if "file_imports" in graphs else F.lit(0)
    status = reports.circular_status(files, sum(others, F.lit(0)))
    return total.select(*graphs, sum(map(F.col, graphs), F.lit(0)).cast("long").alias("groups"), status.alias("status"))


def run_rules(spark: SparkSession, wanted: Sequence[str], callables: Mapping[str, Callable[[], DataFrame]]) -> DataFrame:
    """``(rule_id, status, message)`` of the wanted rules by their callables; an unknown one passes as ``Unknown rule``."""
    parts = [callables[w]().select("rule_id", "status", "message") for w in wanted if w in callables]
    unknown = [(w, "pass", "Unknown rule") for w in wanted if w not in callables]
    out = spark.createDataFrame(unknown, "rule_id string, status string, message string")
    for part in parts:
        out = out.unionByName(part)
    return out


def value_of(store: DataFrame, key: str) -> DataFrame:
    """The row of one key."""
    return store.where(F.col("key") == key)


def trimmed_ids(*sources: tuple[DataFrame, str]) -> DataFrame:
    """Distinct trimmed ids of several ``(frame, column)``; blank ones go."""
    out = None
    for frame, column in sources:
        ids = frame.select(F.trim(F.col(column)).alias("id")).where("id <> ''")
        out = ids if out is None else out.unionByName(ids)
    return out.distinct()
