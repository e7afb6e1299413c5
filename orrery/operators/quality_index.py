"""The quality index: every metric of every file, and their roll-ups by package.

Text metrics are made in a file's row; symbols, edges, issues and fingerprints of lines are
aggregated to one small row a file before they meet it, so that texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import metrics as M
from orrery.functions import paths as P
from orrery.functions.display import documentation_score
from orrery.operators import rollups
from orrery.operators.components import connected_components
from orrery.operators.rules import with_companion
from orrery.operators.views import coupling_counts, symbol_edge_files
from orrery.session import checkpoint, movable

#: The names of the rolled-up metrics, with the column of a file that each is made of.
PACKAGE_METRICS = {
    "complexity": "cyclomatic", "halstead": "halstead_volume", "cognitive": "cognitive", "maintainability": "maintainability", "cbo": "cbo", "coverage": "coverage",
    "issues": "issue_density", "security": "security_density", "ai_quality": "ai_density", "duplication": "duplication_hits", "duplicated_code": "duplicated_pct",
    "nloc": "nloc", "cloc": "cloc", "code_density": "code_density", "comment_density": "comment_density", "dead_code": "dead_code_pct",
    "stale_decisions": "stale_density", "abc": "abc_magnitude", "cyclomatic_density": "cyclomatic_density", "cohesion": "cohesion", "size": "loc",
    "documentation": "documentation_score",
}
ISSUES = ("total", "security", "ai", "duplication", "documentation")


#: All columns of the index but path and package, in order.
COLUMNS = (
    "loc", "nloc", "cloc", "code_density", "comment_density", "cyclomatic", "halstead_volume", "halstead_difficulty", "cognitive", "maintainability", "dit",
    "abc_magnitude", "abc_assignments", "abc_branches", "abc_conditions", "cbo", "symbols", "coverage", "structural", "issue_density", "security_density", "ai_density",
    "duplication_hits", "duplicated_pct", "dead_code_pct", "stale_density", "cyclomatic_density", "cohesion", "documentation_score",
)
#: Columns that are one field of the classic metrics.
CLASSIC = {
    "cyclomatic": "cc", "halstead_volume": "vol", "halstead_difficulty": "diff", "cognitive": "cog", "maintainability": "mi", "dit": "dit", "abc_magnitude": "mag",
    "abc_assignments": "a", "abc_branches": "b", "abc_conditions": "c", "cyclomatic_density": "cc",
}


def duplicated_lines(prints: DataFrame) -> DataFrame:
    """``(path, duplicated)``, a row a line: lines of ``prints(path, print)`` whose fingerprint occurs at least twice anywhere."""
    shared = prints.groupBy("print").agg(F.count("*").alias("total")).where("total >= 2").select(movable("print"))
    return prints.join(shared, "print").select("path", F.lit(1).alias("duplicated"))


def dead_symbols(held: DataFrame, edges: DataFrame) -> DataFrame:
    """``(path, symbols, dead, kinds)``, a row a symbol of ``held(file, id, n)``: dead if no edge leads to it; a repeated symbol counts each time but is one kind."""
    reached = edges.select(F.col("target").alias("id"), F.lit(True).alias("reached")).distinct()
    return held.join(reached, "id", "left").select(F.col("file").alias("path"), F.col("n").alias("symbols"), F.when(F.col("reached").isNull(), F.col("n")).otherwise(0).alias("dead"), F.lit(1).alias("kinds"))


def merged_symbols(held: DataFrame, edges: DataFrame) -> DataFrame:
    """``(path, merged)``: how many parts fewer than symbols each file of ``held(file, id)`` has; only files with edges between their symbols."""
    ends = [held.select("file", F.col("id").alias(end), F.xxhash64("file", "id").alias(part)) for end, part in (("source", "a"), ("target", "b"))]
    inner = checkpoint(edges.join(ends[0], "source").join(ends[1], ["file", "target"]).select("file", "a", "b").distinct())
    nodes = inner.select("file", F.explode(F.array("a", "b")).alias("node")).distinct()
    parted = nodes.join(connected_components(inner, "a", "b"), "node")
    return parted.groupBy(F.col("file").alias("path")).agg((F.count("*") - F.countDistinct("component")).alias("merged"))


def _text_metrics(files: DataFrame, columns: Collection[str]) -> DataFrame:
    """``(path, package, loc, nloc, stale, ...)`` of the ``columns`` that follow from a file's text, and ``prints`` of its clone lines."""
    step = files.select("path", "package", F.coalesce("content", F.lit("")).alias("content")).withColumn("__lines", M.trimmed_lines(F.col("content")))
    clones = F.transform(M.clone_lines(F.col("content"), F.col("path"), F.col("__lines")), lambda norm: F.xxhash64(norm))
    step = step.withColumn("b", M.line_breakdown(F.col("content"), F.col("path"), F.col("__lines")))
    step = step.withColumn("prints", clones if "duplicated_pct" in columns else F.array().cast("array<bigint>")).drop("__lines")
    fields = [name for name in M.CLASSIC if name in {CLASSIC[c] for c in columns if c in CLASSIC}]
    step = step.withColumn("loc", F.col("b.loc"))
    step = M.with_classic_metrics(step, guard=False, fields=fields) if fields else step
    nloc, both = F.when(F.col("b.nloc") > 0, F.col("b.nloc")).otherwise(F.col("loc")), F.col("b.nloc") + F.col("b.cloc")
    share = lambda part, whole: F.when(whole == 0, 0.0).otherwise(100.0 * part / whole)
    made = {"cloc": F.col("b.cloc"), "code_density": share(F.col("b.nloc"), F.col("loc")), "comment_density": share(F.col("b.cloc"), both)}
    made |= {c: F.col(f"m.{name}").cast("double") if c in ("cyclomatic", "cognitive") else F.col(f"m.{name}") for c, name in CLASSIC.items() if c != "cyclomatic_density"}
    if "cyclomatic_density" in columns:
        made["cyclomatic_density"] = F.when(nloc == 0, 0.0).otherwise(F.col("m.cc").cast("double") / nloc)
    return step.select("path", "package", "loc", nloc.alias("nloc"), F.col("b.stale").alias("stale"), "prints", *[v.alias(c) for c, v in made.items() if c in columns])


def file_index(files: DataFrame, imports: DataFrame, symbols: DataFrame, edges: DataFrame, issues: DataFrame, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """One row of metrics, all or the wanted ``columns``, for every row of ``files(path, package, content)``; paths are distinct.

    ``imports(source, target)`` are files, ``symbols(id, file)`` and ``edges(source, target)`` symbols,
    ``issues(path, total, security, ai, duplication, documentation)`` the weighted issues of a file.
    What is missing counts as nothing: no symbols mean no dead code and full cohesion, no issues no
    density; ``documentation_score`` is null without hits.  An empty or null text has no lines.

    What nobody wants is not made, its tables are not read.  Symbols, imports, issues and cloned
    lines meet in one sum a file, and that sum meets the text metrics in the only join by path.
    """
    wants = lambda *names: any(n in columns for n in names)
    texts = checkpoint(_text_metrics(files, columns))
    parts: list[DataFrame] = []
    calls, own = wants("cbo", "structural"), wants("dead_code_pct", "cohesion")
    if calls or own:
        # Each is read several times and may be made from texts.
        held = checkpoint(symbols.groupBy("file", "id").agg(F.count("*").alias("n")))
        edges = checkpoint(edges.select("source", "target"))
        placed = checkpoint(symbol_edge_files(edges, held))
        parts.append(dead_symbols(held, edges))
    elif wants("symbols"):
        parts.append(symbols.select(F.col("file").alias("path"), F.lit(1).alias("symbols")))
    if wants("cohesion"):
        parts.append(merged_symbols(held, placed.where("source_file = target_file").select("source", "target")))
    if calls:
        imports = checkpoint(imports.select("source", "target").distinct())
        parts += [coupling_counts(imports, placed), imports.select(F.col("source").alias("path"), F.lit(1).alias("imports"))]
    if wants("duplicated_pct"):
        parts.append(duplicated_lines(texts.select("path", F.explode("prints").alias("print"))))
    if wants("issue_density", "security_density", "ai_density", "duplication_hits", "documentation_score"):
        parts.append(issues.select("path", *[F.col(c).alias(f"issue_{c}") for c in ISSUES]))
    if wants("coverage"):
        parts.append(with_companion(texts.select("path")).select("path", F.lit(1).alias("companions")))
    counts = ["symbols", "dead", "kinds", "merged", "internal_calls", "cbo", "imports", "duplicated", *[f"issue_{c}" for c in ISSUES], "companions"]
    met = texts.drop("prints")
    if parts:
        rows = reduce(lambda up, down: up.unionByName(down, allowMissingColumns=True), parts)
        met = met.join(rows.groupBy("path").agg(*[F.sum(c).cast("long").alias(c) for c in counts if c in rows.columns]), "path", "left")
    met = met.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) if c in met.columns else F.lit(0).cast("long") for c in counts})
    dense = lambda c: M.per_kloc(F.col(c).cast("double"), F.greatest("loc", F.lit(1)))
    per_line = lambda part: F.when(F.col("nloc") == 0, 0.0).otherwise(part / F.col("nloc"))
    made: dict[str, Column] = {
        "coverage": F.when(P.is_test_path(F.col("path")) | (F.col("companions") > 0), 100.0).otherwise(0.0),
        "structural": 1.0 + F.col("symbols") + F.col("internal_calls") + F.col("imports"),
        "issue_density": dense("issue_total"),
        "security_density": dense("issue_security"),
        "ai_density": dense("issue_ai"),
        "duplication_hits": F.col("issue_duplication").cast("double"),
        "duplicated_pct": F.least(F.lit(100.0), 100.0 * per_line(F.col("duplicated"))),
        "dead_code_pct": F.when(F.col("symbols") == 0, 0.0).otherwise(100.0 * F.col("dead") / F.col("symbols")),
        "stale_density": dense("stale"),
        "cohesion": M.cohesion(F.col("symbols"), F.col("kinds") - F.col("merged")),
        "documentation_score": documentation_score(F.col("issue_documentation")),
    }
    return met.select("path", "package", *[made[c].alias(c) if c in made else F.col(c) for c in columns])


def package_index(index: DataFrame) -> DataFrame:
    """``(package, metric, n_files, avg, p50, p80, p90)`` of ``file_index``; files without a documentation score are left out of it."""
    wide = index.select("package", *[F.col(c).alias(name) for name, c in PACKAGE_METRICS.items()])
    return rollups.package_rollups(wide, list(PACKAGE_METRICS))


def package_totals(index: DataFrame) -> DataFrame:
    """``(package, file_count, total_loc, total_nloc, total_cloc)``."""
    return index.groupBy("package").agg(F.count("*").alias("file_count"), *[F.sum(c).cast("long").alias(f"total_{c}") for c in ("loc", "nloc", "cloc")])
