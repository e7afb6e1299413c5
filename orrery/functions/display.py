"""Scalars for browsing graphs and verdicts, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.functions import paths as P
from orrery.operators.reports import split_location

#: Display classes of node kinds.
KIND_CLASSES = {
    "package": "package", "folder": "package", "file": "file", "module": "file", "class": "class", "struct": "class",
    "interface": "interface", "trait": "interface", "type": "interface", "function": "function", "method": "function",
    "enum": "enum", "const": "const", "constant": "const", "variable": "const",
}
#: Healthy and fair limits of the detail view, by metric and direction.
BANDS = {
    "complexity": ("lower", 10, 25),
    "cyclomaticDensity": ("lower", 0.15, 0.35),
    "abc": ("lower", 20, 60),
    "halstead": ("lower", 500, 2000),
    "cognitive": ("lower", 15, 30),
    "maintainability": ("higher", 65, 40),
    "dit": ("lower", 2, 4),
    "cbo": ("lower", 5, 12),
    "cohesion": ("higher", 70, 40),
    "churn": ("lower", 100, 400),
    "ccp": ("lower", 15, 35),
    "security": ("lower", 0, 2),
    "duplication": ("lower", 0, 1),
    "duplicatedCode": ("lower", 5, 20),
    "deadCode": ("lower", 10, 40),
    "staleDecisions": ("lower", 1, 8),
    "issues": ("lower", 2, 10),
    "aiQuality": ("lower", 0, 3),
    "cloc": ("higher", 5, 1),
    "codeDensity": ("higher", 60, 40),
    "commentDensity": ("higher", 10, 3),
    "coverage": ("higher", 100, 100),
}
#: Bands of packages that differ from those of files.
PACKAGE_BANDS = {"coverage": ("higher", 80, 50)}


def node_class(kind: Column) -> Column:
    """One of seven display classes; unknown kinds are symbols."""
    table = F.create_map(*[F.lit(x) for pair in KIND_CLASSES.items() for x in pair])
    return F.coalesce(F.element_at(table, kind), F.lit("symbol"))


def openable_node(kind: Column, path: Column, node_id: Column, line: Column) -> Column:
    """Struct (path, line) of the source that a node opens; null for packages, folders and nodes without a path."""
    low = F.lower(F.coalesce(kind, F.lit("")))
    whole = low.isin("file", "module")
    target = F.trim(F.when(whole & (F.coalesce(path, F.lit("")) == ""), node_id).otherwise(path))
    opened = F.struct(target.alias("path"), F.when(~whole & (line > 0), line).alias("line"))
    return F.when(~low.isin("package", "folder") & (target != ""), opened)


def openable_path(path: Column, kind: Column) -> Column:
    """The trimmed path if it is a file's; by its extension where the kind says nothing."""
    low, target = F.lower(F.coalesce(kind, F.lit(""))), F.trim(path)
    is_file = low.isin("file", "module") | (~low.isin("package", "folder") & F.regexp_like(target, F.lit(r"\.[A-Za-z0-9]+$")))
    return F.when((target != "") & is_file, target)


def shows_languages(languages: Column, flags: Mapping[str, bool]) -> Column:
    """Whether a node with an array of ``languages`` passes the filter; without any, the flag ``other`` decides."""
    if all(flags.values()):
        return F.lit(True)
    wanted = F.array(*[F.lit(k) for k, on in flags.items() if on]).cast("array<string>")
    known = F.coalesce(F.size(languages), F.lit(0)) > 0
    return F.when(known, F.arrays_overlap(languages, wanted)).otherwise(F.lit(flags.get("other", False)))


def tool_language(path: Column, tool: str) -> Column:
    """Language that the linters (``lint``) or language servers (``lsp``) see in a file; linters know no Java."""
    seen = ("typescript", "rust", "python", "go", *(["java"] if tool == "lsp" else []))
    return P.once(P.language_of(path), lambda found: F.when(found.isin(*seen), found))


def affected_entry(raw: Column) -> Column:
    """Struct (file, line, severity, message) of an affected entry.

    Forms: ``path:line:column: message``, ``path[:line] — [severity] message``, a bare place,
    or a text that names no file, which is its own message.
    """
    text = F.trim(raw)
    looks = lambda c: F.contains(c, F.lit("/")) | F.regexp_like(c, F.lit(r"\.[A-Za-z0-9]+$"))
    compiler, dashed = r"(?s)^(.+?):(\d+):(\d+):\s*(.+)$", r"(?s)^(.+?)\s+[—–]\s+(?:\[(\w+)\]\s+)?(.+)$"
    part = lambda rule, n: F.nullif(F.regexp_extract(text, rule, n), F.lit(""))
    left, whole = split_location(part(dashed, 1)), split_location(text)
    entry = lambda file, line, severity, message: F.struct(
        file.alias("file"), line.cast("int").alias("line"), severity.cast("string").alias("severity"), message.alias("message")
    )
    none = F.lit(None).cast("string")
    return (
        F.when(looks(part(compiler, 1)), entry(split_location(part(compiler, 1))["path"], part(compiler, 2), none, F.trim(part(compiler, 4))))
        .when(looks(left["path"]), entry(left["path"], left["first"], part(dashed, 2), F.trim(part(dashed, 3))))
        .when(looks(whole["path"]), entry(whole["path"], whole["first"], none, none))
        .otherwise(entry(text, F.lit(None), none, F.nullif(text, F.lit(""))))
    )


def merged_settings(defaults: Column, saved: Column) -> Column:
    """A map of defaults, overlaid by what was saved."""
    return F.map_zip_with(defaults, F.coalesce(saved, F.create_map().cast("map<string,string>")), lambda k, d, s: F.coalesce(s, d))


def documentation_score(hits: Column) -> Column:
    """100 less 25 a hit, at least 0; null without hits."""
    return F.when(hits > 0, F.greatest(F.lit(0.0), 100.0 - 25.0 * hits))


def metric_band(metric: str, value: Column) -> Column:
    """``healthy``, ``fair`` or ``poor`` in the detail view of a file; ``unknown`` for null."""
    return _band(BANDS[metric], value)


def package_band(metric: str, p50: Column, p90: Column) -> Column:
    """The band of a package: metrics where less is better are judged by p90, others by p50."""
    limits = PACKAGE_BANDS.get(metric, BANDS[metric])
    return _band(limits, p90 if limits[0] == "lower" else p50)


def _band(limits: tuple[str, float, float], value: Column) -> Column:
    direction, healthy, fair = limits
    within = (lambda limit: value <= limit) if direction == "lower" else (lambda limit: value >= limit)
    return F.when(value.isNull() | F.isnan(value.cast("double")), "unknown").when(within(healthy), "healthy").when(within(fair), "fair").otherwise("poor")


def grouped_number(value: Column, digits: int = 0) -> Column:
    """The number with thousands separated by commas."""
    return F.format_number(value, digits)


def newest_version(versions: Column) -> Column:
    """The greatest ``major.minor.patch`` of an array, by number; others are left out."""
    good = F.filter(versions, lambda v: F.regexp_like(v, F.lit(r"^\d+\.\d+\.\d+$")))
    ranked = F.transform(good, lambda v: F.struct(F.transform(F.split(v, "\\."), lambda x: x.cast("int")).alias("key"), v.alias("version")))
    return F.array_max(ranked)["version"]


def without_words(names: Column, words: Sequence[str]) -> Column:
    """The names of an array that hold none of the words, in any case."""
    return F.filter(names, lambda n: ~F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(n), w)))
