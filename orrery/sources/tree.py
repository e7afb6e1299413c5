"""Source trees, contents and listings read with Spark's own readers, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.metrics import lines_of
from orrery.functions.paths import basename, parent_dir

#: Extensions that are scanned, folders that are skipped.
EXTENSIONS = ("ts", "tsx", "js", "jsx", "rs", "py", "go", "java")
SKIPPED = ("node_modules", "target", "dist", "build", "out", "vendor", "coverage", "venv", "env", "__pycache__", "bin", "obj", "pkg", "tmp", "temp", "third_party")


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """``(path, loc, content)`` of the source files below ``root``; unreadable text has no lines."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}").load(root)
    base = root.split("://", 1)[-1].rstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), f"^.*?{base}/", "")
    folders = F.slice(F.split(rel, "/"), F.lit(1), F.size(F.split(rel, "/")) - 1)
    hidden = F.exists(folders, _hidden_folder)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    kept = files.select(rel.alias("path"), text.alias("content"), hidden.alias("hidden")).where("NOT hidden")
    return kept.select("path", F.coalesce(F.size(lines_of(F.col("content"))), F.lit(0)).alias("loc"), "content")


def contents(tree: DataFrame) -> DataFrame:
    """``(path, content)`` without files that are no UTF-8."""
    return tree.where("content IS NOT NULL").select("path", "content")


def _manifests(files: DataFrame) -> DataFrame:
    """``(package, name, lib)`` of every manifest that makes a package."""
    kind = basename(F.col("path"))
    found = files.where((kind == "package.json") | ((kind == "Cargo.toml") & F.contains("content", F.lit("[package]"))))
    section = lambda name: F.regexp_extract("content", rf"(?s)(?:^|\n)\s*\[{name}\][^\n]*\n(.*?)(?=\n\s*\[|\z)", 1)
    toml = lambda name: F.regexp_extract(section(name), r'(?m)^\s*name\s*=\s*"([^"]*)"', 1)
    name = F.when(kind == "Cargo.toml", toml("package")).otherwise(F.regexp_extract("content", r'"name"\s*:\s*"([^"]*)"', 1))
    return found.select(parent_dir(F.col("path")).alias("package"), name.alias("name"), F.when(kind == "Cargo.toml", toml("lib")).alias("lib"))


def package_roots(files: DataFrame) -> DataFrame:
    """``(package, name)``: folders with a package.json or a Cargo.toml that has ``[package]``; ``.`` if there is none."""
    found = _manifests(files).groupBy("package").agg(F.min("name").alias("name"))
    return found if not found.isEmpty() else files.sparkSession.createDataFrame([(".", "")], "package string, name string")


def package_names(files: DataFrame) -> DataFrame:
    """``(name, package)``: what imports may call a package by: its name, the name with ``_`` for ``-``, and that of its ``[lib]``.

    Of several folders that claim a name the smallest has it; manifests without a name have none.
    """
    spelt = F.explode(F.array_distinct(F.array_compact(F.array("name", F.replace("name", F.lit("-"), F.lit("_")), "lib"))))
    return _manifests(files).select("package", spelt.alias("name")).where("name <> ''").groupBy("name").agg(F.min("package").alias("package"))


def _hidden_folder(name: Column) -> Column:
    return F.startswith(name, F.lit(".")) | name.isin(*SKIPPED)


def list_folder(paths: DataFrame, folder: str = ".") -> DataFrame:
    """``(name, kind, has_children)`` right below a folder: folders first, then by lower-cased name.

    Hidden files, and folders that are hidden or skipped, are not listed; ``has_children`` says whether
    a folder holds anything that would be.  A path that ends in ``/`` is an empty folder.  A folder
    outside the root is an error.
    """
    if ".." in folder.split("/") or folder.startswith("/"):
        raise ValueError(f"the folder {folder} is outside the root")
    prefix = "" if folder in ("", ".") else folder.rstrip("/") + "/"
    parts = F.split(F.substr("path", F.lit(len(prefix) + 1)), "/")
    below = paths.where(F.startswith("path", F.lit(prefix))).select(parts.alias("p"))
    listed = lambda at: (F.get("p", F.lit(at)) != "") & F.when(F.size("p") > at + 1, ~_hidden_folder(F.get("p", F.lit(at)))).otherwise(~F.startswith(F.get("p", F.lit(at)), F.lit(".")))
    kind = F.when(F.size("p") > 1, "directory").otherwise("file")
    rows = below.where(listed(0)).groupBy(F.get("p", F.lit(0)).alias("name"), kind.alias("kind"))
    found = rows.agg(F.max((F.size("p") > 1) & F.coalesce(listed(1), F.lit(False))).alias("has_children"))
    return found.orderBy(F.col("kind") != "directory", F.lower("name"), "name")


def persist_result(df: DataFrame, path: str, project: str) -> None:
    """Write a project's rows below its hash, replacing what was there."""
    hashed = df.withColumn("project_hash", F.lower(F.hex(F.xxhash64(F.lit(project)))))
    hashed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_hash").parquet(path)


def read_result(spark: SparkSession, path: str, project: str) -> DataFrame:
    key = F.lower(F.hex(F.xxhash64(F.lit(project))))
    return spark.read.option("partitionColumnTypeInference", "false").parquet(path).where(F.col("project_hash").cast("string") == key).drop("project_hash")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph kept as one JSON document ``{"nodes": [...], "edges": [...]}``."""
    nodes = "array<struct<id:string,label:string,path:string,loc:int,kind:string,line:int>>"
    whole = spark.read.schema(f"nodes {nodes}, edges array<struct<source:string,target:string,kind:string>>").json(path, multiLine=True)
    return whole.select(F.explode("nodes").alias("n")).select("n.*"), whole.select(F.explode("edges").alias("e")).select("e.*")


def document_symbols(values: DataFrame) -> DataFrame:
    """``(path, label, kind, line, depth)`` of nested symbol lists ``(path, value)``, level by level until none is left."""
    kinds = {5: "class", 6: "method", 8: "field", 10: "enum", 11: "interface", 12: "function", 13: "variable", 14: "constant", 23: "struct", 26: "type"}
    named = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    get = lambda at, kind: F.try_variant_get("s", at, kind)
    listed = lambda v: F.explode(F.try_variant_get(v, "$", "array<variant>")).alias("s")
    level, out, depth = values.select("path", listed(F.try_parse_json("value"))), None, 0
    while out is None or not level.isEmpty():
        kind = F.coalesce(F.element_at(named, get("$.kind", "int")), F.lit("symbol"))
        rows = level.select("path", get("$.name", "string").alias("label"), kind.alias("kind"), (get("$.range.start.line", "int") + 1).alias("line"), F.lit(depth).alias("depth"))
        out = rows if out is None else out.unionByName(rows)
        level, depth = level.select("path", listed(get("$.children", "variant"))), depth + 1
    return out
