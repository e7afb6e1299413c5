"""Rules over files and edges, each one verdict per rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import paths as P

#: Sample limit of untested files and the number that starts a warning.
UNTESTED_SAMPLE, UNTESTED_WARN = 10, 3


def _stem(path: Column) -> Column:
    return F.regexp_replace(P.basename(path), r"\.[^.]*$", "")


#: What the companion test of a file adds to its path without an extension.
COMPANIONS = (".test.ts", ".spec.ts", ".test.tsx", ".spec.tsx", ".test.js", "_test.go", "_test.py")


def with_companion_test(files: DataFrame) -> DataFrame:
    """``files`` plus ``covered``: a test itself, or one of nine companion names exists.

    """
    found = with_companion(files).withColumn("__found", F.lit(True))
    covered = P.is_test_path(F.col("path")) | F.coalesce("__found", F.lit(False))
    return files.join(found, "path", "left").withColumn("covered", covered).drop("__found")


def with_companion(files: DataFrame) -> DataFrame:
    """``(path)`` of ``files`` that have one of nine companions, each once.

    Files that may be companions, few of all, say what they are companions of; a file asks by
    its own name, twice, and not by all nine.
    """
    path = F.col("path")
    own = F.concat(P.parent_dir(path), F.lit("/"), _stem(path))
    beside = [F.when(F.endswith(path, F.lit(end)), F.left(path, F.length(path) - len(end))) for end in COMPANIONS]
    below = F.when(F.regexp_like(path, F.lit(r"(?s)\A.*/__tests__/[^/]*\.ts\z")), F.regexp_replace(path, r"(?s)\A(.*)/__tests__/([^/]*)\.ts\z", "$1/$2"))
    rust = F.when(F.regexp_like(path, F.lit(r"(?s)\Atests/[^/]*\.rs\z")), F.concat(F.lit("*"), F.regexp_extract(path, r"(?s)\Atests/([^/]*)\.rs\z", 1)))
    held = files.select(F.explode(F.array_compact(F.array(*[F.concat(F.lit("/"), c) for c in (*beside, below)], rust))).alias("of")).distinct()
    # A name without its folder stands behind a star, so it is no path of another kind.
    wanted = files.select("path", F.explode(F.array(F.concat(F.lit("/"), own), F.concat(F.lit("*"), _stem(path)))).alias("of"))
    return wanted.join(held, "of", "left_semi").select("path").distinct()


def untested(files: DataFrame) -> DataFrame:
    """Files without ``test`` or ``spec`` in their name and without any of six test files."""
    plain = files.where(~F.regexp_like(F.lower(P.basename(F.col("path"))), F.lit("test|spec"))).select("path")
    d, s = P.parent_dir(F.col("path")), _stem(F.col("path"))
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    names = [join(d, f"/{sub}/", s, ".test.ts") for sub in ("test", "tests", "__tests__")] + [join(d, "/", s, ".test.ts"), join(d, "/", s, ".spec.ts"), join("tests/", s, ".rs")]
    wanted = plain.select("path", F.explode(F.array(*names)).alias("candidate"))
    tested = wanted.join(files.select(F.col("path").alias("candidate")), "candidate", "left_semi").select("path").distinct()
    return plain.join(tested, "path", "left_anti")


def file_rules(files: DataFrame, modularity: int = 200, file_size: int = 300, depth: int = 4) -> DataFrame:
    """``(rule_id, hits, status)`` of six rules over ``(path, loc)``.

    The untested sample is cut to ten before it is compared with the limit, so that rule's
    count saturates; that is its definition.
    """
    name, path = P.basename(F.col("path")), F.col("path")
    tests = {
        "modularity": (F.col("loc") > modularity, "warn"),
        "file_size": (F.col("loc") > file_size, "fail"),
        "dependency_depth": (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))) > depth, "warn"),
        "naming": (F.contains(name, F.lit(" ")) | (F.regexp_like(name, F.lit("[A-Z]")) & F.contains(name, F.lit("."))), "warn"),
        "type_coverage": (F.regexp_like(path, F.lit(r"\.jsx?$")), "warn"),
    }
    counts = files.agg(*[F.count_if(test).alias(rule) for rule, (test, _) in tests.items()])
    long = counts.unpivot([], list(tests), "rule_id", "hits")
    bad = F.lit("warn")
    for rule, (_, verdict) in tests.items():
        bad = F.when(F.col("rule_id") == rule, F.lit(verdict)).otherwise(bad)
    few = untested(files).limit(UNTESTED_SAMPLE).agg(F.count("*").alias("n"))
    cover = few.select(F.lit("test_coverage").alias("rule_id"), F.when(F.col("n") > UNTESTED_WARN, F.col("n")).otherwise(F.lit(0)).cast("long").alias("hits"))
    return long.unionByName(cover).select("rule_id", "hits", F.when(F.col("hits") == 0, "pass").otherwise(bad).alias("status"))


def layer_violations(edges: DataFrame, layers: Sequence[str], rule_id: str = "layers") -> DataFrame:
    """Edges from an earlier layer to a later one; ``layers`` go from the foundation up, names match whole ids.

    Fewer than two layers check nothing.
    """
    spark = edges.sparkSession
    ranks = spark.createDataFrame([(n, k) for k, n in enumerate(layers)] if len(layers) > 1 else [], "layer string, rank int")
    ranks = F.broadcast(ranks.groupBy("layer").agg(F.max("rank").alias("rank")))
    a, b = ranks.select(F.col("layer").alias("source"), F.col("rank").alias("si")), ranks.select(F.col("layer").alias("target"), F.col("rank").alias("ti"))
    return edges.join(a, "source").join(b, "target").where("si < ti").select(F.lit(rule_id).alias("rule_id"), "source", "target")


def forbid_violations(edges: DataFrame, forbidden: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Edges that fit a rule ``(rule_id, from, to)``: equal, below it as a path, or ``.`` for all.

    The rules are a short constant list, so each edge is tested in its row.
    """
    if not forbidden:
        return edges.select(F.lit("").alias("rule_id"), "source", "target").limit(0)
    hits = [
        F.when(P.matches_target(F.col("source"), F.lit(a)) & P.matches_target(F.col("target"), F.lit(b)), F.lit(rule)) for rule, a, b in forbidden
    ]
    found = edges.select("source", "target", F.explode(F.array_compact(F.array(*hits))).alias("rule_id"))
    return found.select("rule_id", "source", "target")


def conformance_status(violations: Column) -> Column:
    return F.when(violations == 0, "pass").when(violations <= 5, "warn").otherwise("fail")
