"""Percentile roll-ups and issue buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators.ranks import rollup


def nearest_rank(value: str, percent: int) -> Column:
    """The nearest-rank percentile; 0 for no values."""
    return F.coalesce(F.expr(f"percentile_disc({percent / 100}) WITHIN GROUP (ORDER BY {value})"), F.lit(0.0)).cast("double")


def rollup_columns(value: str) -> list[Column]:
    """Average and the three percentiles of one value column, for groups of bounded size."""
    average = F.coalesce(F.avg(value), F.lit(0.0))
    return [F.round(average, 6).alias("avg"), *[F.round(nearest_rank(value, p), 6).alias(f"p{p}") for p in (50, 80, 90)]]


def unpivot(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Long form ``(keys, metric, value)``."""
    doubled = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics])
    return doubled.unpivot(list(keys), list(metrics), "metric", "value")


def package_rollups(files: DataFrame, metrics: Sequence[str], package: str = "package") -> DataFrame:
    """One row per package and metric: avg, p50, p80, p90 and the file count."""
    out = rollup(unpivot(files, [package], metrics), [package, "metric"], "value")
    return out.select(package, "metric", F.col("n").alias("n_files"), *[F.round(c, 6).alias(c) for c in ("avg", "p50", "p80", "p90")])


def size_band(p90: Column) -> Column:
    return F.when(p90 <= 200, "healthy").when(p90 <= 300, "fair").otherwise("poor")


def health_band(score: Column) -> Column:
    return F.when(score >= 80, "healthy").when(score >= 50, "fair").otherwise("poor")


def issue_buckets(items: DataFrame, rule_id: str = "rule_id", rule_name: str = "rule_name", status: str = "status", path: str = "path") -> DataFrame:
    """Weighted issues per path: total, security, ai, duplication, documentation.

    An item counts once a file, so ``items`` has one row per (item, file), repeated ones
    having been dropped by the caller; a failure weighs 2, any other non-pass 1.
    """
    text = F.lower(F.concat_ws(" ", rule_id, rule_name))
    weight = F.when(F.col(status) == "fail", 2).otherwise(1)
    hits = {
        "security": F.regexp_like(text, F.lit("security|xss|sql|secret|vuln|auth")),
        "ai": F.regexp_like(F.col(rule_id), F.lit("^(ai_|review_|arch_|clean_)")),
        "duplication": F.regexp_like(text, F.lit("dry|duplicat|maintainability")),
        "documentation": F.regexp_like(text, F.lit("comment|document|docstring")),
    }
    open_items = items.where(F.col(status) != "pass")
    sums = [F.sum(F.when(test, weight).otherwise(0)).cast("long").alias(name) for name, test in hits.items()]
    return open_items.groupBy(path).agg(F.sum(weight).cast("long").alias("total"), *sums)
