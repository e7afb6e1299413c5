"""Ratings: peer scores, absolute scores, weighted means, score history."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.paths import round_half_up
from orrery.operators.ranks import running_counts, top_k
from orrery.session import checkpoint

#: Fixed value: snapshots a project keeps.
HISTORY = 60


class Metric(NamedTuple):
    metric: str
    direction: str
    weight: float
    healthy: float
    fair: float


#: Direction, weight and thresholds of the metrics.
METRICS = (
    Metric("complexity", "lower", 1.1, 10.0, 25.0),
    Metric("cyclomaticDensity", "lower", 1.1, 0.15, 0.35),
    Metric("abc", "lower", 1.0, 20.0, 60.0),
    Metric("halstead", "lower", 1.0, 500.0, 2000.0),
    Metric("cognitive", "lower", 1.1, 15.0, 30.0),
    Metric("maintainability", "higher", 1.4, 70.0, 50.0),
    Metric("cbo", "lower", 1.0, 5.0, 12.0),
    Metric("cohesion", "higher", 1.0, 70.0, 40.0),
    Metric("coverage", "higher", 1.0, 80.0, 50.0),
    Metric("issues", "lower", 1.2, 2.0, 10.0),
    Metric("security", "lower", 1.2, 0.0, 2.0),
    Metric("aiQuality", "lower", 0.9, 0.0, 3.0),
    Metric("duplicatedCode", "lower", 1.2, 5.0, 20.0),
    Metric("deadCode", "lower", 1.1, 10.0, 40.0),
    Metric("staleDecisions", "lower", 1.1, 1.0, 8.0),
    Metric("nloc", "lower", 0.5, 150.0, 350.0),
    Metric("cloc", "higher", 0.4, 8.0, 2.0),
    Metric("codeDensity", "higher", 0.6, 60.0, 40.0),
    Metric("commentDensity", "higher", 0.7, 10.0, 3.0),
    Metric("size", "lower", 0.5, 200.0, 400.0),
)


def metric_table(spark: SparkSession, metrics: tuple[Metric, ...] = METRICS) -> DataFrame:
    return spark.createDataFrame(metrics, "metric string, direction string, weight double, healthy double, fair double")


def peer_scores(values: DataFrame, metrics: DataFrame) -> DataFrame:
    """``values(id, metric, value)`` plus ``score``: the share of peers that are no better, ties included.

    Distinct values are counted first and ranked range by range.
    """
    known = checkpoint(values.where("value IS NOT NULL"))  # read twice; what it comes from may be dear
    counts = known.groupBy("metric", "value").agg(F.count("*").alias("n"))
    ranked = running_counts(counts, ["metric"], "value")
    shares = ranked.select(
        "metric", "value", (F.col("upto") / F.col("total")).alias("up"), ((F.col("total") - F.col("upto") + F.col("n")) / F.col("total")).alias("down")
    )
    joined = known.join(shares, ["metric", "value"]).join(F.broadcast(metrics), "metric")
    return joined.withColumn("score", round_half_up(100.0 * F.when(F.col("direction") == "lower", F.col("down")).otherwise(F.col("up"))))


def weighted_rating(scores: DataFrame, key: str = "id") -> DataFrame:
    """``(key, rating)``: the rounded weighted mean of ``score``, within 0 and 100."""
    mean = F.round(F.sum(F.col("score") * F.col("weight")) / F.sum("weight"), 9)  # sums in another order round alike
    return scores.groupBy(key).agg(F.least(F.greatest(round_half_up(mean), F.lit(0)), F.lit(100)).cast("long").alias("rating"))


def absolute_score(value: Column, direction: Column, healthy: Column, fair: Column) -> Column:
    """100 down to 50 between healthy and fair, on to 0 over one more ``fair``."""
    tiny = F.lit(1e-9)
    over = F.least(F.lit(1.0), (value - fair) / F.greatest(tiny, fair))
    low = F.when(value <= healthy, 100.0).when(value <= fair, 100 - 50 * (value - healthy) / F.greatest(tiny, fair - healthy)).otherwise(F.greatest(F.lit(0.0), 50 - 50 * over))
    under = F.least(F.lit(1.0), (fair - value) / F.greatest(tiny, fair))
    high = F.when(value >= healthy, 100.0).when(value >= fair, 100 - 50 * (healthy - value) / F.greatest(tiny, healthy - fair)).otherwise(F.greatest(F.lit(0.0), 50 - 50 * under))
    return round_half_up(F.when(value.isNull() | F.isnan(value), 100.0).when(direction == "lower", low).otherwise(high))


def percentile_rank(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """``df`` plus ``percentile``: the rounded share of values up to this one within ``keys``."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    ranked = running_counts(counts, keys, value)
    ranks = ranked.select(*keys, value, round_half_up(100.0 * F.col("upto") / F.col("total")).alias("percentile"))
    return df.join(ranks, [*keys, value])


def blend(quality: Column, modularity: Column) -> Column:
    return round_half_up(0.7 * quality + 0.3 * modularity)


def append_history(history: DataFrame, fresh: DataFrame, keep: int = HISTORY) -> DataFrame:
    """Union of snapshots ``(project, at, ...)``, the newest ``keep`` of every project."""
    return top_k(history.unionByName(fresh), ["project"], [F.desc("at"), F.desc("seq")], keep)


def upsert(store: DataFrame, fresh: DataFrame, key: str = "key") -> DataFrame:
    """``fresh`` rows replace rows of the same key; both have one row a key."""
    return store.join(fresh.select(key), key, "left_anti").unionByName(fresh)
