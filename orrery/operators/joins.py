"""As-of and candidate joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, bucket: Column | None = None) -> DataFrame:
    """``left(keys, at, ...)`` plus ``value``: that of the last ``right(keys, at, value)`` up to ``at``.

    Both sides are sorted together within ``keys`` and ``bucket``, a column that does not fall
    as ``at`` rises (a day, a block of lines); nothing is paired.  The last value of earlier
    buckets comes from one row a bucket, so a hot key is spread over its buckets.  A right row
    at the same place comes first; of several there the greatest value counts.
    """
    part = F.lit(0) if bucket is None else bucket
    extra = [c for c in left.columns if c not in (*keys, at)]
    kind = right.schema[value].dataType
    events = left.select(*keys, at, part.alias("__b"), F.struct(F.lit(1).alias("__one"), *extra).alias("__row"), F.lit(None).cast(kind).alias(value), F.lit(1).alias("__side"))
    marks = right.select(*keys, at, part.alias("__b"), F.lit(None).cast(events.schema["__row"].dataType).alias("__row"), value, F.lit(0).alias("__side"))
    every = events.unionByName(marks)
    lasts = every.groupBy(*keys, "__b").agg(F.max(F.when(F.col(value).isNotNull(), F.struct(at, value))).alias("__m"))
    earlier = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(*keys, "__b", F.last(F.col("__m")[value], ignorenulls=True).over(earlier).alias("__carry"))
    order = Window.partitionBy(*keys, "__b").orderBy(at, "__side", value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = every.withColumn(value, F.last(value, ignorenulls=True).over(order)).where("__side = 1").join(carried, [*keys, "__b"], "left")
    return met.select(*keys, at, *[F.col(f"__row.{c}").alias(c) for c in extra], F.coalesce(value, "__carry").alias(value))


def first_candidate(wanted: DataFrame, known: DataFrame, key: str, candidates: str = "candidates") -> DataFrame:
    """``(key, target)``: the first of each row's ordered ``candidates`` that ``known(path)`` holds."""
    each = wanted.select(key, F.posexplode(candidates).alias("ord", "path"))
    return each.join(known.select("path").distinct(), "path").groupBy(key).agg(F.min_by("path", "ord").alias("target"))
