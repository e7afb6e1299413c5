"""Exact ranks, percentiles and top-k that never hold one key's rows in one task.

Values are counted first.  Running counts are split in two levels: approximate quantiles
cut every key's values into ranges, the ranges' totals are summed up over a few hundred
rows, and the exact running count continues inside each range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.session import checkpoint

RANGES = 64
SALTS = 32


def running_counts(counts: DataFrame, keys: Sequence[str], value: str, n: str = "n") -> DataFrame:
    """``counts(keys, value, n)`` with one row a value, plus ``upto`` and ``total`` of its key.

    The counts are read three times and may come from far, so they are written once.  So are the
    cuts: approximate quantiles depend on the order in which parts arrive, and both readers of
    the ranges must see the same ones.
    """
    counts = checkpoint(counts)
    shares = F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)])
    cuts = checkpoint(counts.groupBy(*keys).agg(F.percentile_approx(value, shares, 1000).alias("__cuts")))
    ranged = counts.join(cuts, list(keys)).withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")
    totals = ranged.groupBy(*keys, "__range").agg(F.sum(n).alias("__sum"))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"), F.sum("__sum").over(Window.partitionBy(*keys)).alias("total"))
    inside = Window.partitionBy(*keys, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumn("__inside", F.sum(n).over(inside)).join(totals, [*keys, "__range"])
    return placed.withColumn("upto", F.col("__before") + F.col("__inside")).drop("__before", "__inside", "__range")


def rollup(df: DataFrame, keys: Sequence[str], value: str, percents: Sequence[int] = (50, 80, 90)) -> DataFrame:
    """``(keys, n, total, avg, p50, p80, p90)`` of the non-null values, nearest-rank percentiles."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__value")).agg(F.count("*").alias("n"))
    ranked = running_counts(counts, keys, "__value")
    least = [F.min(F.when(F.col("upto") >= F.greatest(F.ceil(F.col("total") * (p / 100.0) - 1e-9), F.lit(1)), F.col("__value"))).alias(f"p{p}") for p in percents]
    weighted = F.sum(F.col("__value") * F.col("n"))
    return ranked.groupBy(*keys).agg(F.sum("n").alias("n"), weighted.alias("total"), (weighted / F.sum("n")).alias("avg"), *least)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of every key: first within salts of a key, then among those."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))
    first = df.withColumn("__salt", salt).withColumn("__k", F.row_number().over(Window.partitionBy(*keys, "__salt").orderBy(*order))).where(F.col("__k") <= k)
    last = first.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__k") <= k)
    return last.drop("__salt", "__k")


def scanned(rows: DataFrame, order: Sequence[Column], sums: Mapping[str, Column] | None = None, xors: Mapping[str, Column] | None = None, number: str | None = None) -> DataFrame:
    """``rows`` plus running sums and xors in one global order, each row itself included.

    Rows are dealt by ranges of ``order`` and scanned inside their range; what stands before a
    range follows from one row a range, so no task sees more than a range.  ``number`` names a
    column of row numbers from 0.  Rows that ``order`` leaves equal are told apart by
    their place, so many of them do not meet in one range either.
    """
    sums, xors = dict(sums or {}), dict(xors or {})
    if number:
        sums[number] = F.lit(1)
    held = {f"__v{k}": expr for k, expr in enumerate([*sums.values(), *xors.values()])}
    keys = [*order, F.col("__tie")]
    placed = rows.withColumns({**held, "__tie": F.monotonically_increasing_id()})
    ranges = placed.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"__range": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    fixed = checkpoint(ranges.drop("__tie"))
    folds = [*[F.sum] * len(sums), *[F.bit_xor] * len(xors)]
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("__range").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = fixed.groupBy("__range").agg(*[f(v).alias(v) for f, v in zip(folds, held, strict=True)])
    totals = totals.select("__range", *[F.coalesce(f(v).over(before), F.lit(0)).alias(f"{v}b") for f, v in zip(folds, held, strict=True)])
    made = {name: f(v).over(inside) for name, f, v in zip([*sums, *xors], folds, held, strict=True)}
    out = fixed.withColumns(made).join(F.broadcast(totals), "__range")
    whole = {name: (F.col(name) + F.col(f"{v}b")) if f is F.sum else F.col(name).bitwiseXOR(F.col(f"{v}b")) for name, f, v in zip([*sums, *xors], folds, held, strict=True)}
    if number:
        whole[number] = whole[number] - 1
    return out.withColumns(whole).drop("__range", "__at", *held, *[f"{v}b" for v in held])
