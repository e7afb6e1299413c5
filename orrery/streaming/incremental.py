"""Incremental re-analysis: changes of files become changes of package totals.

The metrics of a changed file are column expressions; the state holds each file's last
measures only, and a change sends what it adds to its package and what it takes from the package it was in.
Totals are the sum of all that was sent, so no file is read again and any sequence of changes
gives what one run over the final files gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orrery.functions import metrics as M
from orrery.functions import paths as P
from orrery.session import ship_package

MEASURES = ("files", "loc", "nloc", "cloc", "blank", "stale")
DELTA = "package string, " + ", ".join(f"{m} long" for m in MEASURES)


def measured(files: DataFrame) -> DataFrame:
    """``files(path, content, ...)`` plus ``package`` and the measures; a null content has none."""
    lines = files.withColumn("__lines", M.line_breakdown(F.col("content"), F.col("path")))
    held = F.col("content").isNotNull()
    named = {m: F.when(held, F.col(f"__lines.{m}")).otherwise(0).cast("long") for m in MEASURES[1:]}
    return lines.withColumns({"package": P.parent_dir(F.col("path")), "files": held.cast("long"), **named}).drop("__lines")


def package_totals(files: DataFrame) -> DataFrame:
    """``(package, files, loc, ...)`` of whole files, packages without files left out."""
    sums = measured(files).groupBy("package").agg(*[F.sum(m).alias(m) for m in MEASURES])
    return sums.where("files > 0")


def package_deltas(changes: DataFrame) -> DataFrame:
    """What a stream ``(path, seq, content)`` of changes adds to each package: ``(package, files, loc, ...)``.

    ``seq`` orders the changes of a path, also across micro-batches; an older or repeated one changes nothing.
    A null content deletes the file.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, *before = state.get if state.exists else (None, *[0] * len(MEASURES))
        rows = pd.concat(list(batches))
        row = rows.loc[rows["seq"].idxmax()]
        if last is not None and row["seq"] <= last:
            return
        now = [int(row[m]) for m in MEASURES]
        state.update((int(row["seq"]), *now))
        change = [a - b for a, b in zip(now, before, strict=True)]
        if any(change):
            yield pd.DataFrame([[row["package"], *change]], columns=["package", *MEASURES])

    ship_package(changes.sparkSession)
    small = measured(changes).select("path", "seq", "package", *MEASURES)
    states = "seq long, " + ", ".join(f"{m} long" for m in MEASURES)
    return small.groupBy("path").applyInPandasWithState(run, DELTA, states, "append", GroupStateTimeout.NoTimeout)


def keep_totals(changes: DataFrame, folder: str, checkpoint_path: str) -> StreamingQuery:
    """Write the deltas of every micro-batch to ``folder``, summed by package, until the input is used up.

    A batch has a folder of its own that a repeated run of it replaces, so each counts once.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch.groupBy("package").agg(*[F.sum(m).alias(m) for m in MEASURES]).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return package_deltas(changes).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start()


def read_totals(spark: SparkSession, folder: str) -> DataFrame:
    """The totals of all batches so far."""
    kept = spark.read.schema(f"{DELTA}, batch long").parquet(folder)
    return kept.groupBy("package").agg(*[F.sum(m).alias(m) for m in MEASURES]).where("files > 0")
