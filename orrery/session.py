"""Session helpers: lineage cutting and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SHIPPED: set[str] = set()


def get_spark(master: str = "local[*]", app: str = "orrery", partitions: int = 8) -> SparkSession:
    """A session for local use: UTC, AQE on, the UI off."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where the setting is absent a local session (tests, a laptop) gets a temporary folder;
    on a cluster, whose nodes would not see such a folder, that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if named:
        if current is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes of the cluster share")
        current = tempfile.mkdtemp(prefix="orrery-checkpoints-")
        spark.sparkContext.setCheckpointDir(current)
    return current


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def movable(name: str) -> Column:
    """The BIGINT column ``name`` without what Spark knows about its placement.

    A join on it deals both sides anew, so that adaptive execution can split a hot key; a join
    with an aggregate of the same rows would otherwise stay where the aggregate put the key.
    """
    return F.col(name).bitwiseXOR(F.lit(0)).alias(name)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` as one side of a join that deals both sides by key and sends neither to the driver.

    Spark guesses the size of exploded or checkpointed rows from what they were made of, takes
    a large table for a small one and would broadcast it.
    """
    return df.hint("merge")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` and read again: no lineage, and the size of its files as statistics."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file systems, so that any store works."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="orrery-package-")) / "orrery.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


#: Rows that a Python function sees at once; texts can be long.
SLICE_ROWS = 512

_KEPT: dict[str, Any] = {}


def worker_cache(key: str, build: Callable[[], Any]) -> Any:
    """The one large object that a Python worker keeps; another key replaces it."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = build()
    return _KEPT[key]


def map_arrow(df: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` for functions that use this package, over slices of ``SLICE_ROWS`` rows."""
    ship_package(df.sparkSession)

    def sliced(batches: Iterator) -> Iterator:
        yield from run(batch.slice(at, SLICE_ROWS) for batch in batches for at in range(0, batch.num_rows, SLICE_ROWS))

    return df.mapInArrow(sliced, schema)
