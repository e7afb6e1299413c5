"""Embedding near-duplicates: random-hyperplane sign hashing, exact cosines, components.

Distinct vectors are hashed by the signs of random projections into several tables.  The
bits a table and the number of tables follow from the number of vectors and from the recall
wanted at the threshold itself, so buckets stay small at every size.  Vectors that share a
bucket are compared first by a 256-bit sign sketch, whose bound is six standard deviations
beyond what a pair at the threshold shows, then by their exact cosine in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.operators.components import connected_components
from orrery.session import checkpoint, map_arrow, movable

SKETCH_LONGS = 4
SKETCH_BITS = 64 * SKETCH_LONGS
SEED = 20240229


def plan_tables(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits a table, tables) for ``n`` vectors: about two random vectors a bucket, ``recall`` at the threshold."""
    bits = min(40, max(8, math.ceil(math.log2(max(n, 2))) - 1))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def sketch_bound(threshold: float) -> int:
    p = math.acos(threshold) / math.pi
    return math.floor(SKETCH_BITS * p + 6 * math.sqrt(SKETCH_BITS * p * (1 - p)))


def _signatures(vectors: DataFrame, bits: int, tables: int) -> DataFrame:
    """``(rep, dim, keys, s0..s3)`` of ``(rep, unit)``."""
    schema = T.StructType(
        [
            T.StructField("rep", T.LongType()),
            T.StructField("dim", T.IntegerType()),
            T.StructField("keys", T.ArrayType(T.LongType())),
            *(T.StructField(f"s{k}", T.LongType()) for k in range(SKETCH_LONGS)),
        ]
    )
    powers = (1 << np.arange(bits, dtype=np.int64)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            reps, units = batch.column(0).to_numpy(), [np.array(v, float) for v in batch.column(1).to_pylist()]
            for dim in sorted({len(u) for u in units}):
                if dim not in planes:
                    planes[dim] = np.random.default_rng([SEED, dim]).standard_normal((dim, tables * bits + SKETCH_BITS))
                at = [k for k, u in enumerate(units) if len(u) == dim]
                signs = np.stack([units[k] for k in at]) @ planes[dim] >= 0
                keys = signs[:, : tables * bits].reshape(len(at), tables, bits) @ powers
                sketch = np.packbits(signs[:, tables * bits :], axis=1).view(">i8").astype(np.int64)
                columns = [pa.array(reps[at]), pa.array([dim] * len(at), pa.int32()), pa.array(list(keys), pa.list_(pa.int64()))]
                columns += [pa.array(np.ascontiguousarray(sketch[:, k])) for k in range(SKETCH_LONGS)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return map_arrow(vectors.select("rep", "unit"), run, schema)


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, recall: float = 0.999
) -> DataFrame:
    """``(id_col, n_links, component_id, kept)`` for every row of ``vectors``.

    ``n_links`` counts the other rows found with a cosine of at least ``threshold``;
    ``component_id`` is the smallest id reachable over links; ``kept`` marks that row.
    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, and vectors of different lengths are not compared.  Rows of equal vectors
    are compared once and counted as often as they occur; repeated ids stay repeated rows.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0)).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    top = F.array_max(F.transform("v", F.abs))
    # Extreme vectors are scaled, so that no finite one over- or underflows; cosines stay the same.
    extreme = (top > 1e100) | (top < 1e-100)
    rows = rows.withColumn("top", F.when(finite & (top > 0), F.when(extreme, top).otherwise(1.0)))
    rows = rows.withColumn("v", F.when(F.col("top").isNotNull(), F.transform("v", lambda x: x / F.col("top"))))
    rows = rows.withColumn("norm", F.sqrt(_dot("v", "v"))).withColumn("h", F.when(F.col("v").isNotNull(), F.xxhash64("v")))
    rows = checkpoint(rows.select("id", "v", "norm", "h"))

    # Equal vectors once: the first id stands for them; (h, v) keeps hash collisions apart, a number of their own the groups.
    valid = rows.where(F.col("v").isNotNull())
    groups = valid.groupBy("h", "v").agg(F.min("id").alias("rep_id"), F.count("*").alias("copies"), F.first("norm").alias("norm"))
    groups = checkpoint(groups.withColumn("rep", F.monotonically_increasing_id()))
    units = groups.select("rep", F.transform("v", lambda x: x / F.col("norm")).alias("unit"))
    n = groups.count()
    bits, tables = plan_tables(n, threshold, recall)

    signed = checkpoint(_signatures(units, bits, tables))
    sketch = [f"s{k}" for k in range(SKETCH_LONGS)]
    index = signed.select("rep", "dim", *sketch, F.posexplode("keys").alias("tab", "key"))
    left = index.select("dim", "tab", "key", F.col("rep").alias("a"), *[F.col(s).alias(f"a{s}") for s in sketch])
    right = index.select("dim", "tab", "key", F.col("rep").alias("b"), *[F.col(s).alias(f"b{s}") for s in sketch])
    apart = sum((F.bit_count(F.col(f"a{s}").bitwiseXOR(F.col(f"b{s}"))) for s in sketch), F.lit(0))
    close = left.join(right, ["dim", "tab", "key"]).where((F.col("a") < F.col("b")) & (apart <= sketch_bound(threshold)))
    candidates = close.select("a", "b").distinct()
    own = groups.select("rep", "v", "norm")
    pairs = candidates.join(own.select(F.col("rep").alias("a"), F.col("v").alias("va"), F.col("norm").alias("na")), "a").join(
        own.select(F.col("rep").alias("b"), F.col("v").alias("vb"), F.col("norm").alias("nb")), "b"
    )
    links = checkpoint(pairs.where(_dot("va", "vb") / (F.col("na") * F.col("nb")) >= threshold).select("a", "b"))

    copies = groups.select("rep", "copies", "rep_id")
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = ends.join(copies.select(F.col("rep").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
    parts = connected_components(links, "a", "b").join(copies.withColumnRenamed("rep", "node"), "node")
    roots = parts.groupBy("component").agg(F.min("rep_id").alias("root"))
    moved = parts.join(roots.select(movable("component"), "root"), "component").select(F.col("node").alias("rep"), "root")
    known = (
        groups.join(counts.withColumnRenamed("a", "rep"), "rep", "left")
        .join(moved, "rep", "left")
        .select(
            movable("h").alias("gh"),
            F.col("v").alias("gv"),
            (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
            F.coalesce("root", "rep_id").alias("root"),
        )
    )
    out = rows.join(known, (F.col("h") == F.col("gh")) & (F.col("v") == F.col("gv")), "left")
    component = F.coalesce("root", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("id")).alias("kept"),
    )
