"""SimHash near-duplicate groups with deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments.  If two fingerprints differ in at
most two bits, either their high segments differ in at most one bit, or their low
segments are equal.  The index therefore holds, per distinct fingerprint, 32 variants of
the high segment with one bit deleted plus the whole low segment (33 rows); fingerprints
that share a row are candidates.

Buckets of up to ``bucket_rows`` fingerprints are joined with themselves and verified.
Larger ones are refined without pairing their members: every member emits the variants
with *two* deleted bits that agree with the bucket.  Fingerprints that share such a
variant differ in at most two bits, so each such set is linked to its smallest member.
Together the two routes reach every pair that the join of all pairs would reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.operators.components import connected_components
from orrery.session import checkpoint, dealt, map_arrow, movable

#: Bytes A-Z become a-z; all others stay.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SEED = 42
HALF = 32


def fingerprint(text: str | None, shingle: int) -> int:
    """The unsigned fingerprint of one text; 0 if it has no words.

    Words are runs of bytes other than ASCII white space, after A-Z are lower-cased.
    Shingles count as often as they occur; a text of fewer words is one shingle.
    """
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        digests = xxhash.xxh64_digest(line, SEED)
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(line[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist())])
    hashes = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """``(id_col, fp)`` for every row; ``fp`` holds the 64 bits as a signed BIGINT."""
    source = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    schema = T.StructType([source.schema[0], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=[id_col, "fp"])

    return map_arrow(source, run, schema)


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _high(fp: Column) -> Column:
    return F.shiftrightunsigned(fp, HALF)


def _low(fp: Column) -> Column:
    return fp.bitwiseAND(F.lit((1 << HALF) - 1))


def _masks(deleted: list[tuple[int, ...]]) -> Column:
    """A constant array: for each set of deleted bits the mask of the others."""
    values = [((1 << HALF) - 1) & ~sum(1 << b for b in bits) for bits in deleted]
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


ONE_DELETED = [(b,) for b in range(HALF)]
TWO_DELETED = list(combinations(range(HALF), 2))


def _differing(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _variants(fps: DataFrame) -> DataFrame:
    """``(kind, part, fp)``: kind 0..31 deletes that bit of the high segment, 32 is the low one."""
    fp = F.col("fp")
    part = F.when(F.col("kind") == HALF, _low(fp)).otherwise(_high(fp).bitwiseAND(F.col("mask")))
    return fps.select("fp", F.posexplode(_masks([*ONE_DELETED, ()])).alias("kind", "mask")).select("kind", part.alias("part"), "fp")


def _refined(members: DataFrame) -> DataFrame:
    """Two-deletion variants of the members of large buckets, as ``(kind, part, sub, rest, fp)``."""
    fp, kind, mask = F.col("fp"), F.col("kind"), F.col("mask")
    each = members.where(kind < HALF).select("kind", "part", "fp", F.posexplode(_masks(ONE_DELETED)).alias("sub", "mask"))
    each = each.select("kind", "part", "sub", _low(fp).bitwiseAND(mask).alias("rest"), "fp")
    equal = members.where((kind == 0) | (kind == HALF)).select("kind", "part", "fp", F.posexplode(_masks(TWO_DELETED)).alias("sub", "mask"))
    same, other = F.when(kind == 0, _high(fp)).otherwise(_low(fp)), F.when(kind == 0, _low(fp)).otherwise(_high(fp))
    rest = F.shiftleft(same, HALF).bitwiseOR(other.bitwiseAND(mask))
    equal = equal.select("kind", "part", (F.col("sub") + HALF).alias("sub"), rest.alias("rest"), "fp")
    return each.unionByName(equal)


def link_fingerprints(fps: DataFrame, max_distance: int = 2, bucket_rows: int = 64) -> DataFrame:
    """Links ``(src, dst)`` between distinct fingerprints; their closure holds every pair within range.

    ``fps`` has one BIGINT column ``fp`` of distinct values.  ``bucket_rows`` only decides
    which of two exact routes a bucket takes.
    """
    if not 0 <= max_distance <= 2:
        raise ValueError("two segments with one deletion cover at most two differing bits")
    variants = _variants(fps)
    shared = variants.groupBy("kind", "part").agg(F.count("*").alias("n")).where("n > 1")
    members = checkpoint(variants.join(dealt(shared), ["kind", "part"]))

    small = members.where(F.col("n") <= bucket_rows).select("kind", "part", "fp")
    near = (
        small.withColumnRenamed("fp", "src")
        .join(dealt(small.withColumnRenamed("fp", "dst")), ["kind", "part"])
        .where((F.col("src") < F.col("dst")) & (_differing("src", "dst") <= max_distance))
        .select("src", "dst")
    )

    large = members.where(F.col("n") > bucket_rows).drop("n")
    if max_distance < 2 or large.isEmpty():
        if not large.isEmpty():
            raise ValueError("large buckets are refined for two differing bits only")
        return near.distinct()
    key = ["kind", "part", "sub", "rest"]
    refined = _refined(large)
    leaders = refined.groupBy(*key).agg(F.min("fp").alias("lead"), F.max("fp").alias("last")).where("lead < last")
    star = refined.join(dealt(leaders), key).where("fp <> lead").select(F.col("lead").alias("src"), F.col("fp").alias("dst"))
    return near.unionByName(star).distinct()


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, max_distance: int = 2, bucket_rows: int = 64
) -> DataFrame:
    """``(id_col, fp, component_id)`` for every row of ``docs``.

    ``component_id`` is the smallest id reachable over fingerprints that differ in at most
    ``max_distance`` bits.  Null, empty and blank texts have fingerprint 0 and are linked
    like any other.  Repeated rows stay repeated; a null id never becomes a component id
    unless the whole group has none.  Other columns of ``docs`` are not read.
    """
    rows = checkpoint(fingerprints(docs, id_col, text_col, shingle))
    fps = rows.groupBy("fp").agg(F.min(id_col).alias("first_id"))
    links = link_fingerprints(fps.select("fp"), max_distance, bucket_rows)
    parts = connected_components(links).join(dealt(fps.withColumnRenamed("fp", "node")), "node")
    roots = parts.groupBy("component").agg(F.min("first_id").alias("root"))
    moved = parts.join(dealt(roots.select(movable("component"), "root")), "component").select(F.col("node").alias("fp"), "root")
    final = fps.join(dealt(moved), "fp", "left").select(movable("fp"), F.coalesce("root", "first_id").alias("component_id"))
    return rows.join(dealt(final), "fp").select(id_col, "fp", "component_id")
