"""SimHash near-duplicates at a similarity: fingerprints propose by deletion variants, then banded min-hashes; shingle sets decide.

The similarity of two texts is the Jaccard similarity of their sets of shingles.  Texts whose
64-bit fingerprints differ in at most two bits are found as in ``simhash`` (two segments, one
bit deleted) and compared.  A pair at the similarity itself differs in about ten bits, so the
pairs farther apart than two are proposed by bands.  A text has
min-hashes of its set, four to a band; texts that share a band meet.  The number of bands
follows from the recall wanted at the similarity itself, and no band is shared by chance, so
recall does not depend on the number of texts.  Pairs of large sets whose 512 SimHash bits
differ by five deviations more than those of a pair at the similarity are left out; the other
pairs are decided by the shingle sets.

Only groups are asked for, so pairs inside a group need no second look.  First every text is
compared with the smallest one of each of its buckets, which joins the copies of a large
group.  The members of buckets that still hold several groups are then measured: shingles
that no other of them holds can never be shared, which bounds the similarity of every pair
from above.  Each such bucket is compared with its most typical member, the one whose
shingles the most others hold.  Then the pairs of different groups follow that the bound
allows: all of them in small buckets, and in large ones those that share one of their rarest
shingles.  Sets of this similarity always do (the prefix of a set, in one order for all), so
a passage that many texts hold makes no pairs, and none is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.simhash import LOWER, SEED, link_fingerprints
from orrery.operators.components import connected_components
from orrery.session import checkpoint, dealt, map_arrow, movable

#: Min-hashes of a band, and the share of pairs at the similarity that meet in some band.
BAND_ROWS, RECALL = 4, 0.999
PLANES = 8
MARKS = ("n", *(f"d{k}" for k in range(PLANES)))
#: Fingerprints of smaller sets are not compared: their bits are too coarse for the bound.
FILTER_SHINGLES = 64
#: Larger buckets are searched by rare shingles; both ways are exact.
BUCKET_ROWS = 64


def plan_bands(similarity: float) -> int:
    return max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - min(similarity**BAND_ROWS, RECALL))))


def filter_bits(similarity: float) -> int:
    """Bits that may differ: the mean of sets at this similarity (greatest for equal sizes) plus five deviations."""
    p, bits = math.acos(2 * similarity / (1 + similarity)) / math.pi, 64 * PLANES
    return math.floor(bits * p + 5 * math.sqrt(bits * p * (1 - p)))


def _mixed(hashes: np.ndarray, factor: np.ndarray | np.uint64) -> np.ndarray:
    mixed = hashes * factor
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(29))


def _factors(first: int, count: int) -> np.ndarray:
    return np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) & (2**64 - 1) for k in range(first, first + count)], np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def shingles(words: list[bytes], shingle: int) -> np.ndarray:
    """Distinct hashes of all runs of ``shingle`` words, sorted; a text of fewer words is one shingle."""
    if not words:
        return np.array([], np.uint64)
    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    stops = np.cumsum(lengths + 1) - 1
    starts, ends, digest = (stops - lengths).tolist(), stops.tolist(), xxhash.xxh64_digest
    joined = b"".join([digest(line[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :])])
    return np.unique(np.frombuffer(joined, ">u8").astype(np.uint64))


def _plane(hashes: np.ndarray, factor: np.uint64) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = _mixed(hashes[at : at + 65536], factor).astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def bands_of(hashes: np.ndarray, bands: int) -> list[int]:
    """One key a band, from the least values of the set under ``BAND_ROWS`` orders."""
    factors = _factors(PLANES, bands * BAND_ROWS)[:, None]
    least = np.full(bands * BAND_ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, _mixed(hashes[None, at : at + 4096], factors).min(axis=1))
    rows = least.reshape(bands, BAND_ROWS)
    return [xxhash.xxh64_intdigest(rows[k].tobytes(), k) for k in range(bands)]


def _fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, bands: int) -> DataFrame:
    """``(id_col, at, node, n, bands, d0..)``: ``node`` digests the words, ``n`` counts the shingles."""
    source = docs.select(F.col(id_col), F.xxhash64(text_col).alias("at"), F.col(text_col).alias("__text"))
    planes = [T.StructField(f"d{k}", T.LongType()) for k in range(PLANES)]
    made = [T.StructField("node", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    schema = T.StructType([*source.schema.fields[:2], *made, *planes])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _factors(0, PLANES)
        for batch in batches:
            nodes, sizes, keys, marks = [], [], [], []
            for text in batch.column(2).to_pylist():
                words = words_of(text)
                hashes = shingles(words, shingle)
                nodes.append(xxhash.xxh64_intdigest(b" ".join(words), SEED))
                sizes.append(len(hashes))
                keys.append(bands_of(hashes, bands))
                marks.append([_plane(hashes, f) for f in factors])
            signed = np.array(keys, np.uint64).reshape(-1).view(np.int64)
            offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * np.int32(bands))
            table = np.array(marks, np.uint64).reshape(len(marks), PLANES).view(np.int64)
            columns = [pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(signed))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, *(pa.array(np.ascontiguousarray(table[:, k])) for k in range(PLANES))], names=schema.names)

    return map_arrow(source, run, schema)


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """``(node, shingles)`` from ``(node, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pa.array(shingles(words_of(t), shingle).view(np.int64)) for t in batch.column(1).to_pylist()]
            offsets = pa.array(np.cumsum([0, *map(len, found)], dtype=np.int32))
            values = pa.concat_arrays(found) if found else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, values)], names=["node", "shingles"])

    return map_arrow(texts, run, "node long, shingles array<long>")


def _sizes_fit(a: str, b: str, similarity: float) -> Column:
    return F.least(a, b) >= F.greatest(a, b) * (similarity - 1e-9)


def _marks_fit(a: str, b: str, similarity: float) -> Column:
    """Sizes allow the similarity, and the fingerprints of large sets are near enough."""
    bits = sum((F.bit_count(F.col(f"d{k}_{a}").bitwiseXOR(F.col(f"d{k}_{b}"))) for k in range(PLANES)), F.lit(0))
    return _sizes_fit(f"n_{a}", f"n_{b}", similarity) & ((F.least(f"n_{a}", f"n_{b}") < FILTER_SHINGLES) | (bits <= filter_bits(similarity)))


def _side(rows: DataFrame, side: str, *keys: str) -> DataFrame:
    """The columns of one side of a pair: ``node`` under the side's name, ``keys`` as they are."""
    return rows.select(*keys, F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in rows.columns if c not in (*keys, "node")])


def _within_two_bits(nodes: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of nodes with fingerprints within two bits: the smallest nodes of linked fingerprints, and each node with the smallest of its own."""
    prints = nodes.select(F.col("d0").alias("fp"), "node")
    leads = checkpoint(prints.groupBy("fp").agg(F.min("node").alias("lead"), F.count("*").alias("rows")))
    pairs = link_fingerprints(leads.select("fp"))
    for end, s in (("src", "a"), ("dst", "b")):
        pairs = pairs.join(dealt(leads.select(movable("fp"), F.col("lead").alias(s)).withColumnRenamed("fp", end)), end)
    alike = prints.join(dealt(leads.where("rows > 1").select(movable("fp"), "lead")), "fp").where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(alike)


def _near(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` whose sizes and fingerprints allow the similarity."""
    for s in "ab":
        pairs = pairs.join(_side(nodes.select("node", *MARKS), s), s)
    return pairs.where(_marks_fit("a", "b", similarity)).select("a", "b")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` whose shingle sets have the similarity."""
    for s in "ab":
        pairs = pairs.join(sets.select(F.col("node").alias(s), F.col("shingles").alias(f"set_{s}")), s)
    same = F.size(F.array_intersect("set_a", "set_b"))
    both = pairs.select("a", "b", (F.size("set_a") + F.size("set_b")).alias("n"), same.alias("same"))
    return both.where(F.col("same") / (F.col("n") - F.col("same")) >= similarity).select("a", "b")


def _measured(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``(node, n, shared, typical, rare)`` of the nodes that can be similar to another of them.

    ``shared`` counts the shingles that another node holds, ``typical`` is the mean number of
    nodes that hold a shingle of this one; ``rare`` is the prefix of the set
    in the order of rarity, one shingle of which similar sets share.
    """
    each = members.select("node").distinct().join(sets, "node").select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
    often = each.groupBy("key").agg(F.count("*").alias("often")).where("often > 1")
    found = each.join(often.select(movable("key"), "often"), "key").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("often", "key"))).alias("all"))
    prefix = F.col("n") - F.ceil(F.col("n") * similarity - 1e-6) + 1
    rare = F.slice("all", F.lit(1), F.greatest(prefix - (F.col("n") - F.col("shared")), F.lit(0)).cast("int"))
    held = F.aggregate("all", F.lit(0).cast("double"), lambda total, e: total + e["often"])
    found = found.withColumn("shared", F.size("all")).withColumn("rare", F.transform(rare, lambda e: e["key"])).withColumn("typical", held / F.col("n"))
    return found.where(F.col("shared") >= F.col("n") * (similarity - 1e-9)).select("node", "n", "shared", "typical", "rare")


def _overlap_fits(a: str, b: str, similarity: float) -> Column:
    """Whether the bound of what both sets can share allows the similarity."""
    most = F.least(f"shared_{a}", f"shared_{b}")
    return most * (1 + similarity) >= (F.col(f"n_{a}") + F.col(f"n_{b}")) * (similarity - 1e-9)


def _across(members: DataFrame, similarity: float, *once: Column) -> DataFrame:
    """Pairs of equal keys in different parts that sizes, bounds and fingerprints allow; pairs inside a part are not formed."""
    parts = members.select("key", "part").distinct()
    met = parts.select("key", F.col("part").alias("part_a")).join(parts.select("key", F.col("part").alias("part_b")), "key").where("part_a < part_b")
    met = met.join(_side(members.withColumnRenamed("part", "part_a"), "a", "key", "part_a"), ["key", "part_a"])
    met = met.join(_side(members.withColumnRenamed("part", "part_b"), "b", "key", "part_b"), ["key", "part_b"])
    for test in (_marks_fit("a", "b", similarity), _overlap_fits("a", "b", similarity), *once):
        met = met.where(test)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _undecided(members: DataFrame, groups: DataFrame) -> DataFrame:
    """``members`` with their ``part``, the group of the node, where a bucket holds several; ``rows`` is the bucket's size."""
    own = members.join(groups, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    several = own.groupBy("key").agg(F.min("part").alias("one"), F.max("part").alias("other"), F.count("*").alias("rows")).where("one <> other")
    return checkpoint(own.join(several.select(movable("key"), "rows"), "key"))


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """``(id_col, component_id)`` for every row; the component is named after its smallest id.

    Texts of equal words are one node.  Null, empty and blank texts are alike.  Repeated rows
    stay repeated; a null id names a component only if it has no other.  ``bucket_rows`` only
    decides which of two exact ways a bucket takes.
    """
    rows = checkpoint(_fingerprints(docs, id_col, text_col, shingle, plan_bands(similarity)))
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "at", "bands", *MARKS)).alias("m")
    nodes = rows.groupBy("node").agg(first).select("node", F.col("m.id").alias("first_id"), *[F.col(f"m.{c}").alias(c) for c in ("at", "bands", *MARKS)])
    nodes = checkpoint(nodes)

    close = checkpoint(_within_two_bits(nodes))
    banded = nodes.select(F.explode("bands").alias("key"), "node", "n")
    shared = banded.groupBy("key").agg(F.min("node").alias("low"), F.count("*").alias("rows")).where("rows > 1")
    members = checkpoint(banded.join(shared.select(movable("key"), "low", "rows"), "key"))
    met = members.select("node").unionByName(close.select(F.explode(F.array("a", "b")).alias("node"))).distinct().join(nodes.select("node", "first_id", F.col("at").alias("first_at")), "node")
    texts = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("at"), F.col(text_col).alias("text"))
    texts = texts.join(met, F.col("__id").eqNullSafe(F.col("first_id")) & (F.col("at") == F.col("first_at"))).select("node", "text")
    sets = checkpoint(_sets(texts.dropDuplicates(["node"]), shingle))

    star = members.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()
    links = checkpoint(_similar(_near(close.unionByName(star).distinct(), nodes, similarity), sets, similarity))

    # What is left are pairs of different groups, farther apart than two bits, without a bucket's smallest member.
    rest = _undecided(members.where("rows > 2 AND node <> low").select("key", "node"), connected_components(links, "a", "b"))
    if not rest.isEmpty():
        measured = checkpoint(_measured(rest, sets, similarity))
        rest = rest.select("key", "node", "part").join(measured.select("node", "typical"), "node")
        typical = rest.groupBy("key").agg(F.max(F.struct("typical", "node", "part")).alias("c"))
        met = rest.join(typical.select(movable("key"), "c"), "key").where("part <> c.part")
        met = met.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()
        links = checkpoint(links.unionByName(_similar(_near(met, nodes, similarity), sets, similarity)))

        rest = _undecided(rest.select("key", "node"), connected_components(links, "a", "b"))
        marks = checkpoint(measured.select("node", "shared", "rare").join(nodes.select("node", *MARKS), "node"))
        pairs = _across(rest.where(F.col("rows") <= bucket_rows).select("key", "part", "node").join(marks.drop("rare"), "node"), similarity)
        large = rest.where(F.col("rows") > bucket_rows).select("node", "part").distinct()
        if not large.isEmpty():
            # Pairs that share several of their rarest shingles are formed at the least of them only.
            rare = checkpoint(large.join(marks, "node").withColumn("key", F.explode("rare")))
            pairs = pairs.unionByName(_across(rare, similarity, F.array_min(F.array_intersect("rare_a", "rare_b")) == F.col("key")))
        links = links.unionByName(_similar(pairs.distinct(), sets, similarity))

    parts = connected_components(links, "a", "b").join(nodes.select("node", "first_id"), "node")
    roots = parts.groupBy("component").agg(F.min("first_id").alias("root"))
    moved = parts.join(roots.select(movable("component"), "root"), "component").select("node", "root")
    named = nodes.select("node", "first_id").join(moved, "node", "left").select(movable("node"), F.coalesce("root", "first_id").alias("component_id"))
    return rows.select(id_col, "node").join(named, "node").select(id_col, "component_id")
