"""Target-distribution importance resampling with hashed n-grams of words.

Two passes over the texts, both over Arrow batches.  The first counts hashed features: a
partition sums its ``np.bincount`` vectors into one of ``BUCKETS`` numbers, and ``treeReduce``
adds the vectors of all partitions, so the driver gets one vector for the corpus and one for
the target whatever their sizes.  The second pass has the gain of every bucket broadcast
(``BUCKETS`` numbers), gathers the gains of a text's features and sums them by document as
the weights of a ``bincount``.

A document's score adds Gumbel noise that follows from its id, so the highest scores are a
sample without replacement in proportion to the weights, and the same for every run.
Ranks come from one range partitioning: rows are numbered inside their range, ranges are
shifted by the counts of the ranges before them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.session import checkpoint, map_arrow

BUCKETS = 10_000
#: Rows of a range when ranks are given.
RANGE_ROWS = 500_000
#: A-Z lower-cased, every other ASCII character but a-z and 0-9 a blank; bytes of longer characters stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def text_features(data: bytes | None, longest: int, buckets: int) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every run of 1 to ``longest`` words, repeats included.

    A run's checksum goes on from that of the run without its last word.
    """
    words = (data or b"").translate(FOLD).split()
    last = list(map(zlib.crc32, words))
    sums = list(last)
    for n in range(1, longest):
        last = [zlib.crc32(word, zlib.crc32(b" ", before)) for before, word in zip(last, words[n:], strict=False)]
        sums += last
    return len(words), np.array(sums, np.int64) % buckets


def feature_counts(docs: DataFrame, text_col: str = "text", longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts; null texts hold nothing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data in batch.column(0):
                total += np.bincount(text_features(data.as_py(), longest, buckets)[1], minlength=buckets)
        yield pa.RecordBatch.from_pydict({"counts": pa.array([total.tobytes()], pa.binary())})

    vectors = map_arrow(docs.select(F.col(text_col).cast("binary").alias("data")), count, "counts binary")
    context = docs.sparkSession.sparkContext
    none = context.parallelize([np.zeros(buckets, np.int64)], 1)
    return none.union(vectors.rdd.map(lambda row: np.frombuffer(row[0], np.int64))).treeReduce(np.add, 3)


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 ln)`` of each bucket's smoothed share in the target over that in the corpus."""
    odds = ((target + 1.0) * (corpus.sum() + float(len(corpus)))) / ((corpus + 1.0) * (target.sum() + float(len(target))))
    return np.floor(1000 * np.log(odds)).astype(np.int64)


def gumbel(id_col: Column, seed: int) -> Column:
    """``floor(-1000 ln(-ln u))`` with ``u`` from the digest of seed and id; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(u)))


def weigh(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = 1) -> DataFrame:
    """``(id, n_words, n_features, weight)`` of every row of ``docs``."""
    buckets, sent = len(gains), docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_features(data.as_py(), longest, buckets) for data in batch.column(1)]
            sizes = np.array([len(ids) for _, ids in found], np.int64)
            gained = sent.value[np.concatenate([np.zeros(0, np.int64), *(ids for _, ids in found)])]
            weight = np.bincount(np.repeat(np.arange(len(found)), sizes), weights=gained, minlength=len(found))
            words = pa.array([n for n, _ in found], pa.int64())
            columns = [batch.column(0), words, pa.array(sizes), pa.array(weight.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("data"))
    kind = rows.schema["id"].dataType.simpleString()
    return map_arrow(rows, run, f"id {kind}, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, order: list[Column], count: int) -> DataFrame:
    """``rows`` plus ``rank`` 1, 2, 3 ... in ``order``; rows that ``order`` leaves equal get any order.

    ``count`` is the number of rows.  Equal rows are told apart by their place, so that
    many of them do not meet in one range.
    """
    placed = rows.withColumn("__tie", F.monotonically_increasing_id())
    keys = [*order, F.col("__tie")]
    parts = max(1, -(-count // RANGE_ROWS), min(16, -(-count // 1000)))
    ranges = placed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    fixed = checkpoint(ranges.withColumns({"__range": F.spark_partition_id(), "__at": inside}).drop("__tie"))
    sizes = fixed.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    shifts = sizes.select("__range", F.coalesce(before, F.lit(0)).alias("__before"))
    return fixed.join(F.broadcast(shifts), "__range").withColumn("rank", F.col("__before") + F.col("__at") + 1).drop("__range", "__at", "__before")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    min_words: int = 20,
    longest: int = 1,
    buckets: int = BUCKETS,
    seed: int = 2024,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """Rank the ``percent`` of ``docs`` that a sample towards the distribution of ``target`` draws.

    Returns ``(id_col, n_features, weight, score, rank)``, one row for every row of ``docs``;
    ``rank`` is null for rows that are not drawn.  Only rows of ``min_words`` words are drawn,
    and the share is of their number.  Ties go to the smaller id, nulls last; repeated rows are
    documents of their own, each with its own rank.  Null and empty texts have no feature
    and weight 0; empty tables give an empty result or, as a target, gains against nothing.
    Other columns are not touched.
    """
    gains = bucket_gains(feature_counts(docs, text_col, longest, buckets), feature_counts(target, target_text, longest, buckets))
    weighed = weigh(docs, gains, id_col, text_col, longest)
    scored = checkpoint(weighed.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)))
    eligible = scored.where(F.col("n_words") >= min_words)
    count = eligible.count()
    order = ranked(eligible, [F.desc("score"), F.asc_nulls_last("id")], count)
    drawn = order.withColumn("rank", F.when(F.col("rank") <= percent * count // 100, F.col("rank")))
    others = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(others).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def drawn_documents(docs: DataFrame, ranks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id was drawn, with their texts and all other columns."""
    return docs.join(ranks.where("rank IS NOT NULL").select(id_col).distinct(), id_col, "left_semi")
