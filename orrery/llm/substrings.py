"""Substring de-duplication: seed and extend over winnowed anchors.

An anchor is the smallest hash among the runs of ``ANCHOR`` words that begin in a window of
``length`` words, so equal windows have equal anchors at equal places, and a text has one
anchor for about twelve words.  Anchors of all documents meet in one sorted order, dealt by ranges in which
equal anchors may be cut anywhere; each place looks at its neighbours only, so no group of equal
anchors is gathered and no pairs are formed.

A seed, an anchor that is not alone, is extended both ways in two steps:

* All words that a window through the anchor can reach, its surroundings, are one hash.  Places
  next to equal surroundings match as far as any window asks and are settled at once, however
  many there are.
* Where the order passes from one kind of surroundings to another of the same anchor, a place of
  each goes on and is extended word by word: each window whose anchor it is, so many words to
  the left and the rest to the right, meets the equal windows of other kinds in a second
  sorted order.  The first and last place of every range go on as well, so it does not matter
  where ranges are cut.

Windows found twice are merged where they overlap: the maximal repeats of at least ``length``
words in every document.  Only hashes, row numbers and word numbers are sorted; a text moves
twice, to its places that are extended word by word and to its repeats.

Words, anchors and windows are hashed with 64 bits each, anchors and windows by different
polynomials, and both must agree; a chance match needs 128 equal bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.session import checkpoint, map_arrow, remove_path, scratch_path, write_table

LENGTH, ANCHOR = 35, 8
#: Bytes of texts that are hashed at once (one text at least).
BLOCK_BYTES = 1 << 21
#: Odd factors of the polynomials of anchors, surroundings and windows.
FACTORS = {"anchor": 0x9E3779B97F4A7C15, "around": 0xC2B2AE3D27D4EB4F, "window": 0xD6E8FEB86659FD93}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit depends on all."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of every ``width`` neighbouring numbers; the last one of equals."""
    place, held = np.arange(len(grams)), 1
    while held < width:
        step = min(held, width - held)
        left, right = place[:-step], place[step:]
        place = np.where(grams[right] <= grams[left], right, left)
        held += step
    return place


class Words:
    """The words of several texts in a row, with hashes of any run of them."""

    def __init__(self, texts: list[bytes | None]):
        split = [(t or b"").split() for t in texts]
        self.sizes = np.array([len(w) for w in split], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.row = np.repeat(np.arange(len(split)), self.sizes)
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(split)), np.uint64, len(self.row))
        self._sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def runs(self, first: np.ndarray, end: np.ndarray, kind: str) -> np.ndarray:
        """Hash of the words from ``first`` up to ``end``: differences of running sums of a polynomial, shifted back."""
        if kind not in self._sums:
            n, factor = len(self.hashes), FACTORS[kind]
            powers, back = np.full((2, n + 1), 1, np.uint64)
            powers[1:], back[1:] = factor, pow(factor, -1, 1 << 64)
            powers, back = np.cumprod(powers), np.cumprod(back)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(self.hashes * powers[:-1], out=sums[1:])
            self._sums[kind] = sums, back
        sums, back = self._sums[kind]
        return mixed((sums[end] - sums[first]) * back[first] + (end - first).astype(np.uint64))

    def windows(self, length: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word and anchor's place of every window within one text, and the hashes of all runs of ``size`` words."""
        n = len(self.hashes)
        if n < length:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
        at = np.arange(n - size + 1)
        grams = self.runs(at, at + size, "anchor")
        first = np.flatnonzero(self.row[: n - length + 1] == self.row[length - 1 :])
        return first, winnow(grams, length - size + 1)[first], grams

    def around(self, at: np.ndarray, length: int, size: int) -> np.ndarray:
        """Hash of all words that a window through the anchors ``at`` can reach, and of their number on the left."""
        first = np.maximum(self.starts[self.row[at]], at - (length - size))
        end = np.minimum(self.ends[self.row[at]], at + length)
        return mixed(self.runs(first, end, "around") ^ (at - first).astype(np.uint64))


def blocks(column: pa.Array) -> Iterator[tuple[int, Words]]:
    """The texts of a column in blocks of about ``BLOCK_BYTES``, with the number of each block's first row."""
    held, first, size = [], 0, 0
    for n, data in enumerate(column):
        held.append(data.as_py())
        size += len(held[-1] or b"")
        if size >= BLOCK_BYTES or n == len(column) - 1:
            yield first, Words(held)
            held, first, size = [], n + 1, 0


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def anchor_places(docs: DataFrame, id_col: str, text_col: str, length: int, size: int) -> DataFrame:
    """``(anchor, around, ref, pos, id, tag)`` of every anchor; ``ref`` numbers the rows of ``docs``.

    ``ref`` holds only as long as the result is not computed again; ``id`` and ``tag``, the hash of
    the text, lead back to the row.
    """
    text = F.col(text_col)
    rows = docs.select(F.monotonically_increasing_id().alias("ref"), F.col(id_col).alias("id"), F.xxhash64(text).alias("tag"), text.cast("binary").alias("data"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, words in blocks(batch.column(3)):
                _, owner, grams = words.windows(length, size)
                at = np.unique(owner)
                row = words.row[at]
                same = [batch.column(c).take(pa.array(start + row)) for c in range(3)]
                pos = pa.array((at - words.starts[row]).astype(np.int32))
                columns = [signed(grams[at]), signed(words.around(at, length, size)), same[0], pos, *same[1:]]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "around", "ref", "pos", "id", "tag"])

    return map_arrow(rows, run, f"anchor long, around long, ref long, pos int, id {kind}, tag long")


def beside(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[np.ndarray], np.ndarray]]:
    """Each batch of a sorted partition with, for every key column, whether the row before and the row after are equal in it.

    The last item marks the first and the last row of the partition.
    """
    before: list[int] | None = None
    held = None
    for batch in chain(batches, [None]):
        if batch is not None and not batch.num_rows:
            continue
        if held is not None:
            columns = [held.column(k).to_numpy() for k in range(keys)]
            as_before = [np.concatenate([[before is not None and c[0] == before[k]], c[1:] == c[:-1]]) for k, c in enumerate(columns)]
            as_after = [np.concatenate([c[1:] == c[:-1], [batch is not None and batch.column(k)[0].as_py() == c[-1]]]) for k, c in enumerate(columns)]
            edge = np.zeros(held.num_rows, bool)
            edge[0], edge[-1] = before is None, edge[-1] or batch is None
            edge[0] |= held.num_rows == 1 and batch is None
            yield held, as_before, as_after, edge
            before = [c[-1] for c in columns]
        held = batch


def sift_places(places: DataFrame) -> DataFrame:
    """``(ref, pos, settled, open)`` of seeds: beside equal surroundings, and to be extended word by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, (seed_b, kind_b), (seed_a, kind_a), edge in beside(batches, 2):
            settled = (seed_b & kind_b) | (seed_a & kind_a)
            more = (seed_b & ~kind_b) | (seed_a & ~kind_a) | edge
            kept = pa.array(np.flatnonzero(settled | more))
            flags = [pa.array(settled).take(kept), pa.array(more).take(kept)]
            yield pa.RecordBatch.from_arrays([batch.column(2).take(kept), batch.column(3).take(kept), *flags], ["ref", "pos", "settled", "open"])

    order = ["anchor", "around", "ref", "pos"]
    dealt = places.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    return map_arrow(dealt, run, "ref long, pos int, settled boolean, open boolean")


def open_windows(texts: DataFrame, length: int, size: int) -> DataFrame:
    """``(anchor, window, ref, first)``: the windows of the anchors at ``places`` of ``texts(ref, places, data)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(1).to_pylist()
            for start, words in blocks(batch.column(2)):
                first, owner, grams = words.windows(length, size)
                asked = np.zeros(len(words.row) + 1, bool)
                for n, begin in enumerate(words.starts):
                    asked[begin + np.array(places[start + n], np.int64)] = True
                first, owner = first[asked[owner]], owner[asked[owner]]
                row = words.row[first]
                ref = batch.column(0).take(pa.array(start + row))
                number = pa.array((first - words.starts[row]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([signed(grams[owner]), signed(words.runs(first, first + length, "window")), ref, number], ["anchor", "window", "ref", "first"])

    return map_arrow(texts.select("ref", "places", "data"), run, "anchor long, window long, ref long, first int")


def repeated_windows(windows: DataFrame) -> DataFrame:
    """``(ref, first)`` of the windows that another row equals.

    Equal rows are neighbours in the order; those at the ends of ranges, two a range, are compared
    in a second, small step.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, (seed_b, same_b), (seed_a, same_a), edge in beside(batches, 2):
            twice = (seed_b & same_b) | (seed_a & same_a)
            kept = pa.array(np.flatnonzero(twice | edge))
            flags = [pa.array(twice).take(kept), pa.array(edge).take(kept)]
            yield pa.RecordBatch.from_arrays([*(c.take(kept) for c in batch.columns), *flags], ["anchor", "window", "ref", "first", "twice", "edge"])

    order = ["anchor", "window", "ref", "first"]
    dealt = windows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = checkpoint(map_arrow(dealt, run, "anchor long, window long, ref long, first int, twice boolean, edge boolean"))
    ends = found.where("edge")
    shared = ends.groupBy("anchor", "window").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "window")
    return found.where("twice").unionByName(ends.join(shared, ["anchor", "window"], "left_semi")).select("ref", "first")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, size: int = ANCHOR) -> DataFrame:
    """``(id, tag, spans)``: ``spans`` of ``(first, end)`` words that repeated windows cover, for the rows that have any.

    ``tag`` is the hash of the text.  Spans may overlap and reach past the last word.
    """
    if not 0 < size <= length:
        raise ValueError("an anchor is a part of a window")
    spark = docs.sparkSession
    folder, reach = scratch_path(spark, "substrings"), length - size
    places = write_table(anchor_places(docs, id_col, text_col, length, size), f"{folder}/places")
    rows = places.groupBy("ref").agg(F.first("id").alias("id"), F.first("tag").alias("tag"))
    rows = write_table(rows, f"{folder}/rows")
    seeds = write_table(sift_places(places), f"{folder}/seeds")

    asked = seeds.where("open").join(rows, "ref").groupBy("id", "tag").agg(F.min("ref").alias("ref"), F.collect_set("pos").alias("places"))
    asked = asked.withColumnsRenamed({"id": "__id", "tag": "__tag"})
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).cast("binary").alias("data"))
    texts = texts.join(asked, F.col("id").eqNullSafe(F.col("__id")) & (F.col("tag") == F.col("__tag")))
    windows = write_table(open_windows(texts, length, size), f"{folder}/windows")

    settled = seeds.where("settled").select("ref", F.greatest(F.col("pos") - reach, F.lit(0)).alias("first"), (F.col("pos") + length).alias("end"))
    matched = repeated_windows(windows).select("ref", "first", (F.col("first") + length).alias("end"))
    spans = settled.unionByName(matched).join(rows, "ref").groupBy("id", "tag").agg(F.collect_set(F.struct("first", "end")).alias("spans"))
    spans = checkpoint(spans)
    remove_path(spark, folder)
    return spans


MADE = "n_words long, n_removed long, kept_text string"


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, size: int = ANCHOR) -> DataFrame:
    """``docs`` plus ``n_words``, ``n_removed`` and ``kept_text`` without the words of repeated windows.

    A word goes if it is covered by ``length`` consecutive words of its document that also begin
    anywhere else, in the same document or another; all places of a repeat lose it.  Kept
    words are joined by one space.  Null and empty texts have no words.  Repeated rows are
    documents of their own, so their windows are repeated; null ids are treated alike.
    Empty tables give an empty result; columns of the made names are replaced.
    """
    made = T.StructType.fromDDL(MADE)
    kept = [c for c in docs.columns if c not in made.names]
    schema = T.StructType([*(docs.schema[c] for c in kept), *made.fields])
    spans = repeats(docs, id_col, text_col, length, size).withColumnsRenamed({"id": "__id", "tag": "__tag", "spans": "__spans"})
    met = docs.withColumn("__own", F.xxhash64(text_col))
    met = met.join(spans, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__tag")), "left")
    met = met.select(*kept, F.col("__spans.first").alias("__first"), F.col("__spans.end").alias("__end"), F.col(text_col).cast("binary").alias("__data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, texts = [], [], []
            for first, end, data in zip(*batch.columns[-3:], strict=True):
                words = (data.as_py() or b"").split()
                edges = np.zeros(len(words) + 1, np.int64)
                if first.is_valid:
                    np.add.at(edges, first.values.to_numpy(), 1)
                    np.add.at(edges, np.minimum(end.values.to_numpy(), len(words)), -1)
                stay = np.cumsum(edges[:-1]) == 0
                counts.append(len(words))
                removed.append(len(words) - int(stay.sum()))
                texts.append(b" ".join(words if stay.all() else [words[i] for i in np.flatnonzero(stay)]).decode("utf-8", "replace"))
            columns = [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *columns], [*kept, *made.names])

    return map_arrow(met, run, schema)
