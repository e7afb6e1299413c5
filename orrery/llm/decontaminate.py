"""Benchmark decontamination with one Aho-Corasick automaton over normalised items.

Every distinct benchmark word becomes one character of a private alphabet, so a window of
ten words is a pattern of ten characters and a match ends at a word index.  Document words
outside the alphabet become a separator.  One pass of the automaton over a document finds
all windows of all items, overlapping ones included.

The benchmark is read in chunks of at most ``chunk_chars`` characters (its size is summed
first), one automaton each; a benchmark of ordinary size is one chunk.  Each chunk adds to
the spans and items found so far, so larger benchmarks are scanned exactly as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.session import checkpoint, map_arrow, worker_cache

#: Bytes: A-Z become a-z, ASCII other than letters and digits becomes a space; all else stays.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
SEPARATOR, FIRST = "\x00", 1
#: Characters that can stand for words; a larger alphabet is matched as sequences of numbers.
LETTERS = 0x110000 - 0x800 - FIRST
SPAN = "struct<first:int,last:int,start:int,end:int>"


def folded(text: str | None) -> bytes:
    """The text as bytes, all that is no word a space; places in it are places in the UTF-8 text."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD) if text else b""


def words_of(text: str | None) -> list[bytes]:
    return folded(text).split()


def places_of(line: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and last-but-one character of each word of a folded text, counted in characters."""
    codes = np.frombuffer(b" " + line + b" ", np.uint8)
    edges = np.flatnonzero(np.diff((codes != 32).astype(np.int8)))
    chars = np.append(0, np.cumsum((codes[1:-1] & 0xC0) != 0x80))
    return chars[edges[::2]], chars[edges[1::2]]


class Matcher:
    """The automaton over the windows of ``items``, pairs of (id as string, text)."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = 10, letters: int = LETTERS):
        self.alphabet: dict[bytes, int] = {}
        texts = [(item, [self.alphabet.setdefault(w, len(self.alphabet) + FIRST) for w in words_of(text)]) for item, text in items]
        self.wide = len(self.alphabet) > letters
        found: dict[str | tuple[int, ...], list[str]] = {}
        for item, codes in texts:
            for at in range(max(1, len(codes) - window + 1) if codes else 0):
                owners = found.setdefault(self._joined(codes[at : at + window]), [])
                if item not in owners:
                    owners.append(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE) if self.wide else ahocorasick.Automaton()
        for pattern, owners in found.items():
            self.automaton.add_word(pattern, (len(pattern), tuple(owners)))
        if found:
            self.automaton.make_automaton()
        self.empty = not found
        self._letters = {} if self.wide else {w: self._joined([c]) for w, c in self.alphabet.items()}

    def _joined(self, codes: list[int]) -> str | tuple[int, ...]:
        """The words as characters, surrogates left out, or as numbers."""
        return tuple(codes) if self.wide else "".join([chr(c if c < 0xD800 else c + 0x800) for c in codes])

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, int, int]], set[str]]:
        """Number of words; spans of all matches, merged, as (first word, last word, start, end) with character offsets; items that occur."""
        line = folded(text)
        words = line.split()
        if self.empty or not words:
            return len(words), [], set()
        if self.wide:
            coded: str | tuple[int, ...] = tuple([self.alphabet.get(w, 0) for w in words])
        else:
            get = self._letters.get
            coded = "".join([get(w, SEPARATOR) for w in words])
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for end, (length, owners) in self.automaton.iter(coded):
            spans.append((end - length + 1, end))
            items.update(owners)
        if not spans:
            return len(words), [], items
        starts, ends = places_of(line)
        return len(words), [(a, b, int(starts[a]), int(ends[b])) for a, b in merge(spans)], items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


def united(spans: list[dict[str, int]]) -> list[dict[str, int]]:
    """Spans with character offsets, overlapping and adjoining ones merged."""
    starts, ends = {x["first"]: x["start"] for x in spans}, {x["last"]: x["end"] for x in spans}
    return [{"first": a, "last": b, "start": starts[a], "end": ends[b]} for a, b in merge([(x["first"], x["last"]) for x in spans])]


def _matcher(items: list[tuple[str, str | None]], window: int) -> Matcher:
    """The automaton of a chunk, kept by the Python worker."""
    key = hashlib.sha256(repr((window, items)).encode("utf-8", "surrogatepass")).hexdigest()
    return worker_cache(key, lambda: Matcher(items, window))


def _scan_chunk(docs: DataFrame, items: list[tuple[str, str | None]], text_at: int, window: int) -> DataFrame:
    """Add what one chunk finds to the last three columns of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared.value, window)
        for batch in batches:
            width = batch.num_columns
            spans, owners = batch.column(width - 2).to_pylist(), batch.column(width - 1).to_pylist()
            counts = np.array(batch.column(width - 3).to_pylist(), np.int64)
            for k, text in enumerate(batch.column(text_at).to_pylist()):
                counts[k], more, names = matcher.scan(text)
                if more:
                    old = {(x["first"], x["last"]): x for x in spans[k]}
                    new = [dict(zip(("first", "last", "start", "end"), x)) for x in more]
                    spans[k] = united([*old.values(), *new])
                    owners[k] = sorted({*owners[k], *names})
            kinds = [batch.schema.field(width - j).type for j in (3, 2, 1)]
            added = [pa.array(v, t) for v, t in zip((counts.tolist(), spans, owners), kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: width - 3], *added], names=batch.schema.names)

    return map_arrow(docs, run, docs.schema)


def benchmark_chunks(benchmark: DataFrame, item_col: str, text_col: str, chunk_chars: int) -> Iterator[list[tuple[str, str | None]]]:
    """The items in parts of about ``chunk_chars`` characters; the driver holds one part at a time."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = total // chunk_chars + 1
    for part in range(parts):
        mine = items if parts == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
        yield sorted((r["item"], r["text"]) for r in mine.collect() if r["text"])


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    chunk_chars: int = 8_000_000,
) -> DataFrame:
    """``docs`` plus ``n_words``, ``hit_spans`` and ``hit_items``.

    A span has the indexes of its first and last word, and ``start`` and ``end`` (exclusive)
    of its characters in the original text; overlapping and adjoining spans are merged.

    The three columns replace columns of the same name.  Texts without words (null, empty,
    punctuation) have no hits; items without words never occur; items whose id repeats
    count once; a null id is called ``null``.  An empty benchmark hits nothing.
    """
    kept = docs.drop("n_words", "hit_spans", "hit_items")
    out = kept.withColumns(
        {
            "n_words": F.lit(0).cast("long"),
            "hit_spans": F.from_json(F.lit("[]"), f"array<{SPAN}>"),
            "hit_items": F.from_json(F.lit("[]"), "array<string>"),
        }
    )
    text_at = out.columns.index(text_col)
    for n, chunk in enumerate(benchmark_chunks(benchmark, item_col, item_text_col, chunk_chars)):
        out = _scan_chunk(checkpoint(out) if n else out, chunk, text_at, window)
    return out


def n_hit(spans: str = "hit_spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s["last"] - s["first"] + 1)
