"""Periodic runs of words, by a harmonic grid of longest-common-extension queries.

A run of period ``p`` that is at least four periods long holds three grid points ``jp``,
``(j+1)p``, ``(j+2)p`` whose words are equal.  For every period the grid has ``n/p`` points, so
all periods together have n log n; at each candidate the longest common extensions of ``jp`` and
``(j+1)p`` forwards and backwards give the whole run.  Extensions are range minima over the
common prefixes of neighbours in the suffix array, of the words and of the reversed words.

A document is a unit of its own, so nothing is shuffled; a task holds the arrays of one
document at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.session import map_arrow

#: Words up to which a worker keeps the grid of all periods at hand.
GRID_WORDS = 4096
#: Candidates whose extensions are queried at once.
QUERY_ROWS = 1 << 20


def suffix_ranks(ids: np.ndarray) -> list[np.ndarray]:
    """Ranks of all stretches of 1, 2, 4 ... words, until every suffix has a rank of its own.

    A stretch that the end cuts off comes before the longer ones that it begins.
    """
    n = len(ids)
    levels, width = [np.unique(ids, return_inverse=True)[1].astype(np.int64)], 1
    while levels[-1].max() < n - 1:
        after = np.zeros(n, np.int64)
        after[: n - width] = levels[-1][width:] + 1
        levels.append(np.unique(levels[-1] * (n + 1) + after, return_inverse=True)[1].astype(np.int64))
        width *= 2
    return levels


class Extensions:
    """Longest common extensions to the right, by suffix array, neighbours' prefixes and range minima."""

    def __init__(self, ids: np.ndarray):
        n, levels = len(ids), suffix_ranks(ids)
        self.n, self.rank = n, levels[-1]
        order = np.empty(n, np.int64)
        order[self.rank] = np.arange(n)
        a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(n - 1, np.int64)
        for k in range(len(levels) - 1, -1, -1):
            inside = np.flatnonzero((a + (1 << k) <= n) & (b + (1 << k) <= n))
            same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
            for at in (a, b, common):
                at[same] += 1 << k
        self.table = [common]
        while 2 << (len(self.table) - 1) <= n - 1:
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-half], last[half:]))

    def query(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common words from ``a`` and ``b`` on; places differ, and one past the end has none."""
        out, inside = np.zeros(len(a), np.int64), np.flatnonzero((a < self.n) & (b < self.n))
        x, y = self.rank[a[inside]], self.rank[b[inside]]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.log2(high - low).astype(np.int64)
        found = np.zeros(len(inside), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            found[at] = np.minimum(self.table[k][low[at]], self.table[k][high[at] - (1 << k)])
        out[inside] = found
        return out


@lru_cache(maxsize=1)
def _grid(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Period, first point and third point of all grid triples below ``n`` words, by third point."""
    periods = np.arange(1, (n - 1) // 2 + 1)
    sizes = (n - 1) // periods - 1
    period = np.repeat(periods, sizes)
    first = (np.arange(len(period)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) * period
    order = np.argsort(first + 2 * period, kind="stable")
    return period[order], first[order], (first + 2 * period)[order]


def candidates(ids: np.ndarray, copies: int) -> tuple[np.ndarray, np.ndarray]:
    """Periods and grid points that a run may go through.

    A run of at least four periods has a point ``jp`` in its first period, so the words at ``jp``,
    ``(j+1)p``, ``(j+2)p`` and those after the first two are equal; other points are left out.
    """
    n = len(ids)
    if n <= GRID_WORDS:
        period, first, third = _grid(GRID_WORDS)
        held = slice(0, int(np.searchsorted(third, n)))
        parts = [(period[held], first[held])]
    else:
        parts = ((np.int64(p), np.arange(0, n - 2 * p, p)) for p in range(1, n // copies + 1))
    periods, points = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for p, at in parts:
        here = ids[at]
        same = np.flatnonzero((here == ids[at + p]) & (here == ids[at + 2 * p]))
        at, p = at[same], (p[same] if np.ndim(p) else np.full(len(same), p))
        kept = (ids[at + 1] == ids[at + p + 1]) & (p <= n // copies)
        periods.append(p[kept])
        points.append(at[kept])
    return np.concatenate(periods), np.concatenate(points)


def periodic_runs(ids: np.ndarray, min_length: int = 6, copies: int = 4) -> np.ndarray:
    """Rows ``(start, length, period)`` of all runs, by start, then period.

    A run is a maximal stretch with smallest period ``p`` and at least
    ``max(min_length, copies * p)`` words; ``copies`` is 4 or more.
    """
    if copies < 4:
        raise ValueError("the grid is cut for runs of at least four periods")
    period, point = candidates(ids, copies) if len(ids) >= max(min_length, copies) else (np.zeros(0, np.int64),) * 2
    if not len(period):
        return np.zeros((0, 3), np.int64)
    n, forward, backward = len(ids), Extensions(ids), Extensions(ids[::-1])
    found = []
    for k in range(0, len(period), QUERY_ROWS):
        p, a = period[k : k + QUERY_ROWS], point[k : k + QUERY_ROWS]
        right, left = forward.query(a, a + p), backward.query(n - a, n - a - p)
        rows = np.stack([a - left, right + left + p, p], axis=1)
        found.append(np.unique(rows[rows[:, 1] >= np.maximum(min_length, copies * p)], axis=0))
    runs = np.unique(np.concatenate(found), axis=0)
    # A stretch found with several periods has the smallest of them; rows are sorted by (start, length, period).
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def collapsed(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay if every run keeps its first period only."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:n]) == 0


def best_run(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run with the greatest length over period; ties: smallest start, then period.

    Equal quotients round alike, and different ones differ as doubles below 2**26 words.
    """
    if not len(runs):
        return None
    return tuple(map(int, runs[np.lexsort((runs[:, 2], runs[:, 0], -(runs[:, 1] / runs[:, 2])))[0]]))


MADE = "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed string"


def detect_runs(docs: DataFrame, text_col: str = "text", min_length: int = 6, copies: int = 4) -> DataFrame:
    """``docs`` plus its periodic runs of words; columns of the made names are replaced.

    * ``n_words``, ``n_runs``; ``start``, ``length``, ``period``, ``exponent_milli`` of the run of the
      greatest length over period (null if there is none).
    * ``runs_sha256``: digest of the lines ``start,length,period`` of all runs.
    * ``collapsed``: the words that no run holds after its first period, joined by one space.

    A null or empty text has no words: no runs, an empty ``collapsed``.  Every row counts
    alone, so repeated rows and ids give repeated results.
    """
    made = T.StructType.fromDDL(MADE)
    kept = [c for c in docs.columns if c not in made.names]
    schema = T.StructType([*(docs.schema[c] for c in kept), *made.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(batch.num_columns - 1):
                words = (data.as_py() or b"").split()
                numbers: dict[bytes, int] = {}
                ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
                runs = periodic_runs(ids, min_length, copies)
                top = best_run(runs)
                text = b" ".join(words[i] for i in np.flatnonzero(collapsed(len(words), runs))) if top else b" ".join(words)
                listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs.tolist())
                best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
                rows.append((len(words), len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), text.decode("utf-8", "replace")))
            columns = list(zip(*rows, strict=True)) or [[]] * len(made)
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, columns, kinds)], [*kept, *made.names])

    return map_arrow(docs.select(*kept, F.col(text_col).cast("binary").alias("__data")), run, schema)
