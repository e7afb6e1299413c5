"""Quality classifier: hashed word n-gram logistic regression with FTRL-proximal updates.

A word gives a lexical hash and a shape (case, punctuation, length); both give unigrams and
bigrams, and words that repeat an earlier one at a short distance give a repeat marker.
All are hashed into one weight vector.  Training follows the regularised leader per
coordinate over a bounded sample of labelled rows; scoring is a sparse dot product.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.session import map_arrow

BITS = 18
DIMENSIONS = 1 << BITS
MEMO_WORDS = 400_000
LAGS = (1, 2, 3, 4, 6, 8, 12, 16)
EDGES = re.compile(r"^(\W*)(.*?)(\W*)$", re.S)

_MEMO: dict[str, int] = {}


def _word(word: str) -> int:
    """Lexical hash in the low 32 bits, shape hash in the high ones."""
    before, core, after = EDGES.match(word).groups()
    case = "0" if core.isdigit() else "U" if core.isupper() and len(core) > 1 else "T" if core[:1].isupper() else "l" if core.islower() else "x" if core else "-"
    mixed = "d" if any(c.isdigit() for c in core) else ""
    inner = "p" if re.search(r"\W", core) else ""
    shape = f"{before[:3]}|{case}{mixed}{inner}|{after[:3]}|{min(len(core) // 4, 6)}"
    return zlib.crc32(core.lower().encode("utf-8", "surrogatepass")) | zlib.crc32(shape.encode("utf-8", "surrogatepass")) << 32


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature ids and their values, square roots of relative counts; the whole text counts."""
    words = text.split() if text else []
    bias = np.array([0], np.int64)
    if not words:
        return bias, np.ones(1)
    if len(_MEMO) > MEMO_WORDS:
        _MEMO.clear()
    for w in set(words).difference(_MEMO):
        _MEMO[w] = _word(w)
    both = np.fromiter(map(_MEMO.__getitem__, words), np.uint64, len(words))
    lexical, shape = both & np.uint64(0xFFFFFFFF), both >> np.uint64(32)
    pairs = shape[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ shape[1:]
    bigrams = lexical[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ lexical[1:]
    repeats = [np.full(int((lexical[k:] == lexical[:-k]).sum()), 977 + k, np.uint64) for k in LAGS if k < len(words)]
    families = [lexical, shape * np.uint64(3) + np.uint64(1), pairs * np.uint64(5) + np.uint64(2), bigrams * np.uint64(7) + np.uint64(3), *repeats]
    ids = np.concatenate(families) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)
    ids, counts = np.unique(ids, return_counts=True)
    return np.append(bias, ids.astype(np.int64) + 1), np.append(1.0, np.sqrt(counts / len(words)))


class Ftrl:
    """Follow-the-regularised-leader, per coordinate, for logistic loss."""

    def __init__(self, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)

    def weights(self, ids: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[ids], self.n[ids]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def update(self, ids: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(ids)
        gradient = (logistic(w @ values) - label) * values
        squared = gradient * gradient
        step = (np.sqrt(self.n[ids] + squared) - np.sqrt(self.n[ids])) / self.alpha
        self.z[ids] += gradient - step * w
        self.n[ids] += squared


def logistic(x: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0))))


def train(
    docs: DataFrame, labels: DataFrame, key_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = 8000, epochs: int = 4
) -> np.ndarray:
    """Weights learned from about ``sample_docs`` labelled rows (all, if there are fewer), taken by a hash of the key.

    Labels other than 0 and 1 are left out.  Without labelled rows all weights are zero and
    every score is one half.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(key_col).isNotNull()).select(F.col(key_col).alias("key"), F.col(label_col).cast("int").alias("label"))
    scale = 1 << 30
    size = known.count()
    if size > sample_docs:
        known = known.where(F.pmod(F.xxhash64("key"), F.lit(scale)) < int(sample_docs / size * scale))
    texts = docs.select(F.col(key_col).alias("key"), F.col(text_col).alias("text"))
    sample = texts.join(F.broadcast(known), "key").select(F.xxhash64("key").alias("rank"), "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t) for t in batch.column(2).to_pylist()]
            ids = pa.array([i.astype(np.int32).tobytes() for i, _ in rows], pa.binary())
            values = pa.array([v.astype(np.float32).tobytes() for _, v in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids, values], names=["rank", "label", "ids", "values"])

    table = map_arrow(sample, run, "rank long, label int, ids binary, values binary").toArrow()
    ranks = table.column("rank").to_numpy()
    order = np.argsort(ranks, kind="stable")
    labelled = table.column("label").to_numpy()
    packed = list(zip(table.column("ids").to_pylist(), table.column("values").to_pylist()))
    learner = Ftrl()
    for _ in range(epochs):
        for k in order:
            ids, values = packed[k]
            learner.update(np.frombuffer(ids, np.int32), np.frombuffer(values, np.float32).astype(float), int(labelled[k]))
    return learner.weights().astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``score``, the probability of label 1.

    Null and empty texts are scored by the intercept alone.  A column named ``score`` is replaced.
    """
    source = docs.drop("score")
    schema = T.StructType([*source.schema, T.StructField("score", T.DoubleType())])
    text_at, shared = source.columns.index(text_col), source.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            out = []
            for text in batch.column(text_at).to_pylist():
                ids, values = features(text)
                out.append(logistic(float(own[ids] @ values)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, "score"])

    return map_arrow(source, run, schema)
