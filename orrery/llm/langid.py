"""Language identification by multilingual mixture inference.

A document is a bag of hashed character trigrams drawn from a mixture of languages and one
flat background.  Expectation-maximisation estimates the shares; languages enter the mixture
one by one while the log-likelihood rises by more than a penalty per language (a multiple of
``log N / 2``).  The prediction is the learned language of the largest share.

Trigram counts per language are gathered by Spark over a sample whose expected size per
language is a parameter; the model is one table of ``DIMENSIONS`` rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.session import map_arrow

BITS = 15
DIMENSIONS = 1 << BITS
MAX_LANGUAGES = 512
UNDETERMINED = "und"
HAS_LETTER = regex.compile(r"\p{L}")
#: Odd multipliers of the trigram hash.
MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
ROUNDS, TOLERANCE = 25, 1e-4

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams over letters and single gaps, as (ids, counts); the whole text counts."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    keep = letter | np.concatenate(([True], letter[:-1]))
    codes = np.where(letter, codes, 32).astype(np.uint32)[keep]
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0)
    mixed = codes[:-2] * MIX[0] ^ codes[1:-1] * MIX[1] ^ codes[2:] * MIX[2]
    counts = np.bincount((mixed * MIX[0]) >> np.uint32(32 - BITS), minlength=DIMENSIONS)
    ids = counts.nonzero()[0]
    return ids, counts[ids].astype(float)


@dataclass
class LanguageModel:
    """``shares[f, l]``: probability of trigram ``f`` in language ``l``; the last column is the background.

    ``breadth`` bounds how many languages are tried at a step, those first whose share would
    raise the likelihood fastest; None tries every one that would raise it.
    """

    languages: list[str]
    shares: np.ndarray
    penalty: float = 4.0
    breadth: int | None = None

    def mixture(self, text: str | None) -> dict[str, float]:
        """Shares of the selected languages, the background under an empty name; empty without letters."""
        if not text or not self.languages or HAS_LETTER.search(text) is None:
            return {}
        ids, counts = trigrams(text)
        if not len(ids):
            return {}
        table, total = self.shares[ids], counts.sum()
        single = counts @ np.log(table)
        chosen = [int(single[:-1].argmax())]
        weights, best = np.ones(1), single[chosen[0]]
        price = self.penalty * 0.5 * np.log(total + 1)
        while len(chosen) < table.shape[1]:
            density = table[:, chosen] @ weights
            gain = (counts / density) @ table - total
            others = [l for l in np.argsort(-gain) if gain[l] > 0 and l not in chosen][: self.breadth]
            fits = [(*self._fit(table[:, [*chosen, l]], counts, weights), int(l)) for l in others]
            if not fits:
                break
            likelihood, shares, language = max(fits, key=lambda x: x[0])
            if likelihood - best <= price:
                break
            chosen, weights, best = [*chosen, language], shares, likelihood
        names = [*self.languages, ""]
        return {names[l]: float(w) for l, w in zip(chosen, weights)}

    @staticmethod
    def _fit(table: np.ndarray, counts: np.ndarray, start: np.ndarray) -> tuple[float, np.ndarray]:
        """Expectation-maximisation from the old shares and a tenth for the new one."""
        weights, total, before = np.append(start * 0.9, 0.1), counts.sum(), -np.inf
        for _ in range(ROUNDS):
            joint = table * weights
            density = joint.sum(axis=1)
            likelihood = counts @ np.log(density)
            weights = (counts / density) @ joint / total
            if likelihood - before < TOLERANCE * total:
                break
            before = likelihood
        return float(counts @ np.log(table @ weights)), weights

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, its share, the background's share)."""
        mixture = self.mixture(text)
        named = {k: v for k, v in mixture.items() if k}
        if not named:
            return UNDETERMINED, 0.0, 0.0
        language = max(named, key=named.get)
        return language, min(1.0, max(0.0, named[language])), mixture.get("", 0.0)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", sample_docs: int = 3000, smoothing: float = 0.5) -> LanguageModel:
    """Learn from rows whose text and language are not null.

    About ``sample_docs`` rows a language are counted, taken by a hash of ``key_col`` (all, if
    there are fewer).  Without any such row the model has no language and predicts ``und``.
    """
    labelled = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(key_col).alias("key"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    )
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return LanguageModel([], np.zeros((DIMENSIONS, 1)))
    languages = sorted(sizes)
    scale = 1 << 30
    cut = F.create_map(*[x for l in languages for x in (F.lit(l), F.lit(int(min(1.0, sample_docs / sizes[l]) * scale)))])
    sample = labelled.where(F.pmod(F.xxhash64("key"), F.lit(scale)) < F.element_at(cut, F.col("lang"))).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, counts = trigrams(text)
                totals.setdefault(lang, np.zeros(DIMENSIONS))[ids] += counts
        for lang, counts in totals.items():
            ids = counts.nonzero()[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(ids), pa.string()), pa.array(ids.astype(np.int32)), pa.array(counts[ids].astype(np.int64))], names=["lang", "gram", "n"]
            )

    counts = map_arrow(sample, run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((DIMENSIONS, len(languages) + 1), smoothing)
    at = {l: k for k, l in enumerate(languages)}
    columns = np.array([at[l] for l in counts.column("lang").to_pylist()], np.int64)
    if len(columns):
        np.add.at(table, (counts.column("gram").to_numpy(), columns), counts.column("n").to_numpy())
    table[:, -1] = 1.0
    return LanguageModel(languages, table / table.sum(axis=0))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``lang_pred``, ``score`` (share of that language) and ``background`` (share of no language).

    ``lang_pred`` is ``und`` with score 0 where the text is null or has no letter, or nothing
    was learned.  Columns of these names are replaced; rows are neither merged nor dropped.
    """
    added = {"lang_pred": T.StringType(), "score": T.DoubleType(), "background": T.DoubleType()}
    source = docs.drop(*added)
    schema = T.StructType([*source.schema, *(T.StructField(k, t) for k, t in added.items())])
    text_at, shared = source.columns.index(text_col), source.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.predict(text) for text in batch.column(text_at).to_pylist()]
            made = [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *added])

    return map_arrow(source, run, schema)
