"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece of text exactly one token can be the last token of its BPE
encoding.  An automaton over the reversed-suffix matches of the vocabulary lists the tokens
that end at each byte; a token is the last one of a prefix if it is compatible with the last
token of the prefix before it, that is, if BPE would never merge across their boundary.
Following the stored tokens backwards yields the ids, in time linear in the text for a
fixed vocabulary, also for pieces of any length without a space.

Texts are first cut at added tokens and by the tokenizer's splitting pattern; encodings of
pieces are kept in a bounded memo.
"""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.session import map_arrow, worker_cache

#: Fixed value: the public byte-level splitting pattern.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters outside these ranges may have another class in the tokenizer's Unicode tables.
UNUSUAL = regex.compile("[^\x00-՗‐-‧‰-⁞₠-₿←-⏿　-ヿ一-龥가-힣]")
MEMO_PIECES = 500_000
NO_LIMIT = sys.maxsize
#: A vocabulary is sent to every executor; larger files are refused.
MAX_FILE_BYTES = 64_000_000


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in byte-level vocabularies: itself, or the next from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable}
    rest = [b for b in range(256) if b not in set(printable)]
    return letters | {chr(256 + n): b for n, b in enumerate(rest)}


def refuse(config: dict) -> None:
    """Raise an error for a tokenizer file whose ids this coder would get wrong."""
    model, steps = config["model"], config.get("pre_tokenizer") or {}
    steps = steps.get("pretokenizers", [steps])
    wrong = [
        ("a model other than BPE", model.get("type", "BPE") != "BPE"),
        ("a normalizer", config.get("normalizer")),
        ("a pre-tokenizer other than the plain byte-level one", [s.get("type") for s in steps] != ["ByteLevel"] or steps[0].get("add_prefix_space") or steps[0].get("use_regex") is False),
        ("byte fallback", model.get("byte_fallback")),
        ("ignored merges", model.get("ignore_merges")),
        ("dropout", model.get("dropout")),
        ("affixes of subwords", model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")),
        ("added tokens with flags", any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") and not t.get("special") for t in config.get("added_tokens", []))),
    ]
    if found := [what for what, bad in wrong if bad]:
        raise ValueError(f"tokenizer files with {', '.join(found)} are not supported")


class Bpe:
    """Encoder and decoder of one byte-level tokenizer file."""

    def __init__(self, definition: str):
        config = json.loads(definition)
        refuse(config)
        model, letters = config["model"], byte_letters()
        raw = {i: bytes(letters[c] for c in token) for token, i in model["vocab"].items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        vocab = model["vocab"]
        self.born: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for rank, (left, right) in enumerate(merges):
            token = vocab[left + right]
            if token not in self.born:
                self.born[token] = rank
                self.parts[token] = (vocab[left], vocab[right])
            self.merged[vocab[left], vocab[right]] = rank
        self.tokens = dict(raw)
        self.added = {t["content"]: t["id"] for t in config.get("added_tokens", [])}
        self.tokens |= {i: text.encode() for text, i in self.added.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.matches = ahocorasick.Automaton()
        for token, text in raw.items():
            if token not in self.parts or self._reachable(token):
                self.matches.add_word(text.decode("latin-1"), (len(text), token))
        self.matches.make_automaton()
        self._pairs: dict[tuple[int, int], bool] = {}
        self._memo: dict[str, bytes] = {}
        self._definition, self._splitter = definition, None

    def _reachable(self, token: int) -> bool:
        """Whether BPE turns the token's own bytes into it."""
        todo = [token]
        while todo:
            t = todo.pop()
            if t in self.parts:
                left, right = self.parts[t]
                if self._merges_across(left, right, self.born[t]):
                    return False
                todo += (left, right)
        return True

    def _merges_across(self, left: int, right: int, limit: int = NO_LIMIT) -> bool:
        """Whether a merge older than ``limit`` joins bytes of both tokens before they are whole.

        The younger of the two facing tokens is taken apart again and again.  Merges of one
        rank go from left to right, so a merge across the boundary of the same rank as the
        right token's own comes first.
        """
        while True:
            rank = self.merged.get((left, right))
            if rank is not None and rank < limit:
                return True
            young_left, young_right = self.born.get(left, -1), self.born.get(right, -1)
            if young_left > young_right:
                limit, left = young_left, self.parts[left][1]
            elif young_right >= 0:
                limit, right = young_right + 1, self.parts[right][0]
            else:
                return False

    def _compatible(self, left: int, right: int) -> bool:
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) >= 500_000:
                self._pairs.clear()
            known = self._pairs[left, right] = not self._merges_across(left, right)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece; ``last[e]`` is the last token of the prefix of ``e`` bytes."""
        size = len(piece)
        last, start, done = [-1] * (size + 1), [0] * (size + 1), 0
        for at, (length, token) in self.matches.iter(piece.decode("latin-1")):
            end = at + 1
            if done == end:
                continue
            begin = end - length
            if begin == 0 or (last[begin] >= 0 and self._compatible(last[begin], token)):
                last[end], start[end], done = token, begin, end
        ids, end = [], size
        while end:
            ids.append(last[end])
            end = start[end]
        return ids[::-1]

    def _pieces(self, text: str) -> list[str]:
        if UNUSUAL.search(text) is None:
            return PIECES.findall(text)
        if self._splitter is None:
            from tokenizers import Tokenizer

            self._splitter = Tokenizer.from_str(self._definition).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._splitter.pre_tokenize_str(text)]

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        memo = self._memo
        if len(memo) > MEMO_PIECES:
            memo.clear()
        out = []
        for n, part in enumerate(self.cut.split(text) if self.cut and any(a in text for a in self.added) else [text]):
            if n % 2:
                out.append(np.array([self.added[part]], "<u4").tobytes())
            elif part:
                pieces = self._pieces(part)
                for piece in set(pieces).difference(memo):
                    memo[piece] = np.array(self.encode_piece(piece.encode("utf-8", "surrogatepass")), "<u4").tobytes()
                out += map(memo.__getitem__, pieces)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; bytes that are no UTF-8 become U+FFFD, unknown ids are left out."""
        none = b""
        return b"".join([self.tokens.get(i, none) for i in ids]).decode("utf-8", "replace")


def coder(definition: str) -> Bpe:
    """The coder of a tokenizer, kept by the Python worker."""
    return worker_cache(hashlib.sha256(definition.encode()).hexdigest(), lambda: Bpe(definition))


def read_tokenizer(path: str) -> str:
    """The tokenizer file, read once by the driver, its size checked."""
    with open(path, encoding="utf-8") as f:
        text = f.read(MAX_FILE_BYTES + 1)
    if len(text) > MAX_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MAX_FILE_BYTES} characters")
    return text


def encode_table(spark: SparkSession, docs: DataFrame, tokenizer_path: str, text_col: str = "text", decode: bool = True, ids: bool = True) -> DataFrame:
    """``docs`` plus ``n_tokens``, ``ids`` (int array), ``ids_sha256`` and the decoded text's ``decoded_sha256``.

    A null or empty text has no ids.  Columns of these names are replaced.  ``ids=False``
    leaves the arrays out, ``decode=False`` the decoded digest.
    """
    added = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType()), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    if not ids:
        added.pop("ids")
    if not decode:
        added.pop("decoded_sha256")
    source = docs.drop(*added)
    schema = T.StructType([*source.schema, *(T.StructField(k, t) for k, t in added.items())])
    text_at, shared = source.columns.index(text_col), spark.sparkContext.broadcast(read_tokenizer(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(shared.value)
        for batch in batches:
            counts, arrays, digests, decoded = [], [], [], []
            for value in batch.column(text_at):
                packed = bpe.encode_packed(value.as_py() or "")
                numbers = np.frombuffer(packed, "<u4")
                counts.append(len(numbers))
                digests.append(hashlib.sha256(packed).hexdigest())
                if ids:
                    arrays.append(numbers.astype(np.int32))
                if decode:
                    decoded.append(hashlib.sha256(bpe.decode(numbers.tolist()).encode()).hexdigest())
            made = {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(digests, pa.string())}
            made["ids"] = pa.array(arrays, pa.list_(pa.int32())) if ids else None
            made["decoded_sha256"] = pa.array(decoded, pa.string()) if decode else None
            yield pa.RecordBatch.from_arrays([*batch.columns, *(made[k] for k in added)], names=[*batch.schema.names, *added])

    return map_arrow(source, run, schema)


def decode_table(spark: SparkSession, rows: DataFrame, tokenizer_path: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` plus ``decoded``, the text of an id array; null for a null array."""
    source = rows.drop("decoded")
    schema = source.withColumn("decoded", F.lit("")).schema
    at, shared = source.columns.index(ids_col), spark.sparkContext.broadcast(read_tokenizer(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(shared.value)
        for batch in batches:
            texts = [None if v is None else bpe.decode(v) for v in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return map_arrow(source, run, schema)
