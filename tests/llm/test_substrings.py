import random
from collections import Counter

import numpy as np
import pytest

from orrery.llm import substrings


def brute(rows, length):
    split = [(i, [w for w in (t or "").translate({ord(b): " " for b in "\t\n\x0b\x0c\r"}).split(" ") if w]) for i, t in rows]
    seen = Counter(tuple(w[k : k + length]) for _, w in split for k in range(len(w) - length + 1))
    out = []
    for i, words in split:
        gone = {m for k in range(len(words) - length + 1) if seen[tuple(words[k : k + length])] > 1 for m in range(k, k + length)}
        out.append((i, len(words), len(gone), " ".join(w for m, w in enumerate(words) if m not in gone)))
    return sorted(out, key=str)


def run(docs, length, size):
    out = substrings.drop_repeats(docs, length=length, size=size)
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in out.collect()), key=str)


def corpus(seed, docs=60, vocabulary=400):
    """Texts with shared passages, copies, copies with edits, repeats of their own and periodic stretches."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    passages = [[word() for _ in range(rng.randrange(5, 60))] for _ in range(6)]
    rows = []
    for n in range(docs):
        kind, words = rng.randrange(6), [word() for _ in range(rng.randrange(0, 90))]
        if kind == 0 and rows:
            words = list(rng.choice(rows)[1])
            for _ in range(rng.randrange(3)):
                if words:
                    words[rng.randrange(len(words))] = word()
        elif kind in (1, 2):
            at = rng.randrange(len(words) + 1)
            whole = rng.choice(passages)
            words[at:at] = whole[rng.randrange(3) : len(whole) - rng.randrange(3)]
        elif kind == 3:
            words += words[: rng.randrange(len(words) + 1)]
        elif kind == 4:
            words += ["tick", "tock"] * rng.randrange(20)
        rows.append((n, words))
    return [(n, " ".join(words)) for n, words in rows]


@pytest.mark.parametrize(("seed", "length", "size"), [(1, 12, 3), (2, 35, 8), (3, 8, 8), (4, 5, 1)])
def test_drop_repeats_equals_brute_force(spark, seed, length, size):
    rows = corpus(seed)
    rows += [(100, None), (101, ""), (102, " \n\t"), (5, rows[5][1]), (None, rows[6][1]), (None, rows[6][1]), (5, rows[7][1] + " other"), (103, " " * 3), (104, "x " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'kept' AS n_words", "3 AS spans").repartition(5)
    assert substrings.drop_repeats(docs, length=length, size=size).columns == ["doc_id", "text", "spans", "n_words", "n_removed", "kept_text"]
    assert run(docs, length, size) == brute(rows, length)


def test_equal_groups_cut_into_ranges(spark):
    """A passage that many rows hold crosses the ends of many ranges."""
    rng = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(n, " ".join(f"u{n}-{k}" for k in range(rng.randrange(9))) + " " + passage + f" e{n % 3} f{n}") for n in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert run(docs, 35, 8) == brute(rows, 35)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_text_ids(spark):
    rows = [("a", "one two three four five six"), ("b", "zero one two three four five seven"), (None, "alone")]
    out = substrings.drop_repeats(spark.createDataFrame(rows, "doc_id string, text string"), length=4, size=2)
    assert {r["doc_id"]: (r["n_removed"], r["kept_text"]) for r in out.collect()} == {"a": (5, "six"), "b": (5, "zero seven"), None: (0, "alone")}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.drop_repeats(docs).collect() == []


def test_hashes_of_runs_are_of_their_words():
    words = substrings.Words([b"a b c a b c", b"c a b c", None])
    first = np.arange(len(words.row) - 2)
    hashes = words.runs(first, first + 3, "window")
    texts = ["a b c", "b c a", "c a b", "a b c", "b c c", "c c a", "c a b", "a b c"]
    assert len(set(texts)) == len(set(hashes.tolist())) and all((texts[i] == texts[j]) == (hashes[i] == hashes[j]) for i in range(8) for j in range(8))


def test_winnowing_takes_the_last_smallest():
    grams = np.array([5, 3, 3, 9, 1, 1, 4], np.uint64)
    assert substrings.winnow(grams, 3).tolist() == [2, 2, 4, 5, 5]
