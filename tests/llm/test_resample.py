import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from orrery.llm import resample

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def buckets_of(text, longest, size):
    words = words_of(text)
    runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return [zlib.crc32(r.encode()) % size for r in runs]


def brute(docs, target, percent, min_words, longest, size, seed):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(buckets_of(text, longest, size))
    for text in target:
        t.update(buckets_of(text, longest, size))
    ns, nt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (ns + size) / ((s[b] + 1.0) * (nt + size)))) for b in range(size)}
    rows = []
    for i, text in docs:
        found = buckets_of(text, longest, size)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append((i, len(words_of(text)), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    drawn = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0]))
    take = percent * len(drawn) // 100
    out = [(i, n, w, s, k + 1 if k < take else None) for k, (i, _, n, w, s) in enumerate(drawn)]
    return out + [(i, n, w, s, None) for i, words, n, w, s in rows if words < min_words]


ROWS = [
    (1, "The cat sat on the mat. " * 9),
    (2, None),
    (3, ""),
    (4, "ÉTÉ été 东京 tokyo TOKYO " * 6),
    (5, "!?,;"),
    (6, "word " * 60_000),
    (None, "no id here " * 10),
    (7, "same text twice " * 8),
    (7, "same text twice " * 8),
    (8, "benchmark like question about geology " * 5),
    *[(n, f"filler number {n} about things " * (n % 9 + 1)) for n in range(20, 80)],
]
TARGET = ["Benchmark question about GEOLOGY", None, ""]


@pytest.mark.parametrize(("longest", "percent", "size"), [(1, 10, 10_000), (3, 100, 50), (2, 0, 997)])
def test_resample_equals_brute_force(spark, longest, percent, size):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumnsRenamed({}).selectExpr("doc_id", "text", "'kept' AS rank", "1 AS weight").repartition(5)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    out = resample.resample(docs, target, percent, 20, longest, size, 7)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(brute(ROWS, TARGET, percent, 20, longest, size, 7), key=str)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert resample.resample(none, none).collect() == []
    assert resample.resample(none, some).collect() == []
    assert resample.resample(some, none).count() == len(ROWS)


def test_many_equal_rows_get_ranks_of_their_own(spark):
    rows = spark.range(3000).selectExpr("1L AS id", "5L AS score").repartition(7)
    out = resample.ranked(rows, [rows["score"].desc(), rows["id"].asc()], 3000)
    assert sorted(r["rank"] for r in out.collect()) == list(range(1, 3001))


def test_drawn_documents_are_whole_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "'own' AS source")
    out = resample.drawn_documents(docs, resample.resample(docs, docs, 50))
    assert out.columns == docs.columns and 0 < out.count() < len(ROWS)


def test_counts_are_of_the_whole_corpus(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(6)
    want = np.zeros(100, np.int64)
    for _, text in ROWS:
        for b in buckets_of(text, 2, 100):
            want[b] += 1
    assert (resample.feature_counts(docs, "text", 2, 100) == want).all()
