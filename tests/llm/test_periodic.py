import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from orrery.llm import periodic
from orrery.llm.queries import with_tails

BLANKS = " \t\n\x0b\x0c\r"


def brute_runs(words, min_length=6, copies=4):
    n, found = len(words), {}
    for p in range(1, n // copies + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i + p - start >= max(min_length, copies * p):
                found.setdefault((start, i + p - start), p)
    return sorted((s, length, p) for (s, length), p in found.items())


def brute(text, min_length=6, copies=4):
    words = [w for w in (text or "").translate({ord(b): " " for b in BLANKS}).split(" ") if w]
    runs = brute_runs(words, min_length, copies)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in sorted(runs, key=lambda r: (r[0], r[2])))
    exponent = 1000 * top[1] // top[2] if runs else None
    return (len(words), len(runs), *top, exponent, hashlib.sha256(listed.encode()).hexdigest(), " ".join(w for i, w in enumerate(words) if i not in gone))


@pytest.mark.parametrize("letters", [1, 2, 3, 8])
def test_runs_equal_brute_force(letters):
    rng = random.Random(letters)
    for _ in range(400):
        words = [rng.randrange(letters) for _ in range(rng.randrange(0, 70))]
        for _ in range(rng.randrange(3)):
            part = [rng.randrange(letters) for _ in range(rng.randrange(1, 6))]
            at = rng.randrange(len(words) + 1)
            words[at:at] = part * rng.randrange(2, 9)
        got = periodic.periodic_runs(np.array(words, np.int64))
        assert sorted(map(tuple, got.tolist())) == brute_runs(words)
        assert got.tolist() == sorted(got.tolist(), key=lambda r: (r[0], r[2]))


def test_texts_beyond_the_kept_grid():
    rng = random.Random(5)
    part = [rng.randrange(300) for _ in range(900)]
    words = [rng.randrange(40) for _ in range(1000)] + part * 4 + part[:17] + [7] * 50 + [rng.randrange(40) for _ in range(900)]
    assert len(words) > periodic.GRID_WORDS
    assert sorted(map(tuple, periodic.periodic_runs(np.array(words)).tolist())) == brute_runs(words)


TEXTS = [
    None,
    "",
    " \t\n",
    "one two three",
    "a a a a a",
    "a a a a a a",
    "x " + "go on " * 4 + "y",
    "            tail",
    "a b a b a b a b c c c c c c c a b a b a b a b",
    "Été " * 30 + "the end",
    "spam eggs ham\n" * 1500,
]


def test_detect_runs_equals_brute_force(spark):
    rows = [(n, t, 5, "own") for n, t in enumerate(TEXTS)] + [(None, TEXTS[6], 6, None), (6, TEXTS[6], 6, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs int, source string")
    out = periodic.detect_runs(docs)
    assert out.columns == ["doc_id", "text", "source", *[f.split()[0] for f in periodic.MADE.split(", ")]]
    got = sorted((str(r["doc_id"]), r["source"] or "", *tuple(r)[3:]) for r in out.collect())
    assert got == sorted((str(i), s or "", *brute(t)) for i, t, _, s in rows)
    assert periodic.detect_runs(docs.limit(0)).collect() == []


def test_only_runs_of_four_periods(spark):
    with pytest.raises(ValueError):
        periodic.periodic_runs(np.zeros(9, np.int64), copies=2)


def test_tails_follow_the_rule(spark):
    rng = random.Random(3)
    rows = [(i, None if i % 50 == 0 else " \n".join(rng.choice("abcdefgh") for _ in range(rng.randrange(40)))) for i in range(400)]
    got = {r["doc_id"]: r["text"] for r in with_tails(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    changed = 0
    for i, text in rows:
        words, h = (text or "").split(), zlib.crc32(str(i).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
            changed += 1
        assert (got[i] or "").split() == words
    assert changed > 20
