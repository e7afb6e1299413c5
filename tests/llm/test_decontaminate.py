import random
import re

import pytest

from orrery.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def brute(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        q = words(t)
        for at in range(max(1, len(q) - window + 1)) if q else ():
            pattern = q[at : at + window]
            for s in range(len(w) - len(pattern) + 1):
                if w[s : s + len(pattern)] == pattern:
                    hit |= set(range(s, s + len(pattern)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def cases():
    rng = random.Random(1)
    vocabulary = [f"w{n}" for n in range(30)] + ["Été", "x9"]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(n, line(rng.choice([1, 2, 3, 9, 10, 11, 25]))) for n in range(20)] + [(20, None), (21, "..."), (3, line(12)), (22, "")]
    docs = [(n, line(rng.choice([0, 1, 5, 40, 200]))) for n in range(40)]
    docs += [(n + 50, f"{line(20)}, {items[n % 20][1].upper()}! {line(5)}") for n in range(20)]
    docs += [(90, None), (91, ""), (92, "?!"), (93, f"{items[2][1]} " * 300), (None, items[3][1])]
    return docs, items


@pytest.mark.parametrize("chunk", [8_000_000, 400])
def test_spans_and_items_equal_brute_force(spark, chunk):
    docs, items = cases()
    table = spark.createDataFrame([(i, t, "own") for i, t in docs], "doc_id long, text string, hit_items string")
    found = D.find_contamination(table, spark.createDataFrame(items, "item_id long, text string"), chunk_chars=chunk)
    got = sorted((str(r["doc_id"]), r["n_words"], r["n"], r["hit_items"]) for r in found.withColumn("n", D.n_hit()).collect())
    assert got == sorted((str(i), *brute(t, items)) for i, t in docs)


def test_offsets_point_into_the_original(spark):
    docs = spark.createDataFrame([(1, "Ab-cd: ONE, two... Three é end")], "doc_id long, text string")
    found = D.find_contamination(docs, spark.createDataFrame([(1, "one two three É"), (2, "one two three é")], "item_id long, text string"))
    row = found.first()
    assert [row["text"][s["start"] : s["end"]] for s in row["hit_spans"]] == ["ONE, two... Three é"]


@pytest.mark.parametrize("letters", [D.LETTERS, 5])
def test_one_scan_gives_counts_and_offsets(letters):
    """With more words than letters, words are matched as numbers."""
    docs, items = cases()
    matcher = D.Matcher([(str(i), t) for i, t in items], letters=letters)
    assert matcher.wide == (letters == 5)
    for _, text in [*docs, (0, "𝄞 é" + items[0][1] + "\x00ü " + items[3][1] + "𝄞")]:
        n, spans, names = matcher.scan(text)
        want = brute(text, items)
        assert (n, sum(b - a + 1 for a, b, _, _ in spans), sorted(names)) == want
        places = [m.span() for m in WORD.finditer((text or "").translate(FOLD))]
        assert all((places[a][0], places[b][1]) == (start, end) for a, b, start, end in spans)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert D.find_contamination(docs.limit(0), items).count() == 0
    assert D.find_contamination(docs, items.limit(0)).first()["hit_items"] == []
