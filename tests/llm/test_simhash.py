import random
from collections import defaultdict

import pytest
import xxhash

from orrery.llm import similar, simhash

BLANKS = " \t\n\x0b\x0c\r"


def brute_fingerprint(text, k):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in BLANKS:
            words, word = words + [word] * bool(word), ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


TEXTS = [None, "", " \n ", "One", "one ", "ONE two", "a b c", "a b c d e f g h", "A b c d e f g h", "é É x y z", "x\u00a0y z w", "w " * 5000, "w " * 5001]


def test_fingerprint_of_odd_texts_equals_brute_force():
    for text in TEXTS:
        for k in (3, 5):
            assert simhash.fingerprint(text, k) == brute_fingerprint(text, k)


def test_spark_hash_agrees(spark):
    from pyspark.sql import functions as F

    value = spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first()["h"]
    assert value % 2**64 == xxhash.xxh64_intdigest(b"a b c", seed=42)


def test_groups_equal_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{n}" for n in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice([4, 60, 200]))) for _ in range(25)]
    texts = list(TEXTS) + base
    for t in base:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts += [" ".join(w), t.upper()]
    rows = [(n, t, "clash") for n, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.simhash_groups(docs, shingle=3).collect()}
    prints = [brute_fingerprint(t, 3) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= 2]
    assert got == dict(enumerate(components(len(texts), links)))


@pytest.mark.parametrize("limit", [2, 64])
def test_links_keep_the_closure_on_either_route(spark, limit):
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    prints = {centre} | {rng.getrandbits(64) for _ in range(100)}
    while len(prints) < 260:
        x = centre
        for _ in range(rng.randint(1, 4)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    signed = [x - (x >> 63 << 64) for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    at = {x: n for n, x in enumerate(signed)}
    got = [(at[r["src"]], at[r["dst"]]) for r in simhash.link_fingerprints(df, 2, limit).collect()]
    near = lambda a, b: bin((signed[a] ^ signed[b]) & (2**64 - 1)).count("1") <= 2
    assert all(near(a, b) for a, b in got)
    links = [(a, b) for a in range(len(signed)) for b in range(a) if near(a, b)]
    assert components(len(signed), got) == components(len(signed), links)


def test_null_ids_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "x"), (None, "x"), (3, "x"), (3, "x"), (None, "alone")], "doc_id long, text string")
    want = [("3", "3"), ("3", "3"), ("None", "3"), ("None", "3"), ("None", "None")]
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in simhash.simhash_groups(docs).collect())
    assert got == want
    assert simhash.simhash_groups(docs.limit(0)).count() == 0
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in similar.similar_groups(docs).collect())
    assert got == want
    assert similar.similar_groups(docs.limit(0)).count() == 0


def test_similar_groups_find_near_copies_and_leave_others(spark):
    rng = random.Random(5)
    words = [f"w{n}" for n in range(2000)]
    base = [[rng.choice(words) for _ in range(150)] for _ in range(60)]
    rows, group = [], defaultdict(set)
    for n, w in enumerate(base):
        for copy in range(4):
            v = list(w)
            if copy:
                v[rng.randrange(150)] = "other"
            rows.append((n * 10 + copy, " ".join(v)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in similar.similar_groups(docs).collect():
        group[r["component_id"]].add(r["doc_id"])
    assert all(len({i // 10 for i in g}) == 1 for g in group.values())
    assert len(group) <= 63


def test_links_send_no_table_to_the_driver(spark):
    """The size of exploded and checkpointed variants is a guess, so they were broadcast however many there were."""
    fps = spark.range(200).selectExpr("xxhash64(id DIV 2) ^ (id % 2) AS fp")
    links = simhash.link_fingerprints(fps)
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()
    assert links.count() == 100
