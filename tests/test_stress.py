import math
from collections import deque

from pyspark.sql import functions as F

from orrery.operators import stress


def two_cliques():
    edges = [(a, b) for base in (0, 10) for a in range(base, base + 6) for b in range(a + 1, base + 6)]
    return [*edges, (5, 10), (3, 3), (1, 0), (40, 41)]


def frames(spark, nodes, edges):
    return spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "src long, dst long")


def hops(edges, start):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    found, todo = {start: 0}, deque([start])
    while todo:
        a = todo.popleft()
        for b in near[a]:
            if b not in found:
                found[b] = found[a] + 1
                todo.append(b)
    return found


def test_stress_falls_and_linked_nodes_are_near(spark):
    nodes, edges = [*range(6), *range(10, 16), 40, 41, 99], two_cliques()
    places, seen = stress.stress_layout(*frames(spark, nodes, edges), pivots=3, steps=10)
    assert all(b <= a + 1e-6 for a, b in zip(seen, seen[1:])) and seen[-1] < 0.5 * seen[0]
    at = {r["node"]: (r["x"], r["y"]) for r in places.collect()}
    assert set(at) == set(nodes)
    distance = lambda a, b: math.dist(at[a], at[b])
    linked = [distance(a, b) for a, b in edges if a != b]
    apart = [distance(a, b) for a in range(5) for b in range(11, 16)]
    assert sum(linked) / len(linked) < 0.7 * sum(apart) / len(apart)


def test_terms_are_edges_and_pivot_distances(spark):
    edges = two_cliques()
    rows = stress.stress_terms(spark.createDataFrame(edges, "src long, dst long"), pivots=2).collect()
    links = {(min(e), max(e)) for e in edges if e[0] != e[1]}
    assert len(rows) <= 2 * (len(links) + 2 * 14) and len({(r["a"], r["b"]) for r in rows}) == len(rows)
    assert {(r["a"], r["b"]) for r in rows if r["d"] == 1 and r["a"] < r["b"]} == links
    for r in rows:
        assert hops([e for e in edges if e[0] != e[1]], r["a"])[r["b"]] == r["d"] and r["w"] == 1 / r["d"] ** 2


def test_nothing_to_pull(spark):
    nodes, edges = frames(spark, [1, 2], [])
    places, seen = stress.stress_layout(nodes, edges, steps=1)
    assert places.count() == 2 and seen == [0.0, 0.0]


def test_nodes_on_one_spot_part(spark):
    terms = spark.createDataFrame([(1, 2, 1.0, 1.0), (2, 1, 1.0, 1.0)], "a long, b long, d double, w double")
    places = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0)], "node long, x double, y double")
    out = stress.stress_step(terms, places)
    assert {r["node"]: (r["x"], r["y"]) for r in out.select("node", F.round("x").alias("x"), "y").collect()} == {1: (-30.0, 0.0), 2: (30.0, 0.0)}
