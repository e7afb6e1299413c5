import random
from collections import defaultdict

import pytest

from orrery.operators import trees


def frame(spark, pairs):
    return spark.createDataFrame(list(pairs), "src long, dst long")


def parts(nodes, edges):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    label = {}
    for n in sorted(nodes):
        todo = [n] if n not in label else []
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = n
                todo += near[x]
    return label


def graph(seed, nodes=60, edges=70):
    rng = random.Random(seed)
    out = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)]
    out += [(k, k + 1) for k in range(100, 130)] + [(130, 110), (5, 100)] + [(200, k) for k in range(201, 220)]
    return out + out[:9] + [(b, a) for a, b in out[:4]]


@pytest.mark.parametrize("seed", [1])
def test_bridges_and_clusters_equal_brute_force(spark, seed):
    edges = graph(seed)
    links = {(min(e), max(e)) for e in edges if e[0] != e[1]}
    nodes = {n for e in edges for n in e} | {999}
    count = len(set(parts(nodes, links).values()))
    want = {e for e in links if len(set(parts(nodes, links - {e}).values())) > count}
    got = {tuple(r) for r in trees.bridges(frame(spark, edges)).collect()}
    assert got == want and want
    clusters = {r["node"]: r["cluster"] for r in trees.bridge_clusters(spark.createDataFrame([(n,) for n in nodes], "node long"), frame(spark, edges)).collect()}
    assert clusters == parts(nodes, links - want)


def test_no_edges(spark):
    none = frame(spark, [])
    assert trees.bridges(none).collect() == []
    assert trees.bridges(frame(spark, [(1, 1), (2, 2)])).collect() == []
    out = trees.tree_layout(spark.createDataFrame([(4,), (2,), (4,)], "node long"), none)
    assert sorted((r["node"], r["x"], r["y"]) for r in out.collect()) == [(2, 28.0, 0.0), (4, 84.0, 0.0)]


def test_layout_equals_recursion(spark):
    edges = graph(3)
    nodes = {n for e in edges for n in e} | {998, 999}
    out = {r["node"]: r for r in trees.tree_layout(spark.createDataFrame([(n,) for n in nodes], "node long"), frame(spark, edges)).collect()}
    assert set(out) == nodes
    links = {(min(e), max(e)) for e in edges}
    kids, label = defaultdict(list), parts(nodes, links)
    for n, r in out.items():
        if r["parent"] is None:
            assert label[n] == n
        else:
            assert (min(n, r["parent"]), max(n, r["parent"])) in links
            kids[r["parent"]].append(n)

    def width(n):
        return sum(map(width, kids[n])) or 1

    def place(n, depth, left):
        assert (out[n]["depth"], out[n]["width"]) == (depth, width(n))
        assert out[n]["x"] == pytest.approx((left + width(n) / 2) * trees.X_GAP) and out[n]["y"] == depth * trees.Y_GAP
        for k in sorted(kids[n]):
            place(k, depth + 1, left)
            left += width(k)

    left = 0
    tops = [n for n, r in out.items() if r["parent"] is None]
    touched = {n for e in edges if e[0] != e[1] for n in e}
    for n in sorted(tops, key=lambda n: (n not in touched, n)):
        place(n, 0, left)
        left += width(n)


def test_long_path_takes_few_rounds(spark, monkeypatch):
    n, jumps = 10_000, []
    real = trees.write_table
    monkeypatch.setattr(trees, "write_table", lambda df, path: (jumps.append(path), real(df, path))[1])
    edges = spark.range(n - 1).selectExpr("id * 7919 % 10007 AS src", "(id + 1) * 7919 % 10007 AS dst")
    tree = trees.rooted_forest(edges, spark.createDataFrame([(0,)], "node long"))
    assert len([p for p in jumps if "/jump" in p]) < 30
    rows = {r["node"]: r for r in tree.collect()}
    assert all((rows[k * 7919 % 10007]["depth"], rows[k * 7919 % 10007]["pre"], rows[k * 7919 % 10007]["size"]) == (k, k, n - k) for k in range(n))


def test_hundred_thousand_edges(spark):
    """A cycle of 50,000 nodes with a whisker at each: the whiskers are the bridges."""
    n = 50_000
    ring = spark.range(n).selectExpr("id AS src", f"(id + 1) % {n} AS dst")
    whiskers = spark.range(n).selectExpr("id AS src", f"id + {n} AS dst")
    out = trees.bridges(ring.unionByName(whiskers))
    assert out.count() == n and out.where(f"dst <> src + {n}").isEmpty()


@pytest.mark.parametrize("asked", [[], [204, 130, 17]])
def test_leaves_are_shed_before_the_tour(spark, monkeypatch, asked):
    """Stars on stars: nothing is left to tour, unless a root that was asked for is a leaf."""
    toured = []
    real = trees.tour_places
    monkeypatch.setattr(trees, "tour_places", lambda arcs, folder: (toured.append(arcs.count()), real(arcs, folder))[1])
    edges = [(1, k) for k in range(10, 20)] + [(k % 10 + 10, k) for k in range(100, 400)] + [(500, 501)]
    roots = spark.createDataFrame([(n,) for n in asked], "node long") if asked else None
    nodes = sorted({n for e in edges for n in e})
    out = {r["node"]: r for r in trees.tree_layout(spark.createDataFrame([(n,) for n in nodes], "node long"), frame(spark, edges), roots).collect()}
    assert sorted(out) == nodes and (sum(toured) < 20 if asked else toured == [])
    assert [n for n in nodes if out[n]["parent"] is None] == ([17, 500] if asked else [1, 500])
    kids = defaultdict(list)
    for n, r in out.items():
        kids[r["parent"]].append(n)

    def place(n, left):
        width = sum(place(k, left + sum(out[j]["width"] for j in kids[n] if j < k)) for k in kids[n]) or 1
        assert out[n]["width"] == width and out[n]["x"] == (left + width / 2) * trees.X_GAP
        return width

    place(500, place(17 if asked else 1, 0))


def test_bridges_of_stars_need_no_tour(spark, monkeypatch):
    toured = []
    monkeypatch.setattr(trees, "rooted_forest", lambda *a: toured.append(a))
    edges = [(1, k) for k in range(10, 20)] + [(k % 10 + 10, k) for k in range(100, 400)] + [(500, 501)]
    assert {tuple(r) for r in trees.bridges(frame(spark, edges)).collect()} == set(edges) and not toured
