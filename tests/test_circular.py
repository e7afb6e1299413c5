import itertools
import random

import pytest

from orrery.operators import circular as C


def brute(pos, edges):
    links = sorted({(min(a, b), max(a, b)) for a, b in edges if a != b and a in pos and b in pos})
    total = 0
    for (a, b), (c, d) in itertools.combinations(links, 2):
        if len({a, b, c, d}) == 4:
            lo, hi = sorted((pos[a], pos[b]))
            total += (lo < pos[c] < hi) != (lo < pos[d] < hi)
    return total


def circle(seed, n=11, links=20):
    rng = random.Random(seed)
    nodes = rng.sample(range(100), n)
    return {v: k for k, v in enumerate(nodes)}, [(rng.choice(nodes), rng.choice(nodes)) for _ in range(links)]


def frames(spark, pos, edges):
    return spark.createDataFrame(list(pos.items()), "node long, pos long"), spark.createDataFrame(edges, "src long, dst long")


def without(pos, node):
    return [v for v in sorted(pos, key=pos.get) if v != node]


@pytest.mark.parametrize("seed", [1, 2])
def test_crossings_equal_brute_force(spark, seed):
    pos, edges = circle(seed)
    assert C.chord_crossings(*frames(spark, pos, [*edges, (1000, 1001)])) == brute(pos, edges) > 0


@pytest.mark.parametrize("n", [10, 11])
@pytest.mark.parametrize("odd", [0, 1])
def test_gains_of_swaps_are_exact_and_add_up(spark, n, odd):
    pos, edges = circle(n + odd, n, 24)
    table, links = frames(spark, pos, edges)
    gains = {r["pair"]: r["gain"] for r in C.swap_gains(table, links, n, odd).collect()}
    at, now = {p: v for v, p in pos.items()}, brute(pos, edges)
    for pair in range(n // 2):
        left, right = at[(2 * pair + odd) % n], at[(2 * pair + odd + 1) % n]
        assert now - brute(pos | {left: pos[right], right: pos[left]}, edges) == gains.get(pair, 0)
    after = {r["node"]: r["pos"] for r in C.by_swaps(table, links, n, odd).collect()}
    moved = {((p - odd) % n) // 2 for v, p in pos.items() if after[v] != p}
    assert sorted(after.values()) == list(range(n)) and bool(moved) == any(g > 0 for g in gains.values())
    assert brute(after, edges) == now - sum(gains[p] for p in moved)


def test_gains_of_sifting_are_exact(spark):
    pos, edges = circle(5, 9, 18)
    movers = sorted(pos)[:3]
    rows = C.sift_gains(*frames(spark, pos, edges), 9, movers).collect()
    assert len(rows) == 3 * 8
    for r in rows:
        rest = without(pos, r["mover"])
        rest.insert(rest.index(r["node"]) + 1, r["mover"])
        assert brute(pos, edges) - brute({v: k for k, v in enumerate(rest)}, edges) == r["gain"]
    best = C.by_sifting(*frames(spark, pos, edges), 9, movers)
    assert brute({r["node"]: r["pos"] for r in best.collect()}, edges) == brute(pos, edges) - max(0, *[r["gain"] for r in rows])


def test_crossings_only_fall_and_a_ring_is_untangled(spark):
    n = 8
    ring = [(k, (k + 1) % n) for k in range(n)]
    pos = {v: k for k, v in enumerate([0, 4, 1, 5, 2, 6, 3, 7])}
    better, seen = C.reduce_chord_crossings(*frames(spark, pos, ring), rounds=3, sifts=4)
    out = {r["node"]: r["pos"] for r in better.collect()}
    assert seen == sorted(set(seen), reverse=True) and len(seen) > 1
    assert seen[0] == brute(pos, ring) and seen[-1] == brute(out, ring) and sorted(out.values()) == list(range(n))
    tree = {r["node"]: r["pos"] for r in C.visit_order(spark.createDataFrame([(v,) for v in [*range(n), 50, 50]], "node long"), frames(spark, pos, ring[:-1])[1]).collect()}
    assert brute(tree, ring[:-1]) == 0 and tree[50] == n


def test_small_and_empty_circles(spark):
    nodes, edges = spark.createDataFrame([(3,), (None,), (3,)], "node long"), spark.createDataFrame([(3, 3), (3, 9), (None, 3)], "src long, dst long")
    [only] = C.circular_layout(nodes, edges).collect()
    assert only["node"] == 3 and abs(only["x"]) < 1e-9 and only["y"] < 0
    assert C.circular_layout(nodes.limit(0), edges).collect() == []
    assert C.chord_crossings(nodes.selectExpr("node", "0L AS pos").limit(0), edges) == 0
