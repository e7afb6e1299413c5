import random

from orrery import session
from orrery.operators import crossings as X
from orrery.operators import ranks


def brute(order, edges):
    total = {}
    ends = []
    for a, b in edges:
        (la, pa), (lb, pb) = order[a], order[b]
        if abs(la - lb) == 1:
            ends.append((la, pa, pb) if la < lb else (lb, pb, pa))
    for i, (l, p, q) in enumerate(ends):
        total.setdefault(l, 0)
        total[l] += sum(m == l and (p - r) * (q - s) < 0 for m, r, s in ends[i + 1 :])
    return total


def drawing(seed, widths=(7, 1, 9, 8), edges=45):
    rng = random.Random(seed)
    order = {f"{layer}-{k}": (layer, k) for layer, width in enumerate(widths) for k in range(width)}
    ids = sorted(order)
    return order, [(rng.choice(ids), rng.choice(ids)) for _ in range(edges)]


def frames(spark, order, edges):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in order.items()], "id string, layer int, pos long"), spark.createDataFrame(edges, "source string, target string")


def test_crossings_and_reduction_equal_brute_force(spark):
    order, edges = drawing(1)
    table, links = frames(spark, order, edges)
    assert {r["layer"]: r["crossings"] for r in X.layer_crossings(table, links).collect()} == brute(order, edges)
    better, seen = X.reduce_crossings(table, links, rounds=2)
    out = {r["id"]: (r["layer"], r["pos"]) for r in better.collect()}
    assert set(out) == set(order) and all(out[i][0] == order[i][0] for i in order)
    for layer in range(4):
        assert sorted(p for a, p in out.values() if a == layer) == sorted(p for a, p in order.values() if a == layer)
    assert seen == sorted(set(seen), reverse=True) and len(seen) > 2
    assert seen[0] == sum(brute(order, edges).values()) and seen[-1] == sum(brute(out, edges).values())


def test_gains_of_swaps_are_exact(spark):
    order, edges = drawing(2)
    gains = {(r["layer"], r["pair"]): r["gain"] for r in X.swap_gains(*frames(spark, order, edges), 0, 1).collect()}
    now = sum(brute(order, edges).values())
    for layer in (0, 2):
        at = {p: i for i, (a, p) in order.items() if a == layer}
        for pair in range((len(at) - 1) // 2):
            left, right = at[2 * pair + 1], at[2 * pair + 2]
            swapped = order | {left: order[right], right: order[left]}
            assert now - sum(brute(swapped, edges).values()) == gains.get((layer, pair), 0)


def test_a_ladder_is_untangled(spark):
    order = {f"a{k}": (0, k) for k in range(6)} | {f"b{k}": (1, 5 - k) for k in range(6)}
    better, seen = X.reduce_crossings(*frames(spark, order, [(f"a{k}", f"b{k}") for k in range(6)]))
    assert seen == [15, 0] and better.count() == 12


def test_nothing_to_cross(spark):
    table, links = frames(spark, {"a": (0, 0)}, [])
    assert X.reduce_crossings(table, links)[1] == [0]
    assert X.layer_crossings(table.limit(0), links).collect() == []


def test_inversions_in_blocks_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(k, rng.randrange(9 + 300 * k), rng.randrange(40)) for k in (0, 1, 2) for _ in range(250)] + [(2, 5, 7)] * 60 + [(2, 6, 3)] * 60
    want = {k: sum(p < r and q > s for a, p, q in rows if a == k for b, r, s in rows if b == k) for k in (0, 1, 2)}
    table = spark.createDataFrame(rows, "key int, p long, q long").repartition(7)
    for block_rows in (60, 1 << 18):
        assert {r["key"]: r["n"] for r in X.inversions(table, block_rows).collect()} == want
    assert X.inversions(table.limit(0)).collect() == []


def test_inversions_write_rows_a_few_times_whatever_their_bits(spark, monkeypatch):
    """Before, every row was written once for each bit of the greatest position."""
    written = []

    def counted(df, path):
        out = session.write_table(df, path)
        written.append(out.count())
        return out

    def checkpointed(df):
        out = session.checkpoint(df)
        written.append(out.count())
        return out

    for module in (X, ranks):
        monkeypatch.setattr(module, "checkpoint", checkpointed)
    monkeypatch.setattr(X, "write_table", counted)
    rows = spark.range(400).selectExpr("0 AS key", "id AS p", "(id * 7919) % 1000003 AS q")
    n = X.inversions(rows).collect()[0]["n"]
    qs = [k * 7919 % 1000003 for k in range(400)]
    assert n == sum(qs[i] > qs[j] for j in range(400) for i in range(j))
    assert sum(written) < 4 * 400
