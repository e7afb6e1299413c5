import math

import numpy as np

from orrery.llm import vecdedup


def brute(rows, threshold):
    ok = []
    for n, (_, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok.append(n)
    links = {n: set() for n in range(len(rows))}
    for a in ok:
        for b in ok:
            if a != b and len(rows[a][1]) == len(rows[b][1]):
                u, v = np.float32(rows[a][1]).astype(float), np.float32(rows[b][1]).astype(float)
                if u @ v / (np.sqrt(u @ u) * np.sqrt(v @ v)) >= threshold:
                    links[a].add(b)
    out = []
    for n, (i, _) in enumerate(rows):
        seen, todo = {n}, [n]
        while todo:
            for m in links[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        low = min(rows[m][0] for m in seen)
        out.append((i, len(links[n]), low, low == i))
    return sorted(out)


def test_links_and_components_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = []
    for _ in range(60):
        centre = rng.standard_normal(16)
        rows += [(centre + rng.standard_normal(16) * s).tolist() for s in (0, 0.05, 0.2, 0.3)]
    rows += [rows[0], rows[0], [2 * x for x in rows[0]], [0.0] * 16, None, [], [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] * 16, [1.0, 2.0], [1.0, 2.0], [-0.0, 1.0], [0.0, 1.0]]
    rows += [(rng.standard_normal(16)).tolist() for _ in range(100)]
    rows = [(n, v) for n, v in enumerate(rows)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, rep int, n_links string")
    got = sorted(map(tuple, vecdedup.near_vectors(df, recall=0.99999).collect()))
    assert got == brute(rows, 0.95)


def test_extreme_components_neither_overflow_nor_vanish(spark):
    rows = [(1, [1e200, 1e200]), (2, [3e300, 3e300]), (3, [1e-200, 1e-200]), (4, [5e-324, 0.0]), (5, [1.0, 1.0]), (6, [1.0, 0.0]), (7, [1e200, -1e200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vecdedup.near_vectors(df, recall=0.99999).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 5: (3, 1), 4: (1, 4), 6: (1, 4), 7: (0, 7)}


def test_recall_over_the_planned_tables():
    for n in (1000, 10**6, 10**10):
        bits, tables = vecdedup.plan_tables(n, 0.95, 0.999)
        p = (1 - math.acos(0.95) / math.pi) ** bits
        assert 1 - (1 - p) ** tables >= 0.999


def test_empty_table(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert vecdedup.near_vectors(df.limit(0)).count() == 0
    assert tuple(vecdedup.near_vectors(df).first()) == (1, 0, 1, True)
