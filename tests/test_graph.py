import random

import pytest
from pyspark.sql import functions as F

from orrery.operators import graph as G
from orrery.operators import layering as L
from orrery.operators import rules
from orrery.operators.components import connected_components

E = "source string, target string"
N = "id string, group string"


def frames(spark, ids, edges):
    return spark.createDataFrame([(i, None) for i in ids], N), spark.createDataFrame(edges, E)


CASES = {
    "chain3": (["api", "core", "ui"], [("ui", "api"), ("api", "core")], (0, 0, 0, 0.333333, 0.666667, 13, 0.722222, 0, 77.5)),
    "cycle2": (["a", "b"], [("a", "b"), ("b", "a")], (1, 2, 1, 1, 1, 8, 1, 0, 0)),
    "chain4": (["a", "b", "c", "d"], [("d", "c"), ("c", "b"), ("b", "a")], (0, 0, 0, 0.25, 0.625, 24, 0.5, 0, 81.875)),
    "clique4": (list("abcd"), [(x, y) for x in "abcd" for y in "abcd" if x != y], (1, 4, 1, 1, 1, 144, 0.75, 0, 1.75)),
    "bus12": ([f"p{n}" for n in range(12)], [(f"p{n}", "p0") for n in range(1, 12)], (0, 0, 0, 0.083333, 0.159722, 11, 0.006944, 1, 97.083333)),
}


@pytest.mark.parametrize("name", CASES)
def test_matrix_metrics(spark, name):
    ids, edges, want = CASES[name]
    row = G.dsm_report(*frames(spark, ids, edges), partitioned=True).first()
    got = [row[c] for c in ("cycles", "cyclic_nodes", "upper", "coupling", "propagation", "cost", "normalised", "buses", "health")]
    assert got == pytest.approx(want, abs=1e-5)


def test_orders_put_foundations_first(spark):
    for name, want in (("chain3", ["core", "api", "ui"]), ("cycle2", ["a", "b"]), ("chain4", list("abcd"))):
        ids, edges, _ = CASES[name]
        order = L.partition_order(*frames(spark, ids, edges)).orderBy("idx").collect()
        assert [r["id"] for r in order] == want


def test_ten_elements_have_no_bus(spark):
    cells = spark.createDataFrame([(f"p{n}", "p0") for n in range(1, 10)], E)
    assert G.bus_ids(cells, 10).count() == 0
    assert G.bus_ids(cells, 11).count() == 1


def brute_reach(ids, edges):
    out = {i: {t for s, t in edges if s == i} for i in ids}
    reach = {}
    for i in ids:
        seen, todo = set(), list(out[i])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out[x]
        reach[i] = seen
    return reach


@pytest.mark.parametrize("seed", [1, 2])
def test_closure_and_components_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    ids = [f"n{k:02d}" for k in range(18)]
    edges = [(rng.choice(ids), rng.choice(ids)) for _ in range(22)]
    nodes, frame = frames(spark, ids, edges)
    reach = brute_reach(ids, edges)
    assert {(r["source"], r["target"]) for r in G.closure(frame).collect()} == {(s, t) for s in ids for t in reach[s]}
    got = {r["id"]: (r["component"], r["cyclic"]) for r in G.strong_components(frame, nodes).collect()}
    for i in ids:
        same = {j for j in ids if i == j or (j in reach[i] and i in reach[j])}
        assert got[i] == (min(same), len(same) > 1 or (i, i) in edges)


def test_long_paths_and_stars_are_one_component(spark):
    path = [(n, n + 1) for n in range(200)]
    star = [(1000, 1001 + n) for n in range(300)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(path + star + [(5000, 5000), (None, 3)], "src long, dst long")).collect()}
    assert set(got) == set(range(201)) | set(range(1000, 1301))
    assert {got[n] for n in range(201)} == {0} and {got[n] for n in range(1000, 1301)} == {1000}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_layers_forbid_and_duplicate_names(spark):
    edges = spark.createDataFrame([("core", "ui"), ("ui", "core"), ("app/x", "core"), ("app", "lib/y")], E)
    assert [tuple(r) for r in rules.layer_violations(edges, ["core", "app", "ui"]).collect()] == [("layers", "core", "ui")]
    assert rules.layer_violations(edges, ["core"]).count() == 0
    got = {tuple(r) for r in rules.forbid_violations(edges, [("r", "app", "core"), ("s", ".", "lib")]).collect()}
    assert got == {("r", "app/x", "core"), ("s", "app", "lib/y")}
    assert rules.forbid_violations(edges, []).count() == 0


def test_rings_communities_and_cohesion(spark):
    nodes, edges = frames(spark, list("abcdefg"), [("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("e", "f"), ("f", "d"), ("c", "d")])
    rings = {r["id"]: r["depth"] for r in L.bfs_rings(nodes, edges, nodes.where("id = 'a'")).collect()}
    assert rings == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3, "f": 3, "g": None}
    groups = {r["id"]: r["community"] for r in L.communities(nodes, edges).collect()}
    assert groups["a"] == groups["b"] == groups["c"] and groups["g"] == "g"
    symbols = spark.createDataFrame([("s1", "f"), ("s2", "f"), ("s3", "f"), ("t", "g")], "id string, file string")
    got = {r["file"]: r["cohesion"] for r in L.file_cohesion(symbols, spark.createDataFrame([("s1", "s2")], E)).collect()}
    assert got == {"f": 50.0, "g": 100.0}


def test_prefix_owner(spark):
    paths = spark.createDataFrame([("a/b/c.ts",), ("a/x.ts",), ("z.ts",), ("ab/c.ts",), ("a/b",)], "path string")
    owners = spark.createDataFrame([("a",), ("a/b",), (".",)], "owner string")
    got = {r["path"]: r["owner"] for r in G.prefix_owner(paths, owners).collect()}
    assert got == {"a/b/c.ts": "a/b", "a/x.ts": "a", "z.ts": ".", "ab/c.ts": ".", "a/b": "a/b"}


def test_roles(spark):
    nodes, edges = frames(spark, list("abcd"), [("a", "b"), ("a", "c"), ("a", "b")])
    got = {r["id"]: r["role"] for r in G.degrees(edges, nodes).collect()}
    assert got == {"a": "hub", "b": "withDependencies", "c": "withDependencies", "d": "independent"}
    placed = L.place_on_rings(nodes.withColumn("ring", F.lit(1)), "ring").collect()
    assert len({(r["x"], r["y"]) for r in placed}) == 4


def tables_written(monkeypatch):
    paths, real = [], G.write_table
    monkeypatch.setattr(G, "write_table", lambda df, path: (paths.append(path), real(df, path))[1])
    return paths


@pytest.mark.parametrize("ring", [False, True])
def test_long_chain_takes_few_tables(spark, monkeypatch, ring):
    paths, n = tables_written(monkeypatch), 1000
    edges = spark.range(n - 1 + ring).selectExpr(f"lpad({n} - id, 5, '0') AS source", f"lpad(({n} - id - 2 + {n}) % {n} + 1, 5, '0') AS target")
    nodes = spark.range(1, n + 1).selectExpr("lpad(id, 5, '0') AS id")
    out = G.strong_components(edges, nodes)
    assert out.where("size = 1").count() == (0 if ring else n) and out.where("size = 1000 AND component = '00001' AND cyclic").count() == (n if ring else 0)
    assert len(paths) < 40


def test_strong_components_of_random_graphs(spark):
    rng = random.Random(4)
    for n, m in ((40, 50), (30, 90), (50, 60)):
        ids = [f"n{k:02}" for k in range(n)]
        edges = [(rng.choice(ids), rng.choice(ids)) for _ in range(m)]
        reach = brute_reach(ids, edges)
        out = G.strong_components(spark.createDataFrame(edges, E), spark.createDataFrame([(i, None) for i in ids], N)).collect()
        same = {i: {j for j in ids if j == i or (j in reach[i] and i in reach[j])} for i in ids}
        assert {(r["id"], r["component"], r["size"], r["cyclic"]) for r in out} == {(i, min(same[i]), len(same[i]), i in reach[i]) for i in ids}


def test_hundred_thousand_edges_of_a_file_graph(spark):
    """Blocks of ten nodes in a ring, chained one after the other."""
    ring = spark.range(60_000).selectExpr("CAST(id AS STRING) AS source", "CAST(id DIV 10 * 10 + (id + 1) % 10 AS STRING) AS target")
    chain = spark.range(5999).selectExpr("CAST(id * 10 AS STRING) AS source", "CAST(id * 10 + 13 AS STRING) AS target")
    nodes = spark.range(60_000).selectExpr("CAST(id AS STRING) AS id")
    out = G.strong_components(ring.unionByName(chain), nodes)
    assert out.where("size = 10 AND cyclic").count() == 60_000 and out.select("component").distinct().count() == 6000


def test_a_bus_is_not_merged(spark):
    from orrery.operators import layering

    elements = spark.createDataFrame([(k, name) for k, name in enumerate("abcz")], "idx int, id string")
    cells = spark.createDataFrame([(0, 1, 1), (1, 0, 1), (3, 2, 1), (0, 3, 1)], "row_idx int, col_idx int, weight long")
    merged = lambda buses: {r["id"]: r["cluster"] for r in layering.greedy_clusters(cells, elements, spark.createDataFrame(buses, "target string")).collect()}
    assert merged([("z",)]) == {"a": 0, "b": 0, "c": 2, "z": 3}
    assert merged([]) != merged([("z",)])


@pytest.mark.parametrize("few", [0, 200_000])
def test_strong_components_read_their_edges_once(spark, monkeypatch, tmp_path, few):
    """The edges are gone before the result is read; a round's joins deal both sides or send one."""
    monkeypatch.setattr(G, "FEW_ROWS", few)
    ids = [f"n{k}" for k in range(9)]
    edges = [("n0", "n1"), ("n1", "n2"), ("n2", "n0"), ("n2", "n3"), ("n3", "n4"), ("n4", "n5"), ("n5", "n3"), ("n4", "n3"), ("n6", "n0"), ("n7", "n7"), ("n0", "n0"), ("n1", "n2"), ("n5", "n8")]
    spark.createDataFrame(edges, E).write.parquet(f"{tmp_path}/edges")
    out = G.strong_components(spark.read.parquet(f"{tmp_path}/edges"), spark.createDataFrame([(i,) for i in ids], "id string"))
    for part in (tmp_path / "edges").glob("*"):
        part.unlink()
    want = {i: ("n0", 3, True) for i in ids[:3]} | {i: ("n3", 3, True) for i in ids[3:6]} | {"n6": ("n6", 1, False), "n7": ("n7", 1, True), "n8": ("n8", 1, False)}
    assert {r["id"]: (r["component"], r["size"], r["cyclic"]) for r in out.collect()} == want


def test_next_parts_deal_their_lines_once(spark, tmp_path):
    from orrery.plans.shape_queries import next_parts

    rng = random.Random(7)
    lines = [(rng.choice([1, 2, 3, None]), rng.choice([1, 2, 3, 5, None]), rng.randrange(40), rng.choice("OF"), rng.choice(["N", "R", None])) for _ in range(150)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_linestatus string, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = next_parts(spark, str(tmp_path))
    want = {(a[2], b[2]) for a in lines for b in lines if None not in (*a, *b) and (a[0], a[1] + 1, a[3:]) == (b[0], b[1], b[3:])}
    got = [tuple(r) for r in out.collect()]
    assert want and sorted(got) == sorted(want)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
