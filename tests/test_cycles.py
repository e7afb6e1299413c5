from orrery.operators import cycles as C
from orrery.operators import graph, scopes


def graph_of(spark, edges):
    nodes = sorted({n for e in edges for n in e})
    return spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame(edges, "source string, target string")


def ring(names):
    return list(zip(names, [*names[1:], names[0]]))


def test_rule_over_files_packages_and_symbols(spark):
    big = [f"p/f{k:02}.ts" for k in range(20)]
    files = graph_of(spark, [*ring(["a/x.ts", "a/y.ts", "b/z.ts"]), *ring(big), ("solo.ts", "solo.ts"), ("a/x.ts", "q.ts")])
    packages = graph_of(spark, [("a", "b"), ("b", "c")])
    symbols = graph_of(spark, ring(["s1", "s2"]))
    row = C.circular_rule({"file_imports": files, "package_imports": packages, "symbol_references": symbols}).first()
    assert (row["status"], row["message"]) == ("fail", "4 circular dependency group(s) found")
    assert row["affected"] == [
        "[file imports] a/x.ts → a/y.ts → b/z.ts → a/x.ts",
        "[file imports] solo.ts → solo.ts",
        f"[file imports] strongly connected group (20 files): {', '.join(big[:5])} …",
        "[symbol references] s1 → s2 → s1",
    ]
    groups = {g["label"]: g for g in row["cycle_groups"]}
    large = groups[f"[file imports] strongly connected group (20 files): {', '.join(big[:5])} …"]
    assert large["nodes"] == big[:16] and len(large["path"]) == 16 and large["node_count"] == 20
    assert groups["[symbol references] s1 → s2 → s1"]["node_count"] is None
    assert [g["kind"] for g in row["cycle_groups"]] == ["file_imports"] * 3 + ["symbol_references"]


def test_rule_samples_and_passes(spark):
    packages = graph_of(spark, [*ring(["a", "b"]), *ring(["c", "d"]), *ring(["e", "f"])])
    row = C.circular_rule({"package_imports": packages}, sample=2).first()
    assert (row["status"], row["message"]) == ("warn", "3 circular dependency group(s) found (list truncated)")
    assert row["affected"] == ["[package imports] a → b → a", "[package imports] c → d → c"] and len(row["cycle_groups"]) == 2
    clean = C.circular_rule({"file_imports": graph_of(spark, [("a", "b")]), "symbol_references": graph_of(spark, [("s", "t")])}).first()
    assert (clean["status"], clean["message"], clean["affected"]) == ("pass", "No circular dependencies detected in import graph and LSP symbol references", [])


def test_labels_are_parsed(spark):
    texts = ["  [package imports] a → b → a ", "[symbol references] strongly connected group (20 files): x, y , z …", "[file imports] strongly connected group (13 files)", "no label", "[x]", None, "[file imports] → "]
    rows = C.parsed_labels(spark.createDataFrame([(t,) for t in texts], "affected string")).collect()
    assert [(r["kind"], r["nodes"], r["path"]) for r in rows] == [
        ("package_imports", ["a", "b"], ["a", "b", "a"]),
        ("symbol_references", ["x", "y", "z"], ["x", "y", "z"]),
        ("file_imports", [], []),
    ]


def test_view_plans(spark):
    files = spark.createDataFrame([("a/x.ts", "a"), ("a/sub/y.ts", "a"), ("a/sub/w.ts", "a"), ("b/z.ts", "b"), ("b/deep/q.ts", "b")], "path string, package string")
    symbols = spark.createDataFrame([("a/x.ts:f", "a/x.ts"), ("a/x.ts:g", "a/x.ts"), ("b/z.ts:h", "b/z.ts")], "id string, file string")
    groups = [
        (1, "file_imports", ["a/x.ts", "a/sub/y.ts", "a/sub/w.ts"], ["a/x.ts", "a/sub/y.ts", "a/sub/w.ts", "a/x.ts"]),
        (2, "file_imports", ["a/x.ts", "b/z.ts"], ["a/x.ts", "b/z.ts", "a/x.ts"]),
        (3, "package_imports", ["a", "b", "gone"], ["a", "b", "gone", "a"]),
        (4, "symbol_references", ["a/x.ts:f", "a/x.ts:g", "b/z.ts:h"], []),
        (5, "symbol_references", ["lost"], ["lost", "a/x.ts:f"]),
        (6, "file_imports", ["b/new.ts"], []),
    ]
    plans = {r["group_id"]: tuple(r)[1:] for r in C.view_plan(spark.createDataFrame(groups, "group_id long, kind string, nodes array<string>, path array<string>"), files, symbols).collect()}
    assert plans[1] == ("package", "a", ["a/x.ts", "a/sub"], ["a/x.ts->a/sub"])
    assert plans[2] == ("packages", ".", ["a", "b"], ["a->b"])
    assert plans[3] == ("packages", ".", ["a", "b"], ["a->b"])
    assert plans[4] == ("file", "a/x.ts", ["a/x.ts:f", "a/x.ts:g"], ["a/x.ts:f->a/x.ts:g"])
    assert plans[5] == ("packages", ".", [], [])
    assert plans[6] == ("package", "b", [], [])


def test_package_graph_takes_the_strongest_kind(spark):
    files = spark.createDataFrame([("app/m.ts", "app", 3), ("app/n.ts", "app", 4), ("lib/core-x/l.rs", "lib/core-x", 5)], "path string, package string, loc int")
    imports = spark.createDataFrame([("app/m.ts", "lib/core-x/l.rs"), ("app/n.ts", "app/m.ts")], "source string, target string")
    manifests = spark.createDataFrame([("app", ' "lib/core-x": "file:../lib/core-x",'), ("app", "version = 1")], "package string, line string")
    contents = spark.createDataFrame([("app", "uses core-x"), ("lib/core-x", "core_x here"), ("tool", "core_x")], "package string, text string")
    nodes, edges = scopes.package_graph(files, imports, manifests, contents, ["core-x", "core_x"])
    assert {tuple(r) for r in nodes.collect()} == {("app", "app", 7, "package"), ("lib/core-x", "core-x", 5, "package")}
    assert {tuple(r) for r in edges.collect()} == {("app", "lib/core-x", "manifest"), ("lib/core-x", "lib/core-x", "wasm"), ("tool", "lib/core-x", "wasm")}


def test_matrix_scopes(spark):
    rows = [("pkg/a.ts", "pkg", 1), ("pkg/b.ts", "pkg", 1), ("pkg/in/d.ts", "pkg", 1), ("other/c.ts", "other", 1)]
    files = spark.createDataFrame(rows, "path string, package string, loc int")
    imports = spark.createDataFrame([("pkg/a.ts", "pkg/b.ts"), ("pkg/a.ts", "other/c.ts"), ("pkg/a.ts", "pkg/in/d.ts")], "source string, target string")
    edges = spark.createDataFrame([("pkg", "other"), ("pkg", "ghost")], "source string, target string")
    ids = lambda nodes: sorted(r["id"] for r in nodes.collect())
    nodes, found, cut = scopes.matrix_scope(files, imports, edges, "file", "pkg")
    assert ids(nodes) == ["pkg/a.ts", "pkg/b.ts", "pkg/in/d.ts"] and found.count() == 2 and not cut
    nodes, found, _ = scopes.matrix_scope(files, imports, edges)
    assert ids(nodes) == ["other", "pkg"] and [tuple(r) for r in found.collect()] == [("pkg", "other")]
    nodes, found, _ = scopes.matrix_scope(files, imports, edges, scope="pkg")
    assert ids(nodes) == ["pkg/a.ts", "pkg/b.ts", "pkg/in"] and {tuple(r) for r in found.collect()} == {("pkg/a.ts", "pkg/b.ts"), ("pkg/a.ts", "pkg/in")}
    one = files.where("package = 'pkg'").withColumn("package", scopes.F.lit("."))
    assert ids(scopes.matrix_scope(one, imports, edges)[0]) == ["pkg"]
    assert ids(scopes.matrix_scope(files, imports, edges, "file", "none")[0]) == []
    empty = scopes.matrix_scope(files.limit(0), imports, edges)
    assert graph.dsm_report(empty[0], empty[1]).first()["health"] == 100.0


def test_files_beyond_the_limit_are_the_best_connected(spark):
    files = spark.range(160).selectExpr("concat('p/', lpad(id, 3, '0')) AS path", "'p' AS package", "1 AS loc")
    imports = spark.createDataFrame([("p/159", f"p/{k:03}") for k in range(150, 159)], "source string, target string")
    nodes, edges, cut = scopes.matrix_scope(files, imports, imports, "file")
    kept = {r["id"] for r in nodes.collect()}
    assert cut and len(kept) == 150 and {f"p/{k:03}" for k in [*range(140), *range(150, 160)]} == kept and edges.count() == 9
