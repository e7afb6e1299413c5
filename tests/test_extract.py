from orrery.functions import extract as X
from orrery.operators import scopes


def test_imports_by_language(spark):
    files = {
        "a.ts": "import x from './b'\nimport \"./side\"\nconst y = import('./lazy')\nexport { z } from \"../up\"",
        "a.rs": "use crate::core::{x, y};\nuse std::io as q;\nmod inner;",
        "a.py": "import os.path, sys\nfrom pkg.mod import f\nfrom . import g",
        "A.java": "import com.foo.Bar;\nimport static com.foo.Baz.MEMBER;\nimport com.all.*;",
    }
    df = spark.createDataFrame(list(files.items()), "path string, content string")
    got = {}
    for r in X.extract_imports(df).collect():
        got.setdefault(r["path"], set()).add(r["spec"])
    assert got == {
        "a.ts": {"./b", "./side", "./lazy", "../up"},
        "a.rs": {"crate::core::", "std::io", "inner"},
        "a.py": {"os/path", "pkg/mod"},
        "A.java": {"com/foo/Bar", "com/foo/Baz"},
    }


def test_resolution_takes_the_first_candidate(spark):
    files = spark.createDataFrame(
        [("p/a.ts", "p"), ("p/b.ts", "p"), ("p/b/index.ts", "p"), ("x/src/core.rs", "x"), ("x/src/lib.rs", "x"), ("m/src/main/java/com/foo/Bar.java", "m"), ("z/com/foo/Bar.java", "z")],
        "path string, package string",
    )
    imports = spark.createDataFrame([("p/a.ts", "./b"), ("x/src/lib.rs", "crate::core"), ("p/b.ts", "com/foo/Bar"), ("p/b.ts", "./none"), ("p/a.ts", "./a")], "path string, spec string")
    got = {tuple(r) for r in X.resolve_imports(imports, files).collect()}
    assert got == {("p/a.ts", "p/b.ts"), ("x/src/lib.rs", "x/src/core.rs"), ("p/b.ts", "m/src/main/java/com/foo/Bar.java")}


def test_symbols_and_their_edges(spark):
    files = spark.createDataFrame(
        [("a.ts", "export async function main() {\n  helper();\n}\nclass helper {}\nlet x = 1\nfunction main() {}"), ("b.rs", "pub fn f() {}\npub trait T {}\nconst K: i32 = 1"), ("c.py", "class A:\n  def m(self):\n    pass"), ("D.java", "public static final class D {\n  private void run() {")],
        "path string, content string",
    )
    got = sorted((r["file"], r["kind"], r["label"], r["line"]) for r in X.extract_symbols(files).collect())
    assert got == [
        ("D.java", "class", "D", 1), ("D.java", "function", "run", 2), ("a.ts", "class", "helper", 4), ("a.ts", "function", "main", 1), ("a.ts", "function", "main", 6),
        ("a.ts", "variable", "x", 5), ("b.rs", "const", "K", 3), ("b.rs", "function", "f", 1), ("b.rs", "trait", "T", 2), ("c.py", "class", "A", 1), ("c.py", "function", "m", 2),
    ]
    edges = {tuple(r) for r in X.symbol_edges(files.where("path = 'a.ts'")).collect()}
    assert edges == {("a.ts::main", "a.ts::helper"), ("a.ts::main", "a.ts::x")}  # names are found inside other words


def test_scope_graphs_and_navigation(spark):
    files = spark.createDataFrame([("src/a/x.ts", 10, "src/a"), ("src/a/y.ts", 5, "src/a"), ("src/b/z.ts", 7, "src/b"), ("top.ts", 1, ".")], "path string, loc int, package string")
    imports = spark.createDataFrame([("src/a/x.ts", "src/b/z.ts"), ("src/a/x.ts", "src/a/y.ts"), ("top.ts", "src/a/x.ts")], "source string, target string")
    nodes = {(r["scope"], r["id"], r["loc"], r["kind"]) for r in scopes.scope_nodes(files).collect()}
    assert {(".", "src", 22, "package"), (".", "top.ts", 1, "file"), ("src", "src/a", 15, "package"), ("src/a", "src/a/x.ts", 10, "file")} <= nodes and len(nodes) == 7
    edges = {tuple(r) for r in scopes.scope_edges(files, imports).collect()}
    assert edges == {("src", "src/a", "src/b"), ("src/a", "src/a/x.ts", "src/a/y.ts"), (".", "top.ts", "src")}
    peers = {tuple(r) for r in scopes.scope_peers(files, imports).collect()}
    assert peers == {("src/a", "src/a/x.ts", "src/b")}
    symbols = spark.createDataFrame([("src/a/x.ts::f", "src/a/x.ts")], "id string, file string")
    assert {tuple(r) for r in scopes.navigation(files, imports, symbols, "packages")[1].collect()} == {("src/a", "src/b"), (".", "src/a")}
    assert scopes.navigation(files, imports, symbols, "package", "src/a")[1].count() == 1
    assert [scopes.navigation(files, imports, symbols, "file", "src/a/x.ts")[k].count() for k in (0, 1)] == [1, 0]
    more = symbols.union(spark.createDataFrame([("src/a/x.ts::g", "src/a/x.ts"), ("src/a/x.ts::g", "src/a/x.ts"), ("src/b/z.ts::h", "src/b/z.ts")], "id string, file string"))
    uses = spark.createDataFrame([("src/a/x.ts::f", "src/a/x.ts::g"), ("src/a/x.ts::f", "src/a/x.ts::g"), ("src/a/x.ts::f", "src/b/z.ts::h"), (None, "src/a/x.ts::g")], "source string, target string")
    nodes, edges = scopes.navigation(files, imports, more, "file", "src/a/x.ts", uses)
    assert nodes.count() == 2 and [tuple(r) for r in edges.collect()] == [("src/a/x.ts::f", "src/a/x.ts::g")]
    assert scopes.navigation(files, imports, more, "file", "nowhere", uses)[1].count() == 0


def test_an_import_is_tried_without_its_suffixes(spark):
    from pyspark.sql import functions as F

    from orrery.functions import extract as X

    names = ["a/b.ts", "a/b/index.ts", "src/a/b.js", "x/mod.rs", "a/b", "index.ts", "p/q.tsx"]
    files = spark.createDataFrame([(n,) for n in names], "target string")
    held = {(r["base"] + X.SUFFIXES[r["suffix"]], r["target"]) for r in X.stems(files).collect()}
    assert {t for _, t in held} == set(names) and all(a == b for a, b in held)
    imports = spark.createDataFrame([("a/c.ts", "./b"), ("a/c.ts", "a/b/"), ("m.rs", "x"), ("m.rs", "crate::a::b"), ("o.ts", "p/q"), ("o.ts", "none"), ("o.ts", "")], "path string, spec string")
    package = spark.createDataFrame([(n, ".") for n in [*names, "a/c.ts", "m.rs", "o.ts"]], "path string, package string")
    found = {(r["source"], r["target"]) for r in X.resolve_imports(imports, package).collect()}
    tried = imports.join(package, "path").select("path", F.posexplode(X.candidates(F.col("path"), F.col("spec"), F.col("package"))).alias("ord", "target"), "spec")
    best = {}
    for r in sorted(tried.collect(), key=lambda r: r["ord"]):
        if r["target"] in [*names, "a/c.ts", "m.rs", "o.ts"]:
            best.setdefault((r["path"], r["spec"]), r["target"])
    assert found == {(p, t) for (p, _), t in best.items() if p != t} and len(found) >= 4


def test_folders_of_both_ends_meet_in_the_row(spark):
    from orrery.operators.scopes import scope_edges

    files = spark.createDataFrame([(p, 1) for p in ("a/b/x", "a/b/y", "a/c/z", "d/w", "v", "a/b", "./u")], "path string, loc int")
    pairs = [("a/b/x", "a/b/y"), ("a/b/y", "a/c/z"), ("a/c/z", "d/w"), ("v", "a/b/x"), ("v", "v"), ("a/b", "a/b/x"), ("v", "gone"), (None, "v"), ("./u", "v"), ("a/b/x", "a/b/y")]
    found = scope_edges(files, spark.createDataFrame(pairs, "source string, target string"))
    want = {("a/b", "a/b/x", "a/b/y"), ("a", "a/b", "a/c"), (".", "a", "d"), (".", "v", "a"), (".", "./u", "v"), (".", ".", "v")}
    assert sorted(map(tuple, found.collect())) == sorted(want)
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line]
    assert len(joins) == 2 and all("LeftSemi" in line for line in joins)  # no exploded folders are joined


def test_equal_imports_of_a_folder_are_looked_up_once(spark):
    rows = [(f"a/f{k}.ts", "a", "import { x } from './m';\nimport y from 'com/foo/Bar';\n") for k in range(30)]
    rows += [("a/m.ts", "a", "import z from './f3'\n"), ("b/m.ts", None, "import z from '../a/m'\nimport './m'\n"), ("j/com/foo/Bar.java", "j", "import com.foo.Bar;\n"), ("c/n.rs", "c", "use crate::k;\n"), ("c/src/k.rs", "c", "")]
    files = spark.createDataFrame(rows, "path string, package string, content string")
    imports = X.extract_imports(files)
    assert set(imports.columns) == {"path", "package", "spec"}  # files are not asked for the package again
    plain = imports.select("path", "spec").unionByName(spark.createDataFrame([("gone.ts", "com/foo/Bar"), ("gone.ts", "./m")], "path string, spec string"))
    want = {(p, t) for p, _, _ in rows[:30] for t in ("a/m.ts", "j/com/foo/Bar.java")} | {("a/m.ts", "a/f3.ts"), ("b/m.ts", "a/m.ts"), ("c/n.rs", "c/src/k.rs")}
    assert {tuple(r) for r in X.resolve_imports(imports, files).collect()} == want
    plan = X.resolve_imports(imports, files)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan  # exploded paths are no side to broadcast
    assert {tuple(r) for r in X.resolve_imports(plain, files).collect()} == want | {("gone.ts", "j/com/foo/Bar.java")}


def test_texts_with_declarations_are_found_whole(spark):
    import random

    from pyspark.sql import functions as F

    from orrery.functions.metrics import trimmed_lines

    r = random.Random(7)
    bits = ["function f", "export class K", "pub fn g", "def h", "void run", "let ", "\n", "\r\n", "\r", " ", " ", "\x85", " ", "x ", "\n  ", "é", "class A"]
    rows = [(f"p{k}.{r.choice(['ts', 'rs', 'py', 'java', 'txt'])}", "".join(r.choice(bits) for _ in range(r.randint(0, 9)))) for k in range(500)]
    files = spark.createDataFrame([*rows, ("none", "class B\nclass C")], "path string, content string").withColumn("language", X.language_of(F.col("path")))
    found = F.size(F.filter(trimmed_lines(F.col("content")), lambda t: X.symbol_of(t, F.col("language")).isNotNull()))
    made = files.select("path", found.alias("n"), X.declares(F.col("content"), F.col("language")).alias("one"), X.declares(F.col("content"), F.col("language"), 2).alias("two")).collect()
    assert all(x["one"] == (x["n"] >= 1) and x["two"] == (x["n"] >= 2) for x in made) and sum(x["two"] for x in made) > 5
    listed = {x["file"]: x["n"] for x in X.extract_symbols(files.select("path", "content")).groupBy("file").agg(F.count("*").alias("n")).collect()}
    assert listed == {x["path"]: x["n"] for x in made if x["n"]}
