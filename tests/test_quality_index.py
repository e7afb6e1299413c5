import pytest

from orrery.functions import extract as X
from orrery.operators import quality_index as Q
from orrery.operators import rollups
from orrery.plans import code_queries  # noqa: F401  registers the queries
from orrery.plans.registry import ORACLES
from orrery.sources.tables import code_files
from tests.compare import connect

SF = "/root/testdata/sf0.001"
SHARED = "const sharedDuplicatedIdentifierValue = 42;"
FILES = [
    ("src/a.ts", "src", f"{SHARED}\n// TODO: stale decision here\nimport {{ b }} from './b';\nfunction main() {{ if (true) return helper(); return 2; }}\nfunction helper() {{ return 1; }}\nfunction alone() {{ return 3; }}\n"),
    ("src/b.ts", "src", f"{SHARED}\nexport function unused() {{ return 2; }}\n"),
    ("src/a.test.ts", "src", "test('a', () => {});"),
    ("lib/empty.ts", "lib", ""),
    ("lib/null.ts", "lib", None),
]


def frames(spark, rows=FILES):
    files = spark.createDataFrame(rows, "path string, package string, content string")
    texts = files.na.fill("")
    imports = spark.createDataFrame([("src/a.ts", "src/b.ts"), ("src/a.ts", "src/b.ts"), ("src/a.ts", "src/a.ts")], "source string, target string")
    items = spark.createDataFrame([("security_xss", "XSS", "fail", "src/a.ts"), ("ai_docs", "Comment style", "warn", "src/a.ts"), ("dry", "DRY", "pass", "src/b.ts")], "rule_id string, rule_name string, status string, path string")
    return files, imports, X.extract_symbols(texts), X.symbol_edges(texts), rollups.issue_buckets(items)


def test_index_of_a_small_code_base(spark):
    index = Q.file_index(*frames(spark))
    rows = {r["path"]: r.asDict() for r in index.collect()}
    assert set(rows) == {f[0] for f in FILES}
    a, b, empty = rows["src/a.ts"], rows["src/b.ts"], rows["lib/empty.ts"]
    assert (a["loc"], a["nloc"], a["cloc"], a["coverage"], b["coverage"]) == (6, 5, 1, 100.0, 0.0)
    assert (a["cbo"], b["cbo"], a["symbols"]) == (1, 0, 4)
    assert a["structural"] == 1 + 4 + 1 + 2
    # main calls helper; alone, main and the constant have no way in.
    assert a["dead_code_pct"] == 75.0 and b["dead_code_pct"] == 100.0 and a["cohesion"] == pytest.approx(100 * (1 - 2 / 3))
    assert a["duplicated_pct"] == pytest.approx(20.0) and b["duplicated_pct"] == pytest.approx(50.0)
    assert (a["issue_density"], a["security_density"], a["ai_density"]) == tuple(pytest.approx(x * 1000 / 6) for x in (3, 2, 1))
    assert a["stale_density"] == pytest.approx(1000 / 6) and a["documentation_score"] == 75.0 and b["documentation_score"] is None
    assert a["cyclomatic"] >= 2 and a["cyclomatic_density"] == pytest.approx(a["cyclomatic"] / 5) and a["abc_magnitude"] > 0
    for blank in (empty, rows["lib/null.ts"]):
        assert (blank["loc"], blank["nloc"], blank["dead_code_pct"], blank["cohesion"], blank["duplicated_pct"], blank["cyclomatic_density"], blank["issue_density"]) == (0, 0, 0.0, 100.0, 0.0, 0.0, 0.0)

    packages = {(r["package"], r["metric"]): r for r in Q.package_index(index).collect()}
    assert {m for p, m in packages if p == "src"} == set(Q.PACKAGE_METRICS)
    assert {m for p, m in packages if p == "lib"} == set(Q.PACKAGE_METRICS) - {"documentation"}
    assert packages["src", "documentation"]["n_files"] == 1 and packages["src", "coverage"]["avg"] == pytest.approx(200 / 3, abs=1e-5)
    assert packages["src", "size"]["p50"] == 2 and packages["src", "dead_code"]["p90"] == 100
    totals = {r["package"]: tuple(r)[1:] for r in Q.package_totals(index).collect()}
    assert totals == {"src": (3, 9, 8, 1), "lib": (2, 0, 0, 0)}


def test_index_agrees_with_the_sql_of_single_metrics(spark):
    texts = code_files(spark, SF).select("path", "package", "content")
    _, _, _, _, issues = frames(spark)
    none = spark.createDataFrame([], "source string, target string")
    index = Q.file_index(texts, none, spark.createDataFrame([], "id string, file string"), none, issues).toPandas().set_index("path").sort_index()
    con = connect(SF)
    pairs = {
        "file_loc_breakdown": {"loc": "loc", "cloc": "cloc", "code_density": "code_density", "comment_density": "comment_density", "stale_per_kloc": "stale_density"},
        "code_metrics": {"cyclomatic": "cyclomatic", "halstead_volume": "halstead_volume", "abc": "abc_magnitude", "maintainability": "maintainability"},
        "code_cognitive": {"cognitive": "cognitive"},
    }
    for name, columns in pairs.items():
        want = con.execute(ORACLES[name]).df().set_index("path").sort_index()
        assert list(want.index) == list(index.index)
        for theirs, ours in columns.items():
            assert (want[theirs].astype(float) - index[ours].astype(float)).abs().max() < 1e-5, ours


def test_index_of_nothing(spark):
    empty = [f.limit(0) for f in frames(spark)]
    index = Q.file_index(*empty)
    assert index.collect() == [] and Q.package_index(index).collect() == []


def test_columns_that_nobody_wants_are_not_made(spark):
    from pyspark.sql import functions as F

    files, imports, symbols, edges, issues = frames(spark)
    whole = Q.file_index(files, imports, symbols, edges, issues)
    assert whole.columns == ["path", "package", *Q.COLUMNS]
    broken = lambda frame: frame.select(*[F.raise_error(F.lit("read")).cast("string").alias(c) for c in frame.columns])
    wanted = ["symbols", "coverage", "loc", "cyclomatic_density", "documentation_score", "issue_density"]
    some = Q.file_index(files, broken(imports), symbols, broken(edges), issues, wanted)
    assert some.columns == ["path", "package", *wanted]
    assert sorted(map(str, some.collect())) == sorted(map(str, whole.select("path", "package", *wanted).collect()))
    texts = Q.file_index(files, broken(imports), broken(symbols), broken(edges), broken(issues), ["cognitive", "duplicated_pct"])
    assert sorted(map(str, texts.collect())) == sorted(map(str, whole.select("path", "package", "cognitive", "duplicated_pct").collect()))


def test_parts_of_a_file_are_its_symbols_less_those_joined(spark):
    text = "function alpha() { bravo(); }\nfunction bravo() {}\nfunction delta() {}\nfunction delta() {}\nfunction tango() { sierra(); }\nfunction sierra() { tango(); }\n"
    index = Q.file_index(*frames(spark, [("x.ts", ".", text), ("y.ts", ".", "function alpha() {}\nfunction alpha() {}\n")]), ["symbols", "cohesion", "dead_code_pct"])
    rows = {r["path"]: r for r in index.collect()}
    # Five kinds in three parts: alpha-bravo, delta and tango-sierra; delta stands twice.  One kind twice is one part.
    assert rows["x.ts"]["symbols"] == 6 and rows["x.ts"]["cohesion"] == pytest.approx(100 * (1 - 2 / 5))
    assert rows["x.ts"]["dead_code_pct"] == pytest.approx(100 * 3 / 6)
    assert rows["y.ts"]["cohesion"] == 100.0 and rows["y.ts"]["dead_code_pct"] == 100.0
