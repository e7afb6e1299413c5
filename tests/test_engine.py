import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from orrery.operators import history, joins, ratings
from orrery.operators.rollups import health_band, rollup_columns, size_band
from orrery.sources import findings, tree
from orrery.streaming import triggers

SF = "/root/testdata/sf0.001"


def test_entry_has_rows(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_percentiles_are_nearest_rank(spark):
    df = spark.createDataFrame([(float(v),) for v in range(10, 101, 10)], "v double")
    assert tuple(df.agg(*rollup_columns("v")).first()) == (55.0, 50.0, 80.0, 90.0)
    assert tuple(df.limit(0).agg(*rollup_columns("v")).first()) == (0.0, 0.0, 0.0, 0.0)


def test_bands(spark):
    one = lambda e: spark.range(1).select(e.alias("x")).first()["x"]
    assert [one(size_band(F.lit(v))) for v in (200, 250, 301)] == ["healthy", "fair", "poor"]
    assert [one(health_band(F.lit(v))) for v in (100, 80, 79.9, 50, 49.9, 0)] == ["healthy", "healthy", "fair", "fair", "poor", "poor"]
    args = lambda v, d, h, f: ratings.absolute_score(F.lit(float(v)), F.lit(d), F.lit(float(h)), F.lit(float(f)))
    assert [one(args(v, "lower", 10, 25)) for v in (10, 17.5, 25, 37.5, 80)] == [100, 75, 50, 25, 0]
    assert [one(args(v, "higher", 70, 50)) for v in (70, 60, 50, 25, 0)] == [100, 75, 50, 25, 0]
    assert one(ratings.blend(F.lit(80), F.lit(0))) == 56


def test_peer_scores_equal_counting(spark):
    values = [3.0, 1.0, 1.0, 7.0, None, 5.0]
    df = spark.createDataFrame([(str(n), m, v) for n, v in enumerate(values) for m in ("complexity", "maintainability")], "id string, metric string, value double")
    got = {(r["id"], r["metric"]): r["score"] for r in ratings.peer_scores(df, ratings.metric_table(spark)).collect()}
    known = [v for v in values if v is not None]
    for n, v in enumerate(values):
        if v is not None:
            assert got[str(n), "complexity"] == int(100 * sum(x >= v for x in known) / len(known) + 0.5)
            assert got[str(n), "maintainability"] == int(100 * sum(x <= v for x in known) / len(known) + 0.5)
    assert len(got) == 10


def test_history_ring_and_upsert(spark):
    fresh = spark.createDataFrame([("p", n, n, n) for n in range(100)], "project string, at long, seq long, overall long")
    kept = ratings.append_history(fresh.limit(0), fresh)
    assert (kept.count(), kept.agg(F.min("at")).first()[0]) == (60, 40)
    store = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    assert sorted(map(tuple, ratings.upsert(store, spark.createDataFrame([("b", "3"), ("c", "4")], store.schema)).collect())) == [("a", "1"), ("b", "3"), ("c", "4")]


def test_git_text(spark):
    lines = spark.createDataFrame([("3\t4\tsrc/a b.ts",), ("-\t-\timg.png",), ("",), ("subject",)], "line string")
    assert sorted(map(tuple, history.parse_numstat(lines).collect())) == [(0, 0, "img.png"), (3, 4, "src/a b.ts")]
    log = spark.createDataFrame([("r", "fix: x\na.ts\nb.ts\n\nno paths\n\ndocs\nc.md\n")], "repo string, log string")
    assert [tuple(r) for r in history.parse_log_blocks(log).orderBy("commit_no", "path").collect()] == [("r", 0, "fix: x", "a.ts"), ("r", 0, "fix: x", "b.ts"), ("r", 2, "docs", "c.md")]


def test_asof_and_candidates(spark):
    left = spark.createDataFrame([("f", 5, "l5"), ("f", 1, "l1"), ("g", 9, "g9")], "file string, line int, name string")
    right = spark.createDataFrame([("f", 2, "s2"), ("f", 5, "s5"), ("f", 7, "s7")], "file string, line int, symbol string")
    got = {r["name"]: r["symbol"] for r in joins.asof_backward(left, right, ["file"], "line", "symbol").collect()}
    assert got == {"l5": "s5", "l1": None, "g9": None}
    wanted = spark.createDataFrame([("x", ["a", "b", "c"]), ("y", ["z"])], "id string, candidates array<string>")
    known = spark.createDataFrame([("c",), ("b",), ("b",)], "path string")
    assert [tuple(r) for r in joins.first_candidate(wanted, known, "id").collect()] == [("x", "b")]


FINDINGS = {
    "eslint": (json.dumps([{"filePath": "a.ts", "messages": [{"line": 3, "severity": 2, "message": "m"}, {"severity": 1, "message": "n"}]}]), [("a.ts", 3, "error"), ("a.ts", 1, "warning")]),
    "cargo": (json.dumps({"reason": "compiler-message", "message": {"level": "warning", "message": "m", "code": None, "spans": [{"file_name": "b.rs", "line_start": 4}]}}), [("b.rs", 4, "warning")]),
    "ruff": (json.dumps([{"filename": "c.py", "message": "m", "code": "E1", "location": {"row": 7}}]), [("c.py", 7, "warning")]),
    "pylint": (json.dumps([{"path": "c.py", "line": 1, "type": "fatal", "message": "m"}, {"path": "c.py", "line": 2, "type": "refactor", "message": "m"}]), [("c.py", 1, "error"), ("c.py", 2, "info")]),
    "golangci": (json.dumps({"Issues": [{"Text": "m", "Pos": {"Filename": "d.go", "Line": 2}}]}), [("d.go", 2, "warning")]),
    "gitleaks": (json.dumps([{"File": "e.env", "StartLine": 0, "RuleID": "key", "Description": "d"}]), [("e.env", 1, "error")]),
    "trufflehog": (json.dumps({"DetectorName": "AWS", "Verified": True, "SourceMetadata": {"Data": {"Filesystem": {"file": "f.env", "line": 5}}}}), [("f.env", 5, "error")]),
}


@pytest.mark.parametrize("tool", FINDINGS)
def test_tool_outputs(spark, tool):
    text, want = FINDINGS[tool]
    rows = getattr(findings, tool)(spark.createDataFrame([(text,), ("not json",), ("{",)], "value string")).collect()
    assert sorted((r["path"], r["line"], r["severity"]) for r in rows) == sorted(want)


def test_colon_lines_and_repaired_answers(spark):
    lines = spark.createDataFrame([("a.py:3:1: E1 wrong: here",), ("junk",)], "value string")
    assert [(r["path"], r["line"], r["message"]) for r in findings.colon_separated(lines, "flake8").collect()] == [("a.py", 3, "E1 wrong: here")]
    item = '{"rule_id":"r","status":"warn","message":"m","affected":["a"]}'
    answers = [f"[{item}]", f"Sure:\n```json\n[{item}]\n```", f"text [{item}] more", f'[{item},{{"rule_id":"s","sta', "nothing"]
    got = findings.repaired_reviews(spark.createDataFrame([(a,) for a in answers], "value string")).collect()
    assert [r["rule_id"] for r in got] == ["r"] * 4


def test_tree_scan_and_result_store(spark, tmp_path):
    for name, text in {"a/x.ts": b"1\n2\n", "node_modules/y.ts": b"1", ".git/z.ts": b"1", "a/b.txt": b"1", "bad.py": b"\xff\xfe\n", "package.json": b'{"name": "root"}'}.items():
        (tmp_path / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / name).write_bytes(text)
    scanned = tree.scan_tree(spark, str(tmp_path / "src"))
    assert sorted((r["path"], r["loc"]) for r in scanned.collect()) == [("a/x.ts", 2), ("bad.py", 0)]
    assert [r["path"] for r in tree.contents(scanned).collect()] == ["a/x.ts"]
    files = spark.createDataFrame([("p/package.json", '{"name": "p"}'), ("c/Cargo.toml", '[package]\nname = "c"'), ("w/Cargo.toml", "[workspace]")], "path string, content string")
    assert sorted(map(tuple, tree.package_roots(files).collect())) == [("c", "c"), ("p", "p")]
    listed = tree.list_folder(spark.createDataFrame([("B.ts",), ("a.ts",), ("z/x.ts",)], "path string"))
    assert [(r["name"], r["kind"]) for r in listed.collect()] == [("z", "directory"), ("a.ts", "file"), ("B.ts", "file")]
    store = str(tmp_path / "store")
    for n in (1, 2):
        tree.persist_result(spark.range(n), store, "p")
        tree.persist_result(spark.range(5), store, "q")
    assert (tree.read_result(spark, store, "p").count(), tree.read_result(spark, store, "q").count()) == (2, 5)


def test_leading_edge():
    assert triggers.leading_edge([0, 10, 20, 1000, 1001, 5000], None, 0, 1000) == ([(0, 1), (1000, 2), (2000, 2), (5000, 1)], 5000, 0)
    assert triggers.leading_edge([10], 0, 1, 1000) == ([], 0, 2)


def test_throttled_stream_and_windows(spark, tmp_path):
    rows = [("p", f"2024-01-01 00:00:0{s}") for s in (0, 1, 2)] + [("q", "2024-01-01 00:00:01"), ("z", "2024-01-01 01:00:00")]
    df = spark.createDataFrame(rows, "project string, t string").select("project", F.to_timestamp("t").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "1 second")
    query = triggers.throttle(stream, 3000).writeStream.format("memory").queryName("fired").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    fired = {(r["project"], str(r["at"])[11:19], r["n_changes"]) for r in spark.table("fired").collect()}
    assert {("p", "00:00:00", 1), ("q", "00:00:01", 1), ("z", "01:00:00", 1)} <= fired
    seen = []
    run = triggers.reanalyse(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), seen.append, str(tmp_path / "check"))
    run.awaitTermination(120)
    assert sorted(seen) == ["p", "q", "z"]
    spark.read.parquet(f"{SF}/events.parquet").write.parquet(str(tmp_path / "events"))
    events = spark.readStream.schema(spark.read.parquet(str(tmp_path / "events")).schema).parquet(str(tmp_path / "events"))
    query = triggers.windowed_counts(events).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()


def test_graph_documents_and_nested_symbols(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": "a", "loc": 3}, {"id": "b"}], "edges": [{"source": "a", "target": "b", "kind": "import"}]}, indent=1))
    nodes, edges = tree.read_graph(spark, str(tmp_path / "g.json"))
    assert (nodes.count(), edges.first()["kind"]) == (2, "import")
    at = {"start": {"line": 4}}
    value = json.dumps([{"name": "A", "kind": 5, "range": at, "children": [{"name": "m", "kind": 6, "range": at, "children": [{"name": "x", "kind": 99, "range": at}]}]}])
    got = sorted((r["depth"], r["label"], r["kind"], r["line"]) for r in tree.document_symbols(spark.createDataFrame([("p", value), ("q", "junk")], "path string, value string")).collect())
    assert got == [(0, "A", "class", 5), (1, "m", "method", 5), (2, "x", "symbol", 5)]
    deep = {"name": "7", "range": at}
    for k in range(6, -1, -1):
        deep = {"name": str(k), "range": at, "children": [deep]}
    assert tree.document_symbols(spark.createDataFrame([("p", json.dumps([deep]))], "path string, value string")).count() == 8


def test_ranks_equal_sorting(spark):
    import random

    from orrery.operators import ranks

    rng = random.Random(9)
    rows = [(k, float(rng.choice([1, 2, 3, rng.randrange(10_000)]))) for k in "ab" for _ in range(3000)] + [("c", 5.0), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    for r in ranks.rollup(df, ["k"], "v").collect():
        values = sorted(v for k, v in rows if k == r["k"] and v is not None)
        rank = lambda p: values[max(0, -(-p * len(values) // 100) - 1)]
        assert (r["n"], r["p50"], r["p80"], r["p90"]) == (len(values), rank(50), rank(80), rank(90))
        assert r["avg"] == pytest.approx(sum(values) / len(values))
    top = ranks.top_k(df.where("v IS NOT NULL").distinct(), ["k"], [F.desc("v")], 5).collect()
    for k in "abc":
        assert sorted(r["v"] for r in top if r["k"] == k) == sorted({v for x, v in rows if x == k and v is not None})[-5:]


def test_cuts_of_running_counts_are_made_once(spark):
    """Approximate quantiles may differ between two evaluations, and then counts before a range do not fit the range."""
    from orrery.operators import ranks

    counts = spark.range(3000).selectExpr("id % 3 AS k", "id AS v", "1L AS n")
    out = ranks.running_counts(counts, ["k"], "v")
    assert "percentile_approx" not in out._jdf.queryExecution().toString()
    assert {r["v"]: r["upto"] for r in out.collect()} == {v: v // 3 + 1 for v in range(3000)}
