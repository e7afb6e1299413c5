import json

from orrery.operators import linters
from orrery.sources import findings

SETTINGS = "language string, label string, linter string, min_level string, sample_limit int, enabled boolean, installed boolean, error string"
FOUND = "language string, path string, line int, severity string, message string"


def frame(spark, *values):
    return spark.createDataFrame([(v if isinstance(v, str | None) else json.dumps(v),) for v in values], "value string")


def rows(df):
    return [(r["path"], r["line"], r["severity"], r["message"]) for r in df.collect()]


def test_biome_and_oxlint_reports(spark):
    whole = {
        "diagnostics": [
            {"severity": "Fatal", "description": "d", "message": "m", "location": {"path": "a\\b.ts", "start": {"line": 7}}},
            {"severity": "hint", "message": "m", "span": {"file": "c.ts", "line": 3}},
            {"location": {"path": "e.ts"}},
            {},
        ]
    }
    want = [("a/b.ts", 7, "error", "d"), ("c.ts", 3, "info", "m"), ("e.ts", 1, "warning", "lint issue"), ("", 1, "warning", "lint issue")]
    assert rows(findings.biome(frame(spark, whole, "", "{", None, []))) == want
    plain = [("a/b.ts", 7, "error", "m"), *want[1:]]
    assert rows(findings.oxlint(frame(spark, whole, {"diagnostics": None}))) == plain
    assert rows(findings.oxlint(frame(spark, whole["diagnostics"]))) == plain
    assert rows(findings.biome(frame(spark, whole["diagnostics"]))) == []


def test_verdicts_of_linters(spark):
    settings = [
        ("a", "A", "x", "warning", 2, True, True, None), ("b", "B", "x", "error", 9, True, True, None), ("c", "C", "x", "info", 9, True, True, None),
        ("d", "D", "x", "info", 9, False, True, None), ("e", "E", "x", "info", 9, True, False, None), ("f", "F", "x", "info", 9, True, True, "x timed out"),
        ("g", "G", "x", "warning", 0, True, True, None),
    ]
    found = [("a", f"p{k}", k, "warning", "m") for k in (3, 1, 2, 1)] + [("a", "q", 1, "info", "m"), ("a", None, 1, "style", None), ("b", "p", 1, "warning", "m"), ("e", "p", 1, "error", "m"), ("f", "p", 1, "error", "m"), ("g", "p", 1, "error", "m"), ("zz", "p", 1, "error", "m")]
    got = {r["rule_id"]: tuple(r)[1:] for r in linters.linter_verdicts(spark.createDataFrame(settings, SETTINGS), spark.createDataFrame(found, FOUND)).collect()}
    assert got == {
        "linter:a": ("A (x)", "warn", "0 error(s), 4 warning(s), 0 info — level ≥ warning", ["p1:1 — [warning] m", "p2:2 — [warning] m"]),
        "linter:b": ("B (x)", "pass", "No issues at or above error level", []),
        "linter:c": ("C (x)", "pass", "No issues reported by x", []),
        "linter:d": ("D (linter)", "pass", "D linter disabled in settings", []),
        "linter:e": ("E (x)", "warn", "x is not installed. Install it from Settings → Language Linters.", []),
        "linter:f": ("F (x)", "warn", "x timed out", []),
        "linter:g": ("G (x)", "fail", "1 error(s), 0 warning(s), 0 info — level ≥ warning", []),
    }
    assert linters.linter_verdicts(spark.createDataFrame([], SETTINGS), spark.createDataFrame(found, FOUND)).collect() == []


def test_an_extension_is_looked_up_once(spark):
    from pyspark.sql import functions as F

    from orrery.functions.display import tool_language

    rows = spark.createDataFrame([(p,) for p in ("a/b.TS", "x.tar.gz", ".py", "a.b/c", "Main.java", "m.pyi", "r.rs", "s", None)], "path string")
    found = rows.select(tool_language(F.col("path"), "lint").alias("lint"), tool_language(F.col("path"), "lsp").alias("lsp"))
    assert [tuple(r) for r in found.collect()] == [("typescript", "typescript"), (None, None), (None, None), (None, None), (None, "java"), ("python", "python"), ("rust", "rust"), (None, None), (None, None)]
    plan = rows.select(tool_language(F.col("path"), "lint"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") < 10
