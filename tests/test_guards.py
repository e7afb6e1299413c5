import json

import pytest
from pyspark.errors import SparkRuntimeException

from orrery.functions import metrics as M
from orrery.operators import views
from orrery.sources import findings


def test_large_texts_are_measured_whole_without_the_guard(spark):
    """A text beyond every limit whose only branches stand at its end."""
    text = "let a = 1;\n" * 10_000 + "if (a) { b(); }\n" * 7
    files = spark.createDataFrame([(text, 10_007)], "content string, loc int")
    exact, guess = (M.with_classic_metrics(files, guard=g).first()["m"] for g in (False, True))
    assert exact["cc"] == 8 and guess["cc"] == 200


SECRET = {"DetectorName": "AWS", "Verified": True, "SourceMetadata": {"Data": {"Filesystem": {"file": "f.env", "line": 5}}}}


def test_secret_reports(spark):
    frame = lambda *rows: spark.createDataFrame([(r,) for r in rows], "value string")
    rows = frame(json.dumps(SECRET), " scanning ...", None, "", json.dumps([SECRET, SECRET]), "[]", json.dumps(SECRET | {"Verified": False}))
    assert findings.trufflehog(rows).count() == 4 and findings.trufflehog(rows, only_verified=True).count() == 3
    for broken in ('{"DetectorName": ', '[{"DetectorName": "A"}'):
        with pytest.raises(SparkRuntimeException, match="broken secret report"):
            findings.trufflehog(frame(broken), strict=True).collect()
        assert findings.trufflehog(frame(broken)).collect() == []


def test_violated_cells_equal_brute_force(spark):
    cells = [("a/x.ts", "b/y.ts"), ("x.ts", "y.ts"), ("a", "b"), ("x.ts", "z.ts"), ("x.ts", "y.ts"), ("", "")]
    violations = [("root/a/x.ts", "root/b/y.ts"), ("x.ts", "z"), ("q/x.ts", None), (None, "b")]
    out = views.cell_violations(spark.createDataFrame(cells, "source string, target string"), spark.createDataFrame(violations, "from string, to string"))
    want = sorted((s, t, any(f is not None and g is not None and s and f.endswith(s) and g.endswith(t) for f, g in violations)) for s, t in cells)
    assert sorted(map(tuple, out.collect())) == want
    assert "NestedLoop" not in out._jdf.queryExecution().toString()


def test_companion_tests_equal_their_nine_names(spark, monkeypatch):
    """Also: a file asks twice; before, it asked by nine names."""
    import random

    from pyspark.sql import functions as F

    from orrery.functions import paths as P
    from orrery.operators import rules

    rng = random.Random(3)
    ends = [".ts", ".rs", ".py", "", ".", ".test.ts", ".spec.ts", ".test.tsx", ".spec.tsx", ".test.js", "_test.go", "_test.py", ".test.test.ts"]
    dirs = ["", "a/", "tests/", "a/__tests__/", "__tests__/", "a/__tests__/__tests__/", "./", "/", "a/tests/", "*/"]
    files = sorted({rng.choice(dirs) + rng.choice(["x", "y", "*x", "", "z.k"]) + rng.choice(ends) for _ in range(260)})
    table = spark.createDataFrame([(f,) for f in files], "path string").select("path", P.parent_dir(F.col("path")).alias("d"), rules._stem(F.col("path")).alias("s"), P.is_test_path(F.col("path")).alias("t"))
    want = {}
    for r in table.collect():
        names = [f"{r.d}/{r.s}{e}" for e in rules.COMPANIONS] + [f"tests/{r.s}.rs", f"{r.d}/__tests__/{r.s}.ts"]
        want[r.path] = r.t or any(n in files for n in names)
    asked = []
    monkeypatch.setattr(rules.F, "explode", lambda c, explode=F.explode: asked.append(c) or explode(c))
    got = {r["path"]: r["covered"] for r in rules.with_companion_test(table.select("path")).collect()}
    assert got == want and 0 < sum(want.values()) < len(want)
    monkeypatch.undo()
    assert table.select(F.size(asked[-1].alias("a"))).first()[0] == 2
