import pytest
from pyspark.sql import functions as F

from orrery.functions import metrics as M
from orrery.functions import paths as P


def value(spark, text, expression, path="a.ts"):
    df = spark.createDataFrame([(text, path)], "text string, path string")
    return df.select(expression(F.col("text"), F.col("path")).alias("x")).first()["x"]


def classic(spark, text, loc):
    return M.with_classic_metrics(spark.createDataFrame([(text, loc)], "content string, loc int")).first()["m"]


SNIPPET = "function add(a, b) { if (a > b) return a + b; return a * b; }"


def test_halstead(spark):
    h = value(spark, SNIPPET, lambda t, p: M.halstead(M.halstead_tokens(M.strip_noise(t))))
    assert (h["n1"], h["n2"], h["t1"], h["t2"]) == (11, 4, 15, 10)
    m = classic(spark, SNIPPET, 1)
    assert (m["vol"], m["diff"], m["vol"] * m["diff"]) == pytest.approx((97.672265, 13.75, 1342.993642), abs=1e-5)


def test_maintainability(spark):
    assert value(spark, "", lambda t, p: M.maintainability(F.lit(50.0), F.lit(2.0), F.lit(20))) == pytest.approx(59.454162, abs=1e-5)


def test_line_breakdown(spark):
    text = "\n// header comment\nfunction main() {\n  // TODO: revisit decision\n  return 1;\n}\n"
    b = value(spark, text, M.line_breakdown)
    assert tuple(b) == (6, 3, 2, 1, 1)
    assert tuple(value(spark, "", M.line_breakdown)) == (0, 0, 0, 0, 0)
    assert value(spark, "a\r\nb\r\n", lambda t, p: F.size(M.lines_of(t))) == value(spark, "a\nb", lambda t, p: F.size(M.lines_of(t))) == 2
    assert tuple(value(spark, "# a\nx /* b\n// c */ d\n\ny", M.line_breakdown, "a.py")) == (5, 2, 2, 1, 0)
    assert tuple(value(spark, "# a\nb", M.line_breakdown, "a.ts")) == (2, 2, 0, 0, 0)


def test_noise(spark):
    strip = lambda s: value(spark, s, lambda t, p: M.strip_noise(t))
    assert strip("a /* x\n y */ b // c\nd # e\nf") == "a   b \nd \nf"
    assert strip('x = "a // b" + \'it\\\'s\' + `t\n`') == "x =  str  +  str  +  str "
    assert strip("a /* never ends") == "a  "
    assert strip('a "never ends\\') == "a  str "
    assert strip("a / b") == "a / b"
    assert len(strip("'" + "x" * 50_000 + "'")) == 5


def test_words_have_ascii_boundaries(spark):
    assert value(spark, "éif if IF _if ifx", lambda t, p: M.word_count(t, "if")) == 3
    assert value(spark, "else if (a) x ? y : z && w", lambda t, p: M.cyclomatic(t)) == 5.0


def test_cognitive_clamps_nesting(spark):
    text = "} } }\nif (a) {\n if (b && c) {\n }\n} else {\n}\nx ? y : z"
    assert value(spark, text, lambda t, p: M.cognitive(t)) == 1 + 2 + 1 + 1 + 1


def test_sizes_and_samples(spark):
    m = classic(spark, "if\n" * 5000, 5000)
    assert (m["cc"], m["cog"], m["dit"]) == (200.0, 250.0, 0.0)
    assert len(value(spark, "é" * 40_000, lambda t, p: M.sample(t)).encode()) <= 48 * 1024


def test_inheritance_and_assignments(spark):
    assert value(spark, "class A extends B\nclass C extends D", lambda t, p: M.inheritance_depth(t)) == 2.0
    assert value(spark, "class A(B):", lambda t, p: M.inheritance_depth(t)) == 1.0
    x = value(spark, "a = 1; b += 2; c == d; e => f; g := 1; call(h); if (i) return;", lambda t, p: M.abc(t))
    assert tuple(x) == (2, 2, 1)


def test_clone_lines(spark):
    text = "import something from elsewhere\n  const  total   =  price * quantity;\n/* const total = price * quantity;\n*/\nshort"
    assert value(spark, text, M.clone_lines) == ["const total = price * quantity;"]
    assert value(spark, "éééééééééééé", M.clone_lines) == ["éééééééééééé"]


def test_cohesion_and_densities(spark):
    for symbols, parts, want in ((1, 1, 100.0), (4, 1, 100.0), (4, 4, 0.0), (0, 0, 100.0)):
        assert value(spark, "", lambda t, p: M.cohesion(F.lit(symbols), F.lit(parts))) == want
    assert value(spark, "", lambda t, p: M.per_kloc(F.lit(2), F.lit(0))) == 2000.0


PATHS = [
    ("a/b/c.test.ts", "a/b", "c.test.ts", "typescript", True),
    ("c.go", ".", "c.go", "go", False),
    ("x/tests/y.rs", "x/tests", "y.rs", "rust", True),
    (".env", ".", ".env", None, False),
    ("Makefile", ".", "Makefile", None, False),
    ("a/test_b.py", "a", "test_b.py", "python", True),
    ("a/b.xyz", "a", "b.xyz", "other", False),
]


def test_paths(spark):
    df = spark.createDataFrame([(p,) for p, *_ in PATHS], "path string")
    path = F.col("path")
    got = df.select(P.parent_dir(path), P.basename(path), P.language_of(path), P.is_test_path(path)).collect()
    assert [tuple(r) for r in got] == [tuple(x[1:]) for x in PATHS]


def test_path_rewrites(spark):
    one = lambda e: spark.range(1).select(e.alias("x")).first()["x"]
    assert [one(P.normalize_path(F.lit(p))) for p in ("a/./b//../c", "..", "", "a/../../b")] == ["a/c", ".", ".", "b"]
    assert one(P.normalize_rel(F.lit(" ././a\\b "))) == "a/b"
    assert [one(P.affected_file(F.lit(e))) for e in ("src/a.ts:12 — issue", "src/a.ts — message", "src/a.ts", " ")] == ["src/a.ts"] * 3 + [None]
    assert [one(P.is_corrective(F.lit(s))) for s in ("fix: null pointer in parser", "Hotfix login crash", "feat: add metrics panel", "docs: update README", "add prefix")] == [True, True, False, False, True]
    assert one(P.ancestors(F.lit("a/b/c"))) == ["a/b", "a"]
    assert [one(P.immediate_child(F.lit(p), F.lit(s))) for p, s in (("a/b/c", "a"), ("a/b/c", "."), ("x", "."), ("ab/c", "a"))] == ["a/b", "a", None, None]
    assert 0 <= one(P.palette_index(F.lit("src/engine/graph.ts"))) < 15


def test_scanning_rules_find_what_the_plain_ones_find(spark):
    odd = ["", "a1.b(x)...y 1.2.3abc( $if$ = 0x1F", "x<<=y**=z>>>w ===a!==b=>c:=d?.e??f", "if(a)elif b;_if $if for1 1for while\tELSE IF else\tif Switch", "f  (g(h\n(i))) 1f( $ ($1a (é( aé(", "~^=|=&=%=/=*=-=+=--++::,;{}[]@\\", "return(x) new Y() Catch (e) def g("]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    every = lambda rule, group=0: F.regexp_extract_all(F.col("t"), F.lit(rule), F.lit(group))
    words = r"(?i)(?<![A-Za-z0-9_])(" + "|".join(sorted({*M.DECIDE, *M.JUMP, *M.TEST})) + ")(?![A-Za-z0-9_])"
    plain = [every(M.TOKENS), every(M.ASSIGNMENTS), F.transform(every(M.CALLS), lambda c: F.regexp_replace(c, r"\s*\($", "")), F.transform(every(words, 1), F.lower)]
    scanned = [every(M.SCANNED_TOKENS), every(M.SCANNED_ASSIGNMENTS), every(M.SCANNED_CALLS, 1), M.keywords(F.col("t"))]
    for row in df.select(F.array(*plain).alias("plain"), F.array(*scanned).alias("scanned")).collect():
        assert row["plain"] == row["scanned"]
    signs = df.select(*[(M.literal_count(F.col("t"), p) == F.regexp_count("t", F.lit(rule))).alias(p) for p, rule in (("&&", "&&"), ("||", r"\|\|"), ("?", r"\?"), ("??", r"\?\?"), ("{", r"\{"))])
    assert all(all(r) for r in signs.collect())


def test_metrics_that_nobody_reads_are_not_made(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["code_metrics"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" in plan and "except|elif" not in plan  # the fold over lines of the cognitive metric


def test_lines_ends_and_extensions_equal_their_plain_rules(spark):
    import random
    import re

    r = random.Random(3)
    bits = ["a", "b c", "\n", "\r\n", "\r", " ", "\t", " ", " ", "\x85", "\x1c", "é", "  ", "."]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 9))) for _ in range(400)] + ["", "\n", "\r\n", "a\n\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", M.lines_of(F.col("t")).alias("ls"), M.trimmed_lines(F.col("t")).alias("trimmed")).collect()
    for row in rows:
        want = re.split(r"\r?\n", re.sub(r"\r?\n\Z", "", row["t"])) if row["t"] else []
        assert row["ls"] == want and row["trimmed"] == [line.strip(M.BLANKS) for line in want]
    names = ["a.ts", "d/a.b.PY", ".env", "d/.env.rs", "a.", "a..rs", "noext", "d.x/noext", "a\nb.go", "a b.java", "", "x.unknown"]
    got = {x["p"]: x["l"] for x in spark.createDataFrame([(n,) for n in names], "p string").select("p", P.language_of(F.col("p")).alias("l")).collect()}
    assert got["a.ts"] == "typescript" and got["d/a.b.PY"] == "python" and got["a..rs"] == "rust" and got["x.unknown"] == "other"
    assert [got[n] for n in (".env", "a.", "noext", "d.x/noext", "")] == [None] * 5
    assert got["a\nb.go"] == "go"  # a dot of the short rule may be any character
