from pyspark.sql import functions as F

from orrery.operators import reports as R


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def test_cycle_paths(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdefg"], "id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "d"), ("e", "f"), ("f", "e"), ("f", "g")], "source string, target string")
    got = {r["component"]: r["path"] for r in R.cycle_paths(nodes, edges).collect()}
    assert got == {"a": list("abca"), "d": ["d", "d"], "e": list("efe")}


def test_locations_ranges_and_schedules(spark):
    rows = [tuple(one(spark, R.split_location(F.lit(e)))) for e in ("src/a.ts:12", "src/a.ts:3:4", "src/a.ts:9-4", "src/a.ts", "src/a.ts:0", "src/a.ts:2 (why)")]
    assert rows == [("src/a.ts", 12, 12), ("src/a.ts", 3, 3), ("src/a.ts", 4, 9), ("src/a.ts", None, None), ("src/a.ts", None, None), ("src/a.ts", 2, 2)]
    assert [one(spark, R.line_range(F.lit("a\nb\nc"), F.lit(a), F.lit(b))) for a, b in ((2, 3), (0, 1), (2, 99), (5, 6))] == ["b\nc", "a", "b\nc", ""]
    assert [one(spark, R.normalised_cron(F.lit(c))) for c in ("0 * * * *", "0 */30 * * * *")] == ["0 0 * * * *", "0 */30 * * * *"]
    assert [one(spark, R.compact_count(F.lit(n))) for n in (12, 1240, 12400)] == ["12", "1.24k", "12.4k"]
    assert one(spark, R.one_decimal(F.lit(0.12345))) == 12.3


def test_reviews(spark):
    phases = spark.createDataFrame([("a", 0), ("b", 1)], "rule_id string, ord int")
    reviews = spark.createDataFrame([("b", "warn", "m"), ("zzz", "fail", "n")], "rule_id string, status string, message string")
    assert sorted(map(tuple, R.attribute_reviews(reviews, phases).collect())) == [("a", "fail", "n"), ("b", "warn", "m")]
    assert sorted(r["status"] for r in R.attribute_reviews(reviews.limit(0), phases).collect()) == ["pass", "pass"]
    lenses = spark.createDataFrame([("b", "x", True), ("b", "y", False), ("a", "z", False)], "rule_id string, lens string, selected boolean")
    assert [(r["rule_id"], r["lenses"]) for r in R.plan_phases(phases, lenses).collect()] == [("b", ["x"])]


def test_snapshots_defaults_and_proxies(spark):
    values = spark.createDataFrame([('{"at": 1000, "overall": 79.5, "metrics": {"a": 1.4}}',), ("{}",), ("junk",)], "value string")
    (row,) = R.read_snapshots(values).collect()
    assert (row["overall"], row["architecture"], row["metrics"]) == (80, None, {"a": 1})
    rows = spark.createDataFrame([("b", False, True), ("a", False, False), ("c", False, True)], "id string, flagged boolean, ready boolean")
    assert [r["id"] for r in R.single_default(rows).where("flagged").collect()] == ["b"]
    proxy = R.structural_proxy(spark.createDataFrame([("p", 10, 1, 2, 1)], "path string, loc int, symbols int, imports int, calls int")).first()
    assert proxy["structural"] == 5
    items = spark.createDataFrame([(["b", "a", "b"],)], "affected array<string>")
    assert R.stored_items(items).first()["affected"] == ["a", "b"]
    assert [one(spark, R.circular_status(F.lit(a), F.lit(b))) for a, b in ((1, 0), (0, 2), (0, 0))] == ["fail", "warn", "pass"]
