import math

import pytest

from pyspark.sql import functions as F

from orrery.functions import display as D
from orrery.operators import catalogue as C
from orrery.operators import results as R
from orrery.operators.layering import communities, longest_path_layers
from orrery.sources import tree


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_counts_fall_back_to_quality_and_nodes(spark):
    items = table(spark, "status string", ("pass",), ("warn",), ("fail",), (None,))
    none = table(spark, "path string, package string")
    quality = table(spark, "package string, file_count long", ("a", 3), ("b", None))
    nodes = table(spark, "id string, kind string", ("a", "package"), ("b", "file"), ("c", "package"))
    full = {"items": items, "files": none, "packages": none, "quality_packages": quality, "nodes": nodes, "matrix": table(spark, "health double", (71.5,))}
    assert tuple(R.status_counts(full).first()) == (2, 3, 4, 1, 1, 1, 72)
    assert tuple(R.status_counts({"items": items, "nodes": nodes}).first()) == (2, 0, 4, 1, 1, 1, 100)
    empty = R.with_summary(R.status_counts({"items": items.limit(0), "matrix": table(spark, "health double")})).first()
    assert empty["tone"] == "ok" and empty["summary"].startswith("Analyzed 0 packages (0 source files) with 0 rule(s)") and empty["health"] == 100


def test_slim_and_stored_results(spark, tmp_path):
    items = table(spark, "rule_id string, affected array<string>", ("r", [f"f{k:03}" for k in range(100)] * 2), ("s", None))
    files = table(spark, "path string", ("a",))
    result = {"items": items, "files": files, "symbols": files, "quality_packages": files}
    slim = R.slim_result(result)
    assert [slim[n].count() for n in ("files", "symbols", "quality_packages")] == [0, 0, 1]
    assert {r["rule_id"]: r["affected"] and len(r["affected"]) for r in slim["items"].collect()} == {"r": 80, "s": None}
    paths = R.persist_tables(result, str(tmp_path), "p")
    R.persist_tables({"files": files.limit(0).union(table(spark, "path string", ("z",)))}, str(tmp_path), "q")
    assert sorted(paths) == ["files", "items", "quality_packages"]
    assert [r["path"] for r in tree.read_result(spark, paths["files"], "p").collect()] == ["a"]
    assert [r["path"] for r in tree.read_result(spark, paths["files"], "q").collect()] == ["z"]


def test_rating_of_one_path_is_its_rating_among_all(spark):
    values = [(f"f{k}", m, None if (k, m) == (3, "abc") else float((k * 7 + len(m)) % 5)) for k in range(9) for m in ("complexity", "abc", "maintainability", "unknown")]
    files = table(spark, "id string, metric string, value double", *values)
    packages = table(spark, "id string, metric string, value double", ("p", "abc", 1.0), ("q", "abc", 2.0), ("f1", "abc", 9.0))
    everyone = {r["id"]: r["rating"] for r in R.all_ratings(files).collect()}
    for name in ("f1", "f3", "f8"):
        assert [tuple(r) for r in R.rating_of(name, files, packages).collect()] == [(name, everyone[name])]
    assert [tuple(r) for r in R.rating_of("q", files, packages).collect()] == [("q", 67)]
    assert R.rating_of("nowhere", files, packages).count() == 0


def test_sizes_among_peers(spark):
    rows = [("a/x", "a", 10), ("a/y", "a", 10), ("a/z", "a", None), ("b/w", "b", 5), ("c", None, 7)]
    got = {r["path"]: tuple(r)[3:] for r in R.size_among_peers(table(spark, "path string, package string, loc long", *rows)).collect()}
    assert got == {"a/x": (100, 3, "package", "poor"), "a/y": (100, 3, "package", "poor"), "a/z": (33, 3, "package", "healthy"), "b/w": (40, 5, "project", "healthy"), "c": (60, 5, "project", "fair")}


def test_chart_axes_and_points(spark):
    schema = "chart string, metric string, scale string, run long, value double"
    inf = math.inf
    rows = [("s", "m", "score100", 0, 40.0), ("p", "m", "percent", 0, 120.0), ("flat", "m", "number", 0, 50.0), ("flat", "n", "number", 1, 50.0), ("wide", "m", "score100", 0, 1.0)]
    rows += [("wide", "n", "number", 2, 101.0), ("wide", "n", "number", 1, inf), ("none", "m", "number", 0, None)]
    series = table(spark, schema, *rows)
    axes = {r["chart"]: tuple(round(x, 6) for x in tuple(r)[1:3]) + (r["guides"],) for r in R.chart_domains(series, ["chart"]).collect()}
    assert axes == {"s": (0, 100, True), "p": (0, 100, False), "flat": (45, 55, False), "wide": (0, 109, False), "none": (0, 100, False)}
    points = {(r["chart"], r["metric"], r["run"]): (round(r["x"], 4), round(r["y"], 4)) for r in R.chart_points(series, ["chart"], 100.0, 50.0).collect()}
    assert points[("s", "m", 0)] == (0, 30) and points[("wide", "n", 2)] == (100, 3.6697) and len(points) == 6
    assert R.chart_points(series.where("chart = 's'"), [], 100.0, 50.0).count() == 1
    assert R.chart_points(series.limit(0), ["chart"], 1.0, 1.0).count() == 0


def test_display_order_and_texts(spark):
    names = table(spark, "label string", ("b",), ("B",), ("a",), ("Ä",), ("c",), (None,))
    assert [r["label"] for r in R.display_order(names, "label").collect()] == [None, "a", "Ä", "b", "B", "c"]
    messages = table(spark, "key string, params map<string,string>", ("hi", {"name": "{n}", "n": "1"}), ("bye", None), ("gone", {"x": None}), (None, None))
    texts = table(spark, "locale string, key string, text string", ("en", "hi", "Hi {name}, {n} {n}"), ("zh", "bye", "再见"), ("en", "bye", "Bye"), ("fr", "gone", "Parti"))
    got = {r["key"]: r["text"] for r in R.translated(messages, texts, "zh").collect()}
    assert got == {"hi": "Hi {n}, 1 1", "bye": "再见", "gone": "gone", None: None}


def test_limits(spark):
    values = table(spark, "name string, value long", ("validation_turns", 0), ("validation_turns", 2), ("agent_turns", 9999), ("agent_turns", None), ("validation_tokens", 0), ("validation_tokens", 5), ("other", 7))
    assert [r["value"] for r in R.clamped_limits(values).orderBy("name", "value").collect()] == [64, 256, 7, 0, 1000, 4, 128]


def test_settings_and_lenses(spark):
    assert (C.rules(spark).count(), C.lenses(spark).count()) == (16, 35)
    assert C.lenses(spark).groupBy("rule_id").count().count() == 3
    projects = table(spark, "project string", ("p",), ("q",), ("p",))
    off = [("p", "ai_code_review", key, "False") for key, _ in C.LENSES["ai_code_review"]]
    saved = table(spark, "project string, rule_id string, key string, value string", ("p", "file_size", "max_lines", "9"), ("p", "naming", "flag_spaces", "5"), ("q", "x", "y", "1"), ("r", "naming", "flag_spaces", "false"), *off)
    every = C.settings_in_force(projects, saved)
    values = {(r["project"], r["rule_id"], r["key"]): r["value"] for r in every.collect()}
    assert len(values) == every.count() == 2 * C.settings(spark).count()
    assert (values["p", "file_size", "max_lines"], values["q", "file_size", "max_lines"], values["p", "naming", "flag_spaces"]) == (50, 300, 1)
    chosen = {(r["project"], r["rule_id"]): r["lenses"] for r in C.chosen_lenses(every).collect()}
    assert ("p", "ai_code_review") not in chosen and len(chosen["q", "ai_code_review"]) == 11
    assert chosen["p", "ai_architecture"][0] == "Architecture patterns"


def test_folders_and_package_names(spark):
    paths = table(spark, "path string", ("src/a/x.ts",), ("src/b/.hidden",), ("src/c/node_modules/y.ts",), ("src/empty/",), ("src/.env",), ("src/Z.ts",), ("src/.git/config",), ("src/d/e/f.ts",), ("other/y.ts",))
    got = [tuple(r) for r in tree.list_folder(paths, "src").collect()]
    assert got == [("a", "directory", True), ("b", "directory", False), ("c", "directory", False), ("d", "directory", True), ("empty", "directory", False), ("Z.ts", "file", False)]
    with pytest.raises(ValueError):
        tree.list_folder(paths, "src/../..")
    cargo = '[workspace]\nname = "no"\n[package]\nauthors = ["x"]\nname = "my-core"\n\n[lib]\nname = "core_lib"\n[dependencies]\nname = "dep"\n'
    files = table(spark, "path string, content string", ("b/Cargo.toml", cargo), ("a/package.json", '{"name": "web"}'), ("c/package.json", '{"name": "web"}'), ("d/Cargo.toml", "[workspace]"), ("e/package.json", "{}"))
    assert {r["name"]: r["package"] for r in tree.package_names(files).collect()} == {"my-core": "b", "my_core": "b", "core_lib": "b", "web": "a"}


def test_layers_and_communities_keep_to_their_rounds(spark):
    nodes = table(spark, "id string", *[(x,) for x in "abcd"])
    chain = table(spark, "source string, target string", ("a", "b"), ("b", "c"), ("a", "c"))
    assert {r["id"]: r["layer"] for r in longest_path_layers(nodes, chain).collect()} == {"a": 2, "b": 1, "c": 0, "d": 0}
    with pytest.raises(ValueError):
        longest_path_layers(nodes, table(spark, "source string, target string", ("a", "b"), ("b", "a")))
    assert {r["id"]: r["community"] for r in communities(nodes, chain, None).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d"}
    assert {r["id"] for r in communities(nodes, chain.limit(0)).collect()} == set("abcd")


def test_bands_versions_and_models(spark):
    x, y = F.col("x"), F.col("y")
    rows = table(spark, "k int, x double, y double", (0, 99.0, 1.0), (1, 100.0, 0.0), (2, None, None), (3, math.nan, 60.0), (4, 79.0, 500.0))
    got = [tuple(r) for r in rows.orderBy("k").select(D.metric_band("coverage", x), D.package_band("coverage", x, y), D.package_band("churn", x, y)).collect()]
    assert got == [("poor", "healthy", "healthy"), ("healthy", "healthy", "healthy"), ("unknown", "unknown", "unknown"), ("unknown", "unknown", "healthy"), ("poor", "fair", "poor")]
    names = table(spark, "v array<string>", (["1.9.0", "1.10.0", "x", None, "1.2"],), ([],), (None,))
    assert [r[0] for r in names.select(D.newest_version(F.col("v"))).collect()] == ["1.10.0", None, None]
    models = table(spark, "v array<string>", (["gpt", "text-Embedding", "whisper-1"],), ([],))
    assert [r[0] for r in models.select(D.without_words(F.col("v"), ["embedding", "whisper"])).collect()] == [["gpt"], []]


def test_a_rating_reads_its_peers_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    schema = "id string, metric string, value double"
    files = table(spark, schema, *[(f"f{k}", "abc", float(k)) for k in range(10)]).mapInArrow(counted, schema)
    packages = table(spark, schema, ("p", "abc", 1.0))
    assert R.rating_of("f0", files, packages).first()["rating"] == 100
    assert seen.value == 10
