"""Catalogues of rules, their settings and the lenses of reviews, and settings in force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values: (rule, name, category, settings), in the order of a run.  A setting is
#: (key, default) or, for numbers, (key, default, least, most).
RULES = (
    ("modularity", "Modularity", "architecture", (("max_lines", 200, 50, 2000),)),
    ("dependency_depth", "Dependency Depth", "architecture", (("max_depth", 4, 1, 20),)),
    ("circular_dependencies", "Circular Dependencies", "architecture",
     (("check_file_imports", True), ("check_package_imports", True), ("check_symbol_references", True), ("sample_limit", 10, 1, 50))),
    ("type_coverage", "Type Coverage", "quality", (("flag_javascript", True),)),
    ("test_coverage", "Test Coverage", "quality", (("warn_untested", 3, 0, 100), ("sample_limit", 10, 1, 50))),
    ("file_size", "File Size", "maintainability", (("max_lines", 300, 50, 5000),)),
    ("naming", "Naming Conventions", "maintainability", (("flag_spaces", True), ("flag_mixed_case", True))),
    ("language_linters", "Language Linters", "quality", (("enabled", True),)),
    ("lsp_diagnostics", "Language Diagnostics", "quality", (("include_warnings", True), ("include_errors", True), ("sample_limit", 20, 1, 100))),
    ("gitleaks", "Secret Scan (gitleaks)", "security", (("enabled", True), ("sample_limit", 20, 1, 100))),
    ("trufflehog", "Secret Scan (TruffleHog)", "security", (("enabled", True), ("verify", False), ("only_verified", False), ("sample_limit", 20, 1, 100))),
    ("ai_architecture", "AI Architecture Review", "ai", (("llm_override", False),)),
    ("ai_code_review", "AI Code Reviewer", "ai", (("llm_override", False),)),
    ("ai_clean_code", "AI Clean Code Reviewer", "ai", (("llm_override", False),)),
    ("ai_maintainability", "AI Maintainability Review", "ai", (("llm_override", False),)),
    ("ai_test_gaps", "AI Test Gap Review", "ai", (("llm_override", False),)),
)
#: Lenses by rule, (key, label); each is a setting that is on by default.
LENSES = {
    "ai_architecture": (
        ("arch_patterns", "Architecture patterns"), ("arch_system_design", "System design"), ("arch_scalability", "Scalability"),
        ("arch_technology", "Technology stack"), ("arch_integration", "Integration patterns"), ("arch_security", "Security architecture"),
        ("arch_performance", "Performance architecture"), ("arch_data", "Data architecture"), ("arch_technical_debt", "Technical debt"),
    ),
    "ai_code_review": (
        ("review_performance", "Performance"), ("review_security", "Security"), ("review_universal_quality", "Universal quality"),
        ("review_common_bugs", "Common bugs"), ("review_sql_injection", "SQL injection"), ("review_xss", "XSS prevention"),
        ("review_n_plus_one", "N+1 queries"), ("review_error_handling", "Error handling"), ("review_async_concurrency", "Async & concurrency"),
        ("review_anti_patterns", "Anti-patterns"), ("review_logging", "Logging strategy"),
    ),
    "ai_clean_code": (
        ("clean_general", "General rules"), ("clean_design", "Design rules"), ("clean_understandability", "Understandability"),
        ("clean_code_structure", "Source code structure"), ("clean_meaningful_names", "Meaningful names"), ("clean_functions", "Functions"),
        ("clean_single_responsibility", "Single responsibility"), ("clean_dry", "DRY"), ("clean_comments", "Comments"),
        ("clean_error_handling", "Error handling"), ("clean_boundaries", "Boundaries"), ("clean_unit_tests", "Unit tests"),
        ("clean_classes_and_data", "Classes & data"), ("clean_code_smells", "Code smells"), ("clean_boy_scout", "Boy Scout rule"),
    ),
}


def rules(spark: SparkSession) -> DataFrame:
    """``(ord, rule_id, rule_name, category)`` of all rules, in the order of a run."""
    return spark.createDataFrame([(k, *r[:3]) for k, r in enumerate(RULES)], "ord int, rule_id string, rule_name string, category string")


def lenses(spark: SparkSession) -> DataFrame:
    """``(rule_id, lens, label, ord)`` of the lenses that reviews can take."""
    rows = [(rule, *lens, k) for rule, listed in LENSES.items() for k, lens in enumerate(listed)]
    return spark.createDataFrame(rows, "rule_id string, lens string, label string, ord int")


def setting_rows() -> list[tuple[str, str, str, float, float, float]]:
    """The rows of ``settings``."""
    listed = [(rule, *s) for rule, _, _, own in RULES for s in own] + [(rule, key, True) for rule, own in LENSES.items() for key, _ in own]
    return [(r, k, "boolean" if isinstance(d, bool) else "number", float(d), *map(float, bounds or (0, 1))) for r, k, d, *bounds in listed]


def settings(spark: SparkSession) -> DataFrame:
    """``(rule_id, key, kind, default, least, most)`` of every setting, lenses among them; booleans are 0 and 1."""
    return spark.createDataFrame(setting_rows(), "rule_id string, key string, kind string, default double, least double, most double")


def settings_in_force(projects: DataFrame, saved: DataFrame) -> DataFrame:
    """``(project, rule_id, key, value)``: every setting of every project, saved values kept within their bounds.

    ``projects(project)``, ``saved(project, rule_id, key, value)`` with values as text; what is not
    saved, no number or boolean, or of an unknown setting, leaves the default.  Of repeated values
    the greatest counts.  The catalogue has a fixed number of rows, so each project adds as many.
    """
    known = F.broadcast(settings(projects.sparkSession))
    low = F.lower(F.trim("value"))
    number = F.when(F.col("kind") == "boolean", F.when(low == "true", 1.0).when(low == "false", 0.0)).otherwise(low.try_cast("double"))
    read = saved.join(known, ["rule_id", "key"]).select("project", "rule_id", "key", number.alias("__v")).where("__v IS NOT NULL AND NOT isnan(__v)")
    best = read.groupBy("project", "rule_id", "key").agg(F.max("__v").alias("__v"))
    each = [F.struct(*[F.lit(x).alias(c) for x, c in zip(row, ("rule_id", "key", "kind", "d", "a", "b"), strict=True)]) for row in setting_rows()]
    every = projects.select("project").distinct().select("project", F.explode(F.array(*each)).alias("s")).select("project", "s.*")
    met = every.join(best, ["project", "rule_id", "key"], "left")
    return met.select("project", "rule_id", "key", F.least(F.greatest(F.coalesce("__v", "d"), "a"), "b").alias("value"))


def chosen_lenses(in_force: DataFrame) -> DataFrame:
    """``(project, rule_id, lenses)``: what each review of a project looks at, in the catalogue's order; reviews without a lens go."""
    held = F.broadcast(lenses(in_force.sparkSession).withColumnRenamed("lens", "key"))
    on = in_force.where("value = 1").join(held, ["rule_id", "key"])
    listed = F.array_sort(F.collect_list(F.struct("ord", "label")))
    return on.groupBy("project", "rule_id").agg(F.transform(listed, lambda x: x["label"]).alias("lenses"))
