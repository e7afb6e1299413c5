"""Verdicts of language linters from their findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators.ranks import top_k

#: Ranks of severities; an unknown one ranks as a warning.
RANKS = {"error": 3, "warning": 2, "info": 1, "hint": 1}


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in RANKS.items() for x in pair]), severity), F.lit(2))


def linter_verdicts(settings: DataFrame, findings: DataFrame) -> DataFrame:
    """``(rule_id, rule_name, status, message, affected)``, one row for each language of ``settings``.

    ``settings(language, label, linter, min_level, sample_limit, enabled, installed, error)``;
    ``findings(language, path, line, severity, message)``.  A disabled language passes, a linter that is
    missing or failed (``error``) warns and its findings do not count.  Findings below ``min_level`` are left out; an
    error among the rest fails, anything else warns.  ``affected`` holds the first distinct entries in order.
    """
    level = settings.select("language", severity_rank(F.col("min_level")).alias("least"), F.col("sample_limit").alias("k"))
    ranked = findings.join(F.broadcast(level), "language")
    passed = severity_rank(F.col("severity")) >= F.col("least")
    of = lambda name: F.count_if(passed & (F.col("severity") == name)).alias(f"{name}s")
    counts = ranked.groupBy("language").agg(F.count("*").alias("found"), F.count_if(passed).alias("kept"), of("error"), of("warning"), of("info"))
    entry = F.concat("path", F.lit(":"), F.col("line").cast("string"), F.lit(" — ["), "severity", F.lit("] "), "message")
    entries = ranked.where(passed).select("language", "k", entry.alias("entry")).where("entry IS NOT NULL").distinct()
    # Limits differ by language, so the widest is taken first and each list is cut to its own.
    widest = settings.agg(F.coalesce(F.max("sample_limit"), F.lit(0))).first()[0]
    lists = top_k(entries, ["language"], [F.col("entry")], widest).groupBy("language").agg(F.array_sort(F.collect_list("entry")).alias("affected"))
    met = settings.join(counts, "language", "left").join(lists, "language", "left").na.fill(0, ["found", "kept", "errors", "warnings", "infos"])

    missing = F.concat("linter", F.lit(" is not installed. Install it from Settings → Language Linters."))
    clean = F.when(F.col("found") == 0, F.concat(F.lit("No issues reported by "), "linter")).otherwise(F.concat(F.lit("No issues at or above "), "min_level", F.lit(" level")))
    number = lambda c: F.col(c).cast("string")
    counted = F.concat(number("errors"), F.lit(" error(s), "), number("warnings"), F.lit(" warning(s), "), number("infos"), F.lit(" info — level ≥ "), "min_level")
    ran = F.col("enabled") & F.col("installed") & F.col("error").isNull()
    status = F.when(~F.col("enabled"), "pass").when(~ran, "warn").when(F.col("kept") == 0, "pass").when(F.col("errors") > 0, "fail").otherwise("warn")
    message = F.when(~F.col("enabled"), F.concat("label", F.lit(" linter disabled in settings"))).when(~F.col("installed"), missing).when(F.col("error").isNotNull(), F.col("error"))
    message = F.when(ran & (F.col("kept") == 0), clean).when(ran, counted).otherwise(message)
    shown = F.when(ran, F.slice(F.coalesce("affected", F.array().cast("array<string>")), F.lit(1), F.col("sample_limit"))).otherwise(F.array().cast("array<string>"))
    tool = F.when(F.col("enabled"), F.col("linter")).otherwise(F.lit("linter"))
    name = F.concat("label", F.lit(" ("), tool, F.lit(")"))
    return met.select(F.concat(F.lit("linter:"), "language").alias("rule_id"), name.alias("rule_name"), status.alias("status"), message.alias("message"), shown.alias("affected"))
