"""Commit history: churn, corrective commits, and their package roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.paths import is_corrective
from orrery.operators.ranks import rollup


def within_days(commits: DataFrame, days: int, now: Column) -> DataFrame:
    """Commits of the last ``days`` days, 1 to 3650."""
    return commits.where(F.col("ts") >= now - F.make_dt_interval(F.lit(min(max(days, 1), 3650))))


def churn(commits: DataFrame) -> DataFrame:
    """``(path, lines_added, lines_deleted, commits)``."""
    return commits.groupBy("path").agg(
        F.sum("added").cast("long").alias("lines_added"), F.sum("deleted").cast("long").alias("lines_deleted"), F.count("*").alias("commits")
    )


def corrective(commits: DataFrame) -> DataFrame:
    """``(path, commits, corrective_commits, ccp)``, a share of 0 to 100."""
    out = commits.groupBy("path").agg(F.count("*").alias("commits"), F.count_if(is_corrective(F.col("subject"))).alias("corrective_commits"))
    return out.withColumn("ccp", F.round(100.0 * F.col("corrective_commits") / F.col("commits"), 6))


def project_ccp(commits: DataFrame) -> DataFrame:
    """One row: commits, corrective commits and their share; a commit of many paths counts once."""
    each = commits.groupBy("commit_id").agg(F.max(is_corrective(F.col("subject"))).alias("c"))
    out = each.agg(F.count("*").alias("commits"), F.count_if("c").alias("corrective_commits"))
    return out.withColumn("ccp", F.round(F.when(F.col("commits") == 0, 0.0).otherwise(100.0 * F.col("corrective_commits") / F.col("commits")), 6))


def package_history(files: DataFrame, commits: DataFrame) -> DataFrame:
    """Churn and CCP roll-ups by package of ``files(path, package)``.

    Untouched files count with churn 0 and are left out of the CCP; a package without any
    touched file takes the project's share.
    """
    touched = churn(commits).join(corrective(commits).select("path", "ccp"), "path")
    both = files.join(touched, "path", "left").select(
        "package", (F.coalesce("lines_added", F.lit(0)) + F.coalesce("lines_deleted", F.lit(0))).cast("double").alias("churn"), "ccp"
    )
    whole = F.broadcast(project_ccp(commits).select(F.col("ccp").alias("project_ccp")))
    shares = both.groupBy("package").agg(F.avg("ccp").alias("own_ccp"), F.count("ccp").alias("touched"))
    sums = rollup(both, ["package"], "churn").join(shares, "package")
    return sums.join(whole, F.lit(True)).select(
        "package", "touched", *[F.round(c, 6).alias(f"churn_{c}") for c in ("avg", "p50", "p80", "p90")], F.round(F.coalesce("own_ccp", "project_ccp"), 6).alias("ccp")
    )


def parse_numstat(lines: DataFrame) -> DataFrame:
    """``(path, added, deleted)`` of ``git log --numstat`` lines (column ``line``); ``-`` counts are 0."""
    parts = F.regexp_extract_all("line", F.lit(r"\S+"), F.lit(0))
    count = lambda i: F.when(F.get(parts, F.lit(i)) == "-", F.lit(0)).otherwise(F.expr(f"try_cast(get(regexp_extract_all(line, '\\\\S+', 0), {i}) AS bigint)"))
    rows = lines.select(count(0).alias("added"), count(1).alias("deleted"), F.array_join(F.slice(parts, F.lit(3), F.size(parts)), " ").alias("path"))
    return rows.where("added IS NOT NULL AND deleted IS NOT NULL AND path <> ''")


def parse_log_blocks(text: DataFrame) -> DataFrame:
    """``(commit_no, subject, path)`` of logs that list a subject, then paths, with blank lines between.

    ``text`` has one log per row (``repo``, ``log``); blocks are cut in the row, so no
    window over a whole log is needed.
    """
    blocks = text.select("repo", F.posexplode(F.split("log", r"\n[ \t]*\n\s*")).alias("commit_no", "block"))
    lines = F.filter(F.transform(F.split("block", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    cut = blocks.select("repo", "commit_no", lines.alias("ls")).where(F.size("ls") > 1)
    return cut.select("repo", "commit_no", F.get("ls", F.lit(0)).alias("subject"), F.explode(F.slice("ls", F.lit(2), F.size("ls"))).alias("path"))
