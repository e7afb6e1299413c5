"""Queries over findings, verdicts and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import paths as P
from orrery.functions.display import tool_language
from orrery.operators import linters, rollups
from orrery.operators.ranks import top_k
from orrery.plans.registry import query
from orrery.sources.tables import CODE_LINES_SQL, code_lines, load

FINDINGS_SQL = """found AS (SELECT conv_id, turn AS line, concat('conv', CAST(conv_id AS STRING), '.ts') AS path,
  CASE role WHEN 'user' THEN 'warning' WHEN 'assistant' THEN 'info' ELSE 'error' END AS severity, text AS message FROM conversations)"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as ``(conv_id, line, path, severity, message)``."""
    c = load(spark, sf_dir, "conversations")
    severity = F.when(F.col("role") == "user", "warning").when(F.col("role") == "assistant", "info").otherwise("error")
    return c.select("conv_id", F.col("turn").alias("line"), F.concat(F.lit("conv"), F.col("conv_id").cast("string"), F.lit(".ts")).alias("path"), severity.alias("severity"), F.col("text").alias("message"))


@query(f"WITH {FINDINGS_SQL} SELECT severity, count(*) AS n, count(DISTINCT path) AS files FROM found WHERE CASE severity WHEN 'error' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END >= 2 GROUP BY severity")
def findings_severity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of at least warning level by severity."""
    kept = findings(spark, sf_dir).where(P.severity_rank(F.col("severity")) >= 2)
    return kept.groupBy("severity").agg(F.count("*").alias("n"), F.countDistinct("path").alias("files"))


VERDICTS_SQL = """items AS (
  SELECT doc_id AS item, 'ai_code_review' AS rule_id, 'Security review' AS rule_name, CASE quality WHEN 0 THEN 'fail' ELSE 'pass' END AS status, concat(source, '/', lang, ':', CAST(doc_id AS STRING), ' - low') AS affected FROM labels JOIN documents USING (doc_id)
  UNION ALL SELECT doc_id, 'duplicates', 'Duplicate comments', CASE toxic WHEN 1 THEN 'warn' ELSE 'pass' END, concat(source, '/', lang, ' - text') FROM labels JOIN documents USING (doc_id))"""


@query(f"""WITH {VERDICTS_SQL}, f AS (SELECT DISTINCT item, rule_id, status, regexp_replace(regexp_replace(affected, ' - .*$', ''), ':[0-9]+$', '') AS path FROM items WHERE status <> 'pass')
SELECT path, CAST(sum(CASE status WHEN 'fail' THEN 2 ELSE 1 END) AS BIGINT) AS total, CAST(sum(CASE WHEN rule_id = 'ai_code_review' THEN 2 ELSE 0 END) AS BIGINT) AS security,
  CAST(sum(CASE WHEN rule_id = 'ai_code_review' THEN 2 ELSE 0 END) AS BIGINT) AS ai, CAST(sum(CASE WHEN rule_id = 'duplicates' THEN 1 ELSE 0 END) AS BIGINT) AS duplication,
  CAST(sum(CASE WHEN rule_id = 'duplicates' THEN 1 ELSE 0 END) AS BIGINT) AS documentation FROM f GROUP BY path""")
def issue_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted issues by file and category, an item counting once a file."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    joined = load(spark, sf_dir, "labels").join(docs, "doc_id")
    base = F.concat("source", F.lit("/"), "lang")
    review = joined.select(
        F.col("doc_id").alias("item"), F.lit("ai_code_review").alias("rule_id"), F.lit("Security review").alias("rule_name"),
        F.when(F.col("quality") == 0, "fail").otherwise("pass").alias("status"), F.concat(base, F.lit(":"), F.col("doc_id").cast("string"), F.lit(" - low")).alias("affected"),
    )
    copies = joined.select(
        F.col("doc_id").alias("item"), F.lit("duplicates").alias("rule_id"), F.lit("Duplicate comments").alias("rule_name"),
        F.when(F.col("toxic") == 1, "warn").otherwise("pass").alias("status"), F.concat(base, F.lit(" - text")).alias("affected"),
    )
    items = review.unionByName(copies).withColumn("path", P.affected_file(F.col("affected"))).where("path IS NOT NULL")
    return rollups.issue_buckets(items.dropDuplicates(["item", "rule_id", "path"]))


@query("SELECT 'quality' AS rule, count(*) FILTER (WHERE quality = 1) AS passed, 0 AS warned, count(*) FILTER (WHERE quality = 0) AS failed FROM labels UNION ALL SELECT 'toxic', count(*) FILTER (WHERE toxic = 0), count(*) FILTER (WHERE toxic = 1), 0 FROM labels")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes, warnings and failures by rule."""
    labels = load(spark, sf_dir, "labels")
    verdicts = labels.select(
        F.explode(
            F.array(
                F.struct(F.lit("quality").alias("rule"), F.when(F.col("quality") == 1, "pass").when(F.col("quality") == 0, "fail").alias("status")),
                F.struct(F.lit("toxic").alias("rule"), F.when(F.col("toxic") == 0, "pass").when(F.col("toxic") == 1, "warn").alias("status")),
            )
        ).alias("v")
    ).select("v.*")
    return verdicts.groupBy("rule").agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in (("pass", "passed"), ("warn", "warned"), ("fail", "failed"))])


@query(f"WITH {FINDINGS_SQL} SELECT path, severity, line, length(message) AS size FROM found ORDER BY path, CASE severity WHEN 'error' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END DESC, line, message")
def file_issues_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in display order."""
    f = findings(spark, sf_dir).orderBy("path", F.desc(P.severity_rank(F.col("severity"))), "line", "message")
    return f.select("path", "severity", "line", F.length("message").alias("size"))


@query(f"""WITH {FINDINGS_SQL}, d AS (SELECT DISTINCT severity, path FROM found), r AS (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY path) AS k FROM d)
SELECT severity, string_agg(path, ',' ORDER BY path) AS sample FROM r WHERE k <= 20 GROUP BY severity""")
def affected_dedup_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty distinct paths of every severity; a report of bounded size."""
    first = top_k(findings(spark, sf_dir).select("severity", "path").distinct(), ["severity"], [F.col("path")], 20)
    return first.groupBy("severity").agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("sample"))


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '00') ORDER BY c_name, c_custkey LIMIT 24 OFFSET 24")
def search_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a text search, 24 rows a page."""
    c = load(spark, sf_dir, "customer").where(F.contains(F.lower("c_name"), F.lit("00")))
    return c.select("c_custkey", "c_name").orderBy("c_name", "c_custkey").offset(24).limit(24)


@query("SELECT conv_id, turn, i AS line_no, line FROM (SELECT conv_id, turn, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS ls FROM conversations)) WHERE regexp_matches(line, '[Tt]ion')")
def grep_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that match an expression, with their numbers."""
    lines = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n", -1)).alias("p", "line"))
    return lines.where(F.regexp_like("line", F.lit("[Tt]ion"))).select("conv_id", "turn", (F.col("p") + 1).cast("long").alias("line_no"), "line")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(CAST(json_extract(props, '$.missing') AS BIGINT), 7) AS fallback FROM events")
def typed_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed getters with defaults over JSON settings, as variants."""
    e = load(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("v"))
    return e.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"), F.coalesce(F.try_variant_get("v", "$.missing", "bigint"), F.lit(7)).alias("fallback"))


@query("""WITH p AS (SELECT url, regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1) AS path FROM pages)
SELECT url, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '.' END AS parent, regexp_extract(path, '([^/]*)$', 1) AS base FROM p""")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent and base name of url paths."""
    p = load(spark, sf_dir, "pages").select("url", F.regexp_extract("url", "^[a-z]+://[^/]*(/[^?#]*)", 1).alias("path"))
    return p.select("url", P.parent_dir(F.col("path")).alias("parent"), P.basename(F.col("path")).alias("base"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def three_level_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, subgroup and total in one rollup."""
    return load(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_linenumber").cast("long").alias("lines"))


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders")
def unreferenced_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that nothing refers to."""
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return c.join(load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), "id", "left_anti").distinct()


LINTERS = (
    ("typescript", "TypeScript / JavaScript", "eslint", "warning", 20, True, True, None),
    ("rust", "Rust", "clippy", "error", 5, True, True, None),
    ("python", "Python", "ruff", "info", 10, True, False, None),
    ("go", "Go", "staticcheck", "warning", 20, True, True, None),
)


@query(f"""WITH {CODE_LINES_SQL}, found AS (
  SELECT CASE WHEN path LIKE '%.ts' OR path LIKE '%.js' THEN 'typescript' WHEN path LIKE '%.rs' THEN 'rust' ELSE 'python' END AS language, path, line_no,
    CASE WHEN contains(line, '}} else if') THEN 'error' WHEN contains(line, 'total +=') THEN 'warning' ELSE 'info' END AS severity, trim(line) AS message
  FROM lines WHERE contains(line, '}} else if') OR contains(line, 'total +=') OR contains(line, 'TODO')),
entries AS (SELECT DISTINCT language, concat(path, ':', line_no, ' — [', severity, '] ', message) AS entry FROM found WHERE severity = 'error' OR (severity = 'warning' AND language <> 'rust')),
shown AS (SELECT language, list(entry ORDER BY entry) AS l FROM entries GROUP BY language),
n AS (SELECT language, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w FROM found GROUP BY language)
SELECT 'linter:typescript' AS rule_id, 'TypeScript / JavaScript (eslint)' AS rule_name, 'fail' AS status, concat(e, ' error(s), ', w, ' warning(s), 0 info — level ≥ warning') AS message, array_to_string(l[:20], chr(10)) AS affected FROM n JOIN shown USING (language) WHERE language = 'typescript'
UNION ALL SELECT 'linter:rust', 'Rust (clippy)', 'fail', concat(e, ' error(s), 0 warning(s), 0 info — level ≥ error'), array_to_string(l[:5], chr(10)) FROM n JOIN shown USING (language) WHERE language = 'rust'
UNION ALL SELECT 'linter:python', 'Python (ruff)', 'warn', 'ruff is not installed. Install it from Settings → Language Linters.', ''
UNION ALL SELECT 'linter:go', 'Go (staticcheck)', 'pass', 'No issues reported by staticcheck', ''""")
def language_linters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of four linters over the findings that the lines of the code base give."""
    line = F.col("line")
    severity = F.when(F.contains(line, F.lit("} else if")), "error").when(F.contains(line, F.lit("total +=")), "warning").when(F.contains(line, F.lit("TODO")), "info")
    found = code_lines(spark, sf_dir).select(tool_language(F.col("path"), "lint").alias("language"), "path", F.col("line_no").alias("line"), severity.alias("severity"), F.trim(line).alias("message"))
    settings = spark.createDataFrame(LINTERS, "language string, label string, linter string, min_level string, sample_limit int, enabled boolean, installed boolean, error string")
    verdicts = linters.linter_verdicts(settings, found.where("severity IS NOT NULL"))
    return verdicts.withColumn("affected", F.array_join("affected", "\n"))
