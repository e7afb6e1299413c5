"""Queries over results of an analysis: summary, sizes among peers, charts, one path's rating, settings in force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.operators import catalogue, results
from orrery.plans.history_queries import PEERS_SQL, peer_values
from orrery.plans.registry import query
from orrery.sources.tables import code_files, doc_files, load


@query("""WITH v AS (SELECT CASE WHEN toxic = 1 THEN 'fail' WHEN quality = 0 THEN 'warn' ELSE 'pass' END AS status, quality FROM labels),
c AS (SELECT (SELECT count(DISTINCT source) FROM documents) AS packages, (SELECT count(*) FROM documents) AS files, count(*) AS rules, count(*) FILTER (status = 'pass') AS passed,
  count(*) FILTER (status = 'warn') AS warnings, count(*) FILTER (status = 'fail') AS failures, CAST(floor(avg(quality) * 100 + 0.5) AS BIGINT) AS health FROM v)
SELECT *, CASE WHEN failures > 0 THEN 'fail' WHEN warnings > 0 THEN 'warn' ELSE 'ok' END AS tone,
  concat('Analyzed ', packages, ' packages (', files, ' source files) with ', rules, ' rule(s): ', passed, ' passed, ', warnings, ' warnings, ', failures, ' failures · modularity health ', health) AS summary FROM c""")
def analysis_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, tone and summary of all documents as files, and their labels as verdicts."""
    labels, files = load(spark, sf_dir, "labels"), doc_files(spark, sf_dir).select("path", "package")
    status = F.when(F.col("toxic") == 1, "fail").when(F.col("quality") == 0, "warn").otherwise("pass")
    result = {
        "packages": files.where("package IS NOT NULL").select("package").distinct(),
        "files": files,
        "items": labels.select(status.alias("status")),
        "matrix": labels.agg((F.avg("quality") * 100).alias("health")),
    }
    return results.with_summary(results.status_counts(result))


@query("""WITH f AS (SELECT concat('o', o_orderkey) AS path, concat('c', o_custkey) AS package, count(*) AS loc FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey),
r AS (SELECT *, count(*) OVER (PARTITION BY package) AS inside, count(*) OVER () AS everywhere, count(*) OVER (PARTITION BY package ORDER BY loc) AS a, count(*) OVER (ORDER BY loc) AS b FROM f),
p AS (SELECT path, package, loc, CAST(floor(100.0 * CASE WHEN inside <= 1 THEN b / everywhere ELSE a / inside END + 0.5) AS BIGINT) AS percentile, CASE WHEN inside <= 1 THEN everywhere ELSE inside END AS peers,
  CASE WHEN inside <= 1 THEN 'project' ELSE 'package' END AS peer_scope FROM r)
SELECT *, CASE WHEN percentile <= 50 THEN 'healthy' WHEN percentile <= 80 THEN 'fair' ELSE 'poor' END AS health FROM p""")
def size_among_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every order among its customer's orders; the only order of a customer among all."""
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("loc"))
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    files = orders.join(lines, orders.o_orderkey == lines.l_orderkey)
    return results.size_among_peers(files.select(F.concat(F.lit("o"), "o_orderkey").alias("path"), F.concat(F.lit("c"), "o_custkey").alias("package"), "loc"))


@query("""WITH daily AS (SELECT event_type AS chart, date_trunc('day', ts) AS day, count(*)::DOUBLE AS amount, avg(value) AS mean FROM events WHERE ts IS NOT NULL GROUP BY 1, 2),
runs AS (SELECT *, row_number() OVER (PARTITION BY chart ORDER BY day) - 1 AS run FROM daily),
s AS (SELECT chart, 'amount' AS metric, run, amount AS value FROM runs UNION ALL SELECT chart, 'mean', run, mean FROM runs),
d AS (SELECT chart, min(value) AS a, max(value) AS b, greatest(max(run), 1) AS last FROM s GROUP BY chart),
e AS (SELECT chart, last, CASE WHEN chart = 'signup' THEN 0 ELSE greatest(0, a - CASE WHEN a = b THEN greatest(1, abs(b) * 0.1) ELSE (b - a) * 0.08 END) END AS low,
  CASE WHEN chart = 'signup' THEN 100 ELSE b + CASE WHEN a = b THEN greatest(1, abs(b) * 0.1) ELSE (b - a) * 0.08 END END AS high FROM d)
SELECT chart, metric, run, round(8 + run / last * 304.0, 4) AS x, round(6 + (1 - (value - low) / greatest(high - low, 1e-9)) * 108.0, 4) AS y FROM s JOIN e USING (chart) WHERE value IS NOT NULL""")
def chart_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two series a day of every event type as points of a chart; one type's axis is that of percentages."""
    events = load(spark, sf_dir, "events").where("ts IS NOT NULL")
    daily = events.groupBy(F.col("event_type").alias("chart"), F.date_trunc("day", "ts").alias("day")).agg(F.count("*").cast("double").alias("amount"), F.avg("value").alias("mean"))
    runs = daily.withColumn("run", F.row_number().over(Window.partitionBy("chart").orderBy("day")) - 1)  # a row a day
    scale = F.when(F.col("chart") == "signup", "percent").otherwise("number")
    series = runs.unpivot(["chart", "run"], ["amount", "mean"], "metric", "value").withColumn("scale", scale)
    points = results.chart_points(series, ["chart"], 320.0, 120.0, 8.0, 6.0)
    return points.select("chart", "metric", F.col("run").cast("long").alias("run"), F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(f"""{PEERS_SQL}, own AS (SELECT min(path) AS id FROM wide)
SELECT id, CAST(least(greatest(floor(round(sum(score * weight) / sum(weight), 9) + 0.5), 0), 100) AS BIGINT) AS rating FROM scored JOIN own ON path = id GROUP BY id""")
def rating_of_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rating of the first file by name among all files, without ranking the others."""
    first = code_files(spark, sf_dir).agg(F.min("path").alias("path")).first()["path"]
    values = peer_values(spark, sf_dir)
    return results.rating_of(first, values, values.limit(0))


IN_FORCE_SQL = ", ".join(f"('{r}', '{k}', {d}, {a}, {b})" for r, k, _, d, a, b in catalogue.setting_rows())


@query(f"""WITH s(rule_id, key, d, a, b) AS (VALUES {IN_FORCE_SQL}),
saved AS (SELECT concat('c', o_custkey) AS project, max(CAST(floor(o_totalprice / 1000) AS BIGINT)) AS v FROM orders GROUP BY o_custkey)
SELECT concat('c', c_custkey) AS project, rule_id, key, CAST(least(greatest(coalesce(CASE WHEN key = 'sample_limit' THEN v END, CASE WHEN key = 'clean_dry' AND v % 2 = 0 THEN 0 END, d), a), b) AS DOUBLE) AS value
FROM customer CROSS JOIN s LEFT JOIN saved ON project = concat('c', c_custkey)""")
def settings_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of every customer as a project: limits from the largest order, one lens switched off where that is even."""
    projects = load(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("project"))
    best = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.floor(F.col("o_totalprice") / 1000)).alias("v"))
    limit_of = [r for r, k, *_ in catalogue.setting_rows() if k == "sample_limit"]
    limits = F.transform(F.array(*map(F.lit, limit_of)), lambda r: F.struct(r.alias("rule_id"), F.lit("sample_limit").alias("key"), F.col("v").cast("string").alias("value")))
    lens = F.struct(F.lit("ai_clean_code").alias("rule_id"), F.lit("clean_dry").alias("key"), F.when(F.col("v") % 2 == 0, "false").otherwise("true").alias("value"))
    saved = best.select(F.concat(F.lit("c"), "o_custkey").alias("project"), F.explode(F.array_append(limits, lens)).alias("s")).select("project", "s.*")
    return catalogue.settings_in_force(projects, saved)
