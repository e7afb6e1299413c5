"""Queries over commits, ratings and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import metrics as M
from orrery.functions.paths import round_half_up
from orrery.operators import history as H
from orrery.operators import joins as J
from orrery.operators import ratings as R
from orrery.operators.ranks import rollup
from orrery.plans.code_queries import CLASSIC_SQL, SQL_LINES
from orrery.plans.registry import query
from orrery.sources.tables import CODE_SQL, code_files, load

COMMITS_SQL = """commits AS (
  SELECT event_id AS commit_id, ts, user_id AS path, concat(event_type, ' ', CAST(event_id % 7 AS STRING)) AS subject, CAST(floor(abs(value)) AS BIGINT) AS added,
    event_id % 5 AS deleted FROM events)"""
CORRECTIVE_SQL = "regexp_matches(lower(subject), 'fix|bug|defect|regression|crash|error|fail|patch|resolve|correct|workaround|oops|typo|npe|nullpointer|segfault|leak|broken|issue #|closes #')"


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as ``(commit_id, ts, path, subject, added, deleted)``."""
    e = load(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("commit_id"), "ts", F.col("user_id").alias("path"), F.concat("event_type", F.lit(" "), (F.col("event_id") % 7).cast("string")).alias("subject"),
        F.floor(F.abs("value")).cast("long").alias("added"), (F.col("event_id") % 5).alias("deleted"),
    )


@query(f"WITH {COMMITS_SQL} SELECT path, CAST(sum(added) AS BIGINT) AS lines_added, CAST(sum(deleted) AS BIGINT) AS lines_deleted, count(*) AS commits FROM commits GROUP BY path")
def churn_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines added and deleted and commits by path."""
    return H.churn(commits(spark, sf_dir))


@query(f"""WITH {COMMITS_SQL} SELECT path, count(*) AS commits, count(*) FILTER (WHERE {CORRECTIVE_SQL}) AS corrective_commits,
  round(100.0 * count(*) FILTER (WHERE {CORRECTIVE_SQL}) / count(*), 6) AS ccp FROM commits GROUP BY path""")
def ccp_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrective share of each path's commits."""
    return H.corrective(commits(spark, sf_dir))


@query(f"""WITH {COMMITS_SQL}, recent AS (SELECT * FROM commits WHERE ts >= (SELECT max(ts) FROM commits) - INTERVAL 10 DAY)
SELECT count(DISTINCT commit_id) AS commits, count(DISTINCT commit_id) FILTER (WHERE {CORRECTIVE_SQL}) AS corrective_commits,
  round(100.0 * count(DISTINCT commit_id) FILTER (WHERE {CORRECTIVE_SQL}) / count(DISTINCT commit_id), 6) AS ccp FROM recent""")
def ccp_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrective share of the commits of the last ten days of the log."""
    all_commits = commits(spark, sf_dir)
    last = all_commits.agg(F.max("ts").alias("now"))
    recent = H.within_days(all_commits.join(F.broadcast(last), F.lit(True)), 10, F.col("now"))
    return H.project_ccp(recent)


@query(f"""WITH {COMMITS_SQL}, files AS (SELECT c_custkey AS path, concat('pkg', CAST(c_nationkey AS STRING)) AS package FROM customer),
t AS (SELECT path, sum(added) + sum(deleted) AS churn, 100.0 * count(*) FILTER (WHERE {CORRECTIVE_SQL}) / count(*) AS ccp FROM commits GROUP BY path),
p AS (SELECT round(100.0 * count(*) FILTER (WHERE {CORRECTIVE_SQL}) / count(*), 6) AS project FROM commits),
j AS (SELECT package, CAST(coalesce(churn, 0) AS DOUBLE) AS churn, round(ccp, 6) AS ccp FROM files LEFT JOIN t USING (path))
SELECT package, count(ccp) AS touched, round(avg(churn), 6) AS churn_avg, quantile_disc(churn, 0.5) AS churn_p50, quantile_disc(churn, 0.8) AS churn_p80, quantile_disc(churn, 0.9) AS churn_p90,
  round(coalesce(avg(ccp), (SELECT project FROM p)), 6) AS ccp FROM j GROUP BY package""")
def package_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Churn and corrective share by package, with the project's share as the fallback."""
    files = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"), F.concat(F.lit("pkg"), F.col("c_nationkey").cast("string")).alias("package"))
    return H.package_history(files, commits(spark, sf_dir))


PEERS_SQL = f"""WITH {CODE_SQL}, {CLASSIC_SQL},
wide AS (SELECT path, package, CAST(cc AS DOUBLE) AS complexity, mag AS abc, vol AS halstead, CAST(mi AS DOUBLE) AS maintainability, CAST(loc AS DOUBLE) AS size FROM classic),
long AS (UNPIVOT (SELECT path, complexity, round(abc, 6) AS abc, round(halstead, 6) AS halstead, round(maintainability, 6) AS maintainability, size FROM wide)
  ON complexity, abc, halstead, maintainability, size INTO NAME metric VALUE value),
defs AS (SELECT * FROM (VALUES ('complexity', 'lower', 1.1), ('abc', 'lower', 1.0), ('halstead', 'lower', 1.0), ('maintainability', 'higher', 1.4), ('size', 'lower', 0.5)) AS t(metric, direction, weight)),
scored AS (SELECT path, metric, weight, floor(100.0 * CASE WHEN direction = 'lower' THEN cume_dist() OVER (PARTITION BY metric ORDER BY value DESC) ELSE cume_dist() OVER (PARTITION BY metric ORDER BY value) END + 0.5) AS score
  FROM long JOIN defs USING (metric))"""


def peer_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = M.with_classic_metrics(code_files(spark, sf_dir).withColumn("n", F.size(M.lines_of(F.col("content")))), loc="n", guard=False, fields=("cc", "mag", "vol", "mi"))
    wide = files.select(
        F.col("path").alias("id"), F.col("m.cc").alias("complexity"), F.round("m.mag", 6).alias("abc"), F.round("m.vol", 6).alias("halstead"),
        F.round("m.mi", 6).alias("maintainability"), F.col("n").cast("double").alias("size"),
    )
    return wide.unpivot(["id"], ["complexity", "abc", "halstead", "maintainability", "size"], "metric", "value")


@query(f"{PEERS_SQL} SELECT path AS id, CAST(least(greatest(floor(round(sum(score * weight) / sum(weight), 9) + 0.5), 0), 100) AS BIGINT) AS rating FROM scored GROUP BY path")
def file_peer_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted peer rating of every file."""
    return R.weighted_rating(R.peer_scores(peer_values(spark, sf_dir), R.metric_table(spark)))


OVERALL_SQL = f"""{PEERS_SQL}, stats AS (
  SELECT metric, 'avg' AS mode, avg(value) AS v FROM long GROUP BY metric UNION ALL SELECT metric, 'p50', quantile_disc(value, 0.5) FROM long GROUP BY metric
  UNION ALL SELECT metric, 'p80', quantile_disc(value, 0.8) FROM long GROUP BY metric UNION ALL SELECT metric, 'p90', quantile_disc(value, 0.9) FROM long GROUP BY metric),
lim AS (SELECT * FROM (VALUES ('complexity', 10, 25), ('abc', 20, 60), ('halstead', 500, 2000), ('maintainability', 70, 50), ('size', 200, 400)) AS t(metric, healthy, fair)),
abs_scored AS (SELECT mode, weight, floor(0.5 + CASE
  WHEN direction = 'lower' AND v <= healthy THEN 100 WHEN direction = 'lower' AND v <= fair THEN 100 - 50 * (v - healthy) / (fair - healthy)
  WHEN direction = 'lower' THEN greatest(0, 50 - 50 * least(1, (v - fair) / fair)) WHEN v >= healthy THEN 100 WHEN v >= fair THEN 100 - 50 * (healthy - v) / (healthy - fair)
  ELSE greatest(0, 50 - 50 * least(1, (fair - v) / fair)) END) AS s FROM stats JOIN defs USING (metric) JOIN lim USING (metric))
SELECT mode, CAST(floor(round(sum(s * weight) / sum(weight), 9) + 0.5) AS BIGINT) AS rating, CAST(floor(0.7 * floor(round(sum(s * weight) / sum(weight), 9) + 0.5) + 0.3 * 50 + 0.5) AS BIGINT) AS blended
FROM abs_scored GROUP BY mode"""


@query(OVERALL_SQL)
def overall_rating_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The project's rating from absolute thresholds, for the average and each percentile."""
    stats = rollup(peer_values(spark, sf_dir), ["metric"], "value").select("metric", "avg", "p50", "p80", "p90")
    long = stats.unpivot(["metric"], ["avg", "p50", "p80", "p90"], "mode", "v").join(F.broadcast(R.metric_table(spark)), "metric")
    scored = long.withColumn("score", R.absolute_score(F.col("v"), F.col("direction"), F.col("healthy"), F.col("fair")))
    rated = R.weighted_rating(scored, "mode")
    return rated.withColumn("blended", R.blend(F.col("rating"), F.lit(50)))


@query(f"""WITH {CODE_SQL}, s AS (SELECT path, package, len({SQL_LINES}) AS loc FROM src)
SELECT path, package, loc, CAST(floor(100.0 * cume_dist() OVER (PARTITION BY package ORDER BY loc) + 0.5) AS BIGINT) AS percentile FROM s""")
def size_percentile_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's size among the files of its package."""
    files = code_files(spark, sf_dir).select("path", "package", F.size(M.lines_of(F.col("content"))).cast("long").alias("loc"))
    return R.percentile_rank(files, "loc", "package").select("path", "package", "loc", "percentile")


@query(r"""WITH daily AS (SELECT event_type AS project, date_trunc('day', ts) AS "at", count(*) AS seq, floor(avg(value) + 0.5) AS overall FROM events GROUP BY 1, 2)
SELECT project, CAST("at" AS TIMESTAMP) AS "at", seq, CAST(overall AS BIGINT) AS overall FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY "at" DESC, seq DESC) AS k FROM daily) WHERE k <= 10""")
def score_history_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily snapshots; each project keeps its newest ten."""
    e = load(spark, sf_dir, "events")
    daily = e.groupBy(F.col("event_type").alias("project"), F.date_trunc("day", "ts").alias("at")).agg(F.count("*").alias("seq"), round_half_up(F.avg("value")).alias("overall"))
    return R.append_history(daily.limit(0), daily, keep=10)


@query("""SELECT e.event_id, e.user_id, coalesce((SELECT p.event_id FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'signup' AND p.ts <= e.ts ORDER BY p.ts DESC, p.event_id DESC LIMIT 1), -1) AS last_signup
FROM events e WHERE e.event_type = 'purchase'""")
def asof_symbol_at_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest mark at or before each row: one sort within the key, no pairing."""
    e = load(spark, sf_dir, "events")
    asks = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    marks = e.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("last_signup"))
    met = J.asof_backward(asks, marks, ["user_id"], "ts", "last_signup", F.to_date("ts"))
    return met.select("event_id", "user_id", F.coalesce("last_signup", F.lit(-1)).alias("last_signup"))


@query("""WITH w AS (SELECT p_partkey, p_size FROM part), c AS (SELECT p_partkey, unnest([1, 2, 3]) AS ord, unnest([p_partkey * 7 % 500, p_partkey * 3 % 900, p_size]) AS cand FROM w)
SELECT p_partkey, arg_min(cand, ord) AS target FROM c JOIN supplier ON s_suppkey = cand AND s_acctbal > 5000 GROUP BY p_partkey""")
def resolve_import_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of several candidates, in their order, that exists."""
    part = load(spark, sf_dir, "part")
    tries = F.array(F.col("p_partkey") * 7 % 500, F.col("p_partkey") * 3 % 900, F.col("p_size").cast("long"))
    known = load(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("path"))
    return J.first_candidate(part.select("p_partkey", tries.alias("candidates")), known, "p_partkey")


@query("""WITH t AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
s AS (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM t)
SELECT user_id, min(ts) AS started, count(*) AS events FROM s GROUP BY user_id, sid""")
def events_session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of 30 minutes by user, with Spark's session windows."""
    e = load(spark, sf_dir, "events").where("ts IS NOT NULL")
    out = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("events"))
    return out.select("user_id", F.col("w.start").alias("started"), "events")


@query("SELECT metric, count(value) > 0 AS shown, min(value) AS low, max(value) AS high FROM (UNPIVOT (SELECT c_acctbal AS balance, CAST(c_nationkey AS DOUBLE) AS nation FROM customer) ON balance, nation INTO NAME metric VALUE value) GROUP BY metric")
def chart_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which series have values, and their range."""
    c = load(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"))
    return c.unpivot([], ["balance", "nation"], "metric", "value").groupBy("metric").agg((F.count("value") > 0).alias("shown"), F.min("value").alias("low"), F.max("value").alias("high"))


def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last status by key, one pre-aggregated pass."""
    e = load(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m")).select("user_id", F.col("m.event_type").alias("status"))


query("""SELECT user_id, event_type AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")(latest_status)


@query("""WITH s AS (SELECT c_custkey AS key, c_mktsegment AS value FROM customer), f AS (SELECT DISTINCT o_custkey AS key, 'active' AS value FROM orders WHERE o_totalprice > 200000)
SELECT * FROM f UNION ALL SELECT * FROM s WHERE key NOT IN (SELECT key FROM f)""")
def kv_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the same key are replaced: an anti-join and a union."""
    store = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    fresh = load(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("key"), F.lit("active").alias("value")).distinct()
    return R.upsert(store, fresh)


@query("SELECT user_id, window_start, n FROM (SELECT user_id, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS n FROM events GROUP BY 1, 2)")
def events_daily_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows of a day by user."""
    e = load(spark, sf_dir, "events").where("ts IS NOT NULL")
    return e.groupBy("user_id", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("window_start"), "n")


PACKAGE_PEERS_SQL = f"""{PEERS_SQL}, roll AS (SELECT package, metric, quantile_disc(value, 0.9) AS value FROM long JOIN (SELECT path, package FROM wide) USING (path) GROUP BY package, metric),
pscored AS (SELECT package, weight, floor(100.0 * CASE WHEN direction = 'lower' THEN cume_dist() OVER (PARTITION BY metric ORDER BY value DESC) ELSE cume_dist() OVER (PARTITION BY metric ORDER BY value) END + 0.5) AS score
  FROM roll JOIN defs USING (metric))
SELECT package AS id, CAST(least(greatest(floor(round(sum(score * weight) / sum(weight), 9) + 0.5), 0), 100) AS BIGINT) AS rating FROM pscored GROUP BY package"""


@query(PACKAGE_PEERS_SQL)
def package_peer_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peer rating of every package from the 90th percentile of its files."""
    packages = code_files(spark, sf_dir).select(F.col("path").alias("id"), "package")
    rolled = rollup(peer_values(spark, sf_dir).join(packages, "id"), ["package", "metric"], "value").select("package", "metric", F.col("p90").alias("value"))
    return R.weighted_rating(R.peer_scores(rolled.withColumnRenamed("package", "id"), R.metric_table(spark)))


@query(f"""{PEERS_SQL}, roll AS (SELECT package, metric, quantile_disc(value, 0.9) AS value FROM long JOIN (SELECT path, package FROM wide) USING (path) GROUP BY package, metric)
SELECT metric, round(avg(value), 6) AS avg, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.8), 6) AS p80, round(quantile_disc(value, 0.9), 6) AS p90 FROM roll GROUP BY metric""")
def project_metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of package statistics: two levels of aggregation."""
    packages = code_files(spark, sf_dir).select(F.col("path").alias("id"), "package")
    rolled = rollup(peer_values(spark, sf_dir).join(packages, "id"), ["package", "metric"], "value").select("package", "metric", F.col("p90").alias("value"))
    out = rollup(rolled, ["metric"], "value")
    return out.select("metric", *[F.round(c, 6).alias(c) for c in ("avg", "p50", "p80", "p90")])
