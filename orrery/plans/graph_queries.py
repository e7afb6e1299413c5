"""Queries over dependency graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.operators import graph as G
from orrery.operators import rules
from orrery.plans.registry import query
from orrery.sources.tables import load

EDGES_SQL = """
flows AS (
  SELECT cn.n_name AS source, sn.n_name AS target, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation cn ON cn.n_nationkey = c_nationkey JOIN nation sn ON sn.n_nationkey = s_nationkey
  WHERE cn.n_name <> sn.n_name GROUP BY 1, 2
), edges AS (SELECT source, target, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, target) AS k FROM flows) WHERE k <= 2),
nodes AS (SELECT n_name AS id, r_name AS grp FROM nation JOIN region ON n_regionkey = r_regionkey)"""
REACH_SQL = "reach AS (SELECT source, target FROM edges UNION SELECT r.source, e.target FROM reach r JOIN edges e ON r.target = e.source)"


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line counts from customers' to suppliers' nations; pre-aggregated on the small keys."""
    nation = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supplier = load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).where("c_nationkey <> s_nationkey")
    counts = joined.groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("n"))
    a = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("source"))
    b = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("target"))
    return counts.join(F.broadcast(a), "c_nationkey").join(F.broadcast(b), "s_nationkey").select("source", "target", "n")


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two heaviest suppliers of every nation."""
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "target"))
    return flows(spark, sf_dir).withColumn("k", rank).where("k <= 2").select("source", "target", "n")


def nation_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_name").alias("id"), F.col("r_name").alias("group"))


@query(f"WITH {EDGES_SQL} SELECT source, target, n FROM edges")
def dependency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed dependency edges: the top two targets of every source."""
    return nation_edges(spark, sf_dir)


@query(f"""WITH {EDGES_SQL}, a AS (SELECT id, (SELECT count(*) FROM edges WHERE source = id) AS out_degree, (SELECT count(*) FROM edges WHERE target = id) AS in_degree FROM nodes)
SELECT *, CASE WHEN out_degree + in_degree = 0 THEN 'independent' WHEN greatest(out_degree, in_degree) >= 3 THEN 'hub' ELSE 'withDependencies' END AS role FROM a""")
def node_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees and role of every node, isolated ones included."""
    return G.degrees(nation_edges(spark, sf_dir), nation_nodes(spark, sf_dir))


@query(f"WITH {EDGES_SQL} SELECT target AS id, 'uses' AS direction FROM edges WHERE source = 'NATION_3' UNION SELECT source, 'used by' FROM edges WHERE target = 'NATION_3'")
def neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules next to one module."""
    return G.neighbourhood(nation_edges(spark, sf_dir), "NATION_3")


@query(f"WITH RECURSIVE {EDGES_SQL}, {REACH_SQL} SELECT source, target FROM reach")
def closure_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reachable pairs."""
    return G.closure(nation_edges(spark, sf_dir))


SCC_SQL = f"""WITH RECURSIVE {EDGES_SQL}, {REACH_SQL},
mutual AS (SELECT id, least(id, coalesce((SELECT min(a.target) FROM reach a JOIN reach b ON a.target = b.source WHERE a.source = id AND b.target = id), id)) AS component FROM nodes)
SELECT id, component, count(*) OVER (PARTITION BY component) AS size, count(*) OVER (PARTITION BY component) > 1 AS cyclic FROM mutual"""


@query(SCC_SQL)
def scc_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongly connected components by colouring."""
    return G.strong_components(nation_edges(spark, sf_dir), nation_nodes(spark, sf_dir))


MATRIX_SQL = "els AS (SELECT id, grp, row_number() OVER (ORDER BY grp, id) - 1 AS idx FROM nodes)"


@query(f"""WITH {EDGES_SQL}, {MATRIX_SQL}
SELECT a.idx AS row_idx, b.idx AS col_idx, n AS weight FROM flows f JOIN els a ON f.source = a.id JOIN els b ON f.target = b.id""")
def dsm_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted structure matrix in sparse form; pre-counted flows keep the edge list small."""
    elements = G.matrix_elements(nation_nodes(spark, sf_dir), nation_edges(spark, sf_dir))
    a = elements.select(F.col("id").alias("source"), F.col("idx").alias("row_idx"))
    b = elements.select(F.col("id").alias("target"), F.col("idx").alias("col_idx"))
    return flows(spark, sf_dir).join(F.broadcast(a), "source").join(F.broadcast(b), "target").select("row_idx", "col_idx", F.col("n").alias("weight"))


DSM_SQL = f"""WITH RECURSIVE {EDGES_SQL}, {REACH_SQL}, {MATRIX_SQL},
cells AS (SELECT a.idx AS i, b.idx AS j, a.grp AS ga, b.grp AS gb, e.target FROM edges e JOIN els a ON e.source = a.id JOIN els b ON e.target = b.id),
fan AS (SELECT target, count(*) AS f FROM cells GROUP BY target), bus AS (SELECT target FROM fan WHERE f >= 3),
mutual AS (SELECT id, (SELECT min(a.target) FROM reach a JOIN reach b ON a.target = b.source WHERE a.source = id AND b.target = id) AS c FROM nodes),
ring AS (SELECT count(c) AS cyclic_nodes, count(DISTINCT c) AS cycles FROM mutual),
price AS (SELECT CASE WHEN target IN (SELECT target FROM bus) THEN 1 WHEN ga = gb THEN (SELECT count(*) FROM els WHERE grp = ga) ** 2 ELSE 625 END AS c FROM cells),
one AS (SELECT 25 AS n, (SELECT count(*) FROM cells WHERE i < j) / 300.0 AS upper, (SELECT count(*) FROM cells) / 600.0 AS coupling,
  ((SELECT count(*) FROM reach WHERE source <> target) + 25) / 625.0 AS propagation, (SELECT count(*) FROM cells) AS deps, (SELECT sum(c) FROM price) AS cost, (SELECT count(*) FROM bus) AS buses),
two AS (SELECT *, least(1.0, cost / (deps * 625.0)) AS normalised FROM one, ring)
SELECT CAST(n AS BIGINT) AS n, round(upper, 6) AS upper, round(coupling, 6) AS coupling, cyclic_nodes, cycles, round(propagation, 6) AS propagation, deps, CAST(cost AS DOUBLE) AS cost,
  round(normalised, 6) AS normalised, buses,
  round(least(100, greatest(0, 100 - 45.0 * cyclic_nodes / n - 2.0 * least(cycles, 10) - 20 * upper - 15 * propagation - 15 * normalised - 5 * coupling)), 6) AS health FROM two"""


@query(DSM_SQL)
def dsm_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles, densities, propagation, clustered cost, buses and the health score."""
    edges = nation_edges(spark, sf_dir)
    return G.dsm_report(nation_nodes(spark, sf_dir), edges)


LAYERS = ("AFRICA", "AMERICA", "ASIA", "EUROPE")
_RANK = "CASE {0} " + " ".join(f"WHEN '{n}' THEN {k}" for k, n in enumerate(LAYERS)) + " END"


@query(f"""WITH {EDGES_SQL}, g AS (SELECT DISTINCT a.grp AS source, b.grp AS target FROM edges e JOIN nodes a ON e.source = a.id JOIN nodes b ON e.target = b.id)
SELECT 'layers' AS rule_id, source, target FROM g WHERE {_RANK.format('source')} < {_RANK.format('target')}""")
def layer_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package edges that point up the layers."""
    nodes, edges = nation_nodes(spark, sf_dir), nation_edges(spark, sf_dir)
    a, b = nodes.select(F.col("id").alias("source"), F.col("group").alias("ga")), nodes.select(F.col("id").alias("target"), F.col("group").alias("gb"))
    grouped = edges.join(F.broadcast(a), "source").join(F.broadcast(b), "target").select(F.col("ga").alias("source"), F.col("gb").alias("target")).distinct()
    return rules.layer_violations(grouped, LAYERS)


PART_PATH = "concat('lib/', replace(p_brand, '#', ''), '/', replace(p_type, ' ', '/'), '/p', CAST(p_partkey AS STRING))"
FORBIDDEN = (("no-steel", "lib/Brand11", "lib/Brand22"), ("no-self", "lib/Brand33", "."))


@query(f"""WITH e AS (SELECT DISTINCT a.path AS source, b.path AS target FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1
  JOIN (SELECT p_partkey, {PART_PATH} AS path FROM part) a ON a.p_partkey = x.l_partkey JOIN (SELECT p_partkey, {PART_PATH} AS path FROM part) b ON b.p_partkey = y.l_partkey)
SELECT rule_id, count(*) AS hits FROM (
  SELECT 'no-steel' AS rule_id FROM e WHERE starts_with(source, 'lib/Brand11/') AND starts_with(target, 'lib/Brand22/') UNION ALL
  SELECT 'no-self' FROM e WHERE starts_with(source, 'lib/Brand33/')) GROUP BY rule_id""")
def forbid_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forbidden file dependencies by rule, over all consecutive parts of orders."""
    part = load(spark, sf_dir, "part").select("p_partkey", F.expr(PART_PATH).alias("path"))
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("next"))
    pairs = lines.join(after, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("a"), F.col("next").alias("b")).distinct()
    edges = pairs.join(part.select(F.col("p_partkey").alias("a"), F.col("path").alias("source")), "a").join(part.select(F.col("p_partkey").alias("b"), F.col("path").alias("target")), "b")
    return rules.forbid_violations(edges.select("source", "target").distinct(), FORBIDDEN).groupBy("rule_id").agg(F.count("*").alias("hits"))


@query(f"""WITH p AS (SELECT p_partkey, {PART_PATH} AS path FROM part), owners AS (SELECT DISTINCT concat('lib/', replace(p_brand, '#', '')) AS owner FROM part WHERE p_brand <> 'Brand#11'
  UNION SELECT DISTINCT concat('lib/', replace(p_brand, '#', ''), '/', split_part(p_type, ' ', 1)) FROM part WHERE p_size > 25)
SELECT p.p_partkey, coalesce((SELECT arg_max(owner, length(owner)) FROM owners WHERE path = owner OR starts_with(path, owner || '/')), '.') AS owner FROM p""")
def longest_prefix_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The package that owns each path: ancestors exploded, then an equi-join."""
    part = load(spark, sf_dir, "part")
    brand = F.concat(F.lit("lib/"), F.replace("p_brand", F.lit("#"), F.lit("")))
    owners = part.where("p_brand <> 'Brand#11'").select(brand.alias("owner")).unionByName(
        part.where("p_size > 25").select(F.concat(brand, F.lit("/"), F.split_part("p_type", F.lit(" "), F.lit(1))).alias("owner"))
    )
    return G.prefix_owner(part.select("p_partkey", F.expr(PART_PATH).alias("path")), owners.distinct()).select("p_partkey", "owner")


@query("""WITH e AS (SELECT s_nationkey AS source, c_nationkey AS target, CASE o_orderkey % 3 WHEN 0 THEN 'manifest' WHEN 1 THEN 'import' ELSE 'wasm' END AS kind
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)
SELECT source, target, arg_min(kind, CASE kind WHEN 'manifest' THEN 0 WHEN 'import' THEN 1 ELSE 2 END) AS kind FROM e WHERE source <> target GROUP BY source, target""")
def kind_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edge a pair, the strongest kind: manifest, then import, then wasm."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    joined = lines.join(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    joined = joined.join(load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    rank = F.col("o_orderkey") % 3
    best = joined.where("s_nationkey <> c_nationkey").groupBy(F.col("s_nationkey").alias("source"), F.col("c_nationkey").alias("target")).agg(F.min(rank).alias("k"))
    return best.select("source", "target", F.element_at(F.array(*map(F.lit, ("manifest", "import", "wasm"))), (F.col("k") + 1).cast("int")).alias("kind"))


@query(f"""WITH {EDGES_SQL}, deg AS (SELECT id FROM nodes WHERE (SELECT count(*) FROM edges WHERE source = id OR target = id) >= 3)
SELECT id FROM deg INTERSECT SELECT id FROM nodes WHERE grp IN ('EUROPE', 'ASIA')""")
def visible_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that both the role filter and the group filter show."""
    nodes = nation_nodes(spark, sf_dir)
    by_role = G.degrees(nation_edges(spark, sf_dir), nodes).where("out_degree + in_degree >= 3").select("id")
    return by_role.intersect(nodes.where(F.col("group").isin("EUROPE", "ASIA")).select("id"))
