"""Queries over the shape of graphs: bridges, trees, components, crossings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.operators import circular, crossings, graph, trees
from orrery.operators.ranks import scanned
from orrery.plans.registry import query
from orrery.sources.tables import load


@query("""WITH RECURSIVE e AS (SELECT DISTINCT -l_orderkey AS a, l_partkey AS b FROM lineitem),
ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
tree(n, parent, depth) USING KEY (n) AS (
  SELECT min(a), CAST(NULL AS BIGINT), 0 FROM e
  UNION
  SELECT w.b, min(t.n), t.depth + 1 FROM tree t JOIN ways w ON t.n = w.a LEFT JOIN recurring.tree k ON k.n = w.b WHERE k.n IS NULL GROUP BY w.b, t.depth
), rest AS (
  SELECT e.a AS u, e.b AS v FROM e JOIN tree x ON x.n = e.a JOIN tree y ON y.n = e.b WHERE x.parent IS DISTINCT FROM e.b AND y.parent IS DISTINCT FROM e.a
), climb(u, v, covered) AS (
  SELECT u, v, CAST(NULL AS BIGINT) FROM rest
  UNION
  SELECT CASE WHEN x.depth >= y.depth THEN x.parent ELSE u END, CASE WHEN x.depth >= y.depth THEN v ELSE y.parent END, CASE WHEN x.depth >= y.depth THEN u ELSE v END
  FROM climb JOIN tree x ON x.n = u JOIN tree y ON y.n = v WHERE u <> v
)
SELECT least(n, parent) AS src, greatest(n, parent) AS dst FROM tree WHERE parent IS NOT NULL AND n NOT IN (SELECT covered FROM climb WHERE covered IS NOT NULL)""")
def bridge_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridges between orders (negative keys) and the parts that they hold."""
    lines = load(spark, sf_dir, "lineitem").select((-F.col("l_orderkey")).cast("long").alias("src"), F.col("l_partkey").cast("long").alias("dst"))
    return trees.bridges(lines)


@query("""WITH leaves AS (
  SELECT r_regionkey + 1 AS r, 1000 + n_nationkey AS n, 10000 + c_custkey AS c, 10000000000 + o_orderkey AS o FROM region LEFT JOIN nation ON n_regionkey = r_regionkey
  LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey
), placed AS (SELECT *, row_number() OVER (ORDER BY r, n, c, o) - 1 AS k FROM leaves),
every AS (
  SELECT r AS node, NULL AS parent, 0 AS depth, k FROM placed UNION ALL SELECT n, r, 1, k FROM placed WHERE n IS NOT NULL
  UNION ALL SELECT c, n, 2, k FROM placed WHERE c IS NOT NULL UNION ALL SELECT o, c, 3, k FROM placed WHERE o IS NOT NULL)
SELECT node, parent, depth, count(*) AS width, (min(k) + count(*) / 2.0::DOUBLE) * 56 AS x, depth * 72.0::DOUBLE AS y FROM every GROUP BY node, parent, depth""")
def hierarchy_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tree layout of regions, nations, customers and orders."""
    region = load(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).cast("long").alias("node"))
    links = (
        load(spark, sf_dir, "nation").select(F.col("n_regionkey") + 1, F.col("n_nationkey") + 1000),
        load(spark, sf_dir, "customer").select(F.col("c_nationkey") + 1000, F.col("c_custkey") + 10_000),
        load(spark, sf_dir, "orders").select(F.col("o_custkey") + 10_000, F.col("o_orderkey") + 10_000_000_000),
    )
    edges = None
    for link in links:
        part = link.toDF("src", "dst").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
        edges = part if edges is None else edges.unionByName(part)
    nodes = region.unionByName(edges.select(F.col("dst").alias("node")))
    return trees.tree_layout(nodes, edges)


NEXT_PARTS_SQL = """e AS (SELECT DISTINCT x.l_partkey AS source, y.l_partkey AS target FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1
  WHERE x.l_linestatus = y.l_linestatus AND x.l_returnflag = y.l_returnflag)"""


def next_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge from each part to the next one of its order, where both are of one status and return flag.

    The next lines are a range of numbers within an order's lines, so lines are dealt and sorted once, not once for either side of a join.
    """
    keys = ["l_orderkey", "l_linestatus", "l_returnflag"]
    lines = load(spark, sf_dir, "lineitem").select(*keys, F.col("l_linenumber").cast("long").alias("number"), F.col("l_partkey").cast("long").alias("source"))
    after = Window.partitionBy(*keys).orderBy("number").rangeBetween(1, 1)
    ways = lines.dropna(subset=[*keys, "number"]).withColumn("after", F.collect_list("source").over(after))
    return ways.select("source", F.explode("after").alias("target")).distinct()


@query(f"""WITH RECURSIVE {NEXT_PARTS_SQL}, reach AS (SELECT source, target FROM e UNION SELECT r.source, e.target FROM reach r JOIN e ON r.target = e.source),
mutual AS (SELECT p_partkey AS id, least(p_partkey, coalesce(c, p_partkey)) AS component, c IS NOT NULL AS cyclic FROM part LEFT JOIN (
  SELECT a.source AS id, min(a.target) AS c FROM reach a JOIN reach b ON a.target = b.source AND b.target = a.source GROUP BY 1) ON id = p_partkey)
SELECT id, component, count(*) OVER (PARTITION BY component) AS size, cyclic FROM mutual""")
def part_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong components of the parts, by which part follows which."""
    parts = load(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"))
    return graph.strong_components(next_parts(spark, sf_dir), parts)


@query("""WITH ends AS (
  SELECT 0 AS layer, o_custkey AS p, l_suppkey AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT 1, l_suppkey, l_partkey FROM lineitem
), cells AS (SELECT layer, p, q, count(*) AS n FROM ends GROUP BY ALL),
grid AS (
  SELECT a.layer, a.p, b.q, coalesce(n, 0) AS n FROM (SELECT DISTINCT layer, p FROM ends) a JOIN (SELECT DISTINCT layer, q FROM ends) b USING (layer) LEFT JOIN cells c ON c.layer = a.layer AND c.p = a.p AND c.q = b.q
), beyond AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY layer, p ORDER BY q DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM grid),
above AS (SELECT *, coalesce(sum(f) OVER (PARTITION BY layer, q ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM beyond)
SELECT layer, CAST(sum(n * g) AS BIGINT) AS crossings FROM above GROUP BY layer""")
def trade_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossings if customers, suppliers and parts stand in three rows by key, a line for every line item on both sides of its supplier."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    name = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    edges = lines.join(orders, "l_orderkey").select(name("c", "o_custkey").alias("source"), name("s", "l_suppkey").alias("target"))
    edges = edges.unionByName(lines.select(name("s", "l_suppkey").alias("source"), name("p", "l_partkey").alias("target")))
    order = None
    for layer, (kind, file, key) in enumerate((("c", "customer", "c_custkey"), ("s", "supplier", "s_suppkey"), ("p", "part", "p_partkey"))):
        row = load(spark, sf_dir, file).select(name(kind, key).alias("id"), F.lit(layer).alias("layer"), F.col(key).cast("long").alias("pos"))
        order = row if order is None else order.unionByName(row)
    return crossings.layer_crossings(order, edges)


@query("""WITH ring AS (SELECT s_suppkey AS node, row_number() OVER (ORDER BY s_nationkey, s_suppkey) - 1 AS pos FROM supplier),
links AS (SELECT DISTINCT least(x.l_suppkey, y.l_suppkey) AS a, greatest(x.l_suppkey, y.l_suppkey) AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1
  WHERE x.l_suppkey <> y.l_suppkey),
spans AS (SELECT least(p.pos, q.pos) AS lo, greatest(p.pos, q.pos) AS hi FROM links JOIN ring p ON p.node = a JOIN ring q ON q.node = b)
SELECT (SELECT count(*) FROM spans) AS links, (SELECT count(*) FROM spans x JOIN spans y ON x.lo < y.lo AND y.lo < x.hi AND x.hi < y.hi) AS crossings""")
def supplier_ring_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossing chords if suppliers stand on a circle by nation, and those of neighbouring lines of an order are linked."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").cast("long").alias("src"))
    after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("src").alias("dst"))
    suppliers = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("node"), "s_nationkey")
    ring = scanned(suppliers, [F.col("s_nationkey"), F.col("node")], number="pos").select("node", "pos")
    return circular.crossing_count(ring, lines.join(after, ["l_orderkey", "l_linenumber"]).select("src", "dst"))
