"""Queries over scopes, symbols, orders and communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import extract as X
from orrery.functions import metrics as M
from orrery.operators import graph as G
from orrery.operators import layering as L
from orrery.operators import scopes as S
from orrery.plans.graph_queries import EDGES_SQL, REACH_SQL, flows, nation_edges, nation_nodes
from orrery.plans.registry import query
from orrery.sources.tables import CODE_SQL, DOC_PATH, code_files, doc_files, load

SCOPE_FILES_SQL = f"f AS (SELECT {DOC_PATH} AS path, source, lang, len(CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(regexp_replace(text, '\\n$', ''), chr(10)) END) AS loc FROM documents)"


@query(f"""WITH {SCOPE_FILES_SQL},
up AS (SELECT concat(source, '/', lang) AS scope, path AS id, 'file' AS kind, loc FROM f UNION ALL SELECT source, concat(source, '/', lang), 'package', loc FROM f UNION ALL SELECT '.', source, 'package', loc FROM f)
SELECT scope, id, regexp_extract(id, '([^/]*)$', 1) AS label, CAST(sum(loc) AS BIGINT) AS loc, kind FROM up GROUP BY scope, id, kind""")
def scope_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of every folder with their summed lines."""
    files = doc_files(spark, sf_dir).select("path", F.size(M.lines_of(F.col("content"))).alias("loc"))
    return S.scope_nodes(files)


SCOPE_IMPORTS_SQL = """imp AS (SELECT DISTINCT concat('r', a.c_nationkey % 5, '/n', a.c_nationkey, '/c', a.c_custkey) AS source, concat('r', s_nationkey % 5, '/n', s_nationkey, '/s', s_suppkey) AS target,
  a.c_nationkey AS cn, s_nationkey AS sn FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer a ON o_custkey = a.c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""


def imports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers that import suppliers, as files below regions and nations."""
    path = lambda nation, kind, key: F.concat(F.lit("r"), F.col(nation) % 5, F.lit("/n"), F.col(nation), F.lit(f"/{kind}"), F.col(key))
    customer = load(spark, sf_dir, "customer").select("c_custkey", path("c_nationkey", "c", "c_custkey").alias("source"))
    supplier = load(spark, sf_dir, "supplier").select("s_suppkey", path("s_nationkey", "s", "s_suppkey").alias("target"))
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    pairs = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select("o_custkey", "l_suppkey").distinct()
    edges = pairs.join(customer, pairs.o_custkey == customer.c_custkey).join(supplier, pairs.l_suppkey == supplier.s_suppkey).select("source", "target")
    files = customer.select(F.col("source").alias("path")).unionByName(supplier.select(F.col("target").alias("path"))).withColumn("loc", F.lit(1))
    return files, edges


@query(f"""WITH {SCOPE_IMPORTS_SQL}
SELECT DISTINCT '.' AS scope, concat('r', cn % 5) AS source, concat('r', sn % 5) AS target FROM imp WHERE cn % 5 <> sn % 5
UNION ALL SELECT DISTINCT concat('r', cn % 5), concat('r', cn % 5, '/n', cn), concat('r', sn % 5, '/n', sn) FROM imp WHERE cn % 5 = sn % 5 AND cn <> sn
UNION ALL SELECT DISTINCT concat('r', cn % 5, '/n', cn), source, target FROM imp WHERE cn = sn""")
def scope_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports between children of every folder; ancestors exploded, then an equi-join."""
    files, edges = imports(spark, sf_dir)
    return S.scope_edges(files, edges)


@query(f"""WITH {SCOPE_IMPORTS_SQL}, packs AS (SELECT DISTINCT concat('r', cn % 5, '/n', cn) AS source, concat('r', sn % 5, '/n', sn) AS target FROM imp WHERE cn <> sn) SELECT source, target FROM packs""")
def package_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package dependencies derived from file imports."""
    from orrery.functions.paths import parent_dir

    files, edges = imports(spark, sf_dir)
    return S.package_edges(files.withColumn("package", parent_dir(F.col("path"))), edges)


@query(f"""WITH {SCOPE_IMPORTS_SQL}, both_ends AS (SELECT source AS path, target AS other FROM imp UNION SELECT target, source FROM imp)
SELECT path, count(DISTINCT other) AS cbo FROM both_ends GROUP BY path""")
def cbo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coupling: distinct neighbouring files in either direction."""
    _, edges = imports(spark, sf_dir)
    # A pair counts once at both ends, whichever way it goes, so it is told apart once.
    pairs = edges.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    return pairs.select(F.explode(F.array("a", "b")).alias("path")).groupBy("path").agg(F.count("*").alias("cbo"))


@query(f"""WITH RECURSIVE {EDGES_SQL}, {REACH_SQL}
SELECT CAST((SELECT count(*) FROM reach WHERE source <> target) AS BIGINT) AS pairs, round(((SELECT count(*) FROM reach WHERE source <> target) + 25) / 625.0, 6) AS propagation""")
def propagation_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of element pairs that a change can reach."""
    elements = G.matrix_elements(nation_nodes(spark, sf_dir), nation_edges(spark, sf_dir))
    inner = G.simple_edges(nation_edges(spark, sf_dir), elements)
    pairs = G.closure(inner).where("source <> target").agg(F.count("*").alias("pairs"))
    return pairs.join(G.propagation(inner, elements), F.lit(True)).select("pairs", F.round("propagation", 6).alias("propagation"))


PARTITION_SQL = f"""WITH RECURSIVE {EDGES_SQL}, {REACH_SQL},
mutual AS (SELECT id, least(id, coalesce((SELECT min(a.target) FROM reach a JOIN reach b ON a.target = b.source WHERE a.source = id AND b.target = id), id)) AS component FROM nodes),
cedges AS (SELECT DISTINCT a.component AS s, b.component AS t FROM edges e JOIN mutual a ON a.id = e.source JOIN mutual b ON b.id = e.target WHERE a.component <> b.component),
walk AS (SELECT component AS c, 0 AS len FROM mutual UNION SELECT s, len + 1 FROM walk JOIN cedges ON t = c),
layer AS (SELECT c, max(len) AS l FROM walk GROUP BY c), fan AS (SELECT target, count(*) AS f FROM edges GROUP BY target)
SELECT id, CAST(row_number() OVER (ORDER BY l, component, coalesce(f, 0) DESC, id) - 1 AS INTEGER) AS idx FROM mutual JOIN layer ON c = component LEFT JOIN fan ON target = id"""


@query(PARTITION_SQL)
def partition_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foundations first: condensed layers, then smallest member, fan-in and id."""
    return L.partition_order(nation_nodes(spark, sf_dir), nation_edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {EDGES_SQL}, nb AS (SELECT source AS a, target AS b FROM edges UNION ALL SELECT target, source FROM edges UNION ALL SELECT id, id FROM nodes),
labels AS (SELECT 0 AS k, id, id AS community FROM nodes UNION ALL
  SELECT k + 1, id, min({{'n': -n, 'c': community}}).c FROM (SELECT k, b AS id, community, count(*) AS n FROM labels JOIN nb ON a = id WHERE k < {L.ROUNDS} GROUP BY k, b, community) GROUP BY k, id)
SELECT id, community FROM labels WHERE k = {L.ROUNDS}""")
def label_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of the dependency graph by label propagation."""
    return L.communities(nation_nodes(spark, sf_dir), nation_edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {EDGES_SQL}, nb AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges),
walk AS (SELECT 'NATION_3' AS id, 0 AS depth UNION SELECT nb.b, depth + 1 FROM walk JOIN nb ON nb.a = walk.id WHERE depth < 25)
SELECT nodes.id, coalesce(min(depth), -1) AS depth FROM nodes LEFT JOIN walk ON walk.id = nodes.id GROUP BY nodes.id""")
def bfs_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of every node from one root."""
    nodes = nation_nodes(spark, sf_dir)
    return L.bfs_rings(nodes, nation_edges(spark, sf_dir), nodes.where("id = 'NATION_3'")).na.fill(-1, ["depth"])


@query(f"""WITH {EDGES_SQL}, w AS (SELECT id, (SELECT count(*) FROM flows WHERE source = id OR target = id) AS deg FROM nodes)
SELECT id, deg AS connections FROM w ORDER BY deg DESC, id LIMIT 10""")
def matrix_top_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best connected elements, as a matrix of bounded size keeps them."""
    edges = flows(spark, sf_dir)
    d = G.degrees(edges, nation_nodes(spark, sf_dir)).select("id", (F.col("out_degree") + F.col("in_degree")).alias("connections"))
    return d.orderBy(F.desc("connections"), "id").limit(10)


@query(f"""WITH {CODE_SQL}, l AS (SELECT path, unnest(range(1, len(ls) + 1)) AS line, trim(unnest(ls)) AS t FROM (SELECT path, string_split(content, chr(10)) AS ls FROM src WHERE path LIKE '%.ts' OR path LIKE '%.js'))
SELECT concat(path, '::', regexp_extract(t, '^function ([A-Za-z0-9_]+)', 1)) AS id, path AS file, line FROM l WHERE starts_with(t, 'function ')""")
def symbol_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared functions of script files with their lines."""
    files = code_files(spark, sf_dir).where("path LIKE '%.ts' OR path LIKE '%.js'").select("path", "content")
    return X.extract_symbols(files).where("kind = 'function'").select("id", "file", F.col("line").cast("long").alias("line"))


@query(f"""WITH {CODE_SQL}, d AS (SELECT path, regexp_extract_all(content, 'function (f[0-9]+)', 1) AS names FROM src)
SELECT path, len(names) AS symbols, len(list_distinct(names)) AS components, round(CASE WHEN len(names) <= 1 THEN 100 ELSE greatest(0, 100.0 * (1 - (len(list_distinct(names)) - 1) / (len(names) - 1)::DOUBLE)) END, 6) AS cohesion
FROM d WHERE len(names) > 0""")
def file_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohesion from the components of same-file symbols; same names are one component."""
    files = code_files(spark, sf_dir).select("path", F.regexp_extract_all("content", F.lit("function (f[0-9]+)"), F.lit(1)).alias("names"))
    n, k = F.size("names"), F.size(F.array_distinct("names"))
    return files.where(n > 0).select("path", n.alias("symbols"), k.alias("components"), F.round(M.cohesion(n, k), 6).alias("cohesion"))


@query(f"""WITH RECURSIVE {EDGES_SQL}, {REACH_SQL}, m AS (SELECT id, (SELECT min(a.target) FROM reach a JOIN reach b ON a.target = b.source WHERE a.source = id AND b.target = id) AS c FROM nodes)
SELECT c AS component, count(*) AS size FROM m WHERE c IS NOT NULL GROUP BY c HAVING count(*) > 1""")
def cycle_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cyclic components and their sizes."""
    parts = G.strong_components(nation_edges(spark, sf_dir), nation_nodes(spark, sf_dir)).where("cyclic")
    return parts.groupBy("component").agg(F.count("*").alias("size"))


@query(f"""WITH RECURSIVE {EDGES_SQL}, {REACH_SQL}, m AS (SELECT id, (SELECT min(a.target) FROM reach a JOIN reach b ON a.target = b.source WHERE a.source = id AND b.target = id) AS c FROM nodes),
parts AS (SELECT id, c, count(*) OVER (PARTITION BY c) AS size FROM m WHERE c IS NOT NULL),
inside AS (SELECT a.c, e.source, e.target FROM edges e JOIN parts a ON a.id = e.source JOIN parts b ON b.id = e.target WHERE a.c = b.c),
walk AS (SELECT DISTINCT c, size, [c] AS path FROM parts UNION ALL
  SELECT w.c, w.size, list_append(w.path, min(i.target)) FROM walk w JOIN inside i ON i.c = w.c AND i.source = w.path[-1] WHERE NOT list_contains(w.path, i.target) AND len(w.path) < 16 GROUP BY w.c, w.size, w.path),
ends AS (SELECT c, any_value(size) AS size, arg_max(path, len(path)) AS path FROM walk GROUP BY c)
SELECT c AS component, size, array_to_string(CASE WHEN size = 1 OR EXISTS (SELECT 1 FROM inside i WHERE i.c = ends.c AND i.source = path[-1] AND i.target = ends.c) THEN list_append(path, c) ELSE path END, ' > ') AS path FROM ends""")
def cycle_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk through every cyclic component, as text."""
    from orrery.operators.reports import cycle_paths as walks

    return walks(nation_nodes(spark, sf_dir), nation_edges(spark, sf_dir)).withColumn("path", F.array_join("path", " > "))


@query(f"""WITH {EDGES_SQL}, g AS (SELECT DISTINCT a.grp AS s, b.grp AS t FROM edges e JOIN nodes a ON e.source = a.id JOIN nodes b ON e.target = b.id),
r AS (SELECT *, row_number() OVER (ORDER BY grp) AS k FROM (SELECT DISTINCT grp FROM nodes)),
v AS (SELECT count(*) AS violations FROM g JOIN r a ON a.grp = s JOIN r b ON b.grp = t WHERE a.k < b.k)
SELECT violations, CASE WHEN violations = 0 THEN 'pass' WHEN violations <= 5 THEN 'warn' ELSE 'fail' END AS status FROM v""")
def architecture_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict over layer violations between regions."""
    from orrery.operators import rules

    nodes, edges = nation_nodes(spark, sf_dir), nation_edges(spark, sf_dir)
    layers = [r["group"] for r in nodes.select("group").distinct().orderBy("group").limit(G.MAX_ELEMENTS).collect()]
    a, b = nodes.select(F.col("id").alias("source"), F.col("group").alias("ga")), nodes.select(F.col("id").alias("target"), F.col("group").alias("gb"))
    grouped = edges.join(F.broadcast(a), "source").join(F.broadcast(b), "target").select(F.col("ga").alias("source"), F.col("gb").alias("target")).distinct()
    found = rules.layer_violations(grouped, layers).agg(F.count("*").alias("violations"))
    return found.withColumn("status", rules.conformance_status(F.col("violations")))


@query(f"""WITH {SCOPE_IMPORTS_SQL}, packs AS (SELECT concat('r', n_nationkey % 5, '/n', n_nationkey) AS p, n_nationkey AS n FROM nation),
found AS (
  SELECT concat('r', s_nationkey % 5, '/n', s_nationkey) AS source, 'r0/n0' AS target, 0 AS k FROM supplier WHERE s_acctbal < 0
  UNION ALL SELECT concat('r', cn % 5, '/n', cn), concat('r', sn % 5, '/n', sn), 1 FROM imp WHERE cn <> sn
  UNION ALL SELECT concat('r', cn % 5, '/n', cn), 'r2/n7', 2 FROM imp WHERE contains(target, 'n7'))
SELECT source, target, ['manifest', 'import', 'wasm'][min(k) + 1] AS kind FROM found GROUP BY source, target""")
def package_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One graph of nations as packages: from manifests of indebted suppliers, imports, and texts that mention a package."""
    from orrery.functions.paths import parent_dir

    files, edges = imports(spark, sf_dir)
    supplier = load(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("r"), F.col("s_nationkey") % 5, F.lit("/n"), "s_nationkey").alias("package"))
    manifests = supplier.withColumn("line", F.lit('  "./r0/n1/../n0": "file:../n0",'))
    contents = edges.select(parent_dir(F.col("source")).alias("package"), F.concat(F.lit("import "), "target").alias("text"))
    return S.package_graph(files.withColumn("package", parent_dir(F.col("path"))), edges, manifests, contents, ["n7"])[1]


@query(f"""WITH {SCOPE_IMPORTS_SQL}, files AS (SELECT concat('r', c_nationkey % 5, '/n', c_nationkey, '/c', c_custkey) AS path, concat('r', c_nationkey % 5, '/n', c_nationkey) AS package FROM customer
  UNION ALL SELECT concat('r', s_nationkey % 5, '/n', s_nationkey, '/s', s_suppkey), concat('r', s_nationkey % 5, '/n', s_nationkey) FROM supplier),
ends AS (SELECT source AS path FROM imp UNION ALL SELECT target FROM imp), degrees AS (SELECT path, count(*) AS n FROM ends GROUP BY path)
SELECT path AS id, regexp_extract(path, '([^/]*)$', 1) AS label, package AS "group" FROM files LEFT JOIN degrees USING (path) ORDER BY coalesce(n, 0) DESC, path LIMIT 150""")
def matrix_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that a matrix of all files shows: by definition the 150 with most imports."""
    from orrery.functions.paths import parent_dir

    files, edges = imports(spark, sf_dir)
    return S.matrix_scope(files.withColumn("package", parent_dir(F.col("path"))), edges, edges, "file")[0]
