"""Queries over the operators behind the views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import display as D
from orrery.functions import paths as P
from orrery.operators import views as V
from orrery.plans import finding_queries, graph_queries
from orrery.plans.graph_queries import EDGES_SQL, MATRIX_SQL
from orrery.plans.registry import query
from orrery.sources.tables import load

KINDS = ("package", "folder", "file", "module", "struct", "trait", "method", "enum", "constant", "variable", "macro", "Class")
EXTENSIONS = ("ts", "rs", "py", "go", "java", "md")
_KIND = "[" + ", ".join(f"'{k}'" for k in KINDS) + "][p_partkey % 12 + 1]"
_EXT = "[" + ", ".join(f"'{e}'" for e in EXTENSIONS) + "][p_partkey % 6 + 1]"
_DIR = "lower(replace(p_type, ' ', '/'))"
PARTS_SQL = f"""files AS (SELECT p_partkey, p_size, p_brand, {_KIND} AS kind, {_DIR} AS dir, {_DIR} || '/f' || p_partkey || '.' || {_EXT} AS path,
  CASE {_EXT} WHEN 'ts' THEN 'typescript' WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'md' THEN 'other' ELSE {_EXT} END AS language FROM part)"""


def _at(values: tuple[str, ...], key: str):
    return F.get(F.array(*map(F.lit, values)), (F.col(key) % len(values)).cast("int"))


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as files: the words of the type are folders, kind and extension follow from the key."""
    p = load(spark, sf_dir, "part")
    folder = F.lower(F.replace("p_type", F.lit(" "), F.lit("/")))
    path = F.concat(folder, F.lit("/f"), F.col("p_partkey").cast("string"), F.lit("."), _at(EXTENSIONS, "p_partkey"))
    return p.select("p_partkey", "p_size", "p_brand", _at(KINDS, "p_partkey").alias("kind"), folder.alias("dir"), path.alias("path"))


@query(f"""WITH {PARTS_SQL} SELECT path,
  CASE kind WHEN 'folder' THEN 'package' WHEN 'module' THEN 'file' WHEN 'struct' THEN 'class' WHEN 'trait' THEN 'interface' WHEN 'method' THEN 'function'
    WHEN 'constant' THEN 'const' WHEN 'variable' THEN 'const' WHEN 'macro' THEN 'symbol' WHEN 'Class' THEN 'symbol' ELSE kind END AS class,
  CASE WHEN kind IN ('package', 'folder') THEN NULL ELSE path END AS opened, CASE WHEN kind IN ('package', 'folder', 'file', 'module') OR p_size <= 10 THEN NULL ELSE p_size - 10 END AS line,
  CASE WHEN kind IN ('package', 'folder') THEN NULL ELSE path END AS listed FROM files""")
def node_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display class of every node and the source that it opens."""
    kind, path = F.col("kind"), F.col("path")
    opened = D.openable_node(kind, F.when(F.col("p_partkey") % 2 == 0, path), path, F.col("p_size") - 10)
    even = D.openable_node(kind, path, path, F.col("p_size") - 10)
    leaf = F.when(kind.isin("file", "module"), opened).otherwise(even)
    return part_files(spark, sf_dir).select("path", D.node_class(kind).alias("class"), leaf["path"].alias("opened"), leaf["line"].alias("line"), D.openable_path(path, kind).alias("listed"))


@query(f"""WITH {PARTS_SQL}, sets AS (SELECT p_brand, p_size, list(DISTINCT language) FILTER (WHERE language <> 'other') AS langs FROM files GROUP BY ALL)
SELECT p_brand, p_size, CASE WHEN langs IS NULL OR len(langs) = 0 THEN false ELSE list_has_any(langs, ['rust', 'go']) END AS shown FROM sets""")
def language_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which packages a filter for two languages shows."""
    language = F.nullif(P.language_of(F.col("path")), F.lit("other"))
    sets = part_files(spark, sf_dir).groupBy("p_brand", "p_size").agg(F.collect_set(language).alias("langs"))
    flags = {"typescript": False, "rust": True, "python": False, "go": True, "java": False, "other": False}
    return sets.select("p_brand", "p_size", D.shows_languages(F.col("langs"), flags).alias("shown"))


@query(f"""WITH {PARTS_SQL} SELECT language AS key, count(*) AS n, count(*) FILTER (WHERE language NOT IN ('java', 'other')) AS lint, count(*) FILTER (WHERE language <> 'other') AS lsp FROM files GROUP BY 1""")
def tool_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by language, and how many of them linters and language servers see."""
    path = F.col("path")
    f = part_files(spark, sf_dir).select(P.language_of(path).alias("key"), D.tool_language(path, "lint").alias("a"), D.tool_language(path, "lsp").alias("b"))
    return f.groupBy("key").agg(F.count("*").alias("n"), F.count("a").alias("lint"), F.count("b").alias("lsp"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN 'order ' || o_orderkey ELSE 'src/o' || o_orderkey || '.ts' END AS file,
  CASE WHEN o_orderkey % 5 IN (0, 1) THEN o_orderkey % 90 + 1 END AS line, CASE WHEN o_orderkey % 5 = 1 THEN 'error' END AS severity,
  CASE o_orderkey % 5 WHEN 3 THEN NULL WHEN 4 THEN 'order ' || o_orderkey ELSE o_orderpriority || ' is late' END AS message FROM orders""")
def affected_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affected entries of all forms taken apart."""
    o, key = load(spark, sf_dir, "orders"), F.col("o_orderkey")
    file, line, text = F.concat(F.lit("src/o"), key.cast("string"), F.lit(".ts")), (key % 90 + 1).cast("string"), F.concat("o_orderpriority", F.lit(" is late"))
    raw = (
        F.when(key % 5 == 0, F.concat(file, F.lit(":"), line, F.lit(":7: "), text))
        .when(key % 5 == 1, F.concat(F.lit(" "), file, F.lit(":"), line, F.lit(" — [error] "), text))
        .when(key % 5 == 2, F.concat(file, F.lit(" – "), text))
        .when(key % 5 == 3, file)
        .otherwise(F.concat(F.lit("order "), key.cast("string"), F.lit(" ")))
    )
    return o.select("o_orderkey", D.affected_entry(raw).alias("e")).select("o_orderkey", "e.*")


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), '1') AS k, 'auto' AS mode FROM events")
def merged_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved settings over defaults."""
    defaults = F.create_map(F.lit("k"), F.lit("1"), F.lit("mode"), F.lit("auto"))
    merged = D.merged_settings(defaults, F.from_json("props", "map<string,string>"))
    return load(spark, sf_dir, "events").select("event_id", merged["k"].alias("k"), merged["mode"].alias("mode"))


@query("""WITH syms AS (SELECT p_partkey AS id, p_brand || '/' || p_size AS file FROM part),
calls AS (SELECT a.file AS sf, b.file AS tf FROM lineitem JOIN syms a ON a.id = l_partkey JOIN syms b ON b.id = l_suppkey * 3),
inner_calls AS (SELECT sf AS path, count(*) AS n FROM calls WHERE sf = tf GROUP BY 1),
pairs AS (SELECT sf AS a, tf AS b FROM calls WHERE sf <> tf UNION SELECT tf, sf FROM calls WHERE sf <> tf UNION SELECT p_brand || '/' || p_size, p_brand || '/1' FROM part WHERE p_size <> 1),
near AS (SELECT a AS path, count(*) AS n FROM pairs GROUP BY 1)
SELECT path, coalesce(i.n, 0) AS internal_calls, coalesce(c.n, 0) AS cbo FROM inner_calls i FULL JOIN near c USING (path)""")
def symbol_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Internal calls and coupling of files from symbol edges and imports."""
    file = lambda size: F.concat("p_brand", F.lit("/"), size)
    p = load(spark, sf_dir, "part")
    symbols = p.select(F.col("p_partkey").alias("id"), file(F.col("p_size").cast("string")).alias("file"))
    edges = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source"), (F.col("l_suppkey") * 3).alias("target"))
    imports = p.select(file(F.col("p_size").cast("string")).alias("source"), file(F.lit("1")).alias("target")).distinct()
    return V.coupling_counts(imports, V.symbol_edge_files(edges, symbols))


@query(f"""WITH {finding_queries.VERDICTS_SQL}, f AS (SELECT DISTINCT item, rule_id, status, regexp_replace(regexp_replace(affected, ' - .*$', ''), ':[0-9]+$', '') AS path FROM items WHERE status <> 'pass'),
b AS (SELECT path, sum(CASE status WHEN 'fail' THEN 2 ELSE 1 END) AS total, sum(CASE WHEN rule_id = 'duplicates' THEN 1 ELSE 0 END) AS documentation FROM f GROUP BY path),
all_files AS (SELECT DISTINCT source || '/' || lang AS path FROM documents UNION SELECT 'src/clean.ts')
SELECT path, CAST(coalesce(total, 0) AS BIGINT) AS total, CAST(coalesce(documentation, 0) AS BIGINT) AS documentation,
  CASE WHEN coalesce(documentation, 0) > 0 THEN greatest(0.0, 100.0 - 25.0 * documentation)::DOUBLE END AS documentation_score FROM all_files LEFT JOIN b USING (path) WHERE path IS NOT NULL""")
def file_issue_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of every file, none being 0, and the documentation score."""
    d = load(spark, sf_dir, "documents")
    files = d.select(F.concat("source", F.lit("/"), "lang").alias("path")).where("path IS NOT NULL").unionByName(spark.createDataFrame([("src/clean.ts",)], "path string")).distinct()
    met = V.with_issues(files, finding_queries.issue_buckets(spark, sf_dir), ["total", "documentation"])
    return met.withColumn("documentation_score", D.documentation_score(F.col("documentation")))


@query(f"WITH {EDGES_SQL} SELECT source, target FROM edges WHERE source IN (SELECT id FROM nodes WHERE grp <> 'ASIA') AND target IN (SELECT id FROM nodes WHERE grp <> 'ASIA')")
def highlighted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between selected nodes."""
    ids = graph_queries.nation_nodes(spark, sf_dir).where(F.col("group") != "ASIA")
    return V.highlighted(graph_queries.nation_edges(spark, sf_dir).select("source", "target"), ids)


@query(f"WITH {EDGES_SQL} SELECT source, target, exists(SELECT 1 FROM edges v WHERE v.n % 2 = 0 AND ends_with('root/' || v.source, e.source) AND ends_with('root/' || v.target, e.target)) AS violated FROM edges e")
def violated_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrix cells that a violation names by the ends of its paths."""
    edges = graph_queries.nation_edges(spark, sf_dir)
    root = lambda c: F.concat(F.lit("root/"), c)
    violations = edges.where("n % 2 = 0").select(root(F.col("source")).alias("from"), root(F.col("target")).alias("to"))
    return V.cell_violations(edges.select("source", "target"), violations)


@query("SELECT c_mktsegment AS scope, min(c_acctbal) AS min_x, max(c_acctbal) AS max_x, CAST(min(c_nationkey) AS DOUBLE) AS min_y, CAST(max(c_nationkey) AS DOUBLE) AS max_y FROM customer GROUP BY 1")
def visible_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounding boxes of the visible nodes of every scope."""
    c = load(spark, sf_dir, "customer")
    return V.bounding_box(c.select(F.col("c_mktsegment").alias("scope"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y")), ["scope"])


@query("""SELECT c_mktsegment, side, c_name, c_acctbal FROM (
  SELECT c_mktsegment, 'best' AS side, c_name, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_name) AS k FROM customer UNION ALL
  SELECT c_mktsegment, 'worst', c_name, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_name) FROM customer) WHERE k <= 5""")
def best_and_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best and worst rated entities of every group."""
    from orrery.operators.ranks import top_k

    c = load(spark, sf_dir, "customer").select("c_mktsegment", "c_name", "c_acctbal")
    first = lambda side, order: top_k(c, ["c_mktsegment"], [order, F.col("c_name")], 5).withColumn("side", F.lit(side))
    return first("best", F.desc("c_acctbal")).unionByName(first("worst", F.asc("c_acctbal")))


@query("SELECT o_custkey AS project, o_orderkey AS run, o_orderdate AS started_at FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k <= 2")
def recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two latest runs of every project."""
    from orrery.operators.ranks import top_k

    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("run"), F.col("o_orderdate").alias("started_at"))
    return top_k(o, ["project"], [F.desc("started_at"), F.col("run")], 2)


@query(f"""WITH {PARTS_SQL} (SELECT 'package' AS part, dir AS name FROM (SELECT DISTINCT dir FROM files) ORDER BY dir LIMIT 40)
UNION ALL (SELECT 'file', path FROM files ORDER BY p_size DESC, path LIMIT 25) UNION ALL (SELECT 'item', CAST(doc_id AS VARCHAR) FROM labels ORDER BY doc_id LIMIT 20)""")
def review_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a review is shown: first packages, largest files, first items."""
    files = part_files(spark, sf_dir)
    items = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("item"))
    return V.context(files.select(F.col("dir").alias("package")), files.select("path", F.col("p_size").alias("loc")), items)


@query("""WITH l AS (SELECT conv_id, turn, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS ls FROM conversations)),
hits AS (SELECT * FROM l WHERE regexp_matches(line, '[Ii]n ')) SELECT conv_id, turn, pos, line, (SELECT count(*) FROM hits) > 30 AS truncated FROM hits ORDER BY conv_id, turn, pos LIMIT 30""")
def grep_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 30 matching lines and whether there are more."""
    lines = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return V.grep(lines.withColumn("pos", F.col("pos").cast("long")), "[Ii]n ", ["conv_id", "turn", "pos"], 30)


@query(f"""WITH {finding_queries.FINDINGS_SQL} SELECT 'lsp_diagnostics' AS rule_id, CASE WHEN count(*) FILTER (WHERE severity = 'error') > 0 THEN 'fail' ELSE 'warn' END AS status,
  count(*) FILTER (WHERE severity = 'error') || ' error(s), ' || count(*) FILTER (WHERE severity = 'warning') || ' warning(s) from language servers' AS message,
  (SELECT string_agg(e, chr(10) ORDER BY e) FROM (SELECT DISTINCT path || ':' || line || ' — ' || message AS e FROM found WHERE severity IN ('error', 'warning') ORDER BY e LIMIT 10)) AS affected FROM found""")
def language_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of the language servers' findings."""
    found = finding_queries.findings(spark, sf_dir).withColumn("source", F.lit("tsserver"))
    return V.diagnostics_verdict(found).withColumn("affected", F.array_join("affected", "\n"))


@query("SELECT DISTINCT p_brand AS source, 'lib/' || lower(p_brand) AS target, 'manifest' AS kind FROM part WHERE p_size % 2 = 0")
def manifest_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package edges from manifest lines; a line counts if it starts with a quoted name."""
    line = F.concat(F.when(F.col("p_size") % 2 == 0, F.lit(' "./lib/x/../')).otherwise(F.lit(' path = "./lib/')), F.lower("p_brand"), F.lit('": "file:../elsewhere",'))
    return V.manifest_edges(load(spark, sf_dir, "part").select(F.col("p_brand").alias("package"), line.alias("line")))


@query("SELECT DISTINCT source, 'crates/Licensed under' AS target, 'wasm' AS kind FROM documents WHERE contains(text, 'Licensed under') OR contains(text, 'Released under')")
def mention_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from packages whose texts mention a package."""
    contents = load(spark, sf_dir, "documents").select(F.col("source").alias("package"), "text")
    packages = spark.createDataFrame([("crates/Licensed under",), ("src",)], "package string")
    return V.mention_edges(contents, packages, ["Licensed under", "Released under"])


@query("""WITH syms AS (SELECT p_brand AS file, p_partkey AS id, p_partkey % 997 AS line FROM part), refs AS (SELECT p_brand AS file, p_partkey AS id, (p_partkey * 31 + p_size) % 997 AS line FROM part),
places AS (SELECT file, line, max(id) AS id FROM syms GROUP BY ALL), outside AS (SELECT DISTINCT r.file, r.line, r.id FROM refs r JOIN syms s ON s.file = r.file AND s.id = r.id WHERE r.line <> s.line),
met AS (SELECT o.id AS source, p.id AS target FROM outside o ASOF JOIN places p ON o.file = p.file AND o.line >= p.line)
SELECT DISTINCT source, target, 'reference' AS kind FROM met WHERE source <> target""")
def reference_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol edges from references, to the symbol on or before their line."""
    p = load(spark, sf_dir, "part")
    own = [F.col("p_brand").alias("file"), F.col("p_partkey").alias("id")]
    symbols = p.select(*own, (F.col("p_partkey") % 997).alias("line"))
    return V.reference_edges(symbols, p.select(*own, ((F.col("p_partkey") * 31 + F.col("p_size")) % 997).alias("line")))


@query(f"""WITH {PARTS_SQL}, marks AS (SELECT DISTINCT regexp_extract(dir, '^[^/]*/[^/]*') AS d FROM files WHERE p_size % 10 = 1 UNION SELECT DISTINCT dir FROM files WHERE p_size = 7),
met AS (SELECT path, language, max_by(d, length(d)) AS root FROM files JOIN marks ON starts_with(dir || '/', d || '/') WHERE language IN ('python', 'rust') GROUP BY ALL)
SELECT path, language, CASE WHEN language = 'python' THEN coalesce(root, '.') ELSE '.' END AS root FROM files LEFT JOIN met USING (path, language) WHERE language <> 'other'""")
def language_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The project root of every file by the marker files of its language."""
    files = part_files(spark, sf_dir)
    two = F.regexp_extract("dir", "^[^/]*/[^/]*", 0)
    marks = files.where("p_size % 10 = 1").select(F.concat(two, F.lit("/pyproject.toml")).alias("path")).unionByName(files.where("p_size = 7").select(F.concat("dir", F.lit("/setup.py")).alias("path")))
    return V.language_roots(files, marks.distinct())


@query("""WITH RECURSIVE f AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey - 1 END AS parent, CASE WHEN p_size > 40 THEN 1 ELSE 0 END AS files FROM part),
steps AS (SELECT a.id, b.id AS nxt FROM f a JOIN f b ON b.parent = a.id WHERE a.files = 0), walk AS (SELECT id, id AS place, 0 AS n FROM f UNION ALL SELECT w.id, nxt, n + 1 FROM walk w JOIN steps s ON s.id = w.place WHERE n < 8)
SELECT id, max_by(place, n) AS "end" FROM walk GROUP BY id""")
def folder_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where folders with a single folder inside lead."""
    p = load(spark, sf_dir, "part")
    parent = F.when(F.col("p_partkey") % 4 != 0, F.col("p_partkey") - 1)
    return V.descend(p.select(F.col("p_partkey").alias("id"), parent.alias("parent"), F.when(F.col("p_size") > 40, 1).otherwise(0).alias("files"), F.lit(0).alias("edges")))


@query(f"WITH {EDGES_SQL}, {MATRIX_SQL} SELECT 'layers' AS kind, string_agg(id, '>' ORDER BY idx) AS layers, true AS enabled FROM els")
def suggested_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layers rule from the order of the structure matrix."""
    from orrery.operators import graph

    elements = graph.matrix_elements(graph_queries.nation_nodes(spark, sf_dir), graph_queries.nation_edges(spark, sf_dir))
    return V.suggested_layers(elements.select("idx", "id")).withColumn("layers", F.array_join("layers", ">"))


@query(f"""WITH RECURSIVE {EDGES_SQL}, {graph_queries.REACH_SQL}, regions AS (SELECT DISTINCT a.grp AS source, b.grp AS target FROM edges e JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target WHERE a.grp <> b.grp),
above AS (SELECT source, target FROM regions UNION SELECT r.source, e.target FROM above r JOIN regions e ON r.target = e.source),
one AS (SELECT count(DISTINCT c) AS n FROM (SELECT a.source, min(a.target) AS c FROM reach a JOIN reach b ON a.target = b.source AND b.target = a.source GROUP BY 1)),
two AS (SELECT count(DISTINCT c) AS n FROM (SELECT a.source, min(a.target) AS c FROM above a JOIN above b ON a.target = b.source AND b.target = a.source GROUP BY 1))
SELECT one.n AS file_imports, two.n AS package_imports, one.n + two.n AS groups, CASE WHEN one.n > 0 THEN 'fail' WHEN two.n > 0 THEN 'warn' ELSE 'pass' END AS status FROM one, two""")
def circular_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cycle rule over files and packages."""
    nodes, edges = graph_queries.nation_nodes(spark, sf_dir), graph_queries.nation_edges(spark, sf_dir).select("source", "target")
    a, b = nodes.select(F.col("id").alias("source"), F.col("group").alias("from")), nodes.select(F.col("id").alias("target"), F.col("group").alias("to"))
    above = edges.join(a, "source").join(b, "target").where("`from` <> `to`").select(F.col("from").alias("source"), F.col("to").alias("target")).distinct()
    groups = nodes.select(F.col("group").alias("id")).distinct().withColumn("group", F.col("id"))
    return V.circular_verdict({"file_imports": (nodes, edges), "package_imports": (groups, above)})


_BAND = "CASE WHEN {0} {1} {2} THEN 'healthy' WHEN {0} {1} {3} THEN 'fair' ELSE 'poor' END"
METRIC_VALUES = {"complexity": "l_quantity", "abc": "l_extendedprice / 500", "maintainability": "l_quantity * 2", "cohesion": "l_discount * 1000", "cyclomaticDensity": "l_tax * 5"}


@query(
    "WITH v AS ("
    + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, {_BAND.format(f'({x})', '<=' if D.BANDS[m][0] == 'lower' else '>=', *D.BANDS[m][1:])} AS band FROM lineitem" for m, x in METRIC_VALUES.items()
    )
    + ") SELECT metric, band, count(*) AS n FROM v GROUP BY ALL"
)
def metric_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by metric and health band of the detail view."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), D.metric_band(m, F.expr(x)).alias("band")) for m, x in METRIC_VALUES.items()])
    found = load(spark, sf_dir, "lineitem").select(F.explode(each).alias("e"))
    return found.groupBy("e.metric", "e.band").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, format('{:,}', c_custkey * 1234567) AS shown FROM customer")
def grouped_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with separated thousands."""
    return load(spark, sf_dir, "customer").select("c_custkey", D.grouped_number(F.col("c_custkey") * 1234567).alias("shown"))


@query("SELECT DISTINCT trim(x) AS id FROM (SELECT n_name AS x FROM nation UNION ALL SELECT ' ' || r_name || ' ' FROM region UNION ALL SELECT n_name || '  ' FROM nation)")
def rule_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct trimmed ids of several sources."""
    n, r = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    padded = r.select(F.concat(F.lit(" "), "r_name", F.lit(" ")).alias("x"))
    return V.trimmed_ids((n, "n_name"), (padded, "x"), (n.select(F.concat("n_name", F.lit("  ")).alias("x")), "x"), (spark.createDataFrame([("  ",)], "x string"), "x"))
