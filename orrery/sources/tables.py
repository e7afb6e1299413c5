"""The driver's tables, and adapters that give them the shape of a code base.

``documents`` serve as prose files.  No table holds source code, so ``code_files`` writes
one small source file per order, a line per line item, from a fixed template; the template
is SQL text, so that the checking SQL builds the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The line that a line item becomes.
CODE_LINE = """CASE l_linenumber % 7
  WHEN 1 THEN concat('import { f', CAST(l_partkey % 50 AS STRING), ' } from "./mod', CAST(l_suppkey % 20 AS STRING), '";')
  WHEN 2 THEN concat('function f', CAST(l_partkey % 50 AS STRING), '(a, b) { // TODO ', l_returnflag)
  WHEN 3 THEN concat('  if (q > ', CAST(l_suppkey % 30 AS STRING), ' && flag == "', l_returnflag, '") { total += price * ', CAST(l_partkey % 10 AS STRING), '; }')
  WHEN 4 THEN concat('  for (let i = 0; i < ', CAST(l_suppkey % 30 AS STRING), '; i++) { call', CAST(l_suppkey % 9 AS STRING), '(i); }')
  WHEN 5 THEN concat('  /* block ', l_linestatus, ' comment')
  WHEN 6 THEN '     still inside */'
  ELSE concat('} else if (x', CAST(l_partkey % 5 AS STRING), ' || y) { return x ? y : z; } # done')
END"""
#: The path of an order's file, and its package.
CODE_PACKAGE = "concat('src/pkg', CAST(o_custkey % 40 AS STRING))"
CODE_PATH = (
    f"concat({CODE_PACKAGE}, '/', CASE o_orderkey % 6 WHEN 0 THEN 'test_mod' WHEN 1 THEN 'My Mod' ELSE 'mod' END, CAST(o_orderkey AS STRING), "
    "CASE o_orderkey % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.rs' ELSE '.js' END)"
)
#: The same files in SQL, as the first member of a WITH list.
CODE_SQL = f"""src AS (
  SELECT o_orderkey, o_custkey, {CODE_PATH} AS path, {CODE_PACKAGE} AS package, content FROM orders JOIN (
    SELECT l_orderkey, string_agg(line, chr(10) ORDER BY l_linenumber, line) AS content FROM (SELECT l_orderkey, l_linenumber, {CODE_LINE} AS line FROM lineitem) GROUP BY l_orderkey) ON l_orderkey = o_orderkey
)"""
#: Prose files in SQL.
DOC_PATH = "concat(source, '/', lang, '/', CAST(doc_id AS STRING), CASE lang WHEN 'en' THEN '.ts' WHEN 'fr' THEN '.rs' WHEN 'de' THEN '.py' ELSE '.java' END)"
DOC_SQL = f"docs AS (SELECT doc_id, {DOC_PATH} AS path, source AS package, coalesce(text, '') AS content FROM documents)"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, path, package, content)`` of ``documents``."""
    docs = load(spark, sf_dir, "documents")
    return docs.select("doc_id", F.expr(DOC_PATH).alias("path"), F.col("source").alias("package"), F.coalesce("text", F.lit("")).alias("content"))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(o_orderkey, o_custkey, path, package, content)``, one file per order."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(CODE_LINE).alias("line"))
    whole = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "line"))).alias("ls"))
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.expr(CODE_PATH).alias("path"), F.expr(CODE_PACKAGE).alias("package"))
    content = F.array_join(F.transform("ls", lambda s: s["line"]), "\n").alias("content")
    return orders.join(whole, orders.o_orderkey == whole.l_orderkey).select("o_orderkey", "o_custkey", "path", "package", content)


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, package, line_no, line)`` without building whole files."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line_no"), F.expr(CODE_LINE).alias("line"))
    orders = load(spark, sf_dir, "orders").select("o_orderkey", F.expr(CODE_PATH).alias("path"), F.expr(CODE_PACKAGE).alias("package"))
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select("path", "package", "line_no", "line")


CODE_LINES_SQL = f"""lines AS (
  SELECT {CODE_PATH} AS path, {CODE_PACKAGE} AS package, l_linenumber AS line_no, {CODE_LINE} AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""
