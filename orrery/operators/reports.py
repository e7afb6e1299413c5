"""Cycle reports, verdicts, review planning, snapshots and other small reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.paths import round_half_up
from orrery.operators.graph import simple_edges, strong_components
from orrery.session import checkpoint, remove_path, scratch_path, write_table

#: Nodes of a shown cycle, groups of a sample, affected entries that are stored.
PATH_NODES, SAMPLE_GROUPS, STORED_AFFECTED = 16, 10, 80


def cycle_paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(component, size, path)`` of every cyclic component."""
    return component_walks(strong_components(edges, nodes).where("cyclic"), simple_edges(edges, nodes))


def component_walks(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """``(component, size, path)`` of the components of ``parts(id, component)``, along ``edges(source, target)``.

    The walk starts at the smallest member and goes to the smallest unvisited neighbour in
    the component, up to ``PATH_NODES`` nodes; the start is added where an edge leads back,
    and a single node is shown twice.
    """
    spark, folder = parts.sparkSession, scratch_path(parts.sparkSession, "walks")
    parts = write_table(parts.select("id", "component"), f"{folder}/parts")
    inner = edges.where("source <> target").join(parts.withColumnRenamed("id", "source"), "source")
    inner = inner.join(parts.select(F.col("id").alias("target"), F.col("component").alias("c2")), "target").where("component = c2")
    inner = write_table(inner.select("component", "source", "target"), f"{folder}/edges")
    walks = parts.groupBy("component").agg(F.count("*").alias("size")).select("component", "size", F.array("component").alias("path"), F.lit(True).alias("grew"))
    walks = write_table(walks, f"{folder}/0")
    for k in range(1, PATH_NODES):
        ahead = walks.where("grew").withColumn("source", F.element_at("path", -1)).join(inner, ["component", "source"]).where(~F.array_contains("path", F.col("target")))
        following = ahead.groupBy("component").agg(F.min("target").alias("next"))
        path = F.when(F.col("next").isNull(), F.col("path")).otherwise(F.array_append("path", F.col("next")))
        walks = write_table(walks.join(following, "component", "left").select("component", "size", path.alias("path"), F.col("next").isNotNull().alias("grew")), f"{folder}/{k}")
        if walks.where("grew").isEmpty():
            break
    back = inner.select("component", "source", F.lit(True).alias("closed")).where("target = component").distinct()
    ended = walks.withColumn("source", F.element_at("path", -1)).join(back, ["component", "source"], "left")
    closes = (F.col("size") == 1) | F.coalesce("closed", F.lit(False))
    out = checkpoint(ended.select("component", "size", F.when(closes, F.array_append("path", F.col("component"))).otherwise(F.col("path")).alias("path")))
    remove_path(spark, folder)
    return out


def circular_status(file_groups: Column, other_groups: Column) -> Column:
    """``fail`` if a cycle of files is in the sample, ``warn`` for any other cycle."""
    return F.when(file_groups > 0, "fail").when(other_groups > 0, "warn").otherwise("pass")


def stored_items(items: DataFrame) -> DataFrame:
    """Verdicts with their affected entries sorted, distinct and cut to what is stored."""
    return items.withColumn("affected", F.slice(F.array_sort(F.array_distinct("affected")), 1, STORED_AFFECTED))


def plan_phases(rules: DataFrame, lenses: DataFrame) -> DataFrame:
    """Rules in order that have at least one selected lens: ``rules(rule_id, ord)``, ``lenses(rule_id, lens, selected)``."""
    chosen = lenses.where("selected").groupBy("rule_id").agg(F.array_sort(F.collect_set("lens")).alias("lenses"))
    return rules.join(chosen, "rule_id").orderBy("ord")


def attribute_reviews(reviews: DataFrame, phases: DataFrame) -> DataFrame:
    """Reviews of known rules keep their rule, others go to the first phase; phases without any pass."""
    first = phases.agg(F.min_by("rule_id", "ord").alias("first_rule"))
    known = phases.select("rule_id", F.lit(True).alias("known"))
    met = reviews.join(F.broadcast(known), "rule_id", "left").join(F.broadcast(first), F.lit(True))
    placed = met.select(F.when(F.col("known"), F.col("rule_id")).otherwise(F.col("first_rule")).alias("rule_id"), "status", "message")
    silent = phases.select("rule_id").join(placed.select("rule_id"), "rule_id", "left_anti")
    return placed.unionByName(silent.select("rule_id", F.lit("pass").alias("status"), F.lit("No findings").alias("message")))


def split_location(entry: Column) -> Column:
    """Struct (path, first, last) of ``path:12``, ``path:12:5`` and ``path:9-4``; lines are null where there are none."""
    text = F.regexp_replace(F.trim(entry), r"\s+[\(\[].*[\)\]]$", "")
    rule = r"^(.+?):(\d+)(?:-(\d+)|:\d+)?$"
    number = lambda g: F.expr("try_cast(null as int)") if g is None else F.nullif(F.regexp_extract(text, rule, g), F.lit("")).try_cast("int")
    a, b = number(2), F.coalesce(number(3), number(2))
    good = (a > 0) & (b > 0)
    path = F.when(F.regexp_like(text, F.lit(rule)), F.regexp_extract(text, rule, 1)).otherwise(text)
    return F.struct(path.alias("path"), F.when(good, F.least(a, b)).alias("first"), F.when(good, F.greatest(a, b)).alias("last"))


def line_range(text: Column, first: Column, last: Column) -> Column:
    """Lines ``first`` to ``last``, counted from 1 and cut to the text."""
    lines = F.split(text, "\n", -1)
    start = F.greatest(first, F.lit(1))
    length = F.greatest(F.least(last, F.size(lines)) - start + 1, F.lit(0))
    return F.array_join(F.slice(lines, start, length), "\n")


def normalised_cron(expression: Column) -> Column:
    """Five fields get a leading second of 0."""
    text = F.trim(expression)
    return F.when(F.size(F.split(text, r"\s+")) == 5, F.concat(F.lit("0 "), text)).otherwise(text)


SNAPSHOT = "struct<at:double,overall:double,architecture:double,modularity:double,metrics:map<string,double>>"


def read_snapshots(values: DataFrame) -> DataFrame:
    """``(at, overall, architecture, modularity, metrics)`` of JSON points; malformed ones are dropped, scores rounded."""
    points = values.select(F.from_json("value", SNAPSHOT).alias("p")).select("p.*").where("at IS NOT NULL AND overall IS NOT NULL AND NOT isnan(at) AND NOT isnan(overall)")
    rounded = [round_half_up(F.col(c)).alias(c) for c in ("overall", "architecture", "modularity")]
    return points.select(F.timestamp_millis(F.col("at").cast("long")).alias("at"), *rounded, F.transform_values("metrics", lambda k, v: round_half_up(v)).alias("metrics"))


def one_decimal(share: Column) -> Column:
    """A share of 0 to 1 as a percentage with one decimal."""
    return F.floor(share * 1000 + 0.5) / 10


def single_default(rows: DataFrame) -> DataFrame:
    """``rows(id, flagged, ready)`` with exactly one ``flagged``: a flagged one, else a ready one, else the first by id."""
    best = rows.agg(F.min(F.struct((~F.col("flagged")).alias("a"), (~F.col("ready")).alias("b"), "id")).alias("m")).select(F.col("m.id").alias("best"))
    return rows.join(F.broadcast(best), F.lit(True)).withColumn("flagged", F.col("id") == F.col("best")).drop("best")


def compact_count(n: Column) -> Column:
    """12400 as ``12.4k``, 1240 as ``1.24k``."""
    short = lambda form: F.format_string(form, n / 1000.0)
    return F.when(n < 1000, n.cast("string")).when(n < 10_000, short("%.2fk")).otherwise(short("%.1fk"))


def structural_proxy(files: DataFrame) -> DataFrame:
    """``files(path, loc, symbols, imports, calls)`` plus measures for files without source text."""
    volume = F.greatest(F.lit(2), 2 * F.col("loc")) * F.log2(F.greatest(F.lit(2), F.col("symbols") + F.col("imports") + 8).cast("double"))
    return files.withColumns({"structural": 1 + F.col("symbols") + F.col("calls") + F.col("imports"), "volume": F.round(volume, 6)})
