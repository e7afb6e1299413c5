"""Results of an analysis as tables: counts and tone, stored and slim forms, single ratings, sizes among peers, charts, display order, translated texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.paths import round_half_up
from orrery.operators.ranks import running_counts
from orrery.operators.ratings import metric_table, peer_scores, weighted_rating
from orrery.operators.reports import stored_items
from orrery.session import checkpoint
from orrery.sources.tree import persist_result

#: Bounds of the bands of a file's size percentile.
SIZE_HEALTHY, SIZE_FAIR = 50, 80
#: Health without a matrix; the share of the range, or of a flat value, that pads a chart.
NO_MATRIX_HEALTH, PAD, FLAT_PAD = 100, 0.08, 0.1
#: Scales of chart series whose axis is always 0 to 100.
FULL_SCALES = ("score100", "percent")


def status_counts(result: Mapping[str, DataFrame]) -> DataFrame:
    """One row ``(packages, files, rules, passed, warnings, failures, health)`` of a result's tables.

    ``packages(package)`` and ``files(path, package)`` of the hierarchy count first.  Where they are
    absent or empty, the quality tables ``quality_packages(package, file_count)`` and
    ``quality_files(path)`` count; after those, packages are the nodes of kind ``package`` of
    ``nodes(id, kind)`` and files the sum of the packages' ``file_count``.  ``items(status)`` are
    the verdicts, ``matrix(health)`` has one row or none, which means a health of 100.
    """
    tables = {
        "hp": ("packages", F.count("*")),
        "hf": ("files", F.count("*")),
        "qp": ("quality_packages", F.count("*")),
        "qf": ("quality_files", F.count("*")),
        "np": ("nodes", F.count_if(F.col("kind") == "package")),
    }
    one = result["items"].agg(
        F.count("*").alias("rules"), *[F.count_if(F.col("status") == s).alias(n) for s, n in (("pass", "passed"), ("warn", "warnings"), ("fail", "failures"))]
    )
    for alias, (name, count) in tables.items():
        one = one.join(F.broadcast(result[name].agg(count.alias(alias))), F.lit(True)) if name in result else one.withColumn(alias, F.lit(0).cast("long"))
    of_packages = result["quality_packages"].agg(F.coalesce(F.sum("file_count"), F.lit(0)).alias("pf")) if "quality_packages" in result else None
    one = one.join(F.broadcast(of_packages), F.lit(True)) if of_packages is not None else one.withColumn("pf", F.lit(0).cast("long"))
    health = round_half_up(F.coalesce(F.max("health"), F.lit(float(NO_MATRIX_HEALTH)))).cast("long").alias("health")
    one = one.join(F.broadcast(result["matrix"].agg(health)), F.lit(True)) if "matrix" in result else one.withColumn("health", F.lit(NO_MATRIX_HEALTH).cast("long"))
    first = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit(0)) for n in names], F.lit(0)).cast("long")
    return one.select(first("hp", "qp", "np").alias("packages"), first("hf", "qf", "pf").alias("files"), "rules", "passed", "warnings", "failures", "health")


def with_summary(counts: DataFrame) -> DataFrame:
    """``counts`` plus ``tone`` (``fail``, ``warn`` or ``ok``, the worst verdict) and the line ``summary``."""
    n = lambda c: F.col(c).cast("string")
    parts = [F.lit("Analyzed "), n("packages"), F.lit(" packages ("), n("files"), F.lit(" source files) with "), n("rules"), F.lit(" rule(s): "), n("passed"), F.lit(" passed, ")]
    parts += [n("warnings"), F.lit(" warnings, "), n("failures"), F.lit(" failures · modularity health "), n("health")]
    tone = F.when(F.col("failures") > 0, "fail").when(F.col("warnings") > 0, "warn").otherwise("ok")
    return counts.withColumns({"tone": tone, "summary": F.concat(*parts)})


def slim_result(result: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """What a report needs at once: the hierarchy and the files' quality are empty, affected entries are cut.

    The tables keep their columns, so readers need no second schema; Spark does not read what is emptied.
    """
    emptied = ("packages", "files", "symbols", "symbol_edges", "imports", "scope_nodes", "scope_edges", "quality_files")
    out = {name: table.where(F.lit(False)) if name in emptied else table for name, table in result.items()}
    return out | ({"items": stored_items(result["items"])} if "items" in result else {})


def persist_tables(result: Mapping[str, DataFrame], folder: str, project: str) -> dict[str, str]:
    """Write a result below ``folder``, a table a name, and return the paths.

    Symbols, their edges and scope graphs can be made anew and are not stored; affected entries
    are cut as stored items are.  A table that is absent is not written, and what an earlier
    run of the project stored of a table is replaced; other projects stay.
    """
    left_out = ("symbols", "symbol_edges", "scope_nodes", "scope_edges")
    kept = {name: stored_items(t) if name == "items" else t for name, t in result.items() if name not in left_out}
    for name, table in kept.items():
        persist_result(table, f"{folder}/{name}", project)
    return {name: f"{folder}/{name}" for name in kept}


def _by_value(path: str, values: DataFrame) -> DataFrame:
    """``(metric, value, n, mine)``: how many of ``values(id, metric, value)`` there are, and whether ``path`` has one of them; written once, as it is read twice."""
    mine = F.coalesce(F.max(F.col("id") == path), F.lit(False))
    return checkpoint(values.groupBy("metric", "value").agg(F.count("*").alias("n"), mine.alias("mine")))


def rating_of(path: str, files: DataFrame, packages: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """``(id, rating)`` of one path among its peers: a file's if there is one of that name, else a package's, else no row.

    ``files(id, metric, value)`` and ``packages(id, metric, value)``; packages come with the
    statistic that the view shows.  Only metrics that the path has a value of are ranked, and
    peers are only counted, by value: one pass over them, no ranks of all.
    """
    metrics = metric_table(files.sparkSession) if metrics is None else metrics
    counts = _by_value(path, files)
    if counts.where("mine").isEmpty():
        counts = _by_value(path, packages)
    counts = counts.where("value IS NOT NULL")
    own = counts.where("mine").groupBy("metric").agg(F.max("value").alias("own"))
    met = counts.join(F.broadcast(own), "metric").join(F.broadcast(metrics), "metric")  # at most a row a metric
    no_better = F.when(F.col("direction") == "lower", F.col("value") >= F.col("own")).otherwise(F.col("value") <= F.col("own"))
    shares = met.groupBy("metric", "weight").agg(round_half_up(100.0 * F.sum(F.when(no_better, F.col("n")).otherwise(0)) / F.sum("n")).alias("score"))
    return weighted_rating(shares.withColumn("id", F.lit(path)))


def all_ratings(values: DataFrame) -> DataFrame:
    """``(id, rating)`` of every id of ``values(id, metric, value)``."""
    return weighted_rating(peer_scores(values, metric_table(values.sparkSession)))


def size_among_peers(files: DataFrame) -> DataFrame:
    """``files(path, package, loc)`` plus ``percentile``, ``peers``, ``peer_scope`` and ``health``.

    Peers are the files of the package; a file that has its package for itself is compared with
    the whole project.  Null sizes count as 0 and a null package is one package.
    """
    sized = files.select("path", F.coalesce("package", F.lit(".")).alias("package"), F.coalesce("loc", F.lit(0)).cast("long").alias("loc"))
    counts = sized.groupBy("package", "loc").agg(F.count("*").alias("n"))
    inside = running_counts(counts, ["package"], "loc").select("package", "loc", F.col("upto").alias("in_upto"), F.col("total").alias("in_total"))
    whole = counts.groupBy("loc").agg(F.sum("n").alias("n")).withColumn("all", F.lit(0))
    overall = running_counts(whole, ["all"], "loc").select("loc", F.col("upto").alias("all_upto"), F.col("total").alias("all_total"))
    # Ranks are by distinct size, so a size shared by many files is ranked once.
    ranked = inside.join(overall, "loc")
    alone = F.col("in_total") <= 1
    pick = lambda kind: F.when(alone, F.col(f"all_{kind}")).otherwise(F.col(f"in_{kind}"))
    percentile = round_half_up(100.0 * pick("upto") / pick("total")).cast("long")
    ranks = ranked.select("package", "loc", percentile.alias("percentile"), pick("total").cast("long").alias("peers"), F.when(alone, "project").otherwise("package").alias("peer_scope"))
    return sized.join(ranks, ["package", "loc"]).withColumn("health", size_health(F.col("percentile"))).select("path", "package", "loc", "percentile", "peers", "peer_scope", "health")


def size_health(percentile: Column) -> Column:
    """The band of a file's size percentile."""
    return F.when(percentile <= SIZE_HEALTHY, "healthy").when(percentile <= SIZE_FAIR, "fair").otherwise("poor")


def chart_domains(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, low, high, guides)``: the value axis of each chart of ``series(keys, metric, scale, value)``.

    A chart of scores only, or of percentages only, shows 0 to 100 (``guides`` for scores).  Others show
    their finite values, padded by 8 % of the range, or by 10 % of the value and at least 1 where it
    is flat, and not below 0; without any finite value 0 to 100.
    """
    number = F.col("value").cast("double")
    finite = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    spans = series.groupBy(*keys).agg(F.min(finite).alias("a"), F.max(finite).alias("b"), F.min("scale").alias("s"), F.max("scale").alias("t"))
    full = (F.col("s") == F.col("t")) & F.col("s").isin(*FULL_SCALES) | F.col("a").isNull()
    pad = F.when(F.col("a") == F.col("b"), F.greatest(F.lit(1.0), F.abs("b") * FLAT_PAD)).otherwise((F.col("b") - F.col("a")) * PAD)
    low, high = F.when(full, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("a") - pad)), F.when(full, 100.0).otherwise(F.col("b") + pad)
    guides = (F.col("s") == F.col("t")) & (F.col("s") == FULL_SCALES[0])
    return spans.select(*keys, low.alias("low"), high.alias("high"), guides.alias("guides"))


def chart_points(series: DataFrame, keys: Sequence[str], width: float, height: float, pad_x: float = 0.0, pad_y: float = 0.0) -> DataFrame:
    """``series(keys, metric, scale, run, value)`` as points ``(keys, metric, run, x, y)``.

    ``run`` numbers a chart's runs from 0: they stand evenly from left to right, whatever their
    times.  Values that are null or not finite give no point.  Charts without keys are one chart.
    """
    number = F.col("value").cast("double")
    domain = chart_domains(series, keys)
    runs = series.groupBy(*keys).agg(F.greatest(F.max("run"), F.lit(1)).alias("last"))
    frame = domain.join(runs, list(keys)) if keys else domain.join(F.broadcast(runs), F.lit(True))  # one row a chart
    shown = series.where(~F.isnan(number) & (F.abs(number) < float("inf")))
    met = shown.join(frame, list(keys)) if keys else shown.join(F.broadcast(frame), F.lit(True))
    x = pad_x + F.col("run") / F.col("last") * (width - 2 * pad_x)
    y = pad_y + (1 - (number - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-9))) * (height - 2 * pad_y)
    return met.select(*keys, "metric", "run", x.alias("x"), y.alias("y"))


def display_order(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows sorted as people read: by the root collation of Unicode, then by code points."""
    return rows.orderBy(*[F.collate(F.col(c), "UNICODE") for c in columns], *columns)


def translated(messages: DataFrame, catalogues: DataFrame, locale: str, fallback: str = "en") -> DataFrame:
    """``messages(key, params)`` plus ``text``: the locale's entry, else the fallback's, else the key, with parameters put in.

    ``catalogues(locale, key, text)`` has one row a locale and key; of repeated ones the smallest text
    counts.  ``params`` is a map of names; ``{name}`` is replaced wherever it stands, in the order of
    the names.  A null map has no parameters, and a null value leaves its place as it is.
    """
    known = catalogues.where(F.col("locale").isin(locale, fallback)).groupBy("key").agg(
        F.min(F.when(F.col("locale") == locale, F.col("text"))).alias("__own"), F.min(F.when(F.col("locale") == fallback, F.col("text"))).alias("__other")
    )
    pairs = F.array_sort(F.map_entries(F.coalesce("params", F.create_map().cast("map<string,string>"))))
    given = F.filter(pairs, lambda p: p["value"].isNotNull())
    put = lambda text, p: F.replace(text, F.concat(F.lit("{"), p["key"], F.lit("}")), p["value"])
    met = messages.join(known, "key", "left").withColumn("text", F.aggregate(given, F.coalesce("__own", "__other", "key"), put))
    return met.select(*[c for c in messages.columns if c != "text"], "text")


#: Fixed values: ``(name, default, least, most)`` of the limits of a run; a token limit of 0 is none.
RUN_LIMITS = (("validation_turns", 128, 4, 512), ("agent_turns", 64, 4, 256), ("validation_tokens", 0, 1_000, 2_000_000))


def clamped_limits(values: DataFrame, limits: Sequence[tuple[str, int, int, int]] = RUN_LIMITS) -> DataFrame:
    """``values(name, value)`` with every known limit kept within its bounds; null and 0 take the default.

    Names without limits stay as they are.
    """
    bounds = values.sparkSession.createDataFrame(list(limits), "name string, __default long, __least long, __most long")
    met = values.join(F.broadcast(bounds), "name", "left")
    number = F.col("value").cast("long")
    kept = F.when(F.coalesce(number, F.lit(0)) == 0, F.col("__default")).otherwise(F.least(F.greatest(number, F.col("__least")), F.col("__most")))
    return met.withColumn("value", F.when(F.col("__least").isNull(), number).otherwise(kept)).select(*values.columns)
