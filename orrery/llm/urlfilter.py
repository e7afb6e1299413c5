"""URL filter: longest-rule match, then logistic regression on hashed character n-grams.

Everything is column expressions: hosts and paths are cut by regular expressions, rules are
matched in the row (or by an equi-join on host suffixes if there are many), and the model is
a broadcast table of one row, an array of ``DIMENSIONS`` weights and the intercept.  Training is
full-batch gradient descent over a small labelled table; each step is one aggregation, joined
with the table of weights, which has ``DIMENSIONS + 1`` rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.session import remove_path, scratch_path, write_table

DIMENSIONS = 32768
MAX_LABELLED = 5000
MAX_INLINE_RULES = 500
GRAMS = (3, 4, 5)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: The rules of the query.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

#: The labelled hosts join a topic and a modifier; modifiers, joints, zones and plain paths are the same for both classes.
UNWANTED = {
    "gambling": ("poker", "slots", "betting", "bingo", "jackpot", "roulette", "lottery", "blackjack", "baccarat", "sportsbook"),
    "pharmacy": ("pharmacy", "viagra", "cialis", "steroids", "painkillers", "tramadol"),
    "explicit": ("porn", "xxx", "escorts", "nudes", "sexchat", "erotica"),
    "advertising": ("advertising", "banners", "popunder", "affiliates", "sponsored", "clickfraud"),
    "bulk": ("clickbait", "getrich", "quickcash", "bulkmail", "linkexchange", "ponzi"),
    "piracy": ("warez", "cracks", "keygen", "torrents", "phishing", "malware"),
}
WANTED = {
    "press": ("news", "times", "herald", "gazette", "journal", "radio"),
    "study": ("university", "school", "library", "museum", "academy", "science", "history", "maths"),
    "software": ("docs", "code", "devtools", "wiki", "kernel", "linux"),
    "leisure": ("garden", "kitchen", "travel", "weather", "music", "sports", "cinema", "books"),
    "civic": ("council", "health", "clinic", "post", "railway", "water", "energy"),
    "names": ("bellmore", "karston", "lindqvist", "moreau", "okafor", "hendriks", "tanaka", "silva", "novak", "mortensen", "whitaker", "rossi"),
}
#: Chemical elements, countries, months, colours, trees and animals as hosts of nobody in particular, with fewer modifiers each.
EVERYDAY = (
    "hydrogen helium lithium beryllium boron carbon nitrogen oxygen fluorine neon sodium magnesium aluminium silicon phosphorus sulfur chlorine argon "
    "potassium calcium titanium chromium manganese iron cobalt nickel copper zinc gallium krypton silver platinum gold mercury "
    "argentina australia austria belgium bolivia brazil bulgaria canada chile colombia croatia denmark ecuador egypt estonia ethiopia finland france "
    "germany ghana greece hungary iceland india indonesia ireland italy jamaica japan kenya latvia lebanon lithuania malta mexico morocco nepal nigeria "
    "norway panama paraguay peru poland portugal romania senegal slovakia slovenia spain sweden thailand tunisia turkey uganda ukraine uruguay vietnam "
    "january february march april june july august september october november december "
    "black blue brown crimson green grey orange pink purple red scarlet turquoise violet white yellow "
    "alder ash beech birch cedar cherry chestnut elm hazel larch linden maple oak pine poplar rowan spruce sycamore willow yew "
    "badger beaver buffalo camel dolphin eagle falcon giraffe hamster heron horse kangaroo leopard lion monkey otter owl panda penguin rabbit salmon seal "
    "sheep sparrow squirrel swan tiger tortoise walrus whale wolf zebra"
).split()
MODIFIERS = ("best", "city", "club", "daily", "direct", "easy", "first", "global", "home", "hub", "live", "my", "now", "online", "plus", "pro", "shop", "top", "web", "world", "zone", "24")
JOINTS = ("{t}{m}", "{m}{t}", "{t}-{m}", "{m}-{t}", "{m}.{t}", "{t}")
ZONES = ("com", "net", "org", "info", "biz", "io", "co.uk", "eu", "xyz", "de", "fr", "nl")
PATHS = ("", "/", "/index.html", "/en/12", "/de/7.html", "/fr/905", "/es/41", "/page/3")
OWN_PATHS = (("/articles/2021/05", "/about", "/docs/start.html"), ("/instant-bonus", "/click/9", "/signup-offer"))


def labelled_hosts() -> list[tuple[str, str, int]]:
    """``(url, topic, blocked)``: every topic with modifiers; joint, zone and path follow from a checksum of both."""
    rows = []
    for blocked, groups in ((0, WANTED | {"everyday": EVERYDAY}), (1, UNWANTED)):
        for topic, words in groups.items():
            for word in words:
                for modifier in MODIFIERS[:: 4 if topic == "everyday" else 1]:
                    draw = zlib.crc32(f"{word} {modifier}".encode())
                    pick = lambda options, by: options[draw // by % len(options)]  # noqa: B023, E731
                    host = f"{pick(JOINTS, 1).format(t=word, m=modifier)}.{pick(ZONES, 64)}"
                    path = pick(OWN_PATHS[blocked] if draw % 5 == 0 else PATHS, 4096)
                    rows.append((f"http://{pick(('', 'www.', 'm.', 'blog.'), 65536)}{host}{path}", topic, blocked))
    return rows


def labelled_urls(spark: SparkSession, rows: Sequence[tuple[str, str, int]] | None = None) -> DataFrame:
    """The small labelled table ``(url, topic, blocked)``, made by rule from public everyday words."""
    return spark.createDataFrame(rows if rows is not None else labelled_hosts(), "url string, topic string, blocked int")


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, also where ``use`` holds it in another function."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _ngrams(text: Column, n: int) -> Column:
    """All runs of ``n`` characters, in time linear in the text."""
    starts = lambda c: F.when(F.size(c) >= n, F.sequence(F.lit(0), F.size(c) - n)).otherwise(F.array().cast("array<int>"))
    return _once(F.split(text, ""), lambda c: F.transform(starts(c), lambda i: F.concat(*[F.get(c, i + k) for k in range(n)])))


def gram_ids(host: Column, path: Column) -> Column:
    """Hashed n-grams of the bounded host and of the bounded path without digits."""
    bounded = (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.concat(F.regexp_replace(path, "[0-9]+", "0"), F.lit("$"))))
    tagged = lambda tag: lambda g: F.concat(F.lit(tag), g)  # noqa: E731  a second parameter would be the index
    grams = [F.transform(_ngrams(text, n), tagged(tag)) for tag, text in bounded for n in GRAMS]
    return F.transform(F.concat(*grams), lambda g: F.pmod(F.xxhash64(g), F.lit(DIMENSIONS)).cast("int"))


def _joined(rows: DataFrame, model: DataFrame) -> DataFrame:
    """``rows`` plus ``__model`` of the one row of ``model``, which is broadcast."""
    one = F.pmod(F.spark_partition_id(), F.lit(1))
    return rows.withColumn("__one", one).join(F.broadcast(model.withColumn("__one", F.lit(0))), "__one").drop("__one")


def with_model(rows: DataFrame, values: Sequence[float]) -> DataFrame:
    """``rows`` plus ``__model``, the weights and the intercept as an array."""
    text = F.lit(",".join(f"{v:.9g}" for v in values))
    return _joined(rows, rows.sparkSession.range(1).select(F.split(text, ",").cast("array<double>").alias("__model")))


def probability(ids: Column, model: Column) -> Column:
    """Logistic score of the mean-scaled sum of weights; ``model`` ends with the intercept."""
    total = F.aggregate(ids, F.lit(0.0), lambda acc, i: acc + F.get(model, i))
    margin = total / F.sqrt(F.greatest(F.size(ids), F.lit(1))) + F.get(model, F.lit(DIMENSIONS))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def train(labelled: DataFrame, steps: int = 40, rate: float = 0.5, l2: float = 0.01) -> list[float]:
    """Weights and intercept from ``(url, blocked)``; at most ``MAX_LABELLED`` rows, checked.

    Steps are scaled per coordinate by the root of its summed squared slopes; ``l2`` draws
    weights back to zero.

    Weights of all steps are tables of ``DIMENSIONS + 1`` rows below the shared folder; the
    last ones are returned.  Rows with a null label are left out; an empty table gives zero
    weights, which block nothing.
    """
    spark, folder = labelled.sparkSession, scratch_path(labelled.sparkSession, "url-model")
    rows = labelled.where(F.col("blocked").isin(0, 1)).select("blocked", gram_ids(host_of(F.col("url")), path_of(F.col("url"))).alias("ids"))
    rows = rows.coalesce(1).cache()
    values = spark.range(0, DIMENSIONS + 1, 1, 1).select(F.col("id").cast("int").alias("i"), F.lit(0.0).alias("w"), F.lit(1e-12).alias("squares"))
    try:
        size = rows.count()
        if size > MAX_LABELLED:
            raise ValueError(f"more than {MAX_LABELLED} labelled URLs")
        for step in range(steps if size else 0):
            placed = F.array_sort(F.collect_list(F.struct("i", "w")))
            model = values.agg(F.transform(placed, lambda x: x["w"]).alias("__model"))
            error = probability(F.col("ids"), F.col("__model")) - F.col("blocked")
            scaled = _joined(rows, model).select("ids", error.alias("e"))
            each = (F.col("e") / F.sqrt(F.greatest(F.size("ids"), F.lit(1)))).alias("g")
            terms = scaled.select(F.explode(F.concat(F.transform("ids", lambda i: F.struct(i.alias("i"), each)), F.array(F.struct(F.lit(DIMENSIONS).alias("i"), F.col("e").alias("g"))))).alias("t"))
            slope = terms.groupBy("t.i").agg(F.sum("t.g").alias("g"))
            g = F.col("g") + l2 * F.col("w") * (F.col("i") < DIMENSIONS).cast("int")
            drawn = values.join(slope, "i", "left").withColumn("g", F.coalesce(g, F.lit(0.0))).withColumn("squares", F.col("squares") + F.col("g") * F.col("g"))
            moved = drawn.select("i", (F.col("w") - rate * F.col("g") / F.sqrt("squares")).alias("w"), "squares")
            values = write_table(moved.coalesce(1), f"{folder}/{step}")
        return [r["w"] for r in values.orderBy("i").collect()]
    finally:
        rows.unpersist()
        remove_path(spark, folder)


def _longest(fits: Column) -> Column:
    return F.array_max(F.transform(fits, lambda r: F.struct((F.length(r["host"]) + F.length(r["path"])).alias("n"), r["host"].alias("host"), r["path"].alias("path"), r["verdict"].alias("verdict"))))


def match_rules(urls: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add ``__best``, the longest fitting rule of each (``host``, ``path``), or null."""
    if not rules:
        return urls.withColumn("__best", F.lit(None).cast("struct<n:int,host:string,path:string,verdict:string>"))
    if len(rules) <= MAX_INLINE_RULES:
        table = F.array(*[F.struct(F.lit(r.host).alias("host"), F.lit(r.path).alias("path"), F.lit(r.verdict).alias("verdict")) for r in rules])
        fits = F.filter(
            table,
            lambda r: ((F.col("host") == r["host"]) | F.endswith(F.col("host"), F.concat(F.lit("."), r["host"]))) & F.startswith(F.col("path"), r["path"]),
        )
        return urls.withColumn("__best", _longest(fits))
    known = urls.sparkSession.createDataFrame([tuple(r) for r in rules], "verdict string, rule_host string, rule_path string")
    suffixes = _once(F.split("host", "\\.", -1), lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), ".")))
    places = urls.select("host", "path").distinct()
    found = places.select("host", "path", F.explode(suffixes).alias("rule_host")).join(known, "rule_host").where(F.startswith("path", F.col("rule_path")))
    rank = F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.col("rule_host").alias("host"), F.col("rule_path").alias("path"), "verdict")
    best = found.groupBy("host", "path").agg(F.max(rank).alias("__best"))
    return urls.join(best, ["host", "path"], "left")


def judge(pages: DataFrame, weights: Sequence[float], rules: Sequence[Rule] = RULES, url_col: str = "url", cut: float = 0.5) -> DataFrame:
    """``pages`` plus ``host``, ``path``, ``rule``, ``block_score`` and ``verdict``.

    A null url or one without ``://`` has an empty host and path.  The longest rule that fits
    decides (ties: the greater host, then path); else a score above ``cut`` blocks, so a model
    without weights, which scores one half, blocks nothing.
    Columns of these names are replaced, rows are neither merged nor dropped.
    """
    made = ["host", "path", "rule", "block_score", "verdict"]
    spare = [c for c in made if c in pages.columns and c != url_col]
    cutted = pages.drop(*spare).withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    judged = match_rules(cutted, rules)
    judged = judged.withColumn("rule", F.concat(F.col("__best.host"), F.col("__best.path")))
    score = probability(gram_ids(F.col("host"), F.col("path")), F.col("__model"))
    judged = with_model(judged, weights).withColumn("block_score", score).drop("__model")
    verdict = F.coalesce(F.col("__best.verdict"), F.when(F.col("block_score") > cut, "block").otherwise("allow"))
    return judged.withColumn("verdict", verdict).drop("__best")

