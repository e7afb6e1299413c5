"""Line de-duplication over levelled sorted runs of line hashes.

The documents are dealt into batches.  Each batch's line hashes are counted, merge-anti-joined
with the runs written so far, so that a line that the runs already know as frequent is not
written again, and the rest is added as a run of level 0: a bucketed table ``(h1, h2, n_docs,
first_id)`` sorted by hash.  Runs are bucketed alike, so neither the anti-join nor the merge of two
runs moves or sorts them.  Two runs of a level are compacted into one of the next, so a
long-lived store keeps few, growing runs.  At last all are compacted into one, whose frequent
lines are dropped from the texts.

A line's key is hashed with two 64-bit hashes, so that distinct keys do not meet by chance.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.session import checkpoint, movable, remove_path, scratch_path

#: The white space that is stripped, and the letters that are lower-cased.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ["h1", "h2"]
#: Lets a sorted bucket of one file be merged without another sort.
ORDERED_SCANS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def line_key(line: Column) -> Column:
    """The line without blanks at either end, A-Z lower-cased."""
    return F.btrim(F.translate(line, UPPER, LOWER), F.lit(BLANKS))


def split_lines(text: Column) -> Column:
    """All parts between ``\\n``; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")]


def line_counts(docs: DataFrame, id_col: str, text_col: str, min_key: int) -> DataFrame:
    """``(h1, h2, n_docs, first_id)``: in how many rows of ``docs`` each key occurs."""
    keys = F.array_distinct(F.transform(split_lines(F.col(text_col)), line_key))
    lines = docs.select(F.col(id_col).alias("__id"), F.explode(keys).alias("key")).where(F.length("key") >= min_key)
    return lines.groupBy(*_hashed(F.col("key"))).agg(F.count("*").alias("n_docs"), F.min("__id").alias("first_id"))


class LineRuns:
    """Levelled sorted runs of line hashes below a shared folder.

    ``min_docs`` is the count from which on a line is frequent.
    """

    def __init__(self, spark: SparkSession, min_docs: int, folder: str | None = None):
        self.spark, self.min_docs, self.folder = spark, min_docs, folder or scratch_path(spark, "line-runs")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_key: int = 1) -> None:
        """Anti-join one batch with the runs, add the rest as a run of level 0, compact full levels.

        A line that a run holds as frequent adds nothing, unless its first id comes before
        the run's; so counts below ``min_docs`` and all first ids stay exact.
        """
        fresh = line_counts(docs, id_col, text_col, min_key)
        for run in self.runs():
            known = self.spark.table(run).where(F.col("n_docs") >= self.min_docs).select(*HASH, F.col("first_id").alias("known_id"))
            adds_nothing = F.col("first_id").isNull() | (F.col("known_id") <= F.col("first_id"))
            same = [fresh[h] == known[h] for h in HASH]
            fresh = fresh.join(known.hint("merge"), [*same, adds_nothing], "left_anti")
        self._write(fresh, 0)
        level = 0
        while len(self.levels[level]) > 1:
            self._compact(self.levels[level], level + 1)
            level += 1

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def frequent(self) -> DataFrame:
        """``(h1, h2, first_id)`` of the frequent lines, after all runs are compacted into one."""
        runs = self.runs()
        if not runs:
            raise ValueError("no batch was added")
        while len(runs) > 1:
            self._compact(runs[:2], len(self.levels) - 1)
            runs = self.runs()
        return self.spark.table(runs[0]).where(F.col("n_docs") >= self.min_docs).select(*map(movable, HASH), "first_id")

    def _compact(self, pair: list[str], level: int) -> None:
        """Merge-join two runs into one of ``level``.  (A union would lose their buckets.)"""
        pair = list(pair)
        one, other = (self.spark.table(run).select(*HASH, F.col("n_docs").alias(f"n{k}"), F.col("first_id").alias(f"id{k}")) for k, run in enumerate(pair))
        both = one.hint("merge").join(other, HASH, "full_outer")
        count = F.coalesce("n0", F.lit(0)) + F.coalesce("n1", F.lit(0))
        self._write(both.select(*HASH, count.alias("n_docs"), F.least("id0", "id1").alias("first_id")), level)
        for held in self.levels:
            for run in [r for r in pair if r in held]:
                self._drop(run)
                held.remove(run)

    def _write(self, counts: DataFrame, level: int) -> None:
        run = f"line_run_{uuid.uuid4().hex}"
        before = self.spark.conf.get(ORDERED_SCANS, "false")
        self.spark.conf.set(ORDERED_SCANS, "true")
        try:
            counts.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", self._path(run)).saveAsTable(run)
        finally:
            self.spark.conf.set(ORDERED_SCANS, before)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)

    def _path(self, run: str) -> str:
        return f"{self.folder}/{run}"

    def _drop(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE {run}")
        remove_path(self.spark, self._path(run))

    def drop(self) -> None:
        """Delete all runs."""
        for run in self.runs():
            self._drop(run)
        self.levels = [[]]
        remove_path(self.spark, self.folder)


def drop_frequent_lines(docs: DataFrame, frequent: DataFrame, id_col: str, text_col: str, min_key: int = 1, keep_first: bool = False) -> DataFrame:
    """``docs`` with ``__lines``, ``__n_dropped`` and ``__kept``.

    Only hashes and positions meet the runs; each text is moved once, when the dropped
    positions come back to its row.  With ``keep_first`` the document of the smallest id
    among those that hold a line keeps it.
    """
    rows = docs.withColumn("__tag", F.xxhash64(F.col(text_col)))
    at = rows.select(F.col(id_col).alias("__id"), "__tag", F.posexplode(split_lines(F.col(text_col))).alias("pos", "line"))
    at = at.select("__id", "__tag", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_key)
    at = at.select("__id", "__tag", "pos", *_hashed(F.col("key")))
    hit = at.join(frequent, HASH)
    if keep_first:
        hit = hit.where(~F.col("__id").eqNullSafe(F.col("first_id")))
    gone = hit.groupBy("__id", "__tag").agg(F.collect_list("pos").alias("__gone")).withColumnRenamed("__tag", "__tag2")
    met = rows.join(gone, rows[id_col].eqNullSafe(gone["__id"]) & (rows["__tag"].eqNullSafe(gone["__tag2"])), "left")
    lines = split_lines(F.col(text_col))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    whole = F.coalesce(F.col(text_col), F.lit(""))
    return (
        met.withColumn("__lines", lines)
        .withColumn("__n_dropped", F.coalesce(F.size(F.array_distinct("__gone")), F.lit(0)).cast("long"))
        .withColumn(
            "__kept",
            F.when(F.col("__gone").isNull(), whole).otherwise(F.array_join(F.transform(kept, lambda i: F.get("__lines", i)), "\n")),
        )
        .drop("__id", "__tag", "__tag2", "__gone")
    )


def split_batches(docs: DataFrame, batches: int, id_col: str = "doc_id", text_col: str = "text") -> list[DataFrame]:
    """``docs`` as ``batches`` tables, each row in exactly one, by a predicate on ``docs`` itself.

    Rows of a scan of many files are dealt by file, so that each file is read once in all;
    others by id and text.
    """
    key = [F.col("_metadata.file_path")] if _has_files(docs, 2 * batches) else [F.col(id_col), F.col(text_col)]
    return [docs.where(F.pmod(F.xxhash64(*key), F.lit(batches)) == k) for k in range(batches)]


def _has_files(docs: DataFrame, count: int) -> bool:
    try:
        docs.select("_metadata.file_path")
    except AnalysisException:  # no scan of files, or a union or join of several
        return False
    return len(docs.inputFiles()) >= count


def dedup_lines(
    docs: DataFrame,
    batches: int = 4,
    min_docs: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_key: int = 1,
    keep_first: bool = False,
) -> DataFrame:
    """Drop lines that occur in at least ``min_docs`` documents of ``docs``.

    Returns the columns of ``docs`` plus ``n_lines``, ``n_dropped`` and ``kept_text`` (under
    those names, which replace columns of the same name).  Each row is one document, so
    repeated rows count each; rows whose id is null keep and lose lines alike.  A null text
    is one empty line.  Empty tables give an empty result.  ``batches`` does not change
    the result.
    """
    runs = LineRuns(docs.sparkSession, min_docs)
    for batch in split_batches(docs, batches, id_col, text_col):
        runs.add(batch, id_col, text_col, min_key)
    frequent = checkpoint(runs.frequent())
    runs.drop()
    return (
        drop_frequent_lines(docs, frequent, id_col, text_col, min_key, keep_first)
        .withColumn("n_lines", F.size("__lines").cast("long"))
        .withColumn("n_dropped", F.col("__n_dropped"))
        .withColumn("kept_text", F.col("__kept"))
        .drop("__lines", "__n_dropped", "__kept")
    )
