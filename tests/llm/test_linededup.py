import hashlib
from collections import defaultdict

import pytest

from orrery.llm import linededup

BLANKS = " \t\n\x0b\x0c\r"
KEY = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs):
    split = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda line: line.strip(BLANKS).translate(KEY)
    docs = defaultdict(set)
    for n, (_, lines) in enumerate(split):
        for line in lines:
            docs[key(line)].add(n)
    hot = {k for k, d in docs.items() if k and len(d) >= min_docs}
    out = []
    for i, lines in split:
        kept = [x for x in lines if key(x) not in hot]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def run(docs, min_docs, batches=1):
    from pyspark.sql import functions as F

    out = linededup.dedup_lines(docs, batches, min_docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("s"))
    return sorted(map(tuple, out.collect()), key=str)


ROWS = [
    (1, "Hot Line\nown one\n\n"),
    (2, " hot line\t\nown two\nown two"),
    (3, "HOT LINE\x0b"),
    (4, None),
    (5, ""),
    (6, "\n\n\n"),
    (7, "\u00a0hot line\nÉ\né"),
    (None, "hot line\nnull id"),
    (None, "hot line\nnull id"),
    (8, "\n".join(f"line {n % 700}" for n in range(5000))),
    (9, "\n".join(f"line {n % 900}" for n in range(5000))),
    (2, " hot line\t\nown two\nown two"),
]


def test_drop_equals_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    for min_docs, batches in ((2, 1), (3, 3), (5, 2)):
        assert run(docs, min_docs, batches) == brute(ROWS, min_docs)


@pytest.mark.parametrize("files", [1, 8])
def test_filters_and_projections_of_the_frame_hold_in_every_batch(spark, tmp_path, files):
    """By one file the rows are dealt by id and text, by eight by file."""
    rows = [(n, f"all\nlang {n % 2}\nown {n}\nmod {n % 5}", "de" if n % 2 else "fr") for n in range(60)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(files, "doc_id").write.parquet(path)
    docs = spark.read.parquet(path).where("lang = 'de'").selectExpr("doc_id", "concat(text, '\n', lang) AS text")
    want = [(i, f"{t}\n{lang}") for i, t, lang in rows if lang == "de"]
    parts = linededup.split_batches(docs, 3)
    assert sum(p.count() for p in parts) == len(want) and sum(p.count() > 0 for p in parts) > 1
    for min_docs in (2, 7, 30):
        assert run(docs, min_docs, 3) == brute(want, min_docs)


def test_first_document_keeps_its_lines(spark):
    docs = spark.createDataFrame([(3, "a\nb"), (1, "a"), (2, "A \nc"), (None, "a")], "doc_id long, text string")
    for batches in (1, 3):
        got = {r["doc_id"]: r["kept_text"] for r in linededup.dedup_lines(docs, batches, 2, keep_first=True).collect()}
        assert got == {1: "a", 2: "c", 3: "b", None: ""}


def test_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "x\ny", "keep", 5)], "doc_id long, text string, pos string, n_lines int")
    row = linededup.dedup_lines(docs, 2, 1).first()
    assert (row["pos"], row["n_lines"], row["n_dropped"], row["kept_text"]) == ("keep", 2, 2, "")
    assert linededup.dedup_lines(docs.limit(0), 2, 1).count() == 0


def counted(spark, runs):
    return {run: sorted(r["n_docs"] for r in spark.table(run).collect()) for run in runs.runs()}


def test_levels_are_compacted_and_frequent_lines_are_not_added_again(spark):
    runs = linededup.LineRuns(spark, 2)
    with pytest.raises(ValueError):
        runs.frequent()
    for n in range(5):
        runs.add(spark.createDataFrame([(n, f"same\nown {n}")], "doc_id long, text string"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    # Two batches make the line frequent; their compacted run knows that, so later ones add their own lines only.
    assert sorted(counted(spark, runs).values()) == [[1], [1, 1, 1, 1, 2]]
    runs.add(spark.createDataFrame([(-1, "same\nother")], "doc_id long, text string"))
    assert [r["first_id"] for r in runs.frequent().collect()] == [-1]
    assert [len(level) for level in runs.levels][-1] == 1 and len(runs.runs()) == 1
    runs.drop()
    assert not spark.sql("SHOW TABLES").where("tableName LIKE 'line_run_%'").count()


def test_runs_are_merged_in_place(spark):
    """A batch is anti-joined by a merge join, and a run is neither moved nor sorted."""
    runs = linededup.LineRuns(spark, 1)
    runs.add(spark.createDataFrame([(1, "a\nb")], "doc_id long, text string"))
    plans = []
    runs._write = lambda counts, level: plans.append(counts._jdf.queryExecution().toString())
    spark.conf.set(linededup.ORDERED_SCANS, "true")
    runs.add(spark.createDataFrame([(2, "a\nc")], "doc_id long, text string"))
    spark.conf.unset(linededup.ORDERED_SCANS)
    physical = plans[0].split("== Physical Plan ==")[1]
    assert physical.count("SortMergeJoin") == 1 and physical.count("Exchange") == 1
    run_side = physical[physical.index("SortMergeJoin") :].split(":- ")[1].split("+- Filter")[0]
    assert "LeftAnti" in physical and "Bucketed: true" in physical and run_side
    runs.drop()
