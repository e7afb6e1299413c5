"""The corpus pipeline: language ID, line and near-duplicate removal, decontamination, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's ``docs``; all but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import bpe, decontaminate, langid, linededup, similar
from orrery.llm.queries import LINE_BATCHES, MIN_LINE_DOCS, table, tokenizer_path
from orrery.session import remove_path, scratch_path

#: A text is rejected if this share of it fits no language.
MAX_BACKGROUND = 0.5
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts in some learned language; null texts, texts without letters and noise go."""
    model = langid.train(docs)
    found = langid.identify(docs, model)
    clean = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("background") <= MAX_BACKGROUND)
    return found.where(clean).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten or more documents stay in the one with the smallest id; ``n_chars`` follows the text."""
    out = linededup.dedup_lines(docs, LINE_BATCHES, MIN_LINE_DOCS, keep_first=True)
    changed = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.withColumns(changed).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8) stays, the one with the smallest id.

    SimHash fingerprints within two bits propose by deletion variants, min-hash bands propose what is farther apart, shingle sets decide.  Rows that repeat its id stay with it; rows without an id are no copies of anything and stay.
    """
    groups = similar.similar_groups(docs.where("doc_id IS NOT NULL").select("doc_id", "text"))
    others = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("hit_spans") == 0).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digests of ids and decoded text."""
    return bpe.encode_table(spark, docs.select("doc_id", "text"), tokenizer_path()).drop("text")


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("simhash_dedup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("bpe", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written below the shared folder and read again.

    A result is deleted when the next stage has read it; the last one stays.
    """
    docs, read = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if read:
            remove_path(spark, read)
        read = path
    return docs
