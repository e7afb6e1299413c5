import corpus_pipeline
from orrery.llm import decontaminate, queries

SF = "/root/testdata/sf0.01"


def test_stages_keep_the_columns_and_whole_rows(spark):
    docs = queries.table(spark, SF, "documents")
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        assert docs.select("doc_id").distinct().count() == docs.count()
        counts.append(docs.count())
    assert counts[0] >= counts[1] == counts[2] > counts[3] >= counts[4] > 0.8 * counts[0]
    left = decontaminate.find_contamination(docs, queries.table(spark, SF, "benchmark"))
    assert left.where("size(hit_items) > 0").count() == 0
    tokens = corpus_pipeline.token_stage(spark, docs, SF)
    assert tokens.count() == docs.count()


def test_odd_rows_and_empty_table(spark):
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "1234 !!", "en", "s", 7), (3, "the cat and the dog", None, None, None), (3, "the cat and the dog", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = sorted(str(r["doc_id"]) for r in stage(spark, docs, SF).collect())
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert kept["line_dedup"] == kept["decontamination"] == kept["bpe"] == ["1", "2", "3", "3", "None"]
    assert kept["simhash_dedup"] == ["1", "2", "3", "3", "None"]
    assert kept["language_id"] == ["3", "3"]  # null texts and texts without letters go
