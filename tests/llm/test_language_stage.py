from tidemark.llm import stages


def test_documents_stay_where_nothing_is_labelled(spark, folder):
    rows = [(1, "some english words", None), (2, "日本語", None), (3, "12 34", None), (4, None, None), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(tuple(r) for r in stages.language(spark, docs, folder).collect()) == rows[:2]
