from partlens.llm import language_id


def test_documents_stay_without_any_label(spark):
    docs = spark.createDataFrame([(0, "some words of a text", None), (1, "123 456", None), (2, None, None), (3, "noch ein Text", None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in language_id.recognised(spark, docs).collect()) == [0, 3]
