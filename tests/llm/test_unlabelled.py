"""The language stage on a table without labels."""

from flowlab.llm import langid


def test_unlabelled_texts_stay(spark):
    rows = [(1, "clean text of words", None), (2, "123 !!!", None), (3, None, None), (4, "more words", None)]
    out = langid.drop_undetermined(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {r.doc_id for r in out.collect()} == {1, 4}
