"""Exact dedup on tables with repeated or null ids."""

from collections import Counter

from flowlab.llm import exact_dedup


def test_exact_copies_leave_by_row(spark):
    rows = [(1, "copy"), (2, "copy"), (1, "alone"), (None, "copy"), (None, "unique"), (3, "twice"), (3, "twice"), (None, "void"), (None, "void"), (4, None), (5, "")]
    out = exact_dedup.drop_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(tuple(r) for r in out.collect()) == Counter([(2, "copy"), (1, "alone"), (None, "unique"), (3, "twice"), (None, "void"), (5, "")])
