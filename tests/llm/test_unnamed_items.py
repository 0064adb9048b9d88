"""Benchmark items without id are cut out of training texts."""

from strandline.llm import decontaminate


def test_items_without_id_are_cut(spark):
    docs = spark.createDataFrame([(1, "before it one two three after it"), (2, "one two three"), (3, "one two four"), (4, "five six seven")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "one two three"), ("7", "five six")], "item_id string, text string")
    got = {r["doc_id"]: r["text"] for r in decontaminate.remove_contamination(docs, bench).collect()}
    assert got == {1: "before it\nafter it", 3: "one two four", 4: "seven"}
