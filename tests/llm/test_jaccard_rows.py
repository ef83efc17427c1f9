"""Rows whose doc_id is null or repeated are decided by their own content."""

from ledgerloom.llm import jaccard_join


def test_only_linked_rows_go(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(40))
    rows = [(1, text("a")), (None, text("a") + " tail"), (None, text("b")), (7, text("a") + " end"), (7, text("c")), (None, None), (9, text("d"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = jaccard_join.keep_one_of_each_class(df).collect()
    want = [(1, text("a")), (None, text("b")), (7, text("c")), (None, None), (9, text("d"))]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept))) == sorted(map(repr, want))
