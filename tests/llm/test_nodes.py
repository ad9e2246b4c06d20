from lumenweave.llm import common


def test_equal_nodes_only_for_equal_texts(spark):
    df = common.with_nodes(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "doc_id long, text string"))
    rows = {r.doc_id: r["_lw_t"] for r in df.collect()}
    assert rows[1] == rows[2] != rows[3] and rows[4] is None


