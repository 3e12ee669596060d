from doctree.llm import exact_dedup


def test_a_null_id_is_no_number(spark):
    rows = [(None, "a b"), (-(2**63), "ab"), (0, "c"), (None, "c "), (None, "d"), (None, "d"), (0, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marked = sorted(((r["doc_id"], r["keep_id"]) for r in exact_dedup.find_duplicates(df).where("kept").collect()), key=repr)
    kept = sorted(((r["doc_id"], r["text"]) for r in exact_dedup.keep_first(df).collect()), key=repr)
    assert kept == [(0, "d"), (None, "a b"), (None, "c ")] and [i for i, _ in marked] == [0, None, None]
