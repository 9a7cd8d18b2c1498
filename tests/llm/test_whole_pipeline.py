"""Repeated rows, ids on several texts and rows without an id in the pipeline's dedup stages."""

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k}" for k in range(60))
NEAR, OTHER, FAR = LONG.replace("w59", "edit"), " ".join(f"v{k}" for k in range(60)), " ".join(f"z{k}" for k in range(60))


def found(stage, spark, pairs):
    df = spark.createDataFrame([(i, t, "en", f"s{k % 2}", 0) for k, (i, t) in enumerate(pairs)], SCHEMA)
    out = stage(spark, df, "")
    assert out.columns == df.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


def test_exact_dedup_keeps_one_row_of_each_text(spark):
    pairs = [(7, "a"), (7, "a"), (7, "a"), (3, "a"), (7, "b"), (9, "b"), (None, "c"), (None, "c"), (None, "d"), (2, "d"), (None, "")]
    assert found(corpus_pipeline.drop_exact, spark, pairs) == sorted([(7, "a"), (9, "b"), (None, "c"), (2, "d"), (None, "")], key=str)


def test_near_dedup_tells_rows_of_one_id_apart(spark):
    pairs = [(1, LONG), (5, NEAR), (5, OTHER), (None, LONG.replace("w58", "new")), (None, FAR), (6, FAR.replace("z59", "edit")), (8, "one"), (8, "one")]
    assert found(corpus_pipeline.drop_near, spark, pairs) == sorted([(1, LONG), (5, OTHER), (6, FAR.replace("z59", "edit")), (8, "one")], key=str)
    assert found(corpus_pipeline.drop_near, spark, [(2, LONG), (1, NEAR), (3, OTHER)]) == sorted([(1, NEAR), (3, OTHER)], key=str)


def test_map_columns_pass_through_the_stages(spark):
    rows = [(1, LONG, {"b": "2", "a": "1"}), (1, LONG, {"a": "0"}), (5, NEAR, None), (None, FAR, {"a": "1"}), (9, "one", {}), (8, "one", None)]
    df = spark.createDataFrame([(i, t, "en", "s", 0, m) for i, t, m in rows], SCHEMA + ", more map<string,string>")
    exact = corpus_pipeline.drop_exact(spark, df, "")
    assert exact.columns == df.columns
    assert sorted(((r.doc_id, r.text, r.more) for r in exact.collect()), key=str) == sorted([(1, LONG, {"a": "0"}), (5, NEAR, None), (None, FAR, {"a": "1"}), (9, "one", {})], key=str)
    near = corpus_pipeline.drop_near(spark, df, "")
    assert sorted(((r.doc_id, r.more) for r in near.collect()), key=str) == sorted([(1, {"a": "0"}), (None, {"a": "1"}), (8, None)], key=str)


def test_ids_of_other_types_seed_the_pieces(spark):
    from plumbline.llm import subword

    df = spark.createDataFrame([("a", "two words"), ("b", "two words"), (None, "two words"), ("a", "two words"), ("ä", None)], "doc_id string, text string")
    one, two = (sorted(((r.doc_id, tuple(r.pieces)) for r in subword.encode_texts(df.repartition(n)).collect()), key=str) for n in (1, 4))
    assert one == two and all(p for i, p in one if i != "ä")
    assert {r.decoded for r in subword.decode_texts(subword.encode_texts(df)).collect()} == {"two words", ""}
