"""Near copies are linked whatever else is in the table."""

from plumbline.llm import near_dedup


def test_a_first_wave_without_pairs(spark):
    """All lists have a central text (2) of another size: the near copies 0 and 1 are compared in a later wave."""
    w = [f"w{k}" for k in range(18)]
    texts = [w[:14], w[1:15], w, *([*w[11:], *(f"u{i}x{k}" for k in range(40))] for i in range(5))]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()}
    assert found == {0: 0, 1: 0} | {k: k for k in range(2, 8)}
