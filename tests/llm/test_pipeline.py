import numpy as np

import corpus_pipeline
from plumbline.llm import subword
from plumbline.llm.common import materialize
from test_operators import components, table  # noqa: F401


def test_stages(spark, docs, tmp_path):
    labels = spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    at, rows = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        at = materialize(stage(spark, at, str(tmp_path)), "test-stage")
        rows[name] = [tuple(r) for r in at.collect()]
        if name != "sentencepiece":
            assert at.columns == docs.columns
    assert len(rows["toxicity"]) == docs.count()
    kept = {}
    for r in rows["toxicity"]:
        kept[r[1] or ""] = max(kept.get(r[1] or "", -1), r[0])
    assert {r[0] for r in rows["exact_dedup"]} == set(kept.values())
    want = {i for i, (_, c) in components(rows["exact_dedup"]).items() if i == c}
    assert {r[0] for r in rows["near_dedup"]} == want
    assert {r[0] for r in rows["mixing"]} <= want and len(rows["sentencepiece"]) == len(rows["mixing"])


def test_stages_against_brute_force(spark, tmp_path):
    """Toxic rows, repeated rows, repeated and null ids and columns with clashing names, stage by stage."""
    rng = np.random.default_rng(12)
    clean, bad = [f"word{i}" for i in range(300)], ["blargh", "zonkish", "fribbit"]
    rows, toxic = [], []
    for i in range(240):
        w = list(rng.choice(clean, 30))
        toxic.append(i % 4 == 0)
        if toxic[-1]:
            w[3], w[11], w[20] = rng.choice(bad, 3)
        rows.append((i, " ".join(w), f"s{i % 3}"))
    rows += [(240, rows[5][1], "s0"), (241, rows[6][1] + " more", "s1"), (5, rows[5][1], "s2"), (None, rows[7][1], None), (242, None, "s0"), (243, "", "s0"), (244, "blargh zonkish fribbit", "s0")]
    docs = spark.createDataFrame([(*r, "en", k, "x", 1) for k, r in enumerate(rows)], "doc_id long, text string, source string, lang string, n_chars long, row string, key int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(t)) for i, t in enumerate(toxic)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at, out = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        at = materialize(stage(spark, at, str(tmp_path)), "test-stage")
        out[name] = [(r.doc_id, r.text, r.n_chars) for r in at.collect()]
        assert at.columns[:7] == docs.columns
    numbers = {k for _, _, k in out["toxicity"]}
    assert numbers == {k for k, (i, t, _) in enumerate(rows) if not any(b in (t or "") for b in bad)} | (numbers & {6 * 4}) and len(numbers) < len(rows) - 50
    best = {}
    for i, t, k in out["toxicity"]:
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    assert sorted(str((i, t or "")) for i, t, _ in out["exact_dedup"]) == sorted(str((None if i < 0 else i, t)) for t, i in best.items())
    kept = [(i, t, k) for i, t, k in out["exact_dedup"]]
    labels = components([(k, t) for k, (_, t, _) in enumerate(sorted(kept, key=lambda r: (r[0] is None, r[0])))])
    ordered = sorted(kept, key=lambda r: (r[0] is None, r[0]))
    assert sorted(map(str, out["near_dedup"])) == sorted(str(ordered[k]) for k, (_, c) in labels.items() if k == c)
    assert {str(r) for r in out["mixing"]} <= {str(r) for r in out["near_dedup"]}
    pieces = subword._of(subword.MODEL)
    for r in at.collect():
        raw, _ = subword.decode(np.array(r.pieces, np.int32), np.array([0, len(r.pieces)]), pieces)
        assert raw.tobytes().decode() == (r.text or "")
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, whole.collect())) == sorted(map(str, at.collect()))


def test_stages_take_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    none.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
