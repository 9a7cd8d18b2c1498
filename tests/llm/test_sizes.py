"""Bounds by size change no result: both sides of each switch."""

from plumbline.llm import toxicity, url_filter


def test_no_label_fills_the_sample_alone(spark):
    docs = [(i, ("bad " if i % 2 else "good ") * 60 + str(i), None) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string, other string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    whole = toxicity.sample(df, labels)
    part = toxicity.sample(df, labels, most_bytes=8_000)
    assert len(whole) == sum(1 for i in range(200) if __import__("zlib").crc32(str(i).encode()) % 5)
    for k in (0, 1):
        of = part[part["toxic"] == k]
        assert 0 < of["text"].str.len().sum() <= 4_000 and len(of) >= 10
    # texts too long for a half go, very long ones come last, and a repeated text is read once
    more = df.union(spark.createDataFrame([(500, "bad " * 2_000, None), (501, "bad", None), (503, "bad", None)], df.schema))
    known = labels.union(spark.createDataFrame([(500, 1), (501, 1), (503, 1)], labels.schema))
    again = toxicity.sample(more, known, most_bytes=8_000)
    assert 500 not in set(again["doc_id"]) and (again["text"] == "bad").sum() <= 1 and set(again["toxic"]) == {0, 1}


def test_ties_of_rules_are_judged_alike_by_both_ways(spark, monkeypatch):
    rules = (("b.cc", "/x", "block"), ("cc", "/xy1", "allow"), ("cc", "/x", "allow"))
    urls = ["http://a.b.cc/xy12z", "http://b.cc/xy12z", "http://cc/xy1", "http://b.cc/x", "http://a.b.cc/q", None, "cc/x"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    small = sorted(map(tuple, url_filter.judge(pages, rules).collect()), key=str)
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", 0)
    large = sorted(map(tuple, url_filter.judge(pages, rules).collect()), key=str)
    assert small == large
    assert {r[0]: r[4:] for r in small}[0] == ("b.cc/x", "block")
