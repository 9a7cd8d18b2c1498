import hashlib
import math
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import exact_dedup, media, mixing, near_dedup, pii, substring_dedup, subword, toxicity, url_filter
from plumbline.llm import html as pages
from plumbline.llm.registry import ORACLE_SQL

WORD = re.compile("[^\x20\x09-\x0d]+")


def table(rows, *cols):
    return {r[cols[0]]: tuple(r[c] for c in cols[1:]) for r in rows.collect()}


@pytest.fixture(scope="module")
def saved(docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    docs.write.parquet(str(path / "documents.parquet"))
    return str(path)


def against_sql(name, df, **views):
    con = duckdb.connect()
    for t, path in views.items():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'")
    c = con.execute(ORACLE_SQL[name])
    cols = [x[0] for x in c.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(str, c.fetchall())) == sorted(str(tuple(r)) for r in df.select(cols).collect())


# --- 9 ---


def test_exact_dedup_equals_sql(spark, saved):
    against_sql("op9_exact_dedup", exact_dedup.op9_exact_dedup(spark, saved), documents=f"{saved}/documents.parquet")


def test_index_takes_new_texts_only(spark, none):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    batch = lambda rows: exact_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string"))
    assert index.append(batch([(1, "a"), (2, "a"), (3, None)])).count() == 2
    assert index.append(batch([(4, "a"), (5, "b"), (6, "")])).count() == 1
    assert index.read().count() == 3
    # of all batches the largest id stays, and the sizes add up
    assert table(exact_dedup.groups(batch([(7, "a"), (8, "b")]), index), "id", "keep_id", "group_size") == {7: (4, 3), 8: (5, 1)}
    assert exact_dedup.exact_duplicates(none).count() == 0
    spark.sql(f"DROP TABLE {index.name}")
    again = exact_dedup.DigestIndex(spark, index.name, index.path, 4)
    assert again.exists() and again.read().count() == 3
    plan = batch([(9, "c")]).join(index.known().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan


def test_attached_index_keeps_its_buckets(spark):
    """An index written with 40 buckets and attached with the default number knows all its texts."""
    texts = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    rows = exact_dedup.digests(texts)
    index = exact_dedup.DigestIndex(spark, buckets=40)
    assert index.append(rows).count() == 400
    spark.sql(f"DROP TABLE {index.name}")
    again = exact_dedup.DigestIndex(spark, index.name, index.path)
    assert again.exists() and again.buckets == 40
    assert exact_dedup.groups(rows, again).count() == 400
    assert again.append(rows.withColumn("id", F.col("id") + 1000)).count() == 0
    assert again.read().agg(F.sum("group_size"), F.min("keep_id")).first()[:] == (800, 1000)
    again.remove()
    assert not spark.catalog.tableExists(index.name)


def test_one_text_on_most_rows(spark):
    """A text on two thirds of the rows, null ids and columns with the names of results."""
    rows = [(i if i % 7 else None, "same" if i % 3 else f"t{i}", i, "x") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, keep_id long, digest string")
    got = sorted(str(tuple(r)) for r in exact_dedup.exact_duplicates(df).select("id", "keep_id", "group_size").collect())
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t].append(i)
    want = [(i, max((x for x in groups[t] if x is not None), default=None), len(groups[t])) for i, t, *_ in rows]
    assert got == sorted(map(str, want))


# --- 1 ---


def test_mixing_equals_sql(spark, saved):
    against_sql("op1_mixing", mixing.op1_mixing(spark, saved), documents=f"{saved}/documents.parquet")


def test_mix_meets_targets(spark, none):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.expr("repeat('w ', cast(id % 50 + 1 as int))").alias("text"), F.lit("x").alias("copies"), F.lit(1).alias("size"))
    plan = mixing.mix_plan(rows.drop("copies", "size"))
    got = plan.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max("copies").alias("c"), F.first("source_size").alias("s")).collect()
    assert all(abs(r.t - r.g) <= 60 and r.c <= 3 and r.g <= 3 * r.s for r in got) and abs(sum(r.g for r in got) - sum(r.s for r in got)) < 1e-6
    assert table(plan, "id", "taken") == table(mixing.mix_plan(rows.drop("copies", "size").repartition(7)), "id", "taken")
    mixed = mixing.mix(rows)
    assert mixed.columns == rows.columns and mixed.count() == plan.agg(F.sum("copies")).first()[0]
    twice = rows.unionAll(rows)
    assert mixing.mix(twice).count() == mixing.mix_plan(twice).agg(F.sum("copies")).first()[0]
    assert mixing.mix_plan(none).count() == 0 and mixing.mix(none).count() == 0


def test_mix_handles_null_ids_ties_and_clashing_names(spark):
    rows = [(None if i % 3 == 0 else i // 2, f"w{i % 9} " * (i % 9), None if i % 5 == 0 else f"s{i % 2}", i % 4, "h", i) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row_hash long, _hash string, copies long")
    for c in ("_copies", "_rows", "_own", "_copy", "row", "every"):
        df = df.withColumn(c, F.lit("x"))
    first, again = mixing.mix(df), mixing.mix(df.repartition(5).orderBy(F.desc("copies")))
    assert first.columns == df.columns and sorted(map(str, first.collect())) == sorted(map(str, again.collect()))
    assert first.count() == mixing.mix_plan(df).agg(F.sum("copies")).first()[0] > 0


# --- 3 ---

URLS = [None, "", "nothing", "http://", "HTTP://A.NET/x", "x://net", "x://net/", "x://www.example.net/en/a?b", "x://example.net/en", "x://EXAMPLE.net/EN/", "x://notexample.net/en/", "x://example.com/de/x", "x://a.b.example.com/de/", "x://b.org/fr/#x", "x://org?x/fr/", "x://a://b.net/", "x://u@h.net:80/p", "x://example.com/de/", "x://example.com/de/", "é://straße.net/ü"]


def rule_of(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


def test_urls(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    got = url_filter.op3_url_filter(spark, str(tmp_path))
    assert table(got, "page_id", "host", "path", "rule", "verdict") == {i: rule_of(u) for i, u in enumerate(URLS)}
    against_sql("op3_url_filter", got, pages=f"{tmp_path}/pages.parquet")
    assert url_filter.judge(df.limit(0)).count() == 0 and url_filter.judge(df, ()).filter("rule IS NOT NULL").count() == 0
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    assert table(url_filter.rules_by_join(df, rules), "page_id", "rule", "verdict") == {i: rule_of(u)[2:] for i, u in enumerate(URLS)}


def test_long_lists_and_clashing_names(spark, monkeypatch):
    """Lists beyond the constants' limit go through the join with the same result; result names are replaced."""
    df = spark.createDataFrame([(i, u, "mine", "mine", i, "b") for i, u in enumerate(URLS)], "page_id long, url string, host string, verdict string, n long, b string")
    want = {i: rule_of(u) for i, u in enumerate(URLS)}
    got = url_filter.judge(df)
    assert sorted(got.columns) == sorted([*df.columns, "path", "rule"]) and table(got, "page_id", "host", "path", "rule", "verdict") == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan.replace("Scan ExistingRDD[page_id", "") and "Join" not in plan
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", 0)
    assert url_filter.Cascade.build(url_filter._values(spark, ["a"]), url_filter._values(spark, ["a", "b"])) is None
    joined = url_filter.judge(df)
    assert joined.columns == got.columns and table(joined, "page_id", "host", "path", "rule", "verdict", "n", "b") == {i: (*want[i], i, "b") for i in want}


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter("pmod(hash(key), 4) = 0")
    cascade = url_filter.Cascade.build(listed, universe)
    assert len(cascade.levels) > 1
    held = universe.filter(cascade.holds(F.col("key")))
    assert held.exceptAll(listed).isEmpty() and listed.exceptAll(held).isEmpty()


# --- 10 ---

EM, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    found, n = [], []
    for kind, p in (("email", EM), ("ip", IP), ("card", CARD), ("phone", PHONE)):
        mine = []
        for m in p.finditer(text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                mine.append(f"{kind}:{m.start()}:{m.end()}")
        n.append(len(mine))
        found += mine
    return (*n, hashlib.sha256(",".join(found).encode()).hexdigest())


PRIVATE = [
    None, "", "a@b.c_d@e.f x@y a@b.c.d.@q", "1.2.3.4.5.6.7.8 300.1.1.1 1.2.3 001.002.003.4 1.1.1.256", "4111 1111 1111 1111 and 4111-1111-1111-1112 1 2 3", "+1 (555) 123-4567 + +44 20 7946 0958. +1",
    "\U0001f600 a@b.cc \U0001f600 1.1.1.1", "x" * 50_000, "1" * 50_000, "1 " * 20_000, "a.b@" * 5_000, "1." * 10_000, "+1" + "(" * 20_000, "a@b.cc " * 700, "+1 555 123 4567, " * 300,
]


def test_private_data(spark, tmp_path):
    spark.createDataFrame(list(enumerate(PRIVATE)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = pii.op10_pii(spark, str(tmp_path))
    assert table(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == {i: base_spans(t) for i, t in enumerate(PRIVATE)}


def test_checksums_and_context(spark):
    df = spark.createDataFrame([(1, "iban DE89 3704 0044 0532 0130 00 end"), (2, "iban DE88370400440532013000"), (3, "serial token key GB82WEST12345698765432"), (4, "GB82WEST12345698765432")], "doc_id long, text string")
    found = {r.doc_id: r.pii_iban for r in pii.find_pii(df).collect()}
    assert [(s.start, s.end) for s in found[1]] == [(5, 32)] and not found[2]
    # the words before it decide: an account number in doubt goes, one without context stays below one with it
    assert not found[3] and found[1][0].score > found[4][0].score > pii.THRESHOLD
    assert pii.redact(df).filter("doc_id = 1").first().text == "iban <iban> end"


def test_context_decides(spark):
    texts = ["My SSN is 123-45-6789.", "part no 123-45-6789", "123-45-6789", "social security 000-45-6789 and 666-11-1111, 123-00-4567", "routing 021000021 and order 021000021", "021000021", "ABA 021000022", "é ssn 123-45-6789, 078-05-1120"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find_pii(df).collect()}
    assert [[(s.start, s.end) for s in found[i].pii_ssn] for i in range(8)] == [[(10, 21)], [], [], [], [], [], [], [(6, 17), (19, 30)]]
    assert [[(s.start, s.end) for s in found[i].pii_routing] for i in range(8)] == [[], [], [], [], [(8, 17)], [], [], []]


def test_redaction_cuts_spans(spark):
    texts = ["1.2.3.4 then 1.2.3.45", "a@b.cc xa@b.cc", "", None, "none here", "é 4111 1111 1111 1111é", "+1 555 123 4567 a@b.cc", "x 4111.1.1.1 4111 1111 1111 1111 end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("pii_ip", F.lit("mine"))
    got = pii.redact(df)
    assert got.columns == df.columns and {r.pii_ip for r in got.collect()} == {"mine"}
    assert [r.text for r in got.orderBy("doc_id").collect()][:7] == ["<ip> then <ip>", "<email> <email>", "", None, "none here", "é <card>é", "<phone> <email>"]
    spans = {r.doc_id: [(s.start, s.end) for k in pii.PATTERNS for s in r[f"pii_{k}"]] for r in pii.find_pii(df).collect()}
    for i, text in enumerate(texts):
        left = [c for k, c in enumerate(text or "") if not any(a <= k < b for a, b in spans[i])]
        out = got.filter(F.col("doc_id") == i).first().text or ""
        for kind in pii.PATTERNS:
            out = out.replace(f"<{kind}>", "")
        assert out == "".join(left)


# --- 5 ---


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    sets = {r[0]: shingles(r[1]) for r in rows}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates_equal_brute_force(docs, none):
    rows = [tuple(r) for r in docs.collect()]
    got = table(near_dedup.near_duplicates(docs), "doc_id", "n_shingles", "component_id")
    assert got == components(rows)
    assert near_dedup.near_duplicates(none).count() == 0


def test_group_of_near_copies(spark):
    """A star of edits whose members mostly don't link with each other."""
    rng = np.random.default_rng(7)
    origin = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(origin))]
    for i in range(1, 60):
        w = list(origin)
        for k in rng.choice(150, rng.integers(1, 9), replace=False):
            w[k] = f"e{i}x{k}"
        rows.append((i, " ".join(w)))
    rows = [((i * 37) % 61, t) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert table(near_dedup.near_duplicates(df), "doc_id", "n_shingles", "component_id") == components(rows)


def test_long_lists_are_split(spark, monkeypatch):
    """One list of many members in blocks of a few: the waves and block pairs give the links of brute force."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "WAVES", (1, None))
    rng = np.random.default_rng(11)
    shared = [f"c{i}" for i in range(30)]
    rows = []
    for k in range(12):  # families of texts around one common passage, near copies within a family
        own = [f"f{k}x{i}" for i in range(25)]
        for j in range(4):
            w = [*shared, *own]
            w[40 + int(rng.integers(0, 10))] = f"e{k}x{j}"
            rows.append((k * 4 + j, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("value", F.lit(1)).withColumn("n", F.lit("x"))
    assert table(near_dedup.near_duplicates(df), "doc_id", "n_shingles", "component_id") == components(rows)


# --- 8 ---


def removed(rows):
    words = {r[0]: WORD.findall(r[1] or "") for r in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def test_substrings_equal_brute_force(docs, none, saved, spark):
    rows = [tuple(r) for r in docs.collect()]
    got = substring_dedup.cut_repeats(docs.withColumn("slot", F.lit(1)).withColumn("keys", F.lit("x")))
    assert table(got, "doc_id", "n_words", "n_removed", "kept") == removed(rows)
    for r in got.collect():
        ends = [x for p in r.passages for x in (p.start, p.end)]
        assert sum(p.end - p.start for p in r.passages) == r.n_removed and ends == sorted(ends) and all(p.end - p.start >= 13 for p in r.passages)
    digest = table(substring_dedup.op8_substring_dedup(spark, saved), "doc_id", "n_removed", "kept_sha256")
    assert digest == {i: (n, hashlib.sha256(k.encode()).hexdigest()) for i, (_, n, k) in removed(rows).items()}
    assert substring_dedup.cut_repeats(none).count() == 0


def removed_rows(rows):
    """The same for rows whose ids may repeat or be null."""
    words = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words, strict=True):
        for k in range(len(w) - 12):
            if i is not None:
                key = tuple(w[k : k + 13])
                first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(map(str, out))


def test_groups_split_by_longer_prefixes(spark, monkeypatch):
    """Groups of a few suffixes, so that prefixes grow up to the whole window; null and repeated ids; a hot passage."""
    rng = np.random.default_rng(8)
    words = lambda k, v: [f"w{x}" for x in rng.integers(0, v, k)]
    hot, rows = words(30, 1000), []
    for i in range(60):
        w = words(int(rng.integers(0, 60)), 3)
        if i % 3 == 0:
            w = [*w[:10], *hot, *w[10:]]
        rows.append((None if i % 11 == 5 else i % 50, " ".join(w)))
    rows += [(70, " ".join(["a"] * 400)), (71, " ".join(["a"] * 14)), (72, None), (73, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(substring_dedup, "SUFFIXES", 16)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 2_000)
    got = substring_dedup.cut_repeats(df)
    assert sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept)) for r in got.collect()) == removed_rows(rows)


def test_equal_hashes_are_not_equal_words(monkeypatch):
    """Hashes of four bits: every step still tells windows apart by their words."""
    monkeypatch.setattr(substring_dedup, "HASH", np.uint64(15))
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 2, 40)) + " " + " ".join(f"s{x}" for x in range(20 * (i % 2))) for i in range(40)]
    docs = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(texts)], ["doc", "text"])
    w = lambda table: pa.Table.from_batches(list(table))
    shared = lambda rows, collect: {r["d"]: r["keys"] for r in substring_dedup._gathered(substring_dedup._shared(1)(w(substring_dedup._key_batches(collect, 1)(iter([rows]))))).to_pylist()}
    listed = lambda lists: pa.RecordBatch.from_arrays([*docs.columns, pa.array([lists.get(i, []) for i in range(40)], pa.list_(pa.int64()))], ["doc", "text", "keys"])
    listed = listed(shared(listed(shared(docs, substring_dedup._grams)), substring_dedup._paths))
    none = [np.zeros(0, np.uint64)] * 6
    # two tasks, so that windows meet in the trees too
    book = np.sort(substring_dedup.word_hashes(np.frombuffer(b"w0s3", np.uint8), np.array([0, 2]), np.array([2, 4])))
    sent = [b for part in (listed.slice(0, 25), listed.slice(25)) for b in substring_dedup._send_batches(none, book, 1)(iter([part]))]
    found = {r["d"]: r for r in substring_dedup._gathered(substring_dedup._repeated(book, 1)(w(sent))).to_pylist()}
    lists = [pa.array([found[i][c] if i in found else None for i in range(40)], pa.list_(t)) for c, t in (("keys", pa.int64()), ("places", pa.int32()))]
    marked = pa.RecordBatch.from_arrays([*docs.columns, *lists], ["doc", "text", "keys", "places"])
    got = {r["doc"]: (r["n_words"], r["n_removed"], r["kept"]) for b in substring_dedup._cut_batches(True)(iter([marked])) for r in b.to_pylist()}
    want = removed(list(enumerate(texts)))
    assert got == want and 0 < sum(n for _, n, _ in want.values()) < sum(n for n, _, _ in want.values())


def test_deep_nodes_are_runs_of_equal_windows():
    rng = np.random.default_rng(10)
    words, doc = rng.integers(0, 2, (300, 13)) * 70_000, rng.integers(0, 50, 300)
    words[:100] = words[rng.integers(200, 300, 100)]
    order, opens = substring_dedup.deep_nodes(words, doc)
    rows = [tuple(words[i]) for i in order]
    assert rows == sorted(rows) and opens.tolist() == [k == 0 or rows[k] != rows[k - 1] for k in range(300)]
    assert all(doc[order[k]] >= doc[order[k - 1]] for k in range(1, 300) if not opens[k])


# --- 2 ---


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    emit, trans, start = rng.normal(size=7), rng.normal(size=(2, 2)), rng.normal(size=2)
    row = np.array([0, 0, 0, 1, 1, 1, 1])
    p, joint, first = toxicity.marginals(emit, row, trans, start, pairs=True)
    want, pairs, firsts = np.zeros(7), np.zeros((2, 2)), np.zeros(2)
    for lo, hi in ((0, 3), (3, 7)):
        n, total = hi - lo, 0.0
        m, pr, fi = np.zeros(n), np.zeros((2, 2)), np.zeros(2)
        for code in range(2**n):
            y = [(code >> k) & 1 for k in range(n)]
            wt = math.exp(start[y[0]] + sum(emit[lo + k] * y[k] for k in range(n)) + sum(trans[y[k], y[k + 1]] for k in range(n - 1)))
            total += wt
            m += wt * np.array(y)
            fi[y[0]] += wt
            for k in range(n - 1):
                pr[y[k], y[k + 1]] += wt
        want[lo:hi], pairs, firsts = m / total, pairs + pr / total, firsts + fi / total
    assert np.allclose(p, want) and np.allclose(joint, pairs) and np.allclose(first, firsts)


def naive_marginals(emit, trans, start):
    w, t, p0 = np.exp(np.clip(emit, -30, 30)), np.exp(trans), np.exp(start)
    n = len(emit)
    a, b = np.zeros((n, 2)), np.ones((n, 2))
    for k in range(n):
        a[k] = (p0 if k == 0 else a[k - 1] @ t) * [1, w[k]]
        a[k] /= a[k].sum()
    for k in range(n - 2, -1, -1):
        b[k] = t @ (b[k + 1] * [1, w[k + 1]])
        b[k] /= b[k].sum()
    return (a * b)[:, 1] / (a * b).sum(1)


@pytest.mark.parametrize("stay", [(0.99, 0.98), (0.9, 0.4)])
def test_passes_are_exact_across_blocks(stay):
    """Chains with a long memory, over texts of many sizes; equal texts get equal values wherever they stand."""
    rng = np.random.default_rng(1)
    trans, start = np.log([[stay[0], 1 - stay[0]], [1 - stay[1], stay[1]]]), np.log([0.9, 0.1])
    same = rng.normal(size=5 * toxicity.BLOCK + 7)
    parts = [same, *(rng.normal(size=k) * 3 for k in (1, 2, toxicity.BLOCK, toxicity.BLOCK + 1, 3_000, 17)), same]
    p = toxicity.marginals(np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts]), trans, start)
    cut = np.cumsum([0, *map(len, parts)])
    for k, x in enumerate(parts):
        assert np.abs(p[cut[k] : cut[k + 1]] - naive_marginals(x, trans, start)).max() < 1e-12
    assert (p[: len(same)] == p[-len(same) :]).all()


def test_scores_and_spans_follow_the_marginals():
    """tag against a loop over documents and tokens."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["bad", "good", "été", "worse", "fine", "x"], k)) for k in (0, 1, 5, 400)] + [None, "!?", "bad-bad good"]
    model = {"w": np.zeros(toxicity.TABLE, np.float32), "trans": np.log([[0.8, 0.2], [0.3, 0.7]]), "start": np.log([0.7, 0.3]), "doc": np.array([1.5, 0.7, -2.0])}
    model["w"][1:] = rng.normal(size=toxicity.TABLE - 1)
    scores, found = toxicity.tag(pa.array(texts), model)
    for text, got, spans in zip(texts, scores, found, strict=True):
        raw = (text or "").encode()
        s, e, _, f = toxicity.features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        p = naive_marginals(sum(model["w"][k].astype(float) for k in f), model["trans"], model["start"]) if len(s) else np.zeros(0)
        top, total = max([x for x in p if x > 0.001], default=0.0), p.sum()
        assert abs(got - 1 / (1 + math.exp(-(1.5 * top + 0.7 * math.log1p(total) - 2.0)))) < 1e-9
        want = []
        for k in range(len(s)):
            if p[k] >= toxicity.SPAN_AT:
                at = [len(raw[: x[k]].decode()) for x in (s, e)]
                if want and k and p[k - 1] >= toxicity.SPAN_AT:
                    want[-1][1] = at[1]
                else:
                    want.append(at)
        assert [[x["start"], x["end"]] for x in spans] == want


def test_a_fit_reads_no_more_than_its_bound(toxic, monkeypatch):
    docs, labels, _ = toxic
    whole = toxicity.sample(docs, labels)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 5_000)
    some = toxicity.sample(docs, labels)
    assert 0 < some["text"].str.len().sum() <= 5_000 < whole["text"].str.len().sum()


def test_a_fit_runs_in_a_task(toxic, monkeypatch):
    docs, labels, _ = toxic
    rows = toxicity.sample(docs, labels)
    want = toxicity.fit(rows["text"].tolist(), rows["toxic"].to_numpy())
    monkeypatch.setattr(toxicity, "fit", lambda *_: pytest.fail("the driver fits"))
    got = toxicity.trained(docs, labels)
    assert set(got) == set(want) and want["w"].any() and all(np.allclose(got[k], want[k], rtol=1e-6, atol=1e-9) for k in want)


@pytest.fixture(scope="module")
def toxic(spark):
    rng = np.random.default_rng(2)
    clean, bad = [f"word{i}" for i in range(300)], ["blargh", "zonkish", "fribbit"]
    rows, labels = [], []
    for i in range(400):
        w = list(rng.choice(clean, 40))
        y = i % 4 == 0
        if y:
            for k in rng.choice(40, 3, replace=False):
                w[k] = rng.choice(bad)
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, int(y)))
    rows += [(400, None, None, None, None), (401, "", "en", "s", 0), (402, "é blargh.", "en", "s", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_toxicity_holds_out(toxic, tmp_path, spark):
    docs, labels, truth = toxic
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = table(toxicity.op2_toxicity(spark, str(tmp_path)), "doc_id", "held_out", "score", "predicted")
    assert len(got) == 403 and all(h == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= s <= 1 and p == (s >= 0.5) for i, (h, s, p) in got.items())
    held = [i for i, (h, _, _) in got.items() if h and i in truth]
    assert np.mean([got[i][2] == truth[i] for i in held]) > 0.97 and got[400][2] == got[401][2] == 0
    model = toxicity.trained(docs, labels)
    spans = toxicity.score(docs, model).filter("doc_id = 402").first().toxic_spans
    assert [(s.start, s.end) for s in spans] == [(2, 8)]
    assert toxicity.score(docs.limit(0), model).count() == 0
    empty = toxicity.trained(docs, labels.limit(0))
    assert toxicity.score(docs, empty).filter("toxicity > 0.01").count() == 0


# --- 4 ---


def test_pieces_decode_to_the_text(docs, none):
    coded = subword.encode_texts(docs)
    back = table(subword.decode_texts(coded), "doc_id", "decoded")
    assert back == {r.doc_id: (r.text or "",) for r in docs.collect()}
    again = table(subword.encode_texts(docs.repartition(7)), "doc_id", "pieces")
    assert again == table(coded, "doc_id", "pieces")
    assert subword.encode_texts(none).count() == 0


def test_sampling_follows_the_lattice():
    """Draws for one word have the frequencies of its segmentations, found by enumeration."""
    p = subword.Pieces()
    word = b" the"
    ids = {t: (i, w) for i, (t, w) in enumerate(zip(p.text, p.weight, strict=True)) if t and (b" " not in t[1:])}
    for i in p.byte_id:
        ids.setdefault(p.text[i], (int(i), p.weight[i]))

    def cuts(rest):
        if not rest:
            yield (), 0.0
        for k in range(1, len(rest) + 1):
            options = {i for t, (i, _) in ids.items() if t == rest[:k]} | ({int(p.byte_id[rest[0]])} if k == 1 else set())
            for i in options:
                for tail, w in cuts(rest[k:]):
                    yield (i, *tail), w + p.weight[i]

    all_ = dict(cuts(word))
    z = sum(math.exp(w) for w in all_.values())
    n = 20_000
    text = np.frombuffer(word, np.uint8)
    lattice = subword.Lattices(p, text, np.array([0]), np.array([4]))
    which, pieces = lattice.sample(np.repeat(lattice.ends, n), subword.mix(np.arange(n, dtype=np.uint64)))
    count = defaultdict(int)
    begin = np.searchsorted(which, np.arange(n + 1))
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        count[tuple(int(x) for x in pieces[a:b])] += 1
    assert set(count) <= set(all_)
    assert all(abs(count[s] / n - math.exp(w) / z) < 0.015 for s, w in all_.items())


@pytest.mark.parametrize("text", ["a▁b", "a  b\n\nc\t", "\U0001f600é", "", "x" * 3000, " ", "▁"])
def test_odd_texts_round_trip(text):
    p = subword._of(subword.MODEL)
    data, off = subword.text_buffers(pa.array([text, None, text]))
    piece, poff = subword.encode(np.array([1, 2, 1]), data, off, p)
    back, boff = subword.decode(piece, poff, p)
    assert back.tobytes().decode() == text * 2 and list(boff) == list(off) and list(piece[: poff[1]]) == list(piece[poff[2] :])


def test_result_names_are_replaced(spark, toxic):
    docs, labels, _ = toxic
    some = docs.limit(5)
    model = toxicity.trained(docs, labels)
    plain = table(toxicity.score(some, model), "doc_id", "toxicity")
    odd = some.withColumn("Toxicity", F.lit("x")).withColumn("toxic_spans", F.lit(1)).withColumn("row", F.lit(2))
    got = toxicity.score(odd, model)
    assert got.columns == [*some.columns, "row", "toxicity", "toxic_spans"] and table(got, "doc_id", "toxicity") == plain
    coded = subword.encode_texts(some.withColumn("pieces", F.lit("x")))
    assert coded.columns == [*some.columns, "pieces"]
    back = subword.decode_texts(coded.withColumn("decoded", F.lit(3)))
    assert table(back, "doc_id", "decoded") == {r.doc_id: (r.text or "",) for r in some.collect()}
    page = spark.createDataFrame([(1, "<article><p>Some text here.</article>", "x")], "page_id long, html string, main_text string")
    assert pages.extract(page).columns == ["page_id", "html", "main_text"] and pages.extract(page).first().main_text == "Some text here."


# --- 6 ---

PAGES = [
    (None, ""), ("", ""), ("<p>alone text only", "alone text only"),
    ("<body><nav><ul><li><a href=x>Home</a></ul></nav><article><h1>T &amp; U</h1><p>One\n two<br>three &eacute;. And more text, to be sure.<p>Four five, six seven.</article><footer>&copy; x</footer>", "T & U\nOne two three é. And more text, to be sure.\nFour five, six seven."),
    ("<div class=header>Top</div><div class='content'><h1>T</h1><p>Main text of the story, long enough.</p><script>var x='</p>';</script><div class='comments'><div class=comment><p>I like it.</p></div></div></div><div class=footer>foot</div>", "T\nMain text of the story, long enough."),
    ("<main><p>Hello world, this is it.</p><form><p>Sub</p><input></form></main><aside>x</aside>", "Hello world, this is it."),
]


def test_pages(spark):
    df = spark.createDataFrame([(i, h, "k") for i, (h, _) in enumerate(PAGES)], "page_id long, html string, url string")
    got = pages.extract(df)
    assert got.columns == ["page_id", "html", "url", "main_text"] and table(got, "page_id", "main_text") == {i: (t,) for i, (_, t) in enumerate(PAGES)}
    assert pages.extract(df.limit(0)).count() == 0


def test_trees_hold_on_new_pages():
    rng = np.random.default_rng(99)
    right = total = 0
    for _ in range(40):
        nodes = pages.nodes_of(pages.parse(pages.training_page(rng)))
        x, parent = pages.features(nodes, pages.model().buckets)
        kept = pages.decode(pages.model().log_odds(x), parent)
        text = np.array([bool(n.text) for n in nodes])
        right += int((kept == pages._labels(nodes).astype(bool))[text].sum())
        total += int(text.sum())
        assert all(kept[parent[i]] for i in range(1, len(nodes)) if kept[i])
    assert right / total > 0.95


def test_what_follows_an_unclosed_script_is_no_text():
    text = lambda page: pages.main_texts([page], pages.model())[0]
    head = "<article><h1>T</h1><p>Some text of the story, long enough.</p><p>More of it, here.</p>"
    want = "T\nSome text of the story, long enough.\nMore of it, here."
    assert text(head + "<script>var a=1; more();</article>") == want
    assert text(head + "<style>p {} </article><p>x") == want
    assert text(head + "<script>a</script ></article>") == text(head + "<SCRIPT x='y'>a</SCRIPT\n></article>") == want
    assert text("<button>" * 50_000 + head) == want  # no search to the end of the page for each of them


def test_the_likeliest_consistent_labelling():
    """Decoding against all labellings in which a kept node's parent is kept."""
    rng = np.random.default_rng(4)
    for _ in range(20):
        parent = np.array([-1, *(rng.integers(0, k) for k in range(1, 9))])
        odds = rng.normal(size=9) * 2
        best = max((m for m in range(1, 512, 2) if all(not m >> k & 1 or m >> parent[k] & 1 for k in range(1, 9))), key=lambda m: sum(-np.logaddexp(0, -odds[k] if m >> k & 1 else odds[k]) for k in range(9)))
        assert [bool(best >> k & 1) for k in range(9)] == pages.decode(odds, parent).tolist()


# --- 7 ---


def test_media_round_trip(docs, none, spark):
    rows = media.to_media(docs).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in rows:
        raw = texts[r.id]
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert r.n_bytes == len(raw) and media.samples(bytes(r.media)) == payload and r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
    by_text = defaultdict(set)
    for r in rows:
        by_text[texts[r.id]].add((bytes(r.log_mel), str(r.segments)))
    assert all(len(v) == 1 for v in by_text.values()) and media.to_media(none).count() == 0
    blocks = media.tensors(media.to_media(docs).select("id", "log_mel").toArrow())
    assert blocks.schema.field("log_mel").type.shape == [media.FRAMES, media.MELS]
    assert len(blocks) == sum(-(-r.payload_bytes // (192 * media.FRAMES)) for r in rows)


def test_media_digests_are_of_what_is_stored(docs, saved, spark):
    stored = {r.id: r for r in media.to_media(docs).collect()}
    for r in media.op7_media(spark, saved).collect():
        m = stored[r.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (m.n_bytes, m.payload_bytes, m.payload_sha256, m.tail_crc32)
        assert (r.media_bytes, r.media_sha256) == (len(m.media), hashlib.sha256(m.media).hexdigest())
        end, n, loud, digest = r.feature.split(":")
        blocks = media.from_stream(bytes(m.log_mel))
        assert float(end) == m.payload_bytes / media.RATE_IN and int(n) == len(m.segments)
        assert abs(float(loud) - sum(x.end_s - x.start_s for x in m.segments)) < 1e-6 and digest == hashlib.sha256(media.bands(blocks).tobytes()).hexdigest()


def test_features_equal_plain_sums():
    """Resampling, window, Fourier sums, bands and hysteresis as loops over one payload."""
    rng = np.random.default_rng(6)
    raw = rng.integers(0, 256, media.UNIT * 9).astype(np.uint8)
    raw[media.UNIT * 3 : media.UNIT * 6] = 128 + raw[media.UNIT * 3 : media.UNIT * 6] // 64
    x = (raw.astype(float) - 128) / 128
    half, ratio = media.REACH, media.UNIT / media.OUT
    y = np.zeros(9 * media.OUT)
    for k in range(len(y)):
        unit, within = divmod(k, media.OUT)
        at = [(unit * media.UNIT + j, j - within * ratio) for j in range(-half, media.UNIT + half)]
        taps = [np.sinc(t / ratio) * (0.5 + 0.5 * math.cos(math.pi * t / half)) if abs(t) < half else 0.0 for _, t in at]
        y[k] = sum(c * x[i] for c, (i, _) in zip(taps, at, strict=True) if 0 <= i < len(x)) / sum(taps)
    y = np.append(y, np.zeros(media.OUT))
    mel, energy = [], []
    for u in range(9):
        f = y[u * media.OUT : (u + 2) * media.OUT]
        n = len(f)
        bins = [abs(sum(f[i] * (0.5 - 0.5 * math.cos(2 * math.pi * i / (n - 1))) * np.exp(-2j * math.pi * b * i / n) for i in range(n))) ** 2 for b in range(n // 2 + 1)]
        mel.append([round(100 * math.log10(sum(p * media._MEL[b, m] for b, p in enumerate(bins)) + 1e-6)) for m in range(media.MELS)])
        energy.append(round(1000 * math.log10((f**2).sum() + 1e-6)))
    mean, sd, on, loud = np.mean(energy), np.std(energy), False, []
    for e in energy:
        on = True if e > mean + media.UPPER * sd else False if e < mean + media.LOWER * sd else on
        loud.append(on)
    got = media.features(raw, np.array([0, 9]))
    assert np.abs(got[0] - np.array(mel)).max() <= 1 and got[1].tolist() == loud and 0 < sum(loud) < 9


def test_runs_of_units_leave_no_trace(monkeypatch):
    rng = np.random.default_rng(5)
    units = np.array([0, 1, 4, 30, 47])
    raw = rng.integers(0, 256, media.UNIT * 47).astype(np.uint8)
    whole = media.features(raw, units)
    monkeypatch.setattr(media, "RUN", 3)
    assert all((a == b).all() for a, b in zip(whole, media.features(raw, units), strict=True))


def test_tone_lands_in_its_band():
    t = np.arange(media.UNIT * 20) / media.RATE_IN
    raw = (128 + 100 * np.sin(2 * np.pi * 1000 * t)).astype(np.uint8)
    mel, _, _ = media.features(raw, np.array([0, 20]))
    band = int(mel[5:15].mean(0).argmax())
    f = np.arange(media.OUT + 1) * media.RATE_OUT / (2 * media.OUT)
    assert abs((media._MEL[:, band] * f).sum() / media._MEL[:, band].sum() - 1000) < 120
    loud = np.concatenate((np.full(media.UNIT * 10, 128, np.uint8), raw, np.full(media.UNIT * 10, 128, np.uint8)))
    spans = media.segments(media.features(loud, np.array([0, 40]))[1])
    assert len(spans) == 1 and abs(spans[0][0] - 0.08) < 0.02 and abs(spans[0][1] - 0.24) < 0.02
