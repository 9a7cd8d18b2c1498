"""Phrases and languages against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import collocation, langid

SCHEMA = "lang string, text string, a long, phrase string, f string"


def texts(seed=3, n=160):
    """Rows with a hot first word, phrases that hold others, odd characters, nulls and one very long text."""
    r = random.Random(seed)
    words = ["the", "a", "New", "york", "city", "été", "x\x01", "x", "-", "#", "hall\x00", "of"]
    out = []
    for i in range(n):
        w = []
        for _ in range(r.randrange(0, 40)):
            w.append(r.choice(["New York City Hall", "new york", "the", "the the", r.choice(words), r.choice(words)]))
        out.append((r.choice(["en", "en", "fr", None]), r.choice([" ", "\t", "  "]).join(w).replace("city", r.choice(["city", "city,", "city\n"])), i, None, "f"))
    return out + [("en", None, 0, None, None), ("en", "", 0, None, None), ("de", " .,; ", 0, None, None), ("fr", "the " * 5_000 + "end", 0, None, None)]


def brute(rows, least=30, cover=80, top=2_000):
    f, n = Counter(), Counter()
    for lang, text, *_ in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    found = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
            found[lang, p] = (min(cuts), a)
    for (lang, p), (_, a) in list(found.items()):
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                key = lang, p[i : i + m]
                if key in found and 100 * a >= cover * f[key]:
                    del found[key]
    out = []
    for lang in n:
        mine = sorted((-s, -a, " ".join(p).encode(), k, p) for (g, p), ((s, k), a) in found.items() if g == lang)
        out += [(lang, i + 1, " ".join(p), -a, f[lang, p[:k]], f[lang, p[k:]], n[lang], -s) for i, (s, a, _, k, p) in enumerate(mine[:top])]
    return sorted(out)


@pytest.mark.parametrize("part,gather", [(1 << 17, 1 << 18), (50, 64), (1 << 17, 64)])
def test_phrases_equal_brute_force(spark, monkeypatch, part, gather):
    # small parts split hot first words; small gathers cut texts and count words in parts
    monkeypatch.setattr(collocation, "PART_WORDS", part)
    monkeypatch.setattr(collocation, "HOT_SHARE", 20)
    rows = texts()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    small = (lambda run: run) if gather > 64 else (lambda run: lambda batches: (setattr(collocation, "GATHER", gather), setattr(collocation, "TOGETHER", gather), run(batches))[2])
    for name in ("suffixes", "count_prefixes"):
        made = getattr(collocation, name)
        monkeypatch.setattr(collocation, name, lambda *a, made=made, **k: small(made(*a, **k)))
    phrases, sizes = collocation.phrase_counts(docs)
    got = sorted(tuple(r) for r in collocation.ranked(collocation.collocations(phrases), sizes).collect())
    assert len(got) > 20 and got == brute(rows)


def test_phrases_of_nothing(spark):
    phrases, sizes = collocation.phrase_counts(spark.createDataFrame([], SCHEMA))
    assert collocation.ranked(collocation.collocations(phrases), sizes).count() == 0


def test_scores_pass_64_bits(spark):
    big = 9 * 10**18
    rows = [("en", "a", 1, big), ("en", "b", 1, big), ("en", "a b", 2, big)]
    found = collocation.collocations(spark.createDataFrame(rows, "lang string, phrase string, words int, f long")).collect()
    assert [tuple(r) for r in found] == [("en", "a b", big, big, big, 1_000_000)]


def test_rank_stops_at_the_top(spark):
    rows = [("en", f"p{i:05}", 40 + i % 3, 50, 50, i % 100) for i in range(3_000)]
    df = spark.createDataFrame(rows, "lang string, phrase string, a long, l long, r long, score long")
    sizes = spark.createDataFrame([("en", 9)], "lang string, n long")
    got = [r.phrase for r in sorted(collocation.ranked(df, sizes, 100).collect(), key=lambda r: r["rank"])]
    assert got == [r[1] for r in sorted(rows, key=lambda r: (-r[5], -r[2], r[1]))[:100]]


# --- languages ------------------------------------------------------------------------------------------------------

STEMS = {"xx": ["kla", "mor", "tenu", "ish"], "yy": ["ção", "ndo", "eira", "los"], "zz": ["ско", "ние", "пра", "ать"]}


def spoken(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = r.choice(list(STEMS))
        out.append((i, " ".join("".join(r.choice(STEMS[lang]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(1, 60))), lang))
    return out


def grams(text):
    """N-grams of one text, straight from the definition."""
    flat = "".join(c if ord(c) > 127 or c.isalpha() else " " for c in f" {text.lower()} ").encode()
    for size in langid.SIZES:
        for i in range(len(flat) - size + 1):
            g = flat[i : i + size]
            if 32 not in g[1:-1] and not (g[0] == 32 and g[-1] == 32):
                yield g


def test_scores_equal_sums_by_hand(monkeypatch):
    rng = np.random.default_rng(0)
    model = langid.Model(["a", "b", "c"], rng.normal(size=(langid.BUCKETS, langid.DIMENSIONS)), rng.normal(size=(langid.DIMENSIONS, 3)), rng.normal(size=3))
    found = [t for _, t, _ in spoken(1, 20)] + ["", "a", "Ünï-cødé 12x", "one " * 300]
    want = []
    for t in found:
        total, n = np.zeros(3), 0
        for g in grams(t):
            bucket = langid._grams(np.frombuffer(g, np.uint8), len(g))[0]
            total += model.table[bucket, :-1]
            n += 1
        want.append(total / langid.SCALE / max(n, 1) + model.bias)
    whole = model.logits(pa.array(found))
    assert np.allclose(whole, want, atol=1e-9)
    data, offsets = langid._flat(pa.array(found))
    cut = langid._sums(data, offsets, model.table, 37)  # in small runs: the same integers
    assert (cut == langid._sums(data, offsets, model.table, 1 << 20)).all()


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(1)
    e, w, b = rng.normal(size=(9, 4)), rng.normal(size=(4, 3)), rng.normal(size=3)
    size, y = np.array([3, 1, 4]), np.array([0, 2, 1])
    gram, share, begin = rng.integers(0, 9, 8), np.repeat(1 / size, size), np.array([0, 3, 4])

    def loss():
        mean = np.array([e[gram[i : i + k]].mean(0) for i, k in zip(begin, size, strict=True)])
        x = mean @ w + b
        return (np.log(np.exp(x).sum(1)) - x[np.arange(3), y]).sum()

    which, de, dw, db = langid.gradient(e, w, b, gram, share, begin, y)
    assert sorted(which) == sorted(set(gram.tolist()))
    for table, at, want in [(e, (which[0], 2), de[0, 2]), (e, (which[-1], 0), de[-1, 0]), (w, (1, 2), dw[1, 2]), (b, (1,), db[1])]:
        table[at] += 1e-6
        up = loss()
        table[at] -= 2e-6
        down = loss()
        table[at] += 1e-6
        assert abs((up - down) / 2e-6 - want) < 1e-5


def test_languages_of_held_out_texts(spark, monkeypatch):
    rows = spoken(2, 400) + [(400, None, "xx"), (401, "", "yy"), (402, "12 !?", "zz"), (None, "kla", "xx"), (403, "klamor " * 30_000, None), (404, "ção", "yy"), (404, "ção", "yy")]
    docs = spark.createDataFrame([(*r, "mine", 1) for r in rows], "doc_id long, text string, lang string, Lang_Pred string, `has letters` int").repartition(3)
    model = langid.trained(docs)
    out = langid.identify(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "has letters", "lang_pred", "lang_score", "lang_rejected"]
    got = out.withColumn("held_out", langid.held_out("doc_id")).collect()
    sure = [r.lang == r.lang_pred for r in got if r.held_out and r.lang and r.doc_id < 400]
    assert len(sure) > 80 and np.mean(sure) > 0.97
    odd = {r.doc_id: r for r in got if r.doc_id is None or r.doc_id >= 400}
    assert [odd[i].lang_pred for i in (400, 401, 402, 403, 404)] == ["und", "und", "und", "xx", "yy"] and odd[400].lang_score == 0.0
    assert all(0 <= r.lang_score <= 1 for r in got) and sum(r.lang_rejected for r in got) < 60
    again = {(r.doc_id, r.text): r.lang_score for r in langid.identify(docs.repartition(5), langid.trained(docs.repartition(2))).collect()}
    assert again == {(r.doc_id, r.text): r.lang_score for r in got}


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.trained(none) is None and langid.identify(none, None).count() == 0
    one = spark.createDataFrame([(1, "text", None)], none.schema)
    assert langid.identify(one, langid.trained(one)).first().lang_pred == "und"
    assert one.filter(F.lit(False)).count() == 0
