"""The jobs: growing input, reruns, broken rows, the command line, and results against brute force."""

import datetime as dt
import hashlib
import json
import logging
import math
import os
import random
import subprocess
import sys
from collections import Counter, defaultdict

import pytest
from helpers import rows
from pyspark.sql import functions as F

from jobs import common, readings, register

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
DAY = dt.datetime(2024, 1, 1)


def events(seed, n, first=0):
    r = random.Random(seed)
    return [(first + i, DAY + dt.timedelta(hours=r.randrange(96)), 7 if i % 3 else r.randrange(5), r.choice(["view", "click", "signup", "purchase"]), round(r.uniform(0, 120), 2), "x") for i in range(n)]


def arrive(spark, data, folder, schema=EVENTS):
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(folder)


def brute(config, batches):
    """Decisions and dispositions in plain Python."""
    kinds, seen, sums = config["kinds"], set(), defaultdict(lambda: [0, 0.0])
    for batch in batches:
        best = {}
        for e, t, u, k, v, _ in batch:
            if None in (e, t, u, k, v) or k not in kinds or not math.isfinite(v):
                continue
            best[e, t] = min(best.get((e, t), (u, k, v)), (u, k, v))
        for key, (u, k, v) in best.items():
            if key not in seen:
                seen.add(key)
                sums[u, k][0] += 1
                sums[u, k][1] += round(kinds[k]["scale"] * v + kinds[k]["offset"], 6)
    decided, cases = {}, defaultdict(Counter)
    for (u, k), (n, s) in sums.items():
        c = kinds[k]
        precision = 1 / c["prior_variance"] + n / c["noise"]
        mean = (c["prior_mean"] / c["prior_variance"] + s / c["noise"]) / precision
        p = 0.5 * math.erfc((c["least"] - mean) * math.sqrt(precision) / math.sqrt(2))
        verdict = "SATISFIED" if p >= config["confidence"] else "VIOLATED" if 1 - p >= config["confidence"] else "UNRESOLVED"
        decided[u, k] = (n, round(mean, 6), round(p, 6), verdict)
        cases[u][verdict] += 1
        cases[u]["short"] += n < config["readings_needed"]
    return decided, {u: "REJECT" if c["VIOLATED"] else "REQUEST_EVIDENCE" if c["UNRESOLVED"] or c["short"] else "ACCEPT" for u, c in cases.items()}


def whole(tables):
    return {k: [str(x) for x in rows(df)] for k, df in tables.items()}  # text, as NaN differs from itself


def told(spark, output):
    t = readings.tables_of(spark, output)
    return {(r.asset, r.kind): (r.n, round(r["mean"], 6), round(r.p, 6), r.verdict) for r in t["decisions"].collect()}, {r.asset: r.disposition for r in t["dispositions"].collect()}


def test_readings_over_growing_input(spark, tmp_path, caplog):
    config = common.defaults("readings")
    source, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    first = events(1, 300)
    arrive(spark, first, source)
    with caplog.at_level(logging.INFO, "jobs.readings"):
        counts = readings.run(spark, source, out, mark)
    assert "read 300 rows, wrote 300 readings and refused 0" in caplog.text and counts["readings"] == 300
    assert told(spark, out) == brute(config, [first])
    # the second file brings readings again, twice one new reading, unusable rows and new ones
    t = first[0][1]
    odd = [(None, t, 1, "view", 1.0, None), (9000, None, 1, "view", 1.0, None), (9001, t, None, "view", 1.0, None), (9002, t, 1, None, 1.0, None), (9003, t, 1, "error", 1.0, None), (9004, t, 1, "view", None, None), (9005, t, 1, "view", math.inf, None), (9006, t, 1, "view", math.nan, None)]
    second = first[:40] + events(2, 200, 1000) + [(9100, t, 2, "view", 5.0, None), (9100, t, 1, "view", 9.0, None)] + odd
    arrive(spark, second, source)
    caplog.clear()
    with caplog.at_level(logging.INFO, "jobs.readings"):
        readings.run(spark, source, out, mark)
    assert "batch 1: read 250 rows, wrote 201 readings and refused 49" in caplog.text
    assert told(spark, out) == brute(config, [first, second])
    t = readings.tables_of(spark, out)
    reasons = dict(rows(t["refusals"].groupBy("reason").agg(F.sum("copies"))))
    assert reasons == {"repeated": 41, "no reading id": 1, "no time": 1, "no asset": 1, "unknown kind": 2, "no value": 1, "value not finite": 2}
    assert {os.path.basename(p)[:4] for p in os.listdir(f"{out}/readings/batch=1")} >= {"day="}
    # nothing new: nothing changes
    before = whole(t)
    readings.run(spark, source, out, mark)
    assert whole(readings.tables_of(spark, out)) == before
    # a batch that is run again after a failure writes the same
    batch = common.columns(spark.createDataFrame(second, EVENTS), config["columns"])
    readings.take(batch, 1, out, config)
    readings.settle(spark, out, config)
    assert whole(readings.tables_of(spark, out)) == before
    # a checkpoint that doesn't belong to the tables is refused
    with pytest.raises(Exception, match="another checkpoint"):
        readings.run(spark, source, out, str(tmp_path / "other"))


def test_readings_from_other_formats_and_nothing(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(events(3, 50), EVENTS).withColumnRenamed("event_id", "id").write.json(source)
    config = common.defaults("readings") | {"format": "json"}
    with pytest.raises(ValueError, match="lacks"):
        readings.run(spark, source, out, str(tmp_path / "mark"), config)
    config["columns"] = config["columns"] | {"reading": "id"}
    assert readings.run(spark, source, out, str(tmp_path / "mark"), config)["readings"] == 50
    spark.createDataFrame([], EVENTS).write.parquet(str(tmp_path / "none"))
    counts = readings.run(spark, str(tmp_path / "none"), str(tmp_path / "out2"), str(tmp_path / "mark2"))
    assert set(counts.values()) == {0}


DOCS = "doc_id long, text string, lang string, source string, extra map<string,string>"


def documents(n=400):
    r = random.Random(5)
    out = [(i, f"text {r.random()}", r.choice(["en", None]), "hot" if i % 3 else r.choice(["a", " b ", None, "", "a\x1fb", "7"]), None) for i in range(n)]
    return out + out[:5] + [(3, "other", "en", "hot", None), (None, "x", "en", "a", None), (9000, None, "en", "a", None), (9001, " \t\n", "en", None, None), (9001, " \t\n", "en", None, {"a": "b"})]


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def tree(leaves):
    level = sorted(set(leaves))
    while len(level) > 1:
        level += level[-1:] * (len(level) % 2)
        level = [sha(bytes.fromhex(a) + bytes.fromhex(b)) for a, b in zip(level[::2], level[1::2], strict=True)]
    return level[0]


def test_register_equals_brute_force(spark, tmp_path, caplog):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(documents(), DOCS).repartition(3).write.parquet(source)
    config = common.defaults("register") | {"prove": [1, 8, 12]}
    with caplog.at_level(logging.INFO, "jobs.register"):
        counts = register.run(spark, source, out, config)
    assert f"{counts['register']} register" in caplog.text and str(source) in caplog.text
    by_id, refused = defaultdict(Counter), Counter()
    for i, text, lang, src, _ in documents():
        src = "".join(" " if ord(c) < 32 or ord(c) == 127 else c for c in src or "").strip(" ") or "unknown"
        if i is None or text is None or not text.strip(" \t\n\x0b\x0c\r"):
            refused[i, src, "no id" if i is None else "no text"] += 1
        else:
            by_id[i]["|".join((str(i), lang or "", src, sha(text))), src] += 1
    found = defaultdict(lambda: defaultdict(list))
    for i, seen in by_id.items():
        (line, src), n = min(((k, n) for k, n in seen.items()), key=lambda x: sha(x[0][0]))
        if len(seen) > 1:
            refused[i, src, "conflict"] += seen.total()
        else:
            found[src][sha(line)[:2]].append(sha(line))
            assert n == (2 if i < 5 else 1)
    t = register.tables_of(spark, out)
    assert {(r.id, r.source, r.reason): r.copies for r in t["refusals"].collect()} == refused
    assert sorted(r.digest for r in t["register"].collect()) == sorted(d for b in found.values() for x in b.values() for d in x)
    want = {("bucket", s, b): tree(x) for s, bs in found.items() for b, x in bs.items()}
    want |= {("source", s, None): tree([want["bucket", s, b] for b in bs]) for s, bs in found.items()}
    want["all", None, None] = tree([want["source", s, None] for s in found])
    assert {(r.level, r.source, r.bucket): r.root for r in t["roots"].collect()} == want
    shown = t["proofs"].collect()
    assert {r.id for r in shown} == {1, 8, 12} and all(r.valid for r in shown)
    for r in shown:
        node = r.digest
        for step in r.path:
            a, b = (step.hash, node) if step.left else (node, step.hash)
            node = sha(bytes.fromhex(a) + bytes.fromhex(b))
        assert node == r.root == want["source", r.source, None]
    before = whole(t)
    register.run(spark, source, out, config)
    assert whole(register.tables_of(spark, out)) == before
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "none"))
    assert set(register.run(spark, str(tmp_path / "none"), out).values()) == {0}


def test_config_files(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"confidence": 0.9}))
    assert common.config(spark, "readings", str(path))["confidence"] == 0.9
    path.write_text(json.dumps({"confidense": 0.9}))
    with pytest.raises(ValueError, match="confidense"):
        common.config(spark, "readings", str(path))


@pytest.mark.parametrize("name", ["readings", "register"])
def test_command_line(spark, tmp_path, name):
    source = str(tmp_path / "in")
    if name == "readings":
        arrive(spark, events(4, 30), source)
    else:
        spark.createDataFrame(documents(20), DOCS).write.parquet(source)
    args = ["--input", source, "--output", str(tmp_path / "out")] + (["--checkpoint", str(tmp_path / "mark")] if name == "readings" else [])
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.driver.bindAddress=127.0.0.1 --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    env = {k: v for k, v in env.items() if not k.startswith(("PYSPARK_GATEWAY", "SPARK_ENV"))}
    done = subprocess.run([sys.executable, f"{ROOT}/jobs/{name}.py", *args], capture_output=True, text=True, timeout=300, env=env, cwd=str(tmp_path))
    assert done.returncode == 0, done.stderr[-2000:]
    assert f"jobs.{name}" in done.stderr
    made = (readings if name == "readings" else register).tables_of(spark, str(tmp_path / "out"))
    assert made["readings" if name == "readings" else "register"].count() in (30, 18, 19)
