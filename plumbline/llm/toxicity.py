"""Toxic spans by a linear-chain conditional random field.

Labels are given per document, so tokens of the training documents are labelled first: of the affixes (whole token and
leading letters) those that occur in toxic documents far more often than elsewhere mark the tokens of toxic documents
that have them; all other tokens are clean. The field has two states, a score per affix and token shape for the toxic
state, and transition scores; it is trained by gradient ascent on the conditional likelihood, with marginals from
forward-backward. A document's score is a logistic function, fitted on the same sample, of its most toxic marginal and of
the sum of its marginals; offending spans are runs of tokens with a marginal of at least SPAN_AT.

The fit reads at most SAMPLE toxic and twice as many other documents, the first in order of a hash, with their whole texts
(of equal texts one), and no more than half of SAMPLE_BYTES of either label; it runs in one task on an executor, and the
driver gets the model alone, a table of fixed size. Scoring covers every token of every text, with exact forward and
backward passes.

Cases: null and empty texts have no tokens and get the score of an all-clean document; repeated rows get equal scores;
several label rows of a document count one by one; without labelled rows of both kinds every score is 0; an empty table
gives an empty table; columns named toxicity or toxic_spans are replaced, other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import lean, mix, others, slices, spans, text_buffers, word_hashes

if TYPE_CHECKING:
    import pandas as pd

#: Toxic documents that the fit reads at most; of others it reads twice as many.
SAMPLE = 1_000
#: Bytes of text that the fit reads at most.
SAMPLE_BYTES = 64 << 20
TABLE = 1 << 18
#: Leading letters (bytes) that are features; 0 is the whole token.
AFFIXES = (0, 3, 4, 5, 6, 7, 8)
#: An affix marks tokens if so many toxic documents have it and its share among toxic ones is so many times that elsewhere.
SUPPORT, RATIO = 6, 20.0
#: Tokens of a document that one block of the forward and backward passes holds.
BLOCK = 128
#: Tokens of the sample that one pass of the fit handles together.
CHUNK = 200_000
SPAN_AT = 0.5
STEPS, RATE, DECAY = 40, 0.35, 1e-4

MODEL = pa.schema([("w", pa.binary()), ("trans", pa.list_(pa.float64())), ("start", pa.list_(pa.float64())), ("doc", pa.list_(pa.float64()))])
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))

_BREAK = np.ones(256, bool)
_BREAK[48:58] = _BREAK[65:91] = _BREAK[97:123] = False
_BREAK[128:] = False
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each token, and its feature numbers (one row per affix, 0 where the token is too short)."""
    s, e, row = spans(data, offsets, _BREAK)
    cols = []
    for k in AFFIXES:
        end = e if k == 0 else np.minimum(e, s + k)
        h = mix(word_hashes(data, s, end, lower=True) + np.uint64(k))
        f = ((h >> np.uint64(46)) % np.uint64(TABLE - 1) + np.uint64(1)).astype(np.int32)
        cols.append(f if k == 0 else np.where(e - s > k, f, np.int32(0)))
    return s, e, row, np.stack(cols)


def _emit(w: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Each token's score: the sum of its features' weights."""
    out = np.zeros(f.shape[1])
    for row in f:
        out += w[row]
    return out


def marginals(emit: np.ndarray, row: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = False):
    """P(toxic) of each token; with ``pairs`` also the expected number of each transition and of each start state.

    ``emit`` is the toxic state's score over the clean one's, ``trans`` (2, 2) and ``start`` (2,) are scores. A document's
    tokens fall into blocks counted from its first token; all blocks are worked through side by side. Each block's
    product of transfer matrices, carried along the document, gives the state in which the next block starts, so that
    the passes are exact, and equal documents get equal values wherever they stand.
    """
    n = len(emit)
    if not n:
        return (np.zeros(0), np.zeros((2, 2)), np.zeros(2)) if pairs else np.zeros(0)
    first = np.ones(n, bool)
    first[1:] = row[1:] != row[:-1]
    begin = np.flatnonzero(first)
    length = np.diff(np.append(begin, n))
    w, t, p0 = np.exp(np.clip(emit, -30, 30)), np.exp(trans - trans.max()), np.exp(start - start.max())
    # blocks in order of their sizes, so that those with a k-th token are the first ``active[k]``
    blocks = -(-length // BLOCK)
    base = np.concatenate(([0], np.cumsum(blocks)))[:-1]  # of each document's first block
    doc = np.repeat(np.arange(len(begin)), blocks)
    within = np.arange(len(doc)) - base[doc]
    size = np.minimum(BLOCK, length[doc] - within * BLOCK)
    order = np.argsort(-size, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    active = np.searchsorted(-size[order], -np.arange(size.max()), "left")
    token = np.arange(n) - np.repeat(begin, length)
    at = (token % BLOCK, place[np.repeat(base, length) + token // BLOCK])
    m, depth = len(doc), int(size.max())
    wk = np.ones((depth, m))
    wk[at] = w
    opens = (within == 0)[order]
    # ratios of toxic to clean: r forward (with the token's own score), b backward (without it)
    enter, leave = np.full(m, p0[1] / p0[0]), np.ones(m)
    if blocks.max() > 1:
        # rows of the products: what clean and toxic before the block lead to at its last token
        x0, x1, y0, y1 = np.ones(m), np.zeros(m), np.zeros(m), np.ones(m)
        for k in range(depth):
            c = active[k]
            a0, a1, v = x0[:c].copy(), x1[:c].copy(), wk[k, :c]
            x0[:c], x1[:c] = a0 * t[0, 0] + a1 * t[1, 0], (a0 * t[0, 1] + a1 * t[1, 1]) * v
            a0, a1 = y0[:c].copy(), y1[:c].copy()
            y0[:c], y1[:c] = a0 * t[0, 0] + a1 * t[1, 0], (a0 * t[0, 1] + a1 * t[1, 1]) * v
            if k == 0:  # a document's first token comes from the start state, whatever stood before
                o = np.flatnonzero(opens[:c])
                x0[o] = y0[o] = p0[0]
                x1[o] = y1[o] = p0[1] * v[o]
            if k % 4 == 3:
                s = x0[:c] + x1[:c] + y0[:c] + y1[:c]
                x0[:c] /= s
                x1[:c] /= s
                y0[:c] /= s
                y1[:c] /= s
        with np.errstate(over="ignore"):
            for k in range(1, int(blocks.max())):
                j = np.flatnonzero(blocks > k)
                i, now = place[base[j] + k - 1], place[base[j] + k]
                q = 0.0 if k == 1 else enter[i]
                enter[now] = (x1[i] + q * y1[i]) / (x0[i] + q * y0[i])
            for k in range(int(blocks.max()) - 1, 0, -1):
                j = np.flatnonzero(blocks > k)
                i, now = place[base[j] + k], place[base[j] + k - 1]
                leave[now] = (y0[i] + y1[i] * leave[i]) / (x0[i] + x1[i] * leave[i])
    r, b = np.ones((depth, m)), np.ones((depth, m))
    cur = enter
    for k in range(depth):
        c = active[k]
        step = (t[0, 1] + cur[:c] * t[1, 1]) / (t[0, 0] + cur[:c] * t[1, 0])
        if k == 0:
            step = np.where(opens[:c], p0[1] / p0[0], step)
        cur = step * wk[k, :c]
        r[k, :c] = cur
    cur = leave
    for k in range(depth - 1, -1, -1):
        c = active[k]
        b[k, :c] = cur[:c]
        v = cur[:c] * wk[k, :c]
        cur[:c] = (t[1, 0] + t[1, 1] * v) / (t[0, 0] + t[0, 1] * v)
    r, b = r[at], b[at]
    odds = r * b
    p = odds / (1 + odds)
    if not pairs:
        return p
    prev = np.flatnonzero(~first)
    x, y = r[prev - 1], w[prev] * b[prev]
    joint = np.stack([np.full(len(prev), t[0, 0]), t[0, 1] * y, x * t[1, 0], x * t[1, 1] * y])
    joint = (joint / joint.sum(0)).sum(1).reshape(2, 2)
    return p, joint, np.array([(1 - p[first]).sum(), p[first].sum()])


def fit(texts: list[str | None] | pa.ChunkedArray, toxic: np.ndarray) -> dict:
    """The model from labelled texts: arrays of fixed size."""
    none = {"w": np.zeros(TABLE, np.float32), "trans": np.zeros((2, 2)), "start": np.zeros(2), "doc": np.array([0.0, 0.0, -30.0])}
    toxic = np.asarray(toxic, bool)
    if not toxic.any() or toxic.all():
        return none
    data, offsets = text_buffers(texts if isinstance(texts, pa.ChunkedArray) else pa.array([t or "" for t in texts]))
    rows, feats = [], []
    df = np.zeros((2, TABLE), np.int64)  # documents of each label with a feature
    for i, _, part, off in slices(data, offsets):
        _, _, row, f = features(part, off)
        rows.append(row + i)
        feats.append(f)
        seen = np.unique((row * TABLE + f).ravel())
        for k in (False, True):
            df[int(k)] += np.bincount(seen[toxic[seen // TABLE + i] == k] % TABLE, minlength=TABLE)
    # parts go as soon as they are copied, so that the features are held about once
    row, at = np.concatenate(rows), 0
    f = np.empty((len(AFFIXES), len(row)), np.int32)
    feats.reverse()
    while feats:
        part = feats.pop()
        f[:, at : at + part.shape[1]] = part
        at += part.shape[1]
    del rows
    share = (df[1] / toxic.sum()) / ((df[0] + 0.5) / (~toxic).sum())
    marks = (df[1] >= SUPPORT) & (share >= RATIO)
    marks[0] = False
    y = toxic[row].copy()
    some = np.zeros(len(row), bool)
    for k in f:
        some |= marks[k]
    y &= some
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    prev = np.flatnonzero(~first)
    seen_pairs = np.array([[(~y[prev - 1] & ~y[prev]).sum(), (~y[prev - 1] & y[prev]).sum()], [(y[prev - 1] & ~y[prev]).sum(), (y[prev - 1] & y[prev]).sum()]], float)
    seen_start = np.array([(~y[first]).sum(), y[first].sum()], float)
    used = np.flatnonzero(np.logical_or.reduce([np.bincount(k, minlength=TABLE) > 0 for k in f]))
    number = np.zeros(TABLE, np.int32)
    number[used] = np.arange(len(used))
    for k in range(len(f)):
        f[k] = number[f[k]]

    def count(v: np.ndarray) -> np.ndarray:
        return sum(np.bincount(k, v, len(used)) for k in f)

    seen_w, size = count(y.astype(float)), count(np.ones(len(row)))
    w, trans, start = np.zeros(len(used)), np.log((seen_pairs + 0.1) / (seen_pairs + 0.1).sum(1, keepdims=True)), np.log((seen_start + 0.1) / (seen_start.sum() + 0.2))
    # whole documents of about CHUNK tokens at a time
    cuts = np.unique(np.append(np.flatnonzero(first)[np.searchsorted(np.flatnonzero(first), np.arange(0, len(row), CHUNK)).clip(max=first.sum() - 1)], len(row)))

    def passes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [marginals(_emit(w, f[:, i:j]), row[i:j], trans, start, pairs=True) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        return np.concatenate([x[0] for x in parts]), sum(x[1] for x in parts), sum(x[2] for x in parts)

    step = RATE / np.sqrt(size / len(row) + 1e-4)
    velocity = np.zeros(len(used))
    for _ in range(STEPS):
        p, joint, begin = passes()
        grad = (seen_w - count(p)) / len(row) * 100 - DECAY * w
        grad[used == 0] = 0  # the feature of tokens that are too short for an affix
        velocity = 0.8 * velocity + step * grad
        w += np.clip(velocity, -1, 1)
        trans += 0.5 * (seen_pairs - joint) / len(row)
        start += 0.5 * (seen_start - begin) / len(toxic)
    model = {"w": np.zeros(TABLE, np.float32), "trans": trans, "start": start, "doc": None}
    model["w"][used] = w
    top, total = _gather(passes()[0], row, len(toxic))
    x = np.stack([top, np.log1p(total), np.ones(len(toxic))], 1)
    c = np.zeros(3)
    for _ in range(50):  # Newton's method with a small ridge
        q = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        c += np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(3), x.T @ (toxic - q) - 0.05 * c)
    model["doc"] = c
    return model


def _gather(p: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    top = np.zeros(n)
    np.maximum.at(top, row[p > 0.001], p[p > 0.001])
    return top, np.bincount(row, p, n)


def tag(texts: pa.Array, model: dict) -> tuple[np.ndarray, list[list[dict]]]:
    """Score of each text and its toxic spans (start and end in code points, score)."""
    data, offsets = text_buffers(texts)
    scores, found = [], []
    for i, j, part, off in slices(data, offsets):
        s, e, row, f = features(part, off)
        p = marginals(_emit(model["w"], f), row, model["trans"], model["start"])
        top, total = _gather(p, row, j - i)
        x = model["doc"][0] * top + model["doc"][1] * np.log1p(total) + model["doc"][2]
        scores.append(1 / (1 + np.exp(-np.clip(x, -30, 30))))
        out: list[list[dict]] = [[] for _ in range(j - i)]
        bad = np.flatnonzero(p >= SPAN_AT)
        if len(bad):
            # code points before a byte: bytes that don't continue a character
            chars = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
            joined = np.zeros(len(bad), bool)
            joined[1:] = (bad[1:] == bad[:-1] + 1) & (row[bad[1:]] == row[bad[:-1]])
            begin = np.flatnonzero(~joined)
            for a, b in zip(begin, np.append(begin[1:], len(bad)), strict=True):
                r = int(row[bad[a]])
                base = chars[off[r]]
                out[r].append({"start": int(chars[s[bad[a]]] - base), "end": int(chars[e[bad[b - 1]]] - base), "score": float(p[bad[a:b]].max())})
        found.extend(out)
    return np.concatenate(scores) if scores else np.zeros(0), found


def sampled(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, most_bytes: int | None = None) -> DataFrame:
    """Labelled texts (doc_id, text, toxic) for the fit: rows whose crc32(doc_id) leaves a remainder by 5, at most ``most`` toxic ones and twice as many others.

    Of equal texts with one label one stays. In order of a hash each label's texts are taken while they fit into half of
    ``most_bytes`` (SAMPLE_BYTES) together, whatever the other label takes; texts beyond a sixteenth of a half come after all others. Texts are
    fetched for those that are taken only.
    """
    train = labels.filter(F.col("toxic").isNotNull() & ~held_out("doc_id")).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    picked = [train.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most * (2 - k)) for k in (0, 1)]
    ids = picked[0].union(picked[1])
    texts = docs.select("doc_id", "text").filter("text <> ''")
    sizes = texts.join(F.broadcast(ids), "doc_id").select("toxic", "doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").alias("size"))
    sizes = sizes.groupBy("toxic", "digest").agg(F.min("doc_id").alias("doc_id"), F.max("size").alias("size"))
    half = (SAMPLE_BYTES if most_bytes is None else most_bytes) // 2
    order = [F.col("size") > half // 16, F.xxhash64("doc_id"), F.col("digest")]
    chosen = []
    for k in (0, 1):  # a bounded number of rows without their texts
        own = sizes.filter((F.col("toxic") == k) & (F.col("size") <= half)).orderBy(*order).limit(most * (2 - k))
        read = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        chosen.append(own.withColumn("read", read).filter(F.col("read") <= half).select("toxic", "doc_id", "digest"))
    taken = texts.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").filter(F.sha2("text", 256) == F.col("digest"))
    return taken.groupBy("toxic", "digest", "doc_id").agg(F.first("text").alias("text")).select("doc_id", "text", "toxic")


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, most_bytes: int | None = None) -> pd.DataFrame:
    """The rows of :func:`sampled`, in order."""
    return sampled(docs, labels, most, most_bytes).toPandas().sort_values(["toxic", "doc_id", "text"], kind="stable")


def held_out(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``docs`` with toxicity (0 to 1) and toxic_spans."""
    lean(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = others(docs, "toxicity", "toxic_spans")
    docs, at = docs.select(*(F.col(f"`{c}`") for c in kept)), kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            scores, found = tag(batch.column(at), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array(found, kind)], [*batch.schema.names, "toxicity", "toxic_spans"])

    schema = T.StructType(list(docs.schema.fields)).add("toxicity", "double").add("toxic_spans", SPANS)
    return docs.mapInArrow(run, schema)


def _fit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text and toxic of the whole sample in; one row with the model out."""
    parts = list(batches)
    if not parts:
        return
    rows = pa.Table.from_batches(parts)
    model = fit(rows["text"], rows["toxic"].to_numpy())
    yield pa.RecordBatch.from_pylist([{"w": model["w"].tobytes(), "trans": model["trans"].ravel().tolist(), "start": model["start"].tolist(), "doc": model["doc"].tolist()}], MODEL)


def trained(docs: DataFrame, labels: DataFrame) -> dict:
    """The model from the sample, fitted in one task: neither the texts nor their features come to the driver."""
    lean(docs.sparkSession)
    rows = sampled(docs, labels).repartition(1).sortWithinPartitions("toxic", "doc_id", "text").select("text", "toxic")
    found = rows.mapInArrow(_fit_batches, "w binary, trans array<double>, start array<double>, doc array<double>").collect()
    if not found:  # no labelled texts
        return fit([], np.zeros(0))
    m = found[0]
    return {"w": np.frombuffer(bytes(m.w), np.float32), "trans": np.array(m.trans).reshape(2, 2), "start": np.array(m.start), "doc": np.array(m.doc)}


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity by a model of the labels that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), "toxic_spans")
