"""Language identification by averaged embeddings of hashed subwords.

A text is the mean of the embeddings of its byte n-grams (SIZES) within words, word boundaries included, after Unicode lower
case, with digits and ASCII punctuation as boundaries. N-grams are hashed into BUCKETS; a linear softmax on the mean gives
the languages. Embeddings and softmax are trained together by stochastic gradient descent on random runs of words of the
training texts, so that short texts are known too. One in CALIBRATE of the texts is kept out of that: on runs of its words a
temperature makes the softmax a probability, and the lowest score is found from which on at most a share REJECT of the
runs is wrong; texts below it are marked as rejected.

The fit reads at most SAMPLE_ROWS excerpts of at most EXCERPT characters, from a place given by a hash, as many for each of
the (at most LANGUAGES) most frequent languages. Prediction covers every n-gram of every text, some bytes at a time; sums
are of integers, so equal texts get equal scores wherever they stand.

Cases: a null text and one without a letter is ``und`` with score 0; rows without a language or without an id aren't learned
from; repeated texts are learned once; ties of scores go to the first language in order; without training rows all texts
are ``und``; an empty table gives an empty table; columns with the names of results are replaced, others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import SLICE_BYTES, gram_hashes, lean, others, text_buffers

#: Excerpts that the fit reads at most, their characters, and the languages that it learns at most.
SAMPLE_ROWS, EXCERPT, LANGUAGES = 6_000, 4_096, 1_000
SIZES = (2, 3, 4, 5)
BUCKETS, DIMENSIONS = 1 << 18, 16
#: Runs of words that one excerpt gives in an epoch, and their most words; epochs go on until so many examples are seen.
RUNS, RUN_WORDS = 4, 30
EXAMPLES, BATCH, RATE = 80_000, 64, 0.5
CALIBRATE, REJECT = 5, 0.01
#: Fixed point of the embeddings.
SCALE = 1 << 14
UNKNOWN = "und"

_rng = np.random.default_rng(11)
_CODE = _rng.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_GAP = np.zeros(256, bool)
_GAP[:128] = True
_GAP[97:123] = _GAP[65:91] = False
_FLAT = np.arange(256, dtype=np.uint8)
_FLAT[_GAP] = 32


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts in lower case, with one space before and after each and for all that is no letter."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    gap, joint = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    data, offsets = text_buffers(pc.binary_join_element_wise(gap, pc.utf8_lower(texts), gap, joint))
    return _FLAT[data], offsets


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """The bucket of the n-gram at each place, 0 where none starts: a gap may only be at one of its ends."""
    if len(data) < size:
        return np.zeros(0, np.int64)
    gap = data == 32
    out = (gram_hashes(_CODE[data], size) % np.uint64(BUCKETS - 1)).astype(np.int64) + 1
    n = len(out)
    bad = gap[:n] & gap[size - 1 : size - 1 + n]
    for k in range(1, size - 1):
        bad |= gap[k : k + n]
    out[bad] = 0
    return out


def _sums(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, most: int) -> np.ndarray:
    """Sums of the rows of ``table`` over the n-grams of each text; about ``most`` bytes at once."""
    out = np.zeros((len(offsets) - 1, table.shape[1]), np.int64)
    # texts never run together: each ends with a gap and the next begins with one, and n-grams hold at most one
    for a in range(0, len(data), most):
        b = min(len(data), a + most)
        first = int(np.searchsorted(offsets, a, "right")) - 1
        last = int(np.searchsorted(offsets, b, "left"))
        cuts = np.maximum(offsets[first:last], a) - a
        for size in SIZES:
            g = _grams(data[a : min(len(data), b + size - 1)], size)[: b - a]
            if len(g):
                rows = np.flatnonzero(cuts < len(g))
                out[first + rows] += np.add.reduceat(table[g], cuts[rows], axis=0, dtype=np.int64)
    return out


class Model:
    """``languages`` in order, integer embeddings with a column of ones for known n-grams, and the softmax over their mean."""

    def __init__(self, languages: list[str], embeddings: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.languages, self.temperature, self.threshold = languages, 1.0, 0.0
        if len(languages) <= embeddings.shape[1]:  # the smaller table of both: products with the weights are linear too
            embeddings, weights = embeddings @ weights, np.eye(len(languages))
        self.table = np.concatenate([np.rint(embeddings * SCALE), np.ones((len(embeddings), 1))], 1).astype(np.int32)
        self.table[0] = 0
        self.weights, self.bias = weights, bias

    def logits(self, texts: pa.Array) -> np.ndarray:
        data, offsets = _flat(texts)
        sums = _sums(data, offsets, self.table, max(1 << 16, SLICE_BYTES * 8 // self.table.shape[1]))
        return self.head(sums)

    def head(self, sums: np.ndarray) -> np.ndarray:
        """Logits of sums of embeddings and their numbers."""
        mean = sums[:, :-1] / SCALE / np.maximum(sums[:, -1:], 1)
        return mean @ self.weights + self.bias

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of the likeliest language and its probability."""
        p = _softmax(self.logits(texts) / self.temperature)
        best = p.argmax(1)
        return best, p[np.arange(len(best)), best]


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def gradient(embeddings: np.ndarray, weights: np.ndarray, bias: np.ndarray, gram: np.ndarray, share: np.ndarray, begin: np.ndarray, label: np.ndarray):
    """Gradients of the summed cross-entropy of examples: n-grams ``gram`` with ``share`` of each, examples from ``begin`` on.

    Returns the distinct n-grams with theirs, and those of weights and bias.
    """
    mean = np.add.reduceat(embeddings[gram] * share[:, None], begin, axis=0)
    wrong = _softmax(mean @ weights + bias)
    wrong[np.arange(len(label)), label] -= 1
    back = wrong @ weights.T
    order = np.argsort(gram, kind="stable")
    example = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(gram))))[order]
    sorted_ = gram[order]
    start = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    return sorted_[start], np.add.reduceat(back[example] * share[order, None], start, axis=0), mean.T @ wrong, wrong.sum(0)


def _examples(data: np.ndarray, offsets: np.ndarray, rng: np.random.Generator) -> tuple[list[np.ndarray], np.ndarray]:
    """N-grams of RUNS random runs of words of each text, and the texts' numbers."""
    found, owner = [], []
    for i in range(len(offsets) - 1):
        part = data[offsets[i] : offsets[i + 1]]
        gaps = np.flatnonzero((part[1:] == 32) & (part[:-1] != 32)) + 1
        starts = np.flatnonzero((part[1:] != 32) & (part[:-1] == 32))
        if not len(starts):
            continue
        a = rng.integers(0, len(starts), RUNS)
        b = np.minimum(len(starts) - 1, a + np.exp(rng.uniform(0, np.log(RUN_WORDS), RUNS)).astype(int) - 1)
        for x, y in zip(a, b, strict=True):
            run = part[starts[x] : gaps[y] + 1]
            g = np.concatenate([_grams(run, k) for k in SIZES])
            found.append(g[g > 0])
            owner.append(i)
    return found, np.array(owner, np.int64)


def fit(texts: list[str], labels: list[str], seed: int = 0) -> Model | None:
    """A model of the texts' languages; None without texts."""
    languages = sorted(set(labels))
    if not languages:
        return None
    number = {k: i for i, k in enumerate(languages)}
    y = np.array([number[k] for k in labels])
    rng = np.random.default_rng(seed)
    aside = np.zeros(len(y), bool)
    aside[rng.permutation(len(y))[: len(y) // CALIBRATE]] = True
    data, offsets = _flat(pa.array(texts, pa.large_string()))
    embeddings = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    weights, bias = np.zeros((DIMENSIONS, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    epochs = -(-EXAMPLES // (RUNS * len(texts)))
    for epoch in range(epochs):
        runs, owner = _examples(data, offsets, rng)
        use = [k for k in rng.permutation(len(runs)) if not aside[owner[k]] and len(runs[k])]
        for at in range(0, len(use), BATCH):
            rate = RATE * (1 - (epoch + at / len(use)) / epochs)
            batch = use[at : at + BATCH]
            size = np.array([len(runs[k]) for k in batch])
            gram = np.concatenate([runs[k] for k in batch])
            share = np.repeat(1 / size, size).astype(np.float32)
            begin = np.concatenate(([0], np.cumsum(size)))[:-1]
            which, de, dw, db = gradient(embeddings, weights, bias, gram, share, begin, y[owner[batch]])
            embeddings[which] -= rate * de
            weights -= rate / BATCH * dw
            bias -= rate / BATCH * db
    model = Model(languages, embeddings.astype(float), weights.astype(float), bias.astype(float))
    runs, owner = _examples(data, offsets, rng)
    use = [k for k in range(len(runs)) if aside[owner[k]] and len(runs[k])]
    if use:
        begin = np.concatenate(([0], np.cumsum([len(runs[k]) for k in use])))[:-1]
        sums = np.add.reduceat(model.table[np.concatenate([runs[k] for k in use])], begin, axis=0, dtype=np.int64)
        _calibrate(model, model.head(sums), y[owner[use]])
    return model


def _calibrate(model: Model, x: np.ndarray, y: np.ndarray) -> None:
    """Temperature of the least cross-entropy on logits kept aside, and the threshold of rejection."""
    ways = np.exp(np.linspace(np.log(0.02), np.log(5), 120))
    loss = [-np.log(np.maximum(_softmax(x / t)[np.arange(len(y)), y], 1e-12)).mean() for t in ways]
    model.temperature = float(ways[int(np.argmin(loss))])
    p = _softmax(x / model.temperature)
    best = p.argmax(1)
    score = p[np.arange(len(y)), best]
    order = np.argsort(-score, kind="stable")
    wrong = np.cumsum(best[order] != y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(wrong <= REJECT)
    model.threshold = float(score[order[good[-1]]]) if len(good) else 1.0


def held_out(column: str) -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, languages: int = LANGUAGES):
    """(text, lang) excerpts for the fit, as a Pandas frame: of ``docs`` (doc_id, text, lang) those that are not held out."""
    train = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = train.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    quota = max(1, rows // max(1, len(known)))
    spark = docs.sparkSession
    rates = spark.createDataFrame([(r["lang"], min(1.0, 3 * quota / r["count"])) for r in known], "lang string, rate double")
    h = F.xxhash64("text")
    picked = train.select("lang", "text").join(F.broadcast(rates), "lang").filter((F.pmod(h, F.lit(1 << 30)) < F.col("rate") * (1 << 30)) & F.col("text").rlike(r"\p{L}"))
    place = F.pmod(F.xxhash64(h, F.lit(1)), F.greatest(F.length("text") - EXCERPT, F.lit(0)) + 1)
    picked = picked.select("lang", F.substring("text", place.cast("int") + 1, F.lit(EXCERPT)).alias("text")).distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text")
    picked = picked.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= quota)
    return picked.select("text", "lang").toPandas().sort_values(["lang", "text"], kind="stable")


def trained(docs: DataFrame) -> Model | None:
    found = sample(docs)
    return fit(found["text"].tolist(), found["lang"].tolist())


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, lang_score and lang_rejected."""
    lean(docs.sparkSession)
    kept = others(docs, "lang_pred", "lang_score", "lang_rejected")
    at = kept.index(text_col)
    rows = docs.select(*(F.col(f"`{c}`") for c in kept))
    names = [*kept, "lang_pred", "lang_score", "lang_rejected"]
    if model is None:
        return rows.select("*", F.lit(UNKNOWN), F.lit(0.0), F.lit(True)).toDF(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # columns go by place, as their names may be any
    rows = rows.toDF(*(f"c{i}" for i in range(len(kept))))
    schema = T.StructType(list(rows.schema.fields)).add("pred", "string").add("score", "double").add("rejected", "boolean")
    rows = rows.withColumn("letters", F.coalesce(F.col(f"c{at}").rlike(r"\p{L}"), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        languages = pa.array(model.languages)
        for batch in batches:
            *columns, letters = batch.columns
            best, score = model.predict(batch.column(at))
            lang = pc.if_else(letters, languages.take(pa.array(best)), UNKNOWN)
            score = np.where(letters.to_numpy(zero_copy_only=False), score, 0.0)
            yield pa.RecordBatch.from_arrays([*columns, lang, pa.array(score), pa.array(score < model.threshold)], schema.names)

    return rows.mapInArrow(run, schema).toDF(*names)


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by a model of the documents that are not held out; the prediction sees the text alone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), trained(docs))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))
