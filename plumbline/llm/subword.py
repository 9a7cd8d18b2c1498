"""SentencePiece encoding by sampling from the piece lattice, and lossless decoding.

A space becomes the word mark of the piece model and in pieces no mark follows another character, so the lattice of a text
falls into the lattices of its words, each with all the spaces before it. Forward filtering sums, for each place in a word, the weights of all ways to reach
it; backward sampling starts at the word's end and draws one incoming piece at a time with the probability of its ways.
Draws come from a counter-based generator keyed by the row's key, the word's place and the step, so a row is always cut
the same way, whatever partition it is in. The lattices of a slice's distinct words are built together as arrays of states and
edges; all words of the slice are then sampled side by side.

Weights: a piece of the model has the probability of its rank in a Zipf law (the model is a merge list, its scores are
ranks), raised to ALPHA; a byte piece is BYTE_COST less likely, so that it is used where nothing else fits or, now and
then, by sampling. A mark in the text itself is written in byte pieces only, so that decoding gives back each byte. No mark
is put before a text that starts without a space, for the same reason.

Cases: null gives no pieces and decodes to the empty text; empty texts likewise; very long words work like others; ids
that aren't integers count by a hash of their text;
repeated rows with one key get equal pieces, and a null key counts as -1; an empty table gives an empty table; a column
named as the result (pieces, decoded) is replaced, other columns are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import lean, mix, others, running_hash, slices, span_hashes, text_buffers, word_hashes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA, BYTE_COST = 1.5, 8.0
#: Bytes of text whose distinct words are built at once.
SLICE = 1 << 20
MARK = "▁".encode()
_SPACE = np.zeros(256, bool)
_SPACE[32] = True


class Pieces:
    """The model's pieces as bytes (mark read as a space), their log weights, and a hash index by length."""

    def __init__(self, path: str = MODEL, alpha: float = ALPHA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.text: list[bytes] = [b""] * n
        self.byte_id = np.zeros(256, np.int32)
        by_len: dict[int, list[int]] = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i)):
                self.text[i] = piece.replace("▁", " ").encode()
                if b" " in self.text[i].lstrip(b" "):
                    raise ValueError(f"a mark follows another character in piece {i}: texts don't fall into words")
                if self.text[i]:
                    by_len.setdefault(len(self.text[i]), []).append(i)
        self.weight = -alpha * np.log(np.arange(n) + 2.0)
        self.weight[self.byte_id] = -alpha * np.log(n) - BYTE_COST
        self.lengths = sorted(by_len)
        self.slots = np.full(1 << 18, -1, np.int32)  # open addressing by hash, next slot on collision
        self.hashes = np.zeros(1 << 18, np.uint64)
        for size, ids in by_len.items():
            raw = np.frombuffer(b"".join(self.text[i] for i in ids), np.uint8)
            at = np.arange(len(ids)) * size
            for h, i in zip(word_hashes(raw, at, at + size), ids, strict=True):
                k = int(h) & (len(self.slots) - 1)
                while self.slots[k] >= 0:
                    k = (k + 1) & (len(self.slots) - 1)
                self.slots[k], self.hashes[k] = i, h
        self.size = np.array([len(t) for t in self.text], np.int64)
        self.flat = np.frombuffer(b"".join(self.text), np.uint8)
        self.begin = np.concatenate(([0], np.cumsum(self.size)))


    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        k = (h & np.uint64(len(self.slots) - 1)).astype(np.int64)
        out = np.full(len(h), -1, np.int32)
        left = np.arange(len(h))
        while len(left):
            slot = self.slots[k]
            hit = (slot >= 0) & (self.hashes[k] == h[left])
            out[left[hit]] = slot[hit]
            more = (slot >= 0) & ~hit
            left, k = left[more], (k[more] + 1) & (len(self.slots) - 1)
        return out


class Lattices:
    """The lattices of distinct words, given by their places in ``data``.

    States are places in words (1 to the word's length); the edges into a state stand together, with summed probabilities.
    """

    def __init__(self, p: Pieces, data: np.ndarray, s: np.ndarray, e: np.ndarray):
        size = e - s
        base = np.cumsum(size) - size  # of each word's first byte among the words' bytes
        word = np.repeat(np.arange(len(s)), size)
        within = np.arange(len(word)) - base[word]
        raw = data[s[word] + within]
        start, left, c = np.arange(len(raw), dtype=np.int32), size[word] - within, running_hash(raw)
        within = within.astype(np.int32)
        edges = []
        for n in reversed(p.lengths):  # long pieces are the likely ones and stand first
            x = start[left >= n]
            if len(x):
                found = p.find(span_hashes(c, x, x + np.int32(n)))
                hit = np.flatnonzero(found >= 0)
                x = x[hit]
                edges.append((x, x + np.int32(n), found[hit]))
        edges.append((start, start + np.int32(1), p.byte_id[raw]))
        x, y, piece = (np.concatenate(c) for c in zip(*edges, strict=True))
        del edges, c, left, start, raw
        order = np.argsort(y, kind="stable")  # a merge of sorted runs
        x, y, piece = x[order], y[order], piece[order]
        depth = within[y - 1]  # place of the edge's end in its word, less one
        deepest = int(depth.max())
        order = np.argsort(depth.astype(np.int16) if deepest < 2**15 else depth, kind="stable")
        total = np.full(len(within), -np.inf)  # log weight of all ways to the place after each byte
        ways = p.weight[piece]
        inner = within[x] > 0
        cut = np.concatenate(([0], np.cumsum(np.bincount(depth, minlength=deepest + 1))))
        for d in range(deepest + 1):  # forward filtering, one place of all words at a time
            i = order[cut[d] : cut[d + 1]]
            w = ways[i]
            deep = inner[i]
            w[deep] += total[x[i[deep]] - 1]
            ends = y[i]
            at = np.flatnonzero(np.concatenate(([True], ends[1:] != ends[:-1])))
            top = np.maximum.reduceat(w, at)
            count = np.diff(np.append(at, len(i)))
            total[ends[at] - 1] = top + np.log(np.add.reduceat(np.exp(w - np.repeat(top, count)), at))
            ways[i] = w
        prob = np.cumsum(np.exp(ways - total[y - 1]))
        at = np.flatnonzero(np.concatenate(([True], y[1:] != y[:-1])))
        self.share = prob - np.repeat(np.concatenate(([0.0], prob))[at], np.diff(np.append(at, len(y))))
        self.share[np.append(at[1:], len(y)) - 1] = 1.0
        self.first, self.piece, self.prev = at, piece, np.where(inner, x - np.int32(1), np.int32(-1))
        self.ends = base + size - 1

    def sample(self, last: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, piece) in order: one drawn path to each last state; ``key`` seeds each word's draws."""
        words, pieces, steps = [], [], []
        word, state, step = np.arange(len(last)), last, 0
        while len(word):
            u = (mix(key[word] + np.uint64((0x9E3779B97F4A7C15 * (step + 1)) & (2**64 - 1))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = self.first[state]
            wrong = np.flatnonzero(u >= self.share[edge])
            while len(wrong):
                edge[wrong] += 1
                wrong = wrong[u[wrong] >= self.share[edge[wrong]]]
            words.append(word)
            pieces.append(self.piece[edge])
            steps.append(step)
            state = self.prev[edge]
            more = state >= 0
            word, state, step = word[more], state[more], step + 1
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        # the last drawn piece of a word comes first: place each draw from its word's end
        count = np.zeros(len(last), np.int64)
        for w in words:
            count[w] += 1
        end = np.cumsum(count)
        out = np.empty(int(end[-1]), np.int32)
        for k, (w, p) in enumerate(zip(words, pieces, strict=True)):
            out[end[w] - 1 - k] = p
        return np.repeat(np.arange(len(last)), count), out


_models: dict[str, Pieces] = {}


def _of(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def _word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with their leading spaces: a word starts at each run of spaces and at each text's start."""
    first = _SPACE[data]
    first[1:] &= ~_SPACE[data[:-1]]
    full = off[:-1][off[1:] > off[:-1]]
    first[full] = True
    s = np.flatnonzero(first)
    return s, np.append(s[1:], len(data)), np.searchsorted(off, s, "right") - 1


def encode(ids: np.ndarray, data: np.ndarray, off: np.ndarray, pieces: Pieces, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of the texts of a slice, and each text's offsets in them; ``ids`` are the rows' keys."""
    s, e, row = _word_spans(data, off)
    if not len(s):
        return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
    h = word_hashes(data, s, e)
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    lattices = Lattices(pieces, data, s[first], e[first])
    begin = np.searchsorted(row, np.arange(len(off)))
    key = mix(mix(ids.astype(np.int64).view(np.uint64) + np.uint64(seed))[row] + (np.arange(len(s)) - begin[row]).astype(np.uint64))
    word, piece = lattices.sample(lattices.ends[which], key)
    count = np.bincount(row[word], minlength=len(off) - 1)
    return piece, np.concatenate(([0], np.cumsum(count)))


def decode(piece: np.ndarray, poff: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts, and their offsets."""
    size = pieces.size[piece]
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    at = np.arange(total) + np.repeat(pieces.begin[piece] - (end - size), size)
    return pieces.flat[at], np.concatenate(([0], end))[poff]


def _numbers(ids: pa.Array) -> np.ndarray:
    """Ids as numbers: integers as they are, others by a hash of their text, nulls as -1."""
    if pa.types.is_integer(ids.type):
        return ids.fill_null(-1).to_numpy(zero_copy_only=False)
    data, offsets = text_buffers(ids.cast(pa.string()))
    out = span_hashes(running_hash(data), offsets[:-1], offsets[1:]).view(np.int64)
    return np.where(ids.is_null().to_numpy(zero_copy_only=False), -1, out)


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, seed: int = 0) -> DataFrame:
    """``docs`` with pieces, an array of piece numbers."""
    lean(docs.sparkSession)
    kept = others(docs, "pieces")
    docs, i_id, i_text = docs.select(*(F.col(f"`{c}`") for c in kept)), kept.index(id_col), kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _of(model)
        for batch in batches:
            ids = _numbers(batch.column(i_id))
            data, offsets = text_buffers(batch.column(i_text))
            for i, j, part, off in slices(data, offsets, SLICE):
                piece, poff = encode(ids[i:j], part, off, pieces, seed)
                part_batch = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part_batch.columns, pa.ListArray.from_arrays(pa.array(poff.astype(np.int32)), pa.array(piece))], [*batch.schema.names, "pieces"])

    return docs.mapInArrow(run, T.StructType(list(docs.schema.fields)).add("pieces", T.ArrayType(T.IntegerType())))


def decode_texts(rows: DataFrame, pieces_col: str = "pieces", model: str = MODEL) -> DataFrame:
    """``rows`` with decoded, the text of the pieces."""
    lean(rows.sparkSession)
    kept = others(rows, "decoded")
    rows, at = rows.select(*(F.col(f"`{c}`") for c in kept)), kept.index(pieces_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _of(model)
        for batch in batches:
            lists = batch.column(at)
            size = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            raw, off = decode(lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(size))), pieces)
            whole = raw.tobytes()
            texts = pa.array([whole[a:b].decode() for a, b in zip(off[:-1], off[1:], strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, T.StructType(list(rows.schema.fields)).add("decoded", "string"))


def _digest_batches(model: str, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _of(model)
        byte = np.zeros(len(pieces.size), bool)
        byte[pieces.byte_id] = True
        for batch in batches:
            ids = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            data, offsets = text_buffers(batch.column(1))
            for i, j, part, off in slices(data, offsets, SLICE):
                piece, poff = encode(ids[i:j], part, off, pieces, seed)
                back, boff = decode(piece, poff, pieces)
                whole, raw = back.tobytes(), piece.astype("<i4").tobytes()
                cum = np.concatenate(([0], np.cumsum(byte[piece])))
                same = bool(np.array_equal(back, part))
                texts = [whole[a:b] for a, b in zip(boff[:-1], boff[1:], strict=True)]
                equal = [True] * (j - i) if same else [t == part[a:b].tobytes() for t, a, b in zip(texts, off[:-1], off[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(np.diff(poff)),
                        pa.array(np.diff(cum[poff])),
                        pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(poff[:-1], poff[1:], strict=True)]),
                        pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                        pa.array(equal),
                    ],
                    ["doc_id", "n_pieces", "n_bytes", "pieces_sha256", "decoded_sha256", "lossless"],
                )

    return run


def op4_sentencepiece(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    """Every document's sampled pieces (their number, byte pieces among them, digest) and a digest of the text decoded from them."""
    lean(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.mapInArrow(_digest_batches(model, 0), "doc_id long, n_pieces long, n_bytes long, pieces_sha256 string, decoded_sha256 string, lossless boolean")
