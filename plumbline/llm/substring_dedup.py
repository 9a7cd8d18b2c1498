"""Substring deduplication by prefix-partitioned suffix trees.

A suffix starts at each word of a document. The nodes of the suffix tree that lie WINDOW words deep or deeper and have
leaves of several documents are the passages that documents share; the smallest document below such a node keeps the
passage, the others lose it. The trees need the first WINDOW words of a suffix only, as a deeper node cuts no word that
its ancestor at that depth does not cut; the passages themselves, as long as they go on, are the runs of cut words.

1. Two filters drop suffixes that are leaves. The first finds the lowest-ranked GRAM-word grams of windows (the smallest
   hash, which equal windows share) that occur in one document only, with one small key per run of suffixes; the second
   finds, among the others, hashes of whole windows that occur in one document only. Equal hashes are not taken for equal
   words: what passes goes into the trees.
2. The others are dealt to groups by a prefix of variable length. A window is read from its anchor, the first word of its
   lowest gram, on; so windows that follow each other mostly go to one group, and are sent as one run of words. A prefix
   that more windows share than a group should hold is lengthened by a word, and again, up to the whole gram and then to
   the whole window. Equal windows in one task are combined before they are counted or sent: all but the one of the
   smallest document are settled, so that a passage that a third of all documents share goes out once per task.
3. In each group the suffixes of its runs are sorted by their words, the longest common prefixes of neighbours give the
   tree's deep internal nodes, and each node's leaves but those of its smallest document are repeats.
4. Each document marks the words under its repeated windows, found by hash and compared word by word with the suffix that
   was sent, and cuts them out.

Words stand for themselves by 64-bit hashes throughout. Documents are dealt by id into a bucketed table once; the later
passes read it without a shuffle of texts.

Cases: null and empty texts and texts of fewer than WINDOW words lose nothing; windows are judged on the input; repeats
within one document don't count; rows with the same id don't repeat each other; rows without an id neither give nor lose
words; an empty table gives an empty table; columns other than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import _MULT, delete, drop, gram_hashes, lean, materialize, mix, shared_dir, slices, spans, text_buffers, whole_grams, word_hashes

WINDOW, GRAM = 13, 5
#: Suffixes that a group should hold at most, but no more than GROUPS groups: the table of long prefixes follows their number.
SUFFIXES, GROUPS = 1 << 18, 1 << 20
#: Suffixes that a task combines before it sends them.
FLUSH = 1 << 20
#: Words that are sent as codes of two bytes: the most frequent ones, any other goes as its hash.
CODES = (1 << 16) - 1
#: Bytes of text in one bucket of the documents, about, and in one word of it.
BUCKET_BYTES, WORD_BYTES = 32 << 20, 6
#: Bits of a window's hash that are used; fewer make collisions.
HASH = np.uint64(2**64 - 1)
SENT = "bucket long, settled boolean, doc binary, key binary, place binary, code binary, word binary"
FOUND = "bucket long, doc binary, key binary, place binary"
LISTS = "d long, keys array<long>, places array<int>"


def _windows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words (start, end, row, hash) and, of each suffix of at least WINDOW words: position, lowest gram's hash, window's hash."""
    s, e, row = spans(data, off)
    w = word_hashes(data, s, e)
    at = whole_grams(row, WINDOW)
    g = gram_hashes(w, GRAM)
    low = g[: max(0, len(w) - WINDOW + 1)].copy()
    for k in range(1, WINDOW - GRAM + 1):
        np.minimum(low, g[k : k + len(low)], out=low)
    return s, e, row, w, at, low[at], gram_hashes(w, WINDOW)[at] & HASH


def _pack(values: np.ndarray) -> bytes:
    raw = values.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(packed: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True), kind)


def _blobs(bucket: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """The different buckets, and of each column (sorted by bucket) each bucket's part, packed."""
    begin = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    end = np.append(begin, len(bucket))[1:]
    return bucket[begin], [pa.array([_pack(c[x:y]) for x, y in zip(begin, end, strict=True)], pa.binary()) for c in columns]


def _parts(table: pa.Table, name: str, kind: type) -> list[np.ndarray]:
    return [np.zeros(0, kind), *(_unpack(x.as_py(), kind) for x in table.column(name))]


def _column(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.concatenate(_parts(table, name, kind))


# --- 1: keys of one document only ----------------------------------------------------------------------------------


def _grams(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(doc, lowest gram) of each run of suffixes."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    data, offsets = text_buffers(batch.column(1))
    for i, _, part, off in slices(data, offsets):
        _, _, row, _, at, low, _ = _windows(part, off)
        new = np.ones(len(at), bool)
        new[1:] = (low[1:] != low[:-1]) | (row[at[1:]] != row[at[:-1]])
        yield ids[i + row[at[new]]].astype(np.int64), low[new]


def _paths(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(doc, window's hash) of the suffixes of documents (doc, text, keys) whose lowest grams are among the keys."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    data, offsets = text_buffers(batch.column(1))
    for i, j, part, off in slices(data, offsets):
        _, _, row, _, at, low, path = _windows(part, off)
        hit = _listed(low, row[at], batch.column(2).slice(i, j - i))
        yield ids[i + row[at[hit]]].astype(np.int64), path[hit]


def _key_batches(collect: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]], buckets: int):
    """The pairs (doc, key) of ``collect`` dealt by key; of equal keys in a task the first, the others are settled."""

    def send(doc: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        order = _by_key(doc, key)
        doc, key = doc[order], key[order]
        again = np.zeros(len(key), bool)
        again[1:] = (key[1:] == key[:-1]) & (doc[1:] == doc[:-1])
        doc, key = doc[~again], key[~again]
        lead = np.ones(len(key), bool)
        lead[1:] = key[1:] != key[:-1]
        # keys of several documents of this task are shared: one row goes to the others, all of them back to their documents
        shared = ~lead
        shared[:-1] |= ~lead[1:]
        parts = []
        for settled, d, k in ((False, doc[lead], key[lead]), (True, doc[shared], key[shared])):
            bucket = (mix(d.view(np.uint64) if settled else k) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            names, (ds, ks) = _blobs(bucket[order], d[order], k[order])
            none = pa.array([b""] * len(names), pa.binary())
            parts.append(pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([settled] * len(names), pa.bool_()), ds, ks, none, none, none], ["bucket", "settled", "doc", "key", "place", "code", "word"]))
        return parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc, key in collect(batch):
                held.append((doc, key))
                size += len(doc)
                if size >= FLUSH:
                    yield from send(*map(np.concatenate, zip(*held, strict=True)))
                    held, size = [], 0
        if size:
            yield from send(*map(np.concatenate, zip(*held, strict=True)))

    return run


def _back(doc: np.ndarray, key: np.ndarray, place: np.ndarray, groups: int) -> pa.Table:
    """Keys on their way back to groups of documents."""
    group = (mix(doc.view(np.uint64)) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    names, blobs = _blobs(group[order], doc[order], key[order], place[order])
    return pa.table({"bucket": pa.array(names, pa.int64()), "doc": blobs[0], "key": blobs[1], "place": blobs[2]})


def _shared(groups: int):
    """Of one bucket: per document the keys that several documents have."""

    def run(table: pa.Table) -> pa.Table:
        docs = _parts(table, "doc", np.int64)
        settled = np.repeat(table.column("settled").to_numpy(zero_copy_only=False), [len(x) for x in docs[1:]])
        doc, key = np.concatenate(docs), _column(table, "key", np.uint64)
        order = _by_key(doc, key)
        order = np.concatenate((order[~settled[order]], order[settled[order]]))
        doc, key, settled = doc[order], key[order], settled[order]
        same = np.zeros(len(key), bool)
        same[1:] = (key[1:] == key[:-1]) & (settled[1:] == settled[:-1])
        run_ = np.cumsum(~same) - 1
        first = np.flatnonzero(~same)[run_] if len(key) else run_
        several = np.bincount(run_, doc != doc[first]) > 0 if len(key) else np.zeros(0, bool)
        hit = settled | several[run_] if len(key) else settled
        return _back(doc[hit], key[hit], np.zeros(int(hit.sum()), np.int32), groups)

    return run


def _gathered(table: pa.Table) -> pa.Table:
    """Of one group of documents: each document's keys and places as lists."""
    doc, key, place = _column(table, "doc", np.int64), _column(table, "key", np.int64), _column(table, "place", np.int32)
    order = np.argsort(doc, kind="stable")
    doc, key, place = doc[order], key[order], place[order]
    begin = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, np.int64)
    cut = pa.array(np.append(begin, len(key)).astype(np.int32))
    return pa.table({"d": pa.array(doc[begin], pa.int64()), "keys": pa.ListArray.from_arrays(cut, pa.array(key)), "places": pa.ListArray.from_arrays(cut, pa.array(place))})


# --- 2: suffixes dealt by prefixes ---------------------------------------------------------------------------------


def _entries(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of all list entries."""
    sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy(zero_copy_only=False)


def _tied(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """One hash of a key and the row that it stands in."""
    return mix(key ^ mix(row.astype(np.uint64) + np.uint64(1)))


def _by_key(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The order by key and document."""
    order = np.argsort(key)
    equal = key[order][1:] == key[order][:-1]
    tied = np.flatnonzero(np.concatenate(([False], equal)) | np.concatenate((equal, [False]))) if len(key) else np.zeros(0, np.int64)
    rows = order[tied]
    order[tied] = rows[np.lexsort((doc[rows], key[rows]))]
    return order


def _listed(key: np.ndarray, row: np.ndarray, lists: pa.ListArray) -> np.ndarray:
    """Which keys stand in the list of their row."""
    r, k = _entries(lists)
    want, got = np.sort(_tied(k.view(np.uint64), r)), _tied(key, row)
    hit = np.zeros(len(key), bool)
    if len(want):
        # most others are told by a few bits
        mask = np.uint64((1 << max(10, (8 * len(want)).bit_length())) - 1)
        some = np.zeros(int(mask) + 1, bool)
        some[(want & mask).astype(np.int64)] = True
        near = np.flatnonzero(some[(got & mask).astype(np.int64)])
        hit[near] = want[np.minimum(np.searchsorted(want, got[near]), len(want) - 1)] == got[near]
    return hit


class Suffixes:
    """Suffixes of a task: document, window's hash, place of the first word in its text, anchor, and the words."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = self.words = 0

    def add(self, doc: np.ndarray, key: np.ndarray, place: np.ndarray, at: np.ndarray, anchor: np.ndarray, w: np.ndarray) -> None:
        if len(doc):
            self.parts.append((doc, key, place, at + self.words, anchor + self.words, w))
            self.size += len(doc)
            self.words += len(w)

    def combined(self) -> tuple[np.ndarray, ...]:
        """Words; (doc, key, place, position and anchor among the words) of the smallest document of each window; (doc, key, place) of the others."""
        doc, key, place, at, anchor, w = map(np.concatenate, zip(*self.parts, strict=True))
        order = _by_key(doc, key)
        doc, key, place, at, anchor = doc[order], key[order], place[order], at[order], anchor[order]
        same = np.zeros(len(key), bool)
        same[1:] = key[1:] == key[:-1]
        near = np.flatnonzero(same)
        for k in range(WINDOW):
            near = near[w[at[near] + k] == w[at[near - 1] + k]]
        same[:] = False
        same[near] = True
        again = same.copy()
        again[1:] &= doc[1:] == doc[:-1]
        settled = same & ~again
        return w, doc[~same], key[~same], place[~same], at[~same], anchor[~same], doc[settled], key[settled], place[settled]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[Suffixes]:
    """Suffixes of documents (doc, text, keys) whose windows' hashes are among the keys, in parts of about FLUSH."""
    held = Suffixes()
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        data, offsets = text_buffers(batch.column(1))
        for i, j, part, off in slices(data, offsets):
            _, _, row, w, at, low, path = _windows(part, off)
            hit = _listed(path, row[at], batch.column(2).slice(i, j - i))
            at, path = at[hit], path[hit]
            first = np.searchsorted(row, np.arange(j - i))[row[at]]
            held.add(ids[i + row[at]].astype(np.int64), path, (at - first).astype(np.int32), at, _anchors(w, at, low[hit]), w)
            if held.size >= FLUSH:
                yield held
                held = Suffixes()
    if held.size:
        yield held


def _anchors(w: np.ndarray, at: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Of each window the position of its lowest gram, the first of equal ones."""
    g, where = gram_hashes(w, GRAM), at.copy()
    left = np.flatnonzero(g[at] != low)
    for k in range(1, WINDOW - GRAM + 1):
        where[left] = at[left] + k
        left = left[g[where[left]] != low[left]]
    return where


def _prefixes(w: np.ndarray, anchor: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(length, hash) of the words from the anchors on, each longer by a word."""
    total = np.zeros(len(anchor), np.uint64)
    for d in range(1, GRAM + 1):
        total = total + w[anchor + d - 1] * _MULT[d]
        yield d, mix(total + np.uint64(d))


def _count_batches(least: int):
    """(length, prefix, n): how many suffixes share a prefix, where a part has at least ``least``.

    Length 0 counts all suffixes, length -1 the part's most frequent words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _candidates(batches):
            w, _, _, _, at, anchor, *_ = part.combined()
            names, which, n = np.unique(w[anchor], return_inverse=True, return_counts=True)
            top = np.argsort(-n, kind="stable")[:CODES]
            lengths, prefixes, counts = [np.full(len(top), -1), [0]], [names[top].view(np.int64), [0]], [n[top], [len(at)]]
            left = np.flatnonzero((n >= least)[which])
            for d, prefix in _prefixes(w, anchor):
                names, which, n = np.unique(prefix[left], return_inverse=True, return_counts=True)
                many = n >= least
                lengths.append(np.full(int(many.sum()), d))
                prefixes.append(names[many].view(np.int64))
                counts.append(n[many])
                left = left[many[which]]
                if not len(left):
                    break
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in ((lengths, pa.int64()), (prefixes, pa.int64()), (counts, pa.int64()))], ["length", "prefix", "n"])

    return run


def _send_batches(long: list[np.ndarray], book: np.ndarray, groups: int):
    """Runs of windows by the group of their prefix; ``long`` has the sorted prefixes of each length that are to be lengthened.

    The column key holds the number of windows of each run. A word of the sorted ``book`` is written as its place there plus 1, any other as 0 and its hash beside it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = ["bucket", "settled", "doc", "key", "place", "code", "word"]
        for part in _candidates(batches):
            w, doc, key, place, at, anchor, *settled = part.combined()
            group, left = np.empty(len(doc), np.int64), np.arange(len(doc))
            for d, prefix in _prefixes(w, anchor):
                goes_on = np.isin(prefix[left], long[d])
                group[left[~goes_on]] = (mix(prefix[left[~goes_on]]) % np.uint64(groups)).astype(np.int64)
                left = left[goes_on]
                if not len(left):
                    break
            group[left] = (mix(key[left]) % np.uint64(groups)).astype(np.int64)  # the whole window
            slot = np.minimum(np.searchsorted(book, w), max(len(book) - 1, 0))
            code = np.where(book[slot] == w, slot + 1, 0).astype(np.uint16) if len(book) else np.zeros(len(w), np.uint16)
            order = np.lexsort((at, group))
            group, at = group[order], at[order]
            opens = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (at[1:] != at[:-1] + 1))))
            count = np.diff(np.append(opens, len(at)))
            group, doc, place = group[opens], doc[order][opens], place[order][opens]
            names, (docs, counts, places) = _blobs(group, doc, count.astype(np.int32), place)
            size = count + WINDOW - 1
            end = np.cumsum(size)
            words = np.arange(int(end[-1])) + np.repeat(at[opens] - (end - size), size)
            begin = np.concatenate(([0], end))[np.append(np.searchsorted(group, names), len(group))]
            codes = [_pack(code[words[x:y]]) for x, y in zip(begin[:-1], begin[1:], strict=True)]
            others = [_pack(w[words[x:y]][code[words[x:y]] == 0]) for x, y in zip(begin[:-1], begin[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([False] * len(names), pa.bool_()), docs, counts, places, pa.array(codes, pa.binary()), pa.array(others, pa.binary())], cols)
            bucket = (mix(settled[0].view(np.uint64)) % np.uint64(groups)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            names, blobs = _blobs(bucket[order], *(c[order] for c in settled))
            none = pa.array([b""] * len(names), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([True] * len(names), pa.bool_()), *blobs, none, none], cols)

    return run


def _words(rows: pa.Table, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of the runs that :func:`_send_batches` wrote: as hashes, and as codes of which equal words share one."""
    code, word = _column(rows, "code", np.uint16).astype(np.int64), _column(rows, "word", np.uint64)
    w = np.zeros(len(code), np.uint64)
    known = code > 0
    w[known] = book[code[known] - 1]
    w[~known] = word
    code[~known] = len(book) + 1 + np.unique(word, return_inverse=True)[1]
    return w, code


# --- 3: the deep nodes of a group's tree -----------------------------------------------------------------------------


def deep_nodes(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes (n, WINDOW) in the order of their words, and where a node of depth WINDOW begins: at a common prefix that is shorter.

    Words are codes from 0 on; as many as fit into 63 bits are compared at once.
    """
    bits = max(1, int(words.max()).bit_length()) if words.size else 1
    at_once = 63 // bits
    keys = [doc]
    for k in reversed(range(0, WINDOW, at_once)):
        key = words[:, k].copy()
        for j in range(k + 1, min(WINDOW, k + at_once)):
            key = key << bits | words[:, j]
        keys.append(key)
    order = np.lexsort(keys)
    sorted_ = words[order]
    common = np.zeros(len(order), np.int64)
    common[1:] = np.cumprod(sorted_[1:] == sorted_[:-1], axis=1).sum(1)
    return order, common < WINDOW


def _repeated(book: np.ndarray, groups: int):
    """Of one group: the suffixes whose window a smaller document has too."""

    def run(table: pa.Table) -> pa.Table:
        settled = table.column("settled").to_numpy(zero_copy_only=False)
        done, rest = table.filter(pa.array(settled)), table.filter(pa.array(~settled))
        out = [[_column(done, c, t)] for c, t in (("doc", np.int64), ("key", np.uint64), ("place", np.int32))]
        if len(rest):
            count = _column(rest, "key", np.int32).astype(np.int64)
            w, code = _words(rest, book)
            end = np.cumsum(count)
            within = np.arange(int(end[-1])) - np.repeat(end - count, count)
            start = np.repeat(np.cumsum(count + WINDOW - 1) - (count + WINDOW - 1), count) + within
            doc, place = np.repeat(_column(rest, "doc", np.int64), count), (np.repeat(_column(rest, "place", np.int32), count) + within).astype(np.int32)
            key = gram_hashes(w, WINDOW)[start] & HASH
            order, opens = deep_nodes(code[start[:, None] + np.arange(WINDOW)], doc)
            doc, key, place = doc[order], key[order], place[order]
            first = np.maximum.accumulate(np.where(opens, np.arange(len(doc)), 0))
            hit = doc > doc[first]
            for o, c in zip(out, (doc, key, place), strict=True):
                o.append(c[hit])
        return _back(*map(np.concatenate, out), groups)

    return run


# --- 4: words under repeats ------------------------------------------------------------------------------------------


def _cut_places(row: np.ndarray, w: np.ndarray, at: np.ndarray, path: np.ndarray, keys: pa.ListArray, places: pa.ListArray) -> np.ndarray:
    """The windows (of ``at``) that equal a listed one of their row: by hash, then word by word where the listed one stands in the row."""
    r, key = _entries(keys)
    _, place = _entries(places)
    if not len(r) or not len(at):
        return np.zeros(0, np.int64)
    key = key.view(np.uint64)
    begin = np.searchsorted(row, np.arange(len(keys) + 1))
    told = begin[r] + place  # where the listed window should start
    slot = np.minimum(np.searchsorted(at, told), len(at) - 1)
    here = (at[slot] == told) & (path[slot] == key) & (place >= 0) & (told < begin[r + 1])
    tie = _tied(key, r)
    order = np.argsort(tie, kind="stable")
    tie, told, here = tie[order], told[order], here[order]
    mine = _tied(path, row[at])
    left = np.flatnonzero(_listed(path, row[at], keys))
    lo, hi = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    lo[left], hi[left] = (np.searchsorted(tie, mine[left], side) for side in ("left", "right"))
    hit = np.zeros(len(at), bool)
    while len(left):
        x = lo[left]
        same = np.ones(len(left), bool)
        for k in range(WINDOW):
            same &= ~here[x] | (w[np.minimum(told[x] + k, len(w) - 1)] == w[at[left] + k])
        hit[left[same]] = True
        lo[left] += 1
        left = left[~same & (lo[left] < hi[left])]
    return at[hit]


def cut(data: np.ndarray, off: np.ndarray, s: np.ndarray, e: np.ndarray, row: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words that stay, joined by one space: bytes and offsets."""
    s, e, row = s[~gone], e[~gone], row[~gone]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[s] += 1
    edge[e] -= 1
    mask = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    gap = e[:-1][row[1:] == row[:-1]]  # the byte after a word that is not its text's last
    mask[gap] = True
    out = data.copy()
    out[gap] = 32
    return out[mask], np.concatenate(([0], np.cumsum(mask)))[off]


def _cut_batches(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j, part, off in slices(data, offsets):
                s, e, row, w, at, _, path = _windows(part, off)
                hit = _cut_places(row, w, at, path, *(batch.column(k).slice(i, j - i) for k in (2, 3)))
                edge = np.bincount(hit, minlength=len(s) + WINDOW) - np.bincount(hit + WINDOW, minlength=len(s) + WINDOW)
                gone = np.cumsum(edge)[: len(s)] > 0
                kept, koff = cut(part, off, s, e, row, gone)
                raw = kept.tobytes()
                texts = [raw[a:b] for a, b in zip(koff[:-1], koff[1:], strict=True)]
                count = lambda rows, m=j - i: pa.array(np.bincount(rows, minlength=m).astype(np.int64))
                out = [batch.column(0).slice(i, j - i), count(row), count(row[gone])]
                if with_text:
                    # runs of cut words: the repeated passages, as first word and end
                    opens = np.flatnonzero(gone & ~np.concatenate(([False], gone[:-1] & (row[1:] == row[:-1])))) if len(row) else np.zeros(0, np.int64)
                    ends = np.flatnonzero(gone & ~np.concatenate((gone[1:] & (row[1:] == row[:-1]), [False]))) + 1 if len(row) else opens
                    first = np.searchsorted(row, row[opens])
                    bounds = pa.array(np.searchsorted(row[opens], np.arange(j - i + 1)).astype(np.int32))
                    pairs = pa.StructArray.from_arrays([pa.array((opens - first).astype(np.int32)), pa.array((ends - first).astype(np.int32))], ["start", "end"])
                    out += [pa.array([t.decode() for t in texts], pa.string()), pa.ListArray.from_arrays(bounds, pairs)]
                else:
                    out.append(pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()))
                yield pa.RecordBatch.from_arrays(out, ["doc", "n_words", "n_removed", "kept", "passages"][: len(out)])

    return run


def _marked(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Callable[[], None]]:
    """(doc, text, keys, places) of every row with its repeated windows, and what deletes the tables behind it."""
    spark = docs.sparkSession
    lean(spark)
    doc = F.col(id_col).cast("long")
    # rows without an id are dealt by their texts
    rows = docs.select(doc.alias("doc"), F.col(text_col).alias("text"), F.coalesce(doc, F.xxhash64(F.col(text_col))).alias("slot"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(16, -(-size // BUCKET_BYTES))
    name = f"suffix_docs_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/plumbline/{name}"
    rows.repartition(buckets, "slot").write.format("parquet").option("path", path).bucketBy(buckets, "slot").sortBy("slot").saveAsTable(name)
    rows = spark.table(name)
    known = rows.filter("doc IS NOT NULL")
    suffixes = size // WORD_BYTES
    most = max(SUFFIXES, suffixes // GROUPS)
    groups = max(16, suffixes // most)

    def shared(rows: DataFrame, collect, label: str) -> DataFrame:
        found = rows.mapInArrow(_key_batches(collect, groups), SENT).groupBy("bucket").applyInArrow(_shared(groups), FOUND)
        return materialize(found.groupBy("bucket").applyInArrow(_gathered, LISTS), label)

    def listed(keys: DataFrame) -> DataFrame:
        return known.join(keys.hint("merge"), F.col("slot") == F.col("d")).select("doc", "text", "keys")

    grams = shared(known.select("doc", "text"), _grams, "suffix-grams")
    windows = shared(listed(grams), _paths, "suffix-windows")
    drop(grams)
    left = listed(windows)

    # a prefix of more than an eighth of a group's suffixes is lengthened; parts with few of them needn't tell
    parts = suffixes // FLUSH + buckets
    counts = left.mapInArrow(_count_batches(max(1, most // (8 * parts))), "length long, prefix long, n long").groupBy("length", "prefix").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "suffix-prefixes")
    many = counts.filter(f"length = 0 OR length > 0 AND n >= {most // 8}").collect()
    book = np.sort(np.array([r.prefix for r in counts.filter("length = -1").orderBy(F.desc("n"), "prefix").limit(CODES).collect()], np.int64).view(np.uint64))
    long = [np.sort(np.array([r.prefix for r in many if r.length == d], np.int64).view(np.uint64)) for d in range(GRAM + 1)]
    trees = max(16, -(-4 * sum(r.n for r in many if r.length == 0) // most))
    drop(counts)
    sent = left.mapInArrow(_send_batches(long, book, trees), SENT).groupBy("bucket").applyInArrow(_repeated(book, groups), FOUND)
    found = materialize(sent.groupBy("bucket").applyInArrow(_gathered, LISTS), "suffix-nodes")
    drop(windows)

    def clear() -> None:
        drop(found)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(spark, path)

    of = lambda c: F.when(F.col("doc").isNotNull(), F.col(c)).alias(c)
    return rows.join(found.hint("merge"), F.col("slot") == F.col("d"), "left").select("doc", "text", of("keys"), of("places")), clear


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_removed, the kept words joined by spaces, and the cut passages (first word, end).

    The tables behind the result stay until the shared folder is cleared.
    """
    marked, _ = _marked(docs, id_col, text_col)
    return marked.mapInArrow(_cut_batches(True), "doc long, n_words long, n_removed long, kept string, passages array<struct<start:int,end:int>>").withColumnRenamed("doc", id_col)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its words, the words under repeats of earlier documents, and a digest of the rest."""
    marked, clear = _marked(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id", "text")
    out = materialize(marked.mapInArrow(_cut_batches(False), "doc_id long, n_words long, n_removed long, kept_sha256 string"), "suffix-cut")
    clear()
    return out
