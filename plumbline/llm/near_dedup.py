"""MinHash near-duplicate detection on bottom-k sketches.

One hash function ranks the distinct five-word shingles of a text; the ``k`` smallest hashes are its sketch (the whole
set where that is no larger). Texts with equal sets are one class and are handled once. Inverted lists of the retained
values give candidates: values held by one class only are dropped, the others are ordered by how many classes hold
them, and a class enters the lists of its rarest values only, as many as any partner must share one of (``T`` of
``k`` sketch values agree for a partner at similarity 0.75 but for a chance below 1e-5; sets no larger than the sketch
are treated exactly). In each list every member is first compared with one central member, then with a few; lists that this does not bring into one component
give all pairs of members of different components, unless the shingles that nobody else in such lists has already rule a
pair out. Each pair passes a filter that estimates the overlap on the union sketch, and then the exact Jaccard
similarity of the full sets decides.

Cases: null or empty texts and texts without words have no shingles and are linked with nothing; fewer than five words
make one shingle; repeated rows share a class, and rows with one id count as one document; an empty table gives an empty table; columns other than the id and the
text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import drop, gram_hashes, hot_join, lean, materialize, mix, slices, spans, text_buffers, whole_grams, word_hashes

#: Retained hash values, and how many of them a partner shares at least.
K, T = 64, 32
WORDS = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: In a list that holds several components, how many of its most central members are compared with all others, wave by
#: wave; the last wave compares all that are left.
WAVES = (1, 8, None)
#: Members of a list that the last wave compares at once, in a block.
BLOCK = 512


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each row, sorted by row and hash."""
    s, e, row = spans(data, offsets)
    w = word_hashes(data, s, e, lower=True)
    at = whole_grams(row, WORDS)
    h, hrow = gram_hashes(w, WORDS)[at], row[at]
    count = np.bincount(row, minlength=len(offsets) - 1)
    short = np.flatnonzero((count > 0) & (count < WORDS))
    if len(short):
        begin = np.concatenate(([0], np.cumsum(count)))
        whole = np.array([mix(np.array([np.sum(w[begin[r] : begin[r + 1]] * np.arange(3, 3 + 2 * count[r], 2, dtype=np.uint64)) + np.uint64(count[r])], np.uint64))[0] for r in short], np.uint64)
        h, hrow = np.concatenate((h, whole)), np.concatenate((hrow, short))
        order = np.argsort(hrow, kind="stable")
        h, hrow = h[order], hrow[order]
    begin = np.searchsorted(hrow, np.arange(len(offsets)))
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (hrow[1:] != hrow[:-1])
    return hrow[keep], h[keep]


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        for i, j, part, off in slices(data, offsets):
            row, h = shingle_sets(part, off)
            n = np.bincount(row, minlength=j - i).astype(np.int64)
            begin = np.concatenate(([0], np.cumsum(n)))
            keep = np.arange(len(h)) - begin[row] < K
            marks = [np.zeros(len(h) + 1, np.uint64) for _ in range(2)]
            for m, c in zip(marks, (0x632BE59BD9B4E019, 0x8CB92BA72F3D8DD7), strict=True):
                np.cumsum(mix(h ^ np.uint64(c)), out=m[1:])
            f = [(m[begin[1:]] - m[begin[:-1]]).view(np.int64) for m in marks]
            sizes = np.concatenate(([0], np.cumsum(np.minimum(n, K)))).astype(np.int32)
            sketch = pa.ListArray.from_arrays(pa.array(sizes), pa.array(h[keep].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), pa.array(f[0]), pa.array(f[1]), sketch], ["doc", "n", "f1", "f2", "sketch"])


def _jaccard_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b and the two texts in; the pairs that are linked out."""
    for batch in batches:
        sides = [text_buffers(batch.column(k)) for k in (2, 3)]
        both = sides[0][1] + sides[1][1]
        n, i, keep = batch.num_rows, 0, []
        while i < n:
            j = max(i + 1, int(np.searchsorted(both, both[i] + (2 << 20), "right")) - 1)
            keys, sizes = [], []
            for data, off in sides:
                row, h = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i])
                keys.append(mix(h + mix(row.astype(np.uint64) + np.uint64(1))))
                sizes.append(np.bincount(row, minlength=j - i))
                rows = row
            common = np.bincount(rows[np.isin(keys[1], keys[0])], minlength=j - i)
            keep.append(100 * common >= PERCENT * (sizes[0] + sizes[1] - common))
            i = j
        mask = pa.array(np.concatenate(keep) if keep else np.zeros(0, bool))
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(mask) for k in (0, 1)], ["a", "b"])


def _links(pairs: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    small = (F.col("na") <= K) & (F.col("nb") <= K)
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    sketched = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    both = both.withColumn("shared", shared).filter(F.when(small, 100 * F.col("shared") >= PERCENT * (F.col("na") + F.col("nb") - F.col("shared"))).otherwise((F.col("shared") >= T) & (sketched >= T)))
    both = materialize(both.select("a", "b", small.alias("sure")), "near-pairs")
    open_ = both.filter(~F.col("sure")).select("a", "b")
    ids = open_.select(F.col("a").alias("doc")).union(open_.select("b")).distinct()
    texts = materialize(docs.join(ids, "doc", "left_semi"), "near-texts")
    text = lambda x: texts.select(F.col("doc").alias(x), F.col("text").alias(f"t{x}"))
    exact = open_.join(text("a"), "a").join(text("b"), "b").select("a", "b", "ta", "tb").mapInArrow(_jaccard_batches, "a long, b long")
    out = materialize(both.filter("sure").select("a", "b").union(exact), "near-links")
    drop(both, texts)
    return out


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): for every node of a link the smallest node that it reaches.

    Each round gives every node the smallest label next to it and then that label's own label, so the number of rounds
    grows with the logarithm of a component's diameter; each round ends in a table in the shared folder.
    """
    edges = materialize(links.select(F.col(a).alias("x"), F.col(b).alias("y")).union(links.select(b, a)).filter("x <> y").distinct(), "cc-edges")
    labels = materialize(edges.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("label")), "cc-labels")
    while True:
        near = edges.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("label").alias("m"))
        low = labels.join(near, labels.node == near.x).select("node", F.least("label", "m").alias("label"), F.col("label").alias("was"))
        # hook: the old label's node learns the smaller one too
        hook = low.groupBy(F.col("was").alias("h")).agg(F.min("label").alias("via"))
        low = low.join(hook, F.col("node") == F.col("h"), "left").select("node", F.least("label", "via").alias("label"), "was")
        jump = low.select(F.col("node").alias("j"), F.col("label").alias("next"))
        new = materialize(low.join(jump, F.col("label") == F.col("j"), "left").select("node", F.least("label", "next").alias("label"), "was"), "cc-labels")
        moved = new.filter(F.col("label") != F.col("was")).limit(1).count()
        drop(labels)
        labels = new.select("node", "label")
        labels._plumbline_path = new._plumbline_path
        if not moved:
            drop(edges)
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles and component_id (smallest id that it reaches by links, itself included)."""
    lean(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    sets = materialize(docs.mapInArrow(_sketch_batches, "doc long, n long, f1 long, f2 long, sketch array<long>"), "near-sets")
    reps = materialize(sets.filter("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc").alias("rep"), F.first("sketch").alias("sketch")), "near-classes")
    ranked = materialize(_prefixes(reps), "near-prefixes")
    prefix = materialize(_distinct_lists(ranked), "near-lists")
    drop(ranked)
    # only classes in some list are ever compared: their texts are taken out once
    listed = prefix.select(F.col("rep").alias("doc")).distinct().hint("merge")  # grows with the corpus: the same join at every size
    texts = materialize(docs.join(listed, "doc", "left_semi"), "near-texts")
    made, links, tested, labels = [sets, reps, prefix, texts], None, None, None
    for pivots in WAVES:
        pairs = materialize(_star_pairs(prefix) if labels is None else _open_pairs(prefix, labels, tested, pivots, texts, made), "near-candidates")
        made.append(pairs)
        if pairs.isEmpty():
            if prefix.isEmpty():
                break
            if tested is not None:
                continue
        # a first wave without pairs links nothing, and the later waves compare what the lists hold all the same
        tested = pairs if tested is None else tested.union(pairs)
        found = _links(pairs, reps, texts)
        made.append(found)
        links = found if links is None else links.union(found)
        if labels is not None:
            drop(labels)
        labels = components(links)
    member = sets.select("doc", "n", "f1", "f2").join(reps.select("n", "f1", "f2", "rep"), ["n", "f1", "f2"], "left")
    if labels is not None:
        made.append(labels)
        member = member.join(labels, F.col("rep") == F.col("node"), "left")
    else:
        member = member.withColumn("label", F.lit(None).cast("long"))
    out = materialize(member.select("doc", "n", F.coalesce("label", "rep", "doc").alias("component")), "near-components")
    drop(*made)
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def _needed(n: Column) -> Column:
    """Sketch values that a partner shares at least."""
    return F.when(n > K, F.lit(T)).otherwise(F.least(F.ceil(n * PERCENT / 100), F.lit(T)))


def _prefixes(reps: DataFrame) -> DataFrame:
    """(value, rep, n, score): the rarest shared values of each class, as many as the filter needs."""
    postings = reps.select("rep", "n", F.explode("sketch").alias("value"))
    held = materialize(postings.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1"), "near-values")
    shared = hot_join(postings, held, "value", "df", held.agg(F.sum("df")).first()[0] or 0)
    own = Window.partitionBy("rep")
    ranked = shared.select("value", "rep", "n", F.row_number().over(own.orderBy("df", "value")).alias("rank"), F.count("*").over(own).alias("m"), F.sum("df").over(own).alias("score"))
    size = F.least("n", F.lit(K))
    return ranked.filter(F.col("rank") + size - F.col("m") <= size - _needed(F.col("n")) + 1).select("value", "rep", "n", (F.col("score") / size).alias("score"))


def _distinct_lists(prefix: DataFrame) -> DataFrame:
    """One list of those with the same members: the shingles of a shared passage give the same pairs."""
    h = F.xxhash64("rep")
    lists = prefix.groupBy("value").agg(F.count("*").alias("l"), F.bit_xor(h).alias("x"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("s")).filter("l > 1")
    return hot_join(prefix, lists.groupBy("l", "x", "s").agg(F.min("value").alias("value")).select("value", "l"), "value", "l", prefix.count(), "left_semi")


def _near_sizes(a: str, b: str) -> Column:
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _star_pairs(prefix: DataFrame) -> DataFrame:
    """Every member of a list with the list's most central member."""
    centre = prefix.groupBy("value").agg(F.max(F.struct("score", F.col("rep").alias("c"), F.col("n").alias("nc"))).alias("p"), F.count("*").alias("l")).filter("l > 1")
    pairs = hot_join(prefix, centre, "value", "l", prefix.count()).filter((F.col("rep") != F.col("p.c")) & _near_sizes("n", "p.nc"))
    return pairs.select(F.least("rep", "p.c").alias("a"), F.greatest("rep", "p.c").alias("b")).distinct()


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text its whole set, and a bitmap of the 2,048 ranges of hashes that the set touches."""
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        for i, j, part, off in slices(data, offsets):
            row, h = shingle_sets(part, off)
            begin = np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)
            touched = np.zeros((j - i, 2048), np.uint8)
            touched[row, h >> np.uint64(53)] = 1
            bits = np.packbits(touched, axis=1).view(np.int64).ravel()
            lists = [pa.ListArray.from_arrays(pa.array(o), pa.array(v)) for o, v in ((begin, h.view(np.int64)), (np.arange(0, 32 * (j - i) + 1, 32, dtype=np.int32), bits))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *lists], ["own", "set", "bits"])


def _own(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(own, bits, alone): bitmaps of the sets, and how many shingles of each of ``reps`` no other of them has."""
    held = materialize(docs.join(reps.select(F.col("rep").alias("doc")), "doc", "left_semi").mapInArrow(_set_batches, "own long, set array<long>, bits array<long>"), "near-whole")
    alone = held.select("own", F.explode("set").alias("value")).groupBy("value").agg(F.count("*").alias("df"), F.first("own").alias("own")).filter("df = 1")
    return held.select("own", "bits").join(alone.groupBy("own").agg(F.count("*").alias("alone")), "own", "left")


def _block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two blocks of members of one list a row; out come the pairs of different components that the bounds leave open."""
    for batch in batches:
        sides = []
        for k in ("x", "y"):
            column = batch.column(batch.schema.get_field_index(k))
            flat, begin = column.flatten(), np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))))
            get = lambda c, flat=flat: flat.field(c).to_numpy(zero_copy_only=False)
            sides.append((begin, get("rep"), get("n"), get("most"), get("label"), flat.field("bits").flatten().to_numpy(zero_copy_only=False).reshape(-1, 32)))
        same = batch.column(batch.schema.get_field_index("same")).to_numpy(zero_copy_only=False)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for r in range(batch.num_rows):
            (ra, na, ma, la, ba), (rb, nb, mb, lb, bb) = ([c[s[0][r] : s[0][r + 1]] for c in s[1:]] for s in sides)
            if same[r] and (la == la[0]).all():
                continue
            ua, ub = (np.unpackbits(np.ascontiguousarray(b).view(np.uint8), axis=1).astype(np.float32) for b in (ba, bb))
            both = ua @ ub.T
            most = np.minimum(na[:, None] - ua.sum(1)[:, None] + both, nb[None, :] - ub.sum(1)[None, :] + both)
            most = np.minimum(most, np.minimum(ma[:, None], mb[None, :]))
            open_ = (100 * most >= PERCENT * (na[:, None] + nb[None, :] - most)) & (la[:, None] != lb[None, :])
            if same[r]:
                open_ = np.triu(open_, 1)
            p, q = np.nonzero(open_)
            out.append((np.minimum(ra[p], rb[q]), np.maximum(ra[p], rb[q])))
        a, b = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _open_pairs(prefix: DataFrame, labels: DataFrame, tested: DataFrame, pivots: int | None, docs: DataFrame, made: list[DataFrame]) -> DataFrame:
    """Pairs of different components in lists that still hold several; tables go to ``made``."""
    known = prefix.join(labels, F.col("rep") == F.col("node"), "left").select("value", "rep", "n", "score", F.coalesce("label", "rep").alias("label"))
    mixed = known.groupBy("value").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("l")).filter("lo <> hi")
    known = materialize(hot_join(known, mixed.select("value", "l"), "value", "l", prefix.count()).withColumn("part", F.pmod(F.xxhash64("rep"), F.ceil(F.col("l") / BLOCK))), "near-open")
    made.append(known)
    if pivots is not None:
        # the first of each part of a list, and of those the first of the list
        for by in (["value", "part"], ["value"]):
            rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "rep"))
            left = (known if by[1:] else left).withColumn("r", rank).filter(F.col("r") <= pivots).drop("r")
        left = left.select("value", "l", *(F.col(c).alias(f"{c}_a") for c in ("rep", "n", "label")))
        right = known.select("value", *(F.col(c).alias(f"{c}_b") for c in ("rep", "n", "label")))
        cross = hot_join(right, left, "value", "l", known.count()).filter((F.col("label_a") != F.col("label_b")) & _near_sizes("n_a", "n_b"))
        pairs = cross.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"))
    else:
        # an intersection holds no shingle that only one list member has, and none in a range that the partner doesn't touch
        bounds = known.join(_own(known.select("rep").distinct(), docs), F.col("rep") == F.col("own"))
        member = F.struct("rep", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("most"), "label", "bits")
        blocks = materialize(bounds.groupBy("value", "part").agg(F.collect_list(member).alias("m"), F.ceil(F.first("l") / BLOCK).alias("parts")), "near-blocks")
        made.append(blocks)
        # each pair of a list's blocks meets under its own key
        lower, upper = F.sequence(F.col("part"), F.col("parts") - 1), F.sequence(F.lit(0).cast("long"), F.col("part"))
        x = blocks.select("value", F.col("part").alias("kx"), F.explode(lower).alias("ky"), F.col("m").alias("x"))
        y = blocks.select("value", F.col("part").alias("ky"), F.explode(upper).alias("kx"), F.col("m").alias("y"))
        pairs = x.join(y, ["value", "kx", "ky"]).select("x", "y", (F.col("kx") == F.col("ky")).alias("same")).mapInArrow(_block_batches, "a long, b long")
    return pairs.distinct().join(tested, ["a", "b"], "left_anti")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its shingle set, its component, and whether it stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
