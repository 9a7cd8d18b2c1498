"""Collocations: phrases whose words come together more often than their parts suggest, mined by sorted suffixes.

Every word of a piece starts a suffix of at most LONGEST words. Suffixes are dealt by language and first word, sorted in
reverse lexicographic order, and one pass with a stack of LONGEST open prefixes counts every phrase; the frequencies of a
phrase's parts are joined afterwards. Equal suffixes are counted before the shuffle, and suffixes with one first word and
one count travel as one row. A first word with more than one in HOT_SHARE of all occurrences (and more
than PART_WORDS) is dealt further by a hash of the words after it; the partial counts of its prefixes are added up
afterwards, all others are whole. The table of such words has at most HOT_SHARE rows.

The score of a phrase is the lowest of its cuts, floor(scale * a / (l + r)), by decimals of 38 digits. A phrase goes if a
longer phrase that holds it is nearly as frequent.

Cases: null texts are empty; a null language is ``und`` and counts with rows that say so; repeated rows count each;
scores that tie go by frequency, then by the phrase's bytes; a text without words has no phrases; a table without phrases
gives no rows; columns other than language and text are not read, whatever their names. A text of more than GATHER words
is cut into runs, which overlap so that no suffix is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import drop, hot_join, materialize, running_hash, slices, span_hashes, spans, text_buffers

#: Most words of a phrase, its least frequency, phrases that each language reports.
LONGEST, LEAST, TOP = 4, 30, 2_000
#: A longer phrase with at least so many in a hundred of the frequency stands for the shorter.
COVER = 80
#: What the score counts in: 1,000,000 where neither part occurs without the other.
SCALE = 2_000_000
#: First words that are dealt further: more occurrences than PART_WORDS and than one in HOT_SHARE.
PART_WORDS, HOT_SHARE = 1 << 17, 20_000
#: Words whose suffixes a worker gathers before the shuffle, suffixes that it counts at once after it, and runs copied at once.
GATHER, TOGETHER, BLOCK = 1 << 18, 1 << 18, 1 << 16
#: Groups per language of the first of two rankings.
RANK_GROUPS = 1_024

_END = np.zeros(256, bool)
_END[[ord(c) for c in ".,;:!?"]] = True
_END[0x0A:0x0E] = True
_BREAK = _END.copy()
_BREAK[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _strings(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.Array:
    """The runs of bytes from ``s`` to ``e`` as an Arrow string column; indices are made for BLOCK runs at a time."""
    size = e - s
    off = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    out = np.empty(off[-1], np.uint8)
    for a in range(0, len(s), BLOCK):
        b = min(len(s), a + BLOCK)
        out[off[a] : off[b]] = data[np.arange(off[a], off[b]) + np.repeat(s[a:b] - off[a:b], size[a:b])]
    return pa.LargeStringArray.from_buffers(len(s), pa.py_buffer(off), pa.py_buffer(out)).cast(pa.string())


def _order(first: np.ndarray, levels: list[np.ndarray], size: int) -> np.ndarray:
    """Order by ``first`` and then by the levels, whose numbers are below ``size``; as one number where they fit into it."""
    keys = levels
    if size ** len(levels) < 1 << 62:
        keys = [np.zeros(len(first), np.int64)]
        for v in levels:
            keys[0] = keys[0] * size + v
    return np.lexsort((*keys[::-1], first))


class _Words:
    """Words of one or more runs of texts, each ended by a tab in ``line``: a suffix is one run of its bytes.

    ``code`` numbers equal words alike, ``words`` holds them by number; ``lang`` is a number of ``langs``; ``reach`` says how many
    words follow in the same piece, up to ``longest`` - 1; ``own`` are the words from which suffixes start.
    """

    def __init__(self, runs: list[tuple], langs: list[str], longest: int):
        data, size = np.concatenate([r[0] for r in runs]), np.concatenate([r[2] - r[1] for r in runs])
        base = np.concatenate(([0], np.cumsum([len(r[0]) for r in runs])))
        start = np.concatenate([r[1] + k for r, k in zip(runs, base, strict=False)])
        self.begin = np.concatenate(([0], np.cumsum(size + 1)))
        self.line = np.full(self.begin[-1], 9, np.uint8)
        for a in range(0, len(size), BLOCK):
            z, s, t = size[a : a + BLOCK], start[a : a + BLOCK], self.begin[a : a + BLOCK + 1]
            at = np.arange(z.sum()) - np.repeat(np.cumsum(z) - z, z)
            self.line[at + np.repeat(t[: len(z)], z)] = _LOWER[data[at + np.repeat(s, z)]]
        self.langs, self.lang = langs, np.concatenate([r[3] for r in runs])
        coded = _strings(self.line, self.begin[:-1], self.begin[1:] - 1).dictionary_encode()
        self.words, self.code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        joined = np.concatenate([r[4] for r in runs])  # with the word after it, in one piece
        self.own = np.flatnonzero(np.concatenate([r[5] for r in runs]))
        self.reach, further = np.zeros(len(size), np.int64), np.ones(len(size), bool)
        for k in range(longest - 1):
            further[: len(further) - k] &= joined[k:]
            further[len(further) - k :] = False
            self.reach += further

    def firsts(self) -> np.ndarray:
        """A number for language and first word of the own words."""
        return self.code[self.own] * len(self.langs) + self.lang[self.own]


def _gathered(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[_Words]:
    """The words of (lang, text), about GATHER at a time. A longer text is cut; cuts overlap by ``longest`` - 1 words."""
    runs, n, number = [], 0, {}
    for batch in batches:
        coded = batch.column(0).dictionary_encode()
        spoken = np.array([number.setdefault(k, len(number)) for k in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
        data, offsets = text_buffers(batch.column(1))
        for i, _, part, off in slices(data, offsets):
            s, e, row = spans(part, off, _BREAK)
            if not len(s):
                continue
            piece = np.cumsum(_END[part], dtype=np.int32)[s]
            joined = np.zeros(len(s), bool)
            joined[:-1] = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
            for a in range(0, len(s), GATHER):
                b = min(len(s), a + GATHER)
                c = min(len(s), b + longest - 1)
                follows = joined[a:c].copy()
                follows[-1] = False
                runs.append((part[s[a] : e[c - 1]], s[a:c] - s[a], e[a:c] - s[a], spoken[row[a:c] + i], follows, np.arange(c - a) < b - a))
                n += b - a
                if n >= GATHER:
                    yield _Words(runs, list(number), longest)
                    runs, n = [], 0
    if runs:
        yield _Words(runs, list(number), longest)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, word, c), counted within each part."""
    for w in _gathered(batches, 1):
        first, c = np.unique(w.firsts(), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(w.langs).take(pa.array(first % len(w.langs))), w.words.take(pa.array(first // len(w.langs))), pa.array(c)], ["lang", "word", "c"])


def suffixes(hot: dict[tuple[str, str], int], longest: int = LONGEST):
    """(lang, text) to rows (lang, first, salt, split, c, rests): the suffixes with one first word and one count ``c``.

    ``rests`` holds the words after the first, each ended by a tab, one suffix a line. ``hot``: parts of each hot first word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in _gathered(batches, longest):
            first, own = w.firsts(), w.own
            levels = [np.where(w.reach[own] >= k, w.code[np.minimum(own + k, len(w.code) - 1)] + 1, 0) for k in range(1, longest)]
            order = _order(first, levels, len(w.words) + 1)
            first, at = first[order], own[order]
            start = np.flatnonzero(np.append(True, np.logical_or.reduce([x[1:] != x[:-1] for x in (first, *(v[order] for v in levels))])))
            c = np.diff(np.append(start, len(order)))
            first, at = first[start], at[start]
            low, high = w.begin[at + 1], w.begin[at + w.reach[at] + 1]
            salt = np.full(len(at), -1, np.int32)
            if hot:
                known, back = np.unique(first, return_inverse=True)
                words = w.words.take(pa.array(known // len(w.langs))).to_pylist()
                parts = np.array([hot.get((w.langs[k], word), 0) for k, word in zip((known % len(w.langs)).tolist(), words, strict=True)], np.int64)[back]
                split = np.flatnonzero(parts)
                if len(split):
                    salt[split] = (span_hashes(running_hash(w.line), low[split], high[split]) % parts[split].astype(np.uint64)).astype(np.int32)
            # those with one count and no salt are in order already
            plain = (c == 1) & (salt < 0)
            more = np.flatnonzero(~plain)
            seq = np.concatenate((np.flatnonzero(plain), more[np.lexsort((c[more], salt[more], first[more]))]))
            first, salt, c, low, high = first[seq], salt[seq], c[seq], low[seq], high[seq]
            cut = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (salt[1:] != salt[:-1]) | (c[1:] != c[:-1])))
            rests = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(cut, len(seq)), pa.int32()), _strings(w.line, low, high)), "\n")
            lang, word = pa.array(w.langs).take(pa.array(first[cut] % len(w.langs))), w.words.take(pa.array(first[cut] // len(w.langs)))
            t = pa.table({"lang": lang, "first": word, "salt": salt[cut], "split": salt[cut] >= 0, "c": c[cut], "rests": rests})
            yield from t.to_batches(max_chunksize=20_000)

    return run


def _prefixes(t: pa.Table, whole: bool, longest: int, least: int) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, words, f) of the prefixes of the suffixes in ``t`` (lang, first, split, c, rests), whose first words are together.

    Suffixes are sorted reverse-lexicographically. The stack of open prefixes is kept for all of them at once: a level is popped
    where a suffix differs from the one before it in one of the level's words. Frequencies under ``least`` are left out where
    they are whole: for words that aren't split in ``whole`` tables, and for the longest phrases of others.
    """
    first, lang = t.column("first").combine_chunks(), t.column("lang").combine_chunks()
    new = np.ones(len(t), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in (k.dictionary_encode().indices.to_numpy() for k in (first, lang))])
    lines = pc.split_pattern(t.column("rests").combine_chunks(), "\n")
    parent = pc.list_parent_indices(lines).to_numpy()
    lists = pc.split_pattern(lines.flatten(), "\t")  # each ends with an empty element
    off = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    length = np.diff(off)  # words of the rest and one more: words of the suffix
    coded = lists.flatten().dictionary_encode()
    size = len(coded.dictionary)
    place = np.empty(size, np.int64)
    place[pc.sort_indices(coded.dictionary, sort_keys=[("", "descending")]).to_numpy()] = np.arange(size)
    word = place[coded.indices.to_numpy()]
    levels = []
    for k in range(1, longest):
        v = np.full(len(length), size, np.int64)  # no word comes last: a prefix after what it begins
        has = np.flatnonzero(length > k)
        v[has] = word[off[has] + k - 1]
        levels.append(v)
    group = np.cumsum(new)[parent]
    order = _order(group, levels, size + 1)
    parent, length = parent[order], length[order]
    c = t.column("c").combine_chunks().to_numpy()[parent].astype(np.int64)
    part = t.column("split").combine_chunks().to_numpy(zero_copy_only=False)[parent]
    pop = np.append(True, group[order][1:] != group[order][:-1])
    for m in range(1, longest + 1):
        if m > 1:
            v = levels[m - 2][order]
            pop[1:] |= v[1:] != v[:-1]
        rows = np.flatnonzero(length >= m)
        if not len(rows):
            return
        start = np.flatnonzero(pop[rows])
        f, at = np.add.reduceat(c[rows], start), rows[start]
        if whole:
            keep = f >= least if m == longest else (f >= least) | part[at]
            f, at = f[keep], at[keep]
        phrase = first.take(pa.array(parent[at]))
        if m > 1:
            phrase = pc.binary_join_element_wise(phrase, pc.binary_join(pc.list_slice(lists.take(pa.array(order[at])), 0, m - 1), " "), " ")
        yield pa.RecordBatch.from_arrays([lang.take(pa.array(parent[at])), phrase, pa.array(np.full(len(at), m, np.int32)), pa.array(f)], ["lang", "phrase", "words", "f"])


def count_prefixes(longest: int = LONGEST, least: int = LEAST):
    """Rows (lang, first, split, c, rests) in order of first word and language to (lang, phrase, words, f).

    Whole first words are counted together, about TOGETHER suffixes at a time; one with more than that is counted in parts, none
    of which is held to ``least``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        n, broken = 0, None  # suffixes held, and the first word that was counted in part already
        key = lambda t, i: (t.column("first")[i].as_py(), t.column("lang")[i].as_py())

        def counted(t: pa.Table) -> Iterator[pa.RecordBatch]:
            """Whole words together, but the rows of ``broken`` (at the beginning) by themselves."""
            k = 0
            if broken is not None and len(t) and key(t, 0) == broken:
                same = np.logical_and(pc.equal(t.column("first"), broken[0]).to_numpy(), pc.equal(t.column("lang"), broken[1]).to_numpy())
                k = len(t) if same.all() else int(np.argmin(same))
                yield from _prefixes(t.slice(0, k), False, longest, least)
            if k < len(t):
                yield from _prefixes(t.slice(k), True, longest, least)

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            held.append(t)
            n += int(pc.sum(pc.count_substring(t.column("rests"), "\n")).as_py()) + len(t)
            if n < TOGETHER:
                continue
            t = pa.concat_tables(held)
            last = key(t, len(t) - 1)
            same = np.logical_and(pc.equal(t.column("first"), last[0]).to_numpy(), pc.equal(t.column("lang"), last[1]).to_numpy())
            begin = int(np.argmax(same))
            yield from counted(t.slice(0, begin))
            t = t.slice(begin)
            n = int(pc.sum(pc.count_substring(t.column("rests"), "\n")).as_py()) + len(t)
            held = [t]
            if n >= TOGETHER:
                yield from _prefixes(t, False, longest, least)
                held, n, broken = [], 0, last
        if held:
            yield from counted(pa.concat_tables(held))

    return run


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of 1 to ``longest`` words with f >= least, and (lang, n), the words of each language.

    Both are tables in the shared folder.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": "20000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
    before = {k: spark.conf.get(k) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        words = materialize(texts.mapInArrow(count_words, "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("c")), "words")
        sizes = materialize(words.groupBy("lang").agg(F.sum("c").alias("n")), "word-sizes")
        total = sizes.agg(F.sum("n")).first()[0] or 0
        part = max(PART_WORDS, total // HOT_SHARE)
        hot = {(r.lang, r.word): -(-r.c // part) for r in words.filter(F.col("c") > part).collect()}
        drop(words)
        dealt = texts.mapInArrow(suffixes(hot, longest), "lang string, first string, salt int, split boolean, c long, rests string").repartition("lang", "first", "salt")
        rows = dealt.select("first", "lang", "split", "c", "rests").sortWithinPartitions("first", "lang")
        counts = rows.mapInArrow(count_prefixes(longest, least), "lang string, phrase string, words int, f long")
        counts = counts.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
        return materialize(counts, "phrases"), sizes
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def collocations(phrases: DataFrame, longest: int = LONGEST, cover: int = COVER, scale: int = SCALE) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two words or more that no longer one covers."""
    long = phrases.filter(F.col("words") > 1).withColumn("w", F.split("phrase", " "))
    piece = lambda i, n: F.array_join(F.slice("w", i, n), " ")
    ways = [F.when(F.col("words") > k, F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), part.alias("part"))) for k in range(1, longest) for side, part in (("l", piece(F.lit(1), F.lit(k))), ("r", piece(F.lit(k + 1), F.greatest(F.col("words") - k, F.lit(0)))))]
    asks = long.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.filter(F.array(*ways), lambda x: x.isNotNull())).alias("way")).select("lang", "phrase", "a", "way.*")
    held = asks.groupBy("lang", "part").agg(F.count("*").alias("held"))
    total = phrases.filter(F.col("words") > 1).agg(F.sum((F.col("words") - 1) * 2)).first()[0] or 0
    known = held.join(phrases.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    parts = hot_join(asks, known, ["lang", "part"], "held", total).select("lang", "phrase", "a", "k", "side", "f")
    inner = [F.when(F.col("words") > n, F.when(F.col("words") >= n + i - 1, piece(F.lit(i), F.lit(n)))) for n in range(2, longest) for i in range(1, longest - n + 2)]
    covers = long.select("lang", F.explode(F.filter(F.array(*inner), lambda x: x.isNotNull())).alias("phrase"), F.lit(None).cast("long").alias("a"), F.lit(0).alias("k"), F.lit("c").alias("side"), "f")
    found = [F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f"))).alias(f"{side}{k}") for k in range(1, longest) for side in "lr"]
    whole = parts.unionByName(covers).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max(F.when(F.col("side") == "c", F.col("f"))).alias("longer"), *found)
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    whole = whole.filter(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * cover))
    # a cut that the phrase doesn't have is null, and least passes over nulls
    cuts = [F.when(F.col(f"l{k}").isNotNull(), F.struct(F.expr(f"(cast(a as decimal(20,0)) * cast({scale} as decimal(8,0))) div (cast(l{k} as decimal(20,0)) + cast(r{k} as decimal(20,0)))").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, longest)]
    return whole.select("lang", "phrase", "a", F.array_min(F.array(*cuts)).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def ranked(found: DataFrame, sizes: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language with rank and n; ranked within groups first, so that no task gets a language whole."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    near = found.withColumn("near", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_GROUPS))).orderBy(*order))).filter(F.col("near") <= top)
    last = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return last.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's strongest phrases."""
    phrases, sizes = phrase_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))
    out = materialize(ranked(collocations(phrases), sizes), "collocations")
    drop(phrases, sizes)
    return out


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
lines AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM lines, range(1, 5) t(m)),
f AS (SELECT lang, phrase, m, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
cand AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 30),
cuts AS (SELECT lang, phrase, m, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:m], ' ') AS tail FROM cand, range(1, 4) t(k) WHERE k < m),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f + y.f))::BIGINT AS score, k
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS longer FROM cand, range(2, 4) t(s), range(1, 4) u(i) WHERE s < m AND i + s - 1 <= m GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""
