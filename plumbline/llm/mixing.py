"""Mixing sources to target weights by systematic sampling.

Within a source every document has the same expected number of copies, target / size of the source. The documents are
put in order, their expected copies are summed along it, a random offset (the same on each run) is added, and a document
is taken once for each integer that its part of the running sum crosses. The order is by size class first, so that the
words taken miss the target by no more than about the longest document of the source.

The running sum needs each document's rank in its source. Ranks come from counts of cells (source, size class, leading
digits of the id's MD5), so that no task handles a whole source: the number of digits follows the number of rows. Only
ids, sources and sizes are shuffled, not texts.

Cases: null texts and texts without words have size 0 and are taken like others, adding no words; a null source is a
source of its own, ordered last; rows without an id are ordered by their texts; of rows with equal ids and sizes which one
is taken in the plan is not defined, but how many is, and of those with equal ids and texts the mix takes them in the
order of a hash of all columns; with no words at all nothing is taken; an empty table gives an empty table; other columns
are kept as they are, whatever their names (a map can't be hashed: such columns don't count in that order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, materialize

#: A source gives at most this many times its size.
REPEAT = 3
#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Rows of a cell, about.
CELL_ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shares(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeat: int = REPEAT) -> DataFrame:
    """``sizes`` (source, source_size) with target: all words shared by weight, no target above ``repeat`` times its source.

    What a source cannot take is shared among the others by weight, until none is above: the sources at their limit are
    those with the smallest limit per weight, so one pass in that order finds the level at which the rest stand. The
    windows run over one row per source.
    """
    everything = Window.partitionBy(F.lit(0))
    place = F.row_number().over(everything.orderBy(F.col("source").isNull(), "source")) - 1
    w = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double"))
    w = w.withColumn("cap", F.col("source_size").cast("double") * repeat)
    order = everything.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything).cast("double")
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    w = w.withColumn("level", level)
    # the first source in this order that stays below its limit sets the level
    free = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), "source", "level"))).over(everything)
    return w.withColumn("target", F.least("cap", F.coalesce(free["level"], F.lit(0.0)) * F.col("w"))).select("source", "source_size", "w", "target")


def _size_class(size: Column) -> Column:
    """Sizes within about six percent share a class; classes are ordered as sizes."""
    bits = F.length(F.bin(size))
    return F.when(size < 16, size).otherwise(bits * 16 + F.expr("shiftright(size, cast(length(bin(size)) as int) - 5)") - 16)


def sample_copies(rows: DataFrame, rates: DataFrame, seed: int = 1) -> DataFrame:
    """``rows`` (id, source, size, order) with copies; ``rates`` gives each source's expected copies of a document.

    ``order`` is a hash of the id in hexadecimal digits, or of the text where there is no id.
    """
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    rows = rows.select("*", key.alias("key"), _size_class(F.col("size")).alias("class"))
    digits, n = 0, rows.count()
    while n > CELL_ROWS * 16**digits:
        digits += 1
    rows = rows.withColumn("cell", F.substring("order", 1, digits))
    cells = rows.groupBy("key", "class", "cell").agg(F.count("*").alias("c"))
    classes = cells.groupBy("key", "class").agg(F.sum("c").alias("c"))
    earlier = lambda by, over: F.coalesce(F.sum("c").over(Window.partitionBy(*by).orderBy(over).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    classes = classes.select("key", "class", earlier(["key"], "class").alias("class_base"))
    cells = cells.select("key", "class", "cell", earlier(["key", "class"], "cell").alias("cell_base"))
    base = cells.join(classes, ["key", "class"]).select("key", "class", "cell", (F.col("class_base") + F.col("cell_base")).alias("base"))
    rates = rates.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("key"), "rate", _offset(F.col("source"), seed).alias("u"))
    inner = F.row_number().over(Window.partitionBy("key", "class", "cell").orderBy("order", "id"))
    ranked = rows.withColumn("inner", inner).join(base, ["key", "class", "cell"]).withColumn("rank", F.col("base") + F.col("inner"))
    crossed = lambda r: F.floor(r * F.col("rate") + F.col("u"))
    return ranked.join(rates, "key").withColumn("copies", crossed(F.col("rank")) - crossed(F.col("rank") - 1)).drop("key", "class", "cell", "order", "inner", "base", "rank", "u")


def _offset(source: Column, seed: int) -> Column:
    """A number in [0, 1) for each source and seed."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit(""))).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def mix_plan(docs: DataFrame, id_col: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, repeat: int = REPEAT, seed: int = 1) -> DataFrame:
    """Per row of ``docs``: id, source, size, row_hash (of id and text), source_size, target, copies, taken."""
    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("t"), F.coalesce("text", F.lit("")))).cast("binary"))
    rows = materialize(docs.select(F.col(id_col).alias("id"), "source", word_count(F.col("text")).alias("size"), _row_hash(docs, id_col).alias("row_hash"), order.alias("order")), "sizes")
    plan = materialize(shares(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeat), "shares")
    rates = plan.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    got = sample_copies(rows, rates, seed).drop("rate")
    got = got.join(F.broadcast(plan.select(F.col("source").alias("s"), "source_size", "target")) if plan.count() <= 100_000 else plan.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    return got.withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mixed rows: each document as often as the plan takes it, with all its columns."""
    plan = mix_plan(docs, id_col, **options).groupBy("row_hash").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).filter("copies > 0")
    hashed = [f for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    every = F.xxhash64(*(F.col(f"`{f.name}`") for f in hashed))
    found = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), _row_hash(docs, id_col).alias("row_hash"), every.alias("every")).join(plan, "row_hash")
    # equal rows share their copies
    place = F.row_number().over(Window.partitionBy("row_hash").orderBy("every"))
    own = F.floor(F.col("copies") / F.col("rows")) + F.when(place <= F.col("copies") % F.col("rows"), 1).otherwise(0)
    found = found.withColumn("own", own.cast("int")).filter("own > 0")
    return found.select("row", F.explode(F.sequence(F.lit(1), F.col("own")))).select("row.*")


def _row_hash(docs: DataFrame, id_col: str) -> Column:
    return F.xxhash64(docs[id_col], docs["text"])


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_plan(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
p AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
        source_size::DOUBLE * 3 AS cap FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM p),
f AS (SELECT coalesce(min_by(level, cap / w) FILTER (level * w <= cap), 0) AS free FROM l),
t AS (SELECT source, source_size, least(cap, free * w) AS target,
        ('0x' || substr(md5('1:' || coalesce(source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM l, f),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
        row_number() OVER (PARTITION BY d.source ORDER BY CASE WHEN d.size < 16 THEN d.size ELSE length(bin(d.size)) * 16 + (d.size >> (length(bin(d.size)) - 5)::BIGINT) - 16 END, md5(coalesce(d.doc_id::VARCHAR, 't' || coalesce(d.text, ''))), d.doc_id) AS rank
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(rank * rate + u) - floor((rank - 1) * rate + u)) * size)::BIGINT AS taken FROM r
"""
