"""URL filtering by a cascade of Bloom filters.

Rules are keys host + path. A URL's candidate keys are every suffix of its host at a label boundary joined with every
prefix of its path that is as long as some rule's path. Over the complete set of candidate keys of the corpus the cascade
is exact: the first level holds the listed keys, the second those unlisted keys that pass the first, the third the
listed keys that pass the second, and so on until a level lets nothing wrong through. Looking a key up then takes a few
bit tests on constants in the plan and no join. One cascade tells the keys of rules from all others; a second, whose
universe is the rules' keys, tells those to allow from those to block.

A level is a list of blocks of 32,768 bits, built with Spark's bitmap aggregates; a key's block and bits come from
xxHash64 with the level's number as salt. Its size follows the number of keys that it holds (the listed ones, or wrong
passes, which the first level's rate keeps below the number of listed ones), never the corpus. MAX_BLOCKS bounds it, as
constants travel with each task; a list too large for that is looked up by joins with the rules instead.

Cases: a null URL or one without ``://`` has an empty host and path and matches nothing; repeated rows are judged
alike; of rules that fit the longest wins, of equally long ones the one with the longer host, and of equal keys the one
to allow, whichever way a list of that size is looked up; an empty table or an empty list of
rules gives no matches; columns named host, path, rule or verdict are replaced, other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import drop, materialize, others, packed

#: The rules of the query: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: The verdict for URLs that no rule fits.
DEFAULT = "allow"
BITS, HASHES, MAX_BLOCKS, MAX_LEVELS = 32_768, 5, 256, 40
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """All keys that a rule fitting this host and path can have."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    fitting = F.filter(F.array(*map(F.lit, lengths)), lambda k: k <= F.length(path))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(fitting, lambda k: F.concat(s, F.left(path, k)))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(keys)


class Level:
    """One Bloom filter: blocks of bits as constants."""

    def __init__(self, salt: int, blocks: dict[int, bytes], n_blocks: int):
        self.salt, self.blocks, self.n_blocks = salt, blocks, n_blocks

    @staticmethod
    def places(key: Column, salt: int, n_blocks: int) -> tuple[Column, list[Column]]:
        h, g = F.xxhash64(key, F.lit(salt)), F.xxhash64(F.lit(salt), key)
        return F.pmod(h, F.lit(n_blocks)).cast("int"), [F.pmod(F.shiftrightunsigned(h, 20) + g.bitwiseAND(F.lit(0x7FFFFFFF)) * i, F.lit(BITS)).cast("int") for i in range(1, HASHES + 1)]

    @classmethod
    def build(cls, keys: DataFrame, n: int, salt: int) -> Level:
        n_blocks = max(1, -(-n * 16 // BITS))
        block, bits = cls.places(F.col("key"), salt, n_blocks)
        rows = keys.select(block.alias("block"), F.explode(F.array(*bits)).alias("bit")).groupBy("block").agg(F.bitmap_construct_agg(F.col("bit").cast("long")).alias("bitmap")).collect()
        return cls(salt, {r["block"]: bytes(r["bitmap"]) for r in rows}, n_blocks)

    def passes(self, key: Column) -> Column:
        block, bits = self.places(key, self.salt, self.n_blocks)
        empty = bytes(BITS // 8)
        maps = [self.blocks.get(i, empty) for i in range(self.n_blocks)]
        bitmap = F.lit(maps[0]) if self.n_blocks == 1 else F.element_at(F.array(*map(F.lit, maps)), block + 1)
        byte = lambda bit: F.conv(F.hex(F.substring(bitmap, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        test = lambda bit: F.getbit(byte(bit), F.pmod(bit, F.lit(8))) == 1
        out = test(bits[0])
        for bit in bits[1:]:
            out = out & test(bit)
        return out


class Cascade:
    """Exact membership of the listed keys within a universe of keys."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, salt: int = 0) -> Cascade | None:
        """``listed`` and ``universe`` have one column, key; listed keys outside the universe change nothing.

        None if the levels would be larger or more than the limits: then a join must do.
        """
        inside, n = listed, listed.count()
        levels, rest, tables = [], None, []
        while n:
            if n * 16 > MAX_BLOCKS * BITS or len(levels) == MAX_LEVELS:
                drop(*tables)
                return None
            level = Level.build(inside, n, salt * MAX_LEVELS + len(levels))
            levels.append(level)
            # what passes wrongly is the next level's content
            wrong = universe.filter(level.passes(F.col("key"))).distinct().join(listed, "key", "left_anti") if rest is None else rest.filter(level.passes(F.col("key")))
            wrong = materialize(wrong, "cascade")
            tables.append(wrong)
            inside, rest, n = wrong, inside, wrong.count()
        drop(*tables)
        return cls(levels)

    def holds(self, key: Column) -> Column:
        """A key is listed if the first level that turns it away has an even number, or if none does and their number is odd."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed(list(enumerate(self.levels))):
            out = F.when(level.passes(key), out).otherwise(F.lit(i % 2 == 1))
        return out


def _values(spark: SparkSession, keys: list[str]) -> DataFrame:
    """(key): the constants as a relation."""
    return spark.range(1).select(F.explode(F.array(*map(F.lit, keys)).cast("array<string>")).alias("key"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, default: str = DEFAULT, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (the longest that fits, or null) and verdict."""
    spark = pages.sparkSession
    verdicts: dict[str, str] = {}
    for host, path, verdict in rules:
        if verdicts.get(host + path) != "allow":
            verdicts[host + path] = verdict
    url = F.col(url_col)
    parsed = pages.select(*(F.col(f"`{c}`") for c in others(pages, "host", "path", "rule", "verdict")), host_of(url).alias("host"), path_of(url).alias("path"))
    if not verdicts:
        return parsed.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    if len(verdicts) * 16 > MAX_BLOCKS * BITS:
        return rules_by_join(pages, spark.createDataFrame(list(rules), "host string, path string, verdict string"), default, url_col)
    keys = candidates(F.col("host"), F.col("path"), sorted({len(path) for _, path, _ in rules}))
    listed, allowed = _values(spark, list(verdicts)), _values(spark, [k for k, v in verdicts.items() if v == "allow"])
    fits, allows = Cascade.build(listed, parsed.select(F.explode(keys).alias("key"))), Cascade.build(allowed, listed, 1)
    if fits is None or allows is None:
        return rules_by_join(pages, spark.createDataFrame(list(rules), "host string, path string, verdict string"), default, url_col)
    longest = F.reduce(F.filter(keys, fits.holds), F.lit(None).cast("string"), lambda a, k: F.when(a.isNull() | (F.length(k) > F.length(a)), k).otherwise(a))
    verdict = F.when(F.col("rule").isNull(), default).when(allows.holds(F.col("rule")), "allow").otherwise("block")
    return parsed.withColumn("rule", longest).withColumn("verdict", verdict)


def rules_by_join(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, url_col: str = "url") -> DataFrame:
    """The same for lists of any size, ``rules`` being a table (host, path, verdict): candidate keys are joined with it."""
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().collect()]
    url = F.col(url_col)
    parsed = pages.select(*(F.col(f"`{c}`") for c in others(pages, "host", "path", "rule", "verdict")), host_of(url).alias("host"), path_of(url).alias("path"))
    numbered = materialize(packed(parsed).withColumn("n", F.monotonically_increasing_id()), "urls")
    listed = rules.groupBy(F.concat("host", "path").alias("key")).agg(F.min("verdict").alias("v"))
    # candidates come in order of their hosts' lengths, the longest first, as in the cascade
    keys = numbered.select("n", F.posexplode(F.array_distinct(candidates(F.col("row.host"), F.col("row.path"), lengths))).alias("place", "key"))
    found = keys.select("key").distinct().join(listed, "key")
    best = keys.join(found, "key").groupBy("n").agg(F.max(F.struct(F.length("key").alias("l"), (-F.col("place")).alias("p"), "key", "v")).alias("b"))
    return numbered.join(best, "n", "left").select("row.*", F.col("b.key").alias("rule"), F.coalesce("b.v", F.lit(default)).alias("verdict"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = r"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS t(h, q, v))
SELECT page_id, any_value(host) AS host, any_value(path) AS path, arg_max(h || q, length(h || q)) AS rule, coalesce(arg_max(v, length(h || q)), 'allow') AS verdict
FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id
"""
