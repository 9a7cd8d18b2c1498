"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the score.

Everything is a DataFrame expression. Positions come from splitting the text at the matches: the lengths of the pieces
and of the matches alternate, and their running sum gives each start and end in code points. The patterns are written
so that no long run of characters is tried from each of its positions: a run is entered at its first character only
(or where the last match ended) and is never given back.

Kinds of the base: email, ip (parts at most 255), card (13 to 19 digits, Luhn), phone (9 to 15 digits). The method adds
iban (mod-97), ssn (United States social security numbers of a possible area, group and serial) and routing (nine digits
with the weighted sum of bank routing numbers). An iban may start at any place that looks like one; it ends at its
country's length, or in a country not in LENGTHS at the last end of a word that passes the checksum. Of ibans that
overlap the first stays.

A span's score starts at its kind's prior; a context word in the CONTEXT code points before it raises it, a word that
speaks for something else lowers it. Base kinds are kept whatever their score; of the others only spans with THRESHOLD:
an iban goes where the words before it speak against it, an ssn or a routing number stays only where they speak for it.

Cases: null and empty texts have no spans; ties cannot occur within a kind, spans of different kinds may overlap; an
empty table gives an empty table; columns named pii_<kind> are replaced, other columns are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import others

#: Kind: pattern, a test that is cheap and that every text with a match passes.
PATTERNS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
    # a match is the first letter only, so that what follows can start a match too; the group holds what may belong to it
    "ssn": (r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "routing": (r"(?<![0-9A-Za-z.-])[0-9]{9}(?![0-9A-Za-z-])", r"[0-9]{9}"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z](?=([A-Z][0-9]{2}(?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?))", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11}"),
}
BASE = ("email", "ip", "card", "phone")
#: Letters and digits of an account number, by country.
LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU",
    31: "MT SC", 32: "LC", 33: "RU",
}
#: Kind: prior score, words that raise it, words that lower it (looked for in the code points before the span).
CONTEXT = 40
RUN = 128
SCORES = {
    "email": (0.9, r"(?i)mail|contact|write", r"(?i)example"),
    "ip": (0.5, r"(?i)\bip\b|address|host|server", r"(?i)version|release"),
    "card": (0.7, r"(?i)card|visa|credit|payment", r"(?i)order|tracking|serial"),
    "phone": (0.6, r"(?i)phone|call|tel|mobile|fax", r"(?i)isbn|serial"),
    "ssn": (0.4, r"(?i)\bssn\b|social security|taxpayer", r"(?i)part|model|order|serial"),
    "routing": (0.4, r"(?i)routing|\baba\b|\brtn\b", r"(?i)phone|order|serial|tracking"),
    "iban": (0.7, r"(?i)iban|bank|account|konto|cuenta|compte", r"(?i)token|key|serial|hash"),
}
RAISE, LOWER, THRESHOLD = 0.2, 0.3, 0.5


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _mod97(text: Column) -> Column:
    """Whether the letters and digits of an account number leave 1 on division by 97, its first four moved to the end."""
    plain = F.regexp_replace(text, " ", "")
    moved = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    def step(rest: Column, c: Column) -> Column:
        v = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (rest * F.when(v < 10, 10).otherwise(100) + v) % 97
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(step(rest, c))) == 1


def _account(run: Column) -> Column:
    """The account number that ``run`` starts with: it ends where no letter or digit follows. Null if there is none."""
    known = F.create_map(*(F.lit(x) for n, names in LENGTHS.items() for c in names.split() for x in (c, n)))
    size = F.element_at(known, F.substring(run, 1, 2))
    sizes = F.when(size.isNull(), F.sequence(F.lit(34), F.lit(15), F.lit(-1))).otherwise(F.array(size))
    head = lambda n: F.call_function("regexp_extract", run, F.concat(F.lit(r"^(?:[A-Z0-9]\x20?){"), (n - 1).cast("string"), F.lit("}[A-Z0-9](?![A-Za-z0-9])")), F.lit(0))
    return F.get(F.filter(F.transform(sizes, head), lambda v: (v != "") & _mod97(v)), F.lit(0))


def _apart(spans: Column) -> Column:
    """``spans`` in order of their starts without those that start inside one that stays."""
    meet = F.exists(F.arrays_zip(spans.alias("s"), F.slice(spans, 2, F.greatest(F.size(spans), F.lit(1))).alias("t")), lambda x: x["t"]["start"] < x["s"]["end"])
    one = F.aggregate(spans, F.slice(spans, 1, 0), lambda kept, s: F.when((F.size(kept) == 0) | (s["start"] >= F.get(kept, F.size(kept) - 1)["end"]), F.concat(kept, F.array(s))).otherwise(kept))
    return F.when(meet, one).otherwise(spans)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        # no part above 255: at most three digits once leading zeros are gone
        return ~m.rlike(r"(^|\.)0*(25[6-9]|2[6-9][0-9]|[3-9][0-9]{2}|[1-9][0-9]{3,})(\.|$)")
    if kind == "card":
        d = _digits(m)
        return F.length(d).between(13, 19) & F.coalesce(F.call_function("luhn_check", d), F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "ssn":
        return ~m.rlike(r"^(000|666|9..)|-00-|-0000$")
    if kind == "routing":
        digit = lambda k: F.substring(m, k, 1).cast("int")
        weighted = reduce(lambda x, y: x + y, (digit(k) * (3, 7, 1)[(k - 1) % 3] for k in range(1, 10)))
        return (weighted > 0) & (weighted % 10 == 0)
    if kind == "iban":
        return m.isNotNull()
    return F.lit(True)


def _score(kind: str, before: Column) -> Column:
    prior, up, down = SCORES[kind]
    raised = F.when(before.rlike(up), RAISE).otherwise(0.0) - F.when(before.rlike(down), LOWER).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(prior) + raised))


SPAN = "array<struct<kind:string,start:int,end:int,score:double,value:string>>"


def _positions(pairs: Column) -> Column:
    """Start, end and value of each match, and the text just before it."""
    width = lambda x: F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0))
    # growing an array copies it, so positions are summed by runs of RUN matches: first where each run starts, then within it
    run = lambda i: F.slice(pairs, i * RUN + 1, F.lit(RUN))
    runs = F.sequence(F.lit(0), F.ceil(F.size(pairs) / RUN).cast("int") - 1)
    sums = F.transform(runs, lambda i: F.aggregate(run(i), F.lit(0), lambda n, x: n + width(x)))
    starts = F.aggregate(sums, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    none = F.array().cast("array<struct<start:int,end:int,before:string,value:string>>")
    last = lambda x: F.right(x, F.lit(CONTEXT))
    # the text before a run: eight pieces with their matches are longer than the context
    lead = lambda i: F.when(i == 0, "").otherwise(last(F.array_join(F.transform(F.slice(pairs, F.greatest(i * RUN - 7, F.lit(1)), F.lit(8)), lambda x: F.concat(x["p"], F.coalesce(x["m"], F.lit("")))), "")))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["p"])
        before = last(F.concat(acc["tail"], x["p"]))
        one = F.array(F.struct(begin.alias("start"), (acc["at"] + width(x)).alias("end"), before.alias("before"), x["m"].alias("value")))
        return F.struct((acc["at"] + width(x)).alias("at"), last(F.concat(before, F.coalesce(x["m"], F.lit("")))).alias("tail"), F.when(x["m"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], one)).alias("found"))

    return F.flatten(F.transform(F.arrays_zip(runs.alias("i"), starts.alias("at")), lambda r: F.when(r["i"].isNull(), none).otherwise(F.aggregate(run(r["i"]), F.struct(r["at"].alias("at"), lead(r["i"]).alias("tail"), none.alias("found")), step, lambda acc: acc["found"]))))


def _kind_spans(text: Column, kind: str) -> Column:
    """The confirmed spans of one kind, in order."""
    pattern, test = PATTERNS[kind]
    likely = text.contains(test) if kind in ("email", "phone") else text.rlike(test)
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # one lambda variable holds the pieces and matches, or each use would run the patterns again
    found = F.element_at(F.transform(F.array(F.arrays_zip(pieces.alias("p"), matches.alias("m"))), _positions), 1)
    if kind == "iban":
        tails = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        whole = lambda s, tail: F.transform(F.array(_account(F.concat(s["value"], tail))), lambda v: F.struct(s["start"].alias("start"), (s["start"] + F.length(v)).alias("end"), s["before"].alias("before"), v.alias("value")))[0]
        found = F.zip_with(found, tails, whole)
    found = F.filter(found, lambda s: _valid(kind, s["value"]))
    scored = F.transform(found, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _score(kind, s["before"]).alias("score"), s["value"].alias("value")))
    if kind == "iban":
        scored = F.element_at(F.transform(F.array(scored), _apart), 1)
    return F.when(likely, scored).otherwise(F.array().cast(SPAN)).cast(SPAN)


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with one array of spans (kind, start, end, score, value) per kind, in columns ``pii_<kind>``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [F.col(f"`{c}`") for c in others(docs, *(f"pii_{kind}" for kind in PATTERNS))]
    sure = lambda kind: _kind_spans(text, kind) if kind in BASE else F.filter(_kind_spans(text, kind), lambda s: s["score"] >= THRESHOLD)
    return docs.select(*kept, *(sure(kind).alias(f"pii_{kind}") for kind in PATTERNS))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with what the spans cover in the text replaced: each run of overlapping spans by its first one's kind in angle brackets."""
    found = find_pii(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).alias("text")))
    one = lambda kind: F.transform(f"pii_{kind}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"<{kind}>").alias("mark")))
    spans = F.array_sort(reduce(F.concat, map(one, PATTERNS)))
    joined = F.aggregate(spans, F.slice(spans, 1, 0), lambda kept, s: F.when((F.size(kept) > 0) & (s["start"] < F.element_at(kept, -1)["end"]), F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(F.struct(F.element_at(kept, -1)["start"].alias("start"), F.greatest(F.element_at(kept, -1)["end"], s["end"]).alias("end"), F.element_at(kept, -1)["mark"].alias("mark"))))).otherwise(F.concat(kept, F.array(s))))
    part = lambda start, end: F.substring(F.col("text"), start + 1, end - start)
    pieces = F.transform(F.col("spans"), lambda s, i: F.concat(part(F.when(i > 0, F.get(F.col("spans"), i - 1)["end"]).otherwise(0), s["start"]), s["mark"]))
    text = F.concat(F.array_join(pieces, ""), part(F.element_at("spans", -1)["end"], F.length("text")))
    out = found.withColumn("spans", joined).withColumn("text", F.when(F.size("spans") > 0, text).otherwise(F.col("text")))
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with counts of base spans, their digest, and all spans."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", *(f"pii_{k}" for k in PATTERNS))
    listed = lambda kinds: F.array_join(F.transform(reduce(F.concat, [F.col(f"pii_{k}") for k in kinds]), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in BASE]
    scores = F.array_join(F.transform(reduce(F.concat, [F.col(f"pii_{k}") for k in PATTERNS]), lambda s: F.format_number(s["score"], 2)), ",")
    return found.select("doc_id", *counts, F.sha2(listed(BASE), 256).alias("base_sha256"), listed(PATTERNS).alias("spans"), scores.alias("scores"))
