"""STEP physical files: a scanner and parser as a Python data source, and the lowering to entity and slot tables.

``spark.read.format("step").load(folder or file)`` gives (file, step_id, type_name, args), args being JSON: numbers,
strings, null for ``$``, {"omitted": true} for ``*``, {"ref": n}, {"enum": s}, {"type": t, "args": [...]}, and lists.
A file is one task; files spread over executors.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, step_id long, type_name string, args string"
_TOKEN = re.compile(
    r"""(?P<space>\s+|/\*.*?\*/)|(?P<string>'(?:[^']|'')*')|(?P<ref>\#\d+)|(?P<enum>\.[A-Za-z_][A-Za-z_0-9]*\.)
    |(?P<real>[+-]?\d+\.\d*(?:[eE][+-]?\d+)?(?![eE\d.]))|(?P<int>[+-]?\d+(?![eE\d.]))|(?P<word>[A-Za-z_][A-Za-z_0-9-]*)|(?P<mark>[()=,;$*])""",
    re.S | re.X,
)


class StepError(ValueError):
    """A STEP text that does not follow the grammar, with line and column."""


def tokens(text: str) -> Iterator[tuple[str, str, int]]:
    """(kind, text, position); white space and comments are skipped."""
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            line = text.count("\n", 0, at) + 1
            raise StepError(f"line {line}, column {at - text.rfind(chr(10), 0, at)}: unexpected {text[at : at + 10]!r}")
        if m.lastgroup != "space":
            yield m.lastgroup, m[0], at
        at = m.end()


class _Parser:
    def __init__(self, text: str):
        self.text, self.toks, self.k = text, [*tokens(text), ("end", "", len(text))], 0

    def fail(self, want: str):
        _, got, at = self.toks[self.k]
        line = self.text.count("\n", 0, at) + 1
        raise StepError(f"line {line}, column {at - self.text.rfind(chr(10), 0, at)}: {want} expected, not {got!r}")

    def take(self, kind: str, text: str | None = None) -> str:
        k, t, _ = self.toks[self.k]
        if k != kind or text is not None and t.upper() != text:
            self.fail(text or kind)
        self.k += 1
        return t

    def value(self):
        kind, t, _ = self.toks[self.k]
        self.k += 1
        match kind:
            case "string":
                return t[1:-1].replace("''", "'")
            case "ref":
                return {"ref": int(t[1:])}
            case "enum":
                return {"enum": t[1:-1].upper()}
            case "real":
                return float(t)
            case "int":
                return int(t)
            case "word":
                return {"type": t.upper(), "args": self.list()}
            case "mark" if t == "$":
                return None
            case "mark" if t == "*":
                return {"omitted": True}
            case "mark" if t == "(":
                self.k -= 1
                return self.list()
        self.k -= 1
        return self.fail("a value")

    def list(self) -> list:
        self.take("mark", "(")
        out = []
        if self.toks[self.k][1] != ")":
            out.append(self.value())
            while self.toks[self.k][1] == ",":
                self.k += 1
                out.append(self.value())
        self.take("mark", ")")
        return out


def parse(text: str) -> tuple[list[tuple[str, list]], list[tuple[int, str, list]]]:
    """(header records, instances); a repeated instance number is an error."""
    p, header, rows, seen = _Parser(text), [], [], set()
    p.take("word", "ISO-10303-21")
    p.take("mark", ";")
    p.take("word", "HEADER")
    p.take("mark", ";")
    while p.toks[p.k][1].upper() != "ENDSEC":
        header.append((p.take("word").upper(), p.list()))
        p.take("mark", ";")
    p.take("word", "ENDSEC")
    p.take("mark", ";")
    p.take("word", "DATA")
    p.take("mark", ";")
    while p.toks[p.k][1].upper() != "ENDSEC":
        n = int(p.take("ref")[1:])
        if n in seen:
            raise StepError(f"#{n} is defined twice")
        seen.add(n)
        p.take("mark", "=")
        rows.append((n, p.take("word").upper(), p.list()))
        p.take("mark", ";")
    p.take("word", "ENDSEC")
    p.take("mark", ";")
    p.take("word", "END-ISO-10303-21")
    p.take("mark", ";")
    p.take("end")
    return header, rows


def write(header: list[tuple[str, list]], rows: list[tuple[int, str, list]]) -> str:
    """STEP text of the records; reals in their shortest form that reads back the same."""

    def show(v) -> str:
        if v is None:
            return "$"
        if isinstance(v, list):
            return "(" + ",".join(map(show, v)) + ")"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, dict):
            if "ref" in v:
                return f"#{v['ref']}"
            if "enum" in v:
                return f".{v['enum']}."
            return "*" if "omitted" in v else v["type"] + show(v["args"])
        if isinstance(v, float):
            t = repr(v)
            return (t if "." in t else t.replace("e", ".e") if "e" in t else t + ".").replace("e", "E")
        return str(v)

    record = lambda t, a: f"{t}{show(a)};"
    return "\n".join(["ISO-10303-21;", "HEADER;", *(record(t, a) for t, a in header), "ENDSEC;", "DATA;", *(f"#{n}={record(t, a)}" for n, t, a in rows), "ENDSEC;", "END-ISO-10303-21;", ""])


class StepSource(DataSource):
    """Python data source ``step``: option path, or paths as a JSON list."""

    @classmethod
    def name(cls) -> str:
        return "step"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        if "paths" in self.options:
            return _Reader(json.loads(self.options["paths"]))
        path = self.options["path"]
        return _Reader([os.path.join(path, f) for f in sorted(os.listdir(path)) if not f.startswith((".", "_"))] if os.path.isdir(path) else [path])


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition):
        with open(partition.value, encoding="utf-8") as f:
            for n, t, args in parse(f.read())[1]:
                yield partition.value, n, t, json.dumps(args)


#: Texts whose records a task holds at a time, whatever the rows of an Arrow batch.
TEXTS = 100


def spread(texts: DataFrame, file: str = "file") -> DataFrame:
    """Texts dealt to two tasks a core. Plans count compressed bytes, of which alike texts have few, and gather or read them in few
    tasks; more tasks would write more files of each record type."""
    return texts.repartition(2 * texts.sparkSession.sparkContext.defaultParallelism, file)


def read_texts(texts: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """The same rows from texts that Spark has read itself (any store), one text a row; a task holds the records of :data:`TEXTS` of them."""
    most = TEXTS

    def run(it):
        import pandas as pd

        for pdf in it:
            for at in range(0, len(pdf), most):
                some = pdf.iloc[at : at + most]
                rows = [(f, n, t, json.dumps(a)) for f, x in zip(some[file], some[text], strict=True) for n, t, a in parse(x)[1]]
                yield pd.DataFrame(rows, columns=["file", "step_id", "type_name", "args"])

    return spread(texts.select(file, text), file).mapInPandas(run, SCHEMA)


def load(spark: SparkSession, path: str) -> DataFrame:
    """All STEP files of a folder or pattern, through Spark's own file readers."""
    whole = spark.read.text(path, wholetext=True)
    return read_texts(whole.select(F.input_file_name().alias("file"), F.col("value").alias("text")))


def by_type(rows: DataFrame, type_name: str) -> DataFrame:
    return rows.filter(F.col("type_name") == type_name.upper())


def dangling(rows: DataFrame) -> DataFrame:
    """(file, step_id, ref): references to instances that don't exist."""
    refs = rows.select("file", "step_id", F.explode(F.regexp_extract_all("args", F.lit(r'\{"ref": (\d+)\}'), 1)).alias("r")).withColumn("r", F.col("r").cast("long"))
    return refs.join(rows.select("file", F.col("step_id").alias("r")), ["file", "r"], "left_anti").select("file", "step_id", F.col("r").alias("ref"))


#: Product classes and the quantities that each needs.
PRODUCTS = {
    "IFCBUILDINGSTOREY": ("ClearHeight",), "IFCWALL": ("Length", "Width"), "IFCOPENINGELEMENT": ("Width", "Height"),
    "IFCDOOR": ("Width", "Height"), "IFCSPACE": ("Length", "Width"), "IFCBEAM": ("Length",),
}
EDGES = {"IFCRELAGGREGATES": ("aggregates", 4, 5), "IFCRELCONTAINEDINSPATIALSTRUCTURE": ("contains", 5, 4), "IFCRELSPACEBOUNDARY": ("bounds", 5, 4), "IFCRELVOIDSELEMENT": ("voids", 5, 4), "IFCRELFILLSELEMENT": ("fills", 5, 4)}


def _ref(i: int, json_col: str = "args"):
    return F.get_json_object(json_col, f"$[{i}].ref").cast("long")


def entities(rows: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """(file, step_id, ifc_class, global_id, name) of the products; a scope of global ids filters before any join."""
    e = rows.filter(F.col("type_name").isin(list(PRODUCTS))).select("file", "step_id", F.col("type_name").alias("ifc_class"), F.get_json_object("args", "$[0]").alias("global_id"), F.nullif(F.get_json_object("args", "$[2]"), F.lit("null")).alias("name"))
    return e.filter(F.col("global_id").isin(scope)) if scope is not None else e


def edges(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(file, kind, src, dst) by instance number, with both ends among the products."""
    out = None
    for type_name, (kind, a, b) in EDGES.items():
        r = by_type(rows, type_name)
        many = lambda i: F.when(F.get_json_object("args", f"$[{i}].ref").isNotNull(), F.array(_ref(i))).otherwise(F.transform(F.regexp_extract_all(F.get_json_object("args", f"$[{i}]"), F.lit(r'"ref":\s*(\d+)'), 1), lambda x: x.cast("long")))
        e = r.select("file", F.lit(kind).alias("kind"), F.explode(many(a)).alias("src"), many(b).alias("d")).select("file", "kind", "src", F.explode("d").alias("dst"))
        out = e if out is None else out.unionByName(e)
    for end in ("src", "dst"):
        out = out.join(known.select("file", F.col("step_id").alias(end)), ["file", end], "left_semi")
    return out.select("file", "kind", "src", "dst")


def quantities(rows: DataFrame) -> DataFrame:
    """(file, product, quantity, value): lengths, areas, volumes and single numbers attached to products, the last of a name wins."""
    attach = by_type(rows, "IFCRELDEFINESBYPROPERTIES").select("file", "step_id", F.explode(F.transform(F.regexp_extract_all(F.get_json_object("args", "$[4]"), F.lit(r'"ref":\s*(\d+)'), 1), lambda x: x.cast("long"))).alias("product"), _ref(5).alias("set"))
    sets = rows.filter("type_name IN ('IFCELEMENTQUANTITY', 'IFCPROPERTYSET')").select("file", F.col("step_id").alias("set"), F.posexplode(F.transform(F.regexp_extract_all(F.when(F.col("type_name") == "IFCELEMENTQUANTITY", F.get_json_object("args", "$[5]")).otherwise(F.get_json_object("args", "$[4]")), F.lit(r'"ref":\s*(\d+)'), 1), lambda x: x.cast("long"))).alias("pos", "item"))
    item = rows.filter("type_name IN ('IFCQUANTITYLENGTH', 'IFCQUANTITYAREA', 'IFCQUANTITYVOLUME', 'IFCPROPERTYSINGLEVALUE')")
    value = F.when(F.col("type_name") == "IFCPROPERTYSINGLEVALUE", F.coalesce(F.get_json_object("args", "$[2].args[0]"), F.get_json_object("args", "$[2]"))).otherwise(F.get_json_object("args", "$[3]"))
    item = item.select("file", F.col("step_id").alias("item"), F.get_json_object("args", "$[0]").alias("quantity"), value.try_cast("double").alias("value"))
    all_ = attach.join(sets, ["file", "set"]).join(item, ["file", "item"]).filter("value IS NOT NULL")
    return all_.groupBy("file", "product", "quantity").agg(F.max_by("value", F.struct("step_id", "pos")).alias("value"))


def missing(known: DataFrame, found: DataFrame) -> DataFrame:
    """(file, global_id, quantity): required quantities that a product lacks."""
    spark = known.sparkSession
    need = spark.createDataFrame([(c, q) for c, qs in PRODUCTS.items() for q in qs], "ifc_class string, quantity string")
    want = known.join(F.broadcast(need), "ifc_class")
    return want.join(found.withColumnRenamed("product", "step_id"), ["file", "step_id", "quantity"], "left_anti").select("file", "global_id", "quantity")
