"""Writing beliefs back into STEP texts: edits at the places of tokens, all other bytes as they were.

What changes is told by tables: values (file, step_id, position, text) replace one argument of a record, gone (file, step_id) drops
records, and posteriors (file, product, quantity, sigma) become property sets with numbers after the largest of their file.
A file's text is rewritten by the task that holds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.belief import MIN_SIGMA
from plumbline.sources.scene import _json, _refs, length_units
from plumbline.sources.step import StepError, by_type, spread, tokens

#: Arguments that hold the value of a quantity and of a property.
QUANTITY_AT, PROPERTY_AT = 3, 2


def real(x: Column) -> Column:
    """A real as STEP writes it: its shortest form, always with a point."""
    t = x.cast("double").cast("string")
    return F.when(t.contains("."), t).when(t.contains("E"), F.regexp_replace(t, "E", ".E")).otherwise(F.concat(t, F.lit(".")))


def edit(text: str, values: dict[tuple[int, int], str], gone: set[int], added: list[str]) -> str:
    """``text`` with arguments replaced, records dropped with the line break after them, and records added at the end of the data."""
    out, done, depth, data = [], 0, 0, False
    number = begin = arg = None
    first = last = position = 0
    left = set(values)
    toks = list(tokens(text))

    def put(at: int, end: int, new: str) -> None:
        nonlocal done
        out.append(text[done:at])
        out.append(new)
        done = end

    for k, (kind, t, at) in enumerate(toks):
        if depth == 0 and kind == "word" and t.upper() == "DATA":
            data = True
        elif depth == 0 and data and kind == "word" and t.upper() == "ENDSEC":
            put(at, at, "".join(line + "\n" for line in added))
            data = False
        elif depth == 0 and data and kind == "ref" and toks[k + 1][1] == "=":
            number, begin, position = int(t[1:]), at, 0
        elif kind == "mark" and t in "()":
            depth += 1 if t == "(" else -1
            if depth == 1 and t == "(":
                arg, first = 0, at + 1
                last = at + 1
                continue
        if depth == 0 and kind == "mark" and t in ");" and number is not None:
            if t == ")":
                if (number, position) in values and number not in gone and last > first:
                    put(first, last, values[number, position])
                    left.discard((number, position))
            else:
                if number in gone:
                    end = at + 1 + (text[at + 1 : at + 2] == "\n")
                    put(begin, end, "")
                number = None
        elif depth == 1 and number is not None and arg is not None:
            if kind == "mark" and t == ",":
                if (number, position) in values and number not in gone:
                    put(first, last, values[number, position])
                    left.discard((number, position))
                position, first, last = position + 1, at + 1, at + 1
            else:
                if last == first:
                    first = at
                last = at + len(t)
        elif depth > 1:
            if last == first:
                first = at
            last = at + len(t)
    if any(n not in gone for n, _ in left):
        raise StepError(f"nothing to edit at {sorted(left)[0]}")
    out.append(text[done:])
    return "".join(out)


def posterior_records(rows: DataFrame, sigmas: DataFrame, name: str = "Posterior") -> DataFrame:
    """(file, lines): records of one property set a product with its deviations, sigmas (file, product, quantity, sigma) in file units.

    Numbers follow the largest of the file: first the properties in order of product and quantity, then a set and its link a product.
    """
    most = rows.groupBy("file").agg(F.max("step_id").alias("most"))
    s = sigmas.withColumn("sigma", F.greatest("sigma", F.lit(MIN_SIGMA))).join(most, "file")
    by = Window.partitionBy("file")
    s = s.withColumns({"n": F.col("most") + F.row_number().over(by.orderBy("product", "quantity")), "set": F.dense_rank().over(by.orderBy("product")), "props": F.count("*").over(by)})
    text = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs))
    prop = s.select("file", F.col("n"), text("#", F.col("n"), "=IFCPROPERTYSINGLEVALUE('", F.col("quantity"), "Sigma',$,IFCREAL(", real(F.col("sigma")), "),$);").alias("line"))
    sets = s.groupBy("file", "product", "set").agg(F.max(F.col("most") + F.col("props")).alias("base"), F.array_sort(F.collect_list("n")).alias("refs"))
    sets = sets.withColumn("n", F.col("base") + 2 * F.col("set") - 1)
    refs = F.concat_ws(",", F.transform("refs", lambda x: F.concat(F.lit("#"), x.cast("string"))))
    one = sets.select("file", "n", text("#", F.col("n"), "=IFCPROPERTYSET('P", F.col("n"), f"',$,'{name}',$,(", refs, "));").alias("line"))
    two = sets.select("file", (F.col("n") + 1).alias("n"), text("#", F.col("n") + 1, "=IFCRELDEFINESBYPROPERTIES('R", F.col("n") + 1, "',$,$,$,(#", F.col("product"), "),#", F.col("n"), ");").alias("line"))
    every = prop.unionByName(one).unionByName(two)
    return every.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l")).select("file", F.col("l.line").alias("lines"))


def stale(rows: DataFrame, name: str = "Posterior") -> DataFrame:
    """(file, step_id): the property sets of an earlier export, their properties, and what links them."""
    sets = by_type(rows, "IFCPROPERTYSET").filter(_json("$[2]") == name)
    props = sets.select("file", F.explode(_refs("$[4]")).alias("step_id"))
    sets = sets.select("file", "step_id")
    links = by_type(rows, "IFCRELDEFINESBYPROPERTIES").select("file", "step_id", _json("$[5].ref").cast("long").alias("set")).join(sets.withColumnRenamed("step_id", "set"), ["file", "set"], "left_semi").select("file", "step_id")
    return sets.unionByName(props).unionByName(links).distinct()


def sources(rows: DataFrame) -> DataFrame:
    """(file, product, quantity, step_id, position): the record that holds each product's quantity, the last one where several do."""
    refs = lambda path: F.transform(F.regexp_extract_all(_json(path), F.lit(r'"ref":\s*(\d+)'), 1), lambda x: x.cast("long"))
    attach = by_type(rows, "IFCRELDEFINESBYPROPERTIES").select("file", F.col("step_id").alias("rel"), F.explode(refs("$[4]")).alias("product"), _json("$[5].ref").cast("long").alias("set"))
    listed = rows.filter("type_name IN ('IFCELEMENTQUANTITY', 'IFCPROPERTYSET')").select("file", F.col("step_id").alias("set"), F.posexplode(F.when(F.col("type_name") == "IFCELEMENTQUANTITY", refs("$[5]")).otherwise(refs("$[4]"))).alias("pos", "step_id"))
    held = rows.filter("type_name IN ('IFCQUANTITYLENGTH', 'IFCQUANTITYAREA', 'IFCQUANTITYVOLUME', 'IFCPROPERTYSINGLEVALUE')").select("file", "step_id", _json("$[0]").alias("quantity"), F.when(F.col("type_name") == "IFCPROPERTYSINGLEVALUE", PROPERTY_AT).otherwise(QUANTITY_AT).alias("position"))
    j = attach.join(listed, ["file", "set"]).join(held, ["file", "step_id"])
    return j.groupBy("file", "product", "quantity").agg(F.max_by(F.struct("step_id", "position"), F.struct("rel", "pos")).alias("s")).select("file", "product", "quantity", "s.*")


def export(texts: DataFrame, rows: DataFrame, belief: DataFrame, name: str = "Posterior") -> DataFrame:
    """(file, text): texts (file, text) with the belief (file, product, quantity, mu, sigma; metres) written into their records and as property sets.

    Earlier property sets of that name go. Files without a belief are given back byte for byte.
    """
    unit = length_units(rows).select("file", "scale")
    in_file = belief.join(unit, "file").withColumn("u", F.when(F.col("quantity").isin("Length", "Width", "Height", "ClearHeight"), F.col("scale")).otherwise(1.0))
    in_file = in_file.select("file", "product", "quantity", (F.col("mu") / F.col("u")).alias("mu"), (F.col("sigma") / F.col("u")).alias("sigma"))
    value = F.when(F.col("position") == PROPERTY_AT, F.concat(F.lit("IFCREAL("), real(F.col("mu")), F.lit(")"))).otherwise(real(F.col("mu")))
    values = in_file.join(sources(rows), ["file", "product", "quantity"]).groupBy("file").agg(F.collect_list(F.struct("step_id", "position", value.alias("value"))).alias("values"))
    old = stale(rows, name).join(belief.select("file").distinct(), "file", "left_semi").groupBy("file").agg(F.collect_list("step_id").alias("gone"))
    lines = posterior_records(rows, in_file.select("file", "product", "quantity", "sigma"), name)
    j = texts.select("file", "text").join(values, "file", "left").join(old, "file", "left").join(lines, "file", "left")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some = lambda x: [] if x is None else list(x)
        for pdf in it:
            made = [edit(t, {(int(v["step_id"]), int(v["position"])): v["value"] for v in some(vs)}, set(map(int, some(g))), some(ls)) for t, vs, g, ls in zip(pdf["text"], pdf["values"], pdf["gone"], pdf["lines"], strict=True)]
            yield pd.DataFrame({"file": pdf["file"], "text": made})

    return spread(j.select("file", "text", "values", "gone", "lines")).mapInPandas(run, "file string, text string")
