"""PLY point clouds: ascii or little-endian binary files, of which x, y and z are read."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

TYPES = {"char": "i1", "uchar": "u1", "short": "<i2", "ushort": "<u2", "int": "<i4", "uint": "<u4", "float": "<f4", "double": "<f8", "int8": "i1", "uint8": "u1", "int16": "<i2", "uint16": "<u2", "int32": "<i4", "uint32": "<u4", "float32": "<f4", "float64": "<f8"}


def points(raw: bytes) -> np.ndarray:
    """(n, 3) coordinates; anything but a finite point cloud is an error."""
    head, mark, body = raw.partition(b"end_header\n")
    lines = head.decode("ascii").split("\n")
    if not mark or lines[0].strip() != "ply":
        raise ValueError("not a PLY file")
    kind, n, fields, inside = "", 0, [], False
    for line in map(str.split, lines[1:]):
        if line[:1] == ["format"]:
            kind = line[1]
        elif line[:1] == ["element"]:
            inside = line[1] == "vertex"
            n = int(line[2]) if inside else n
        elif line[:1] == ["property"] and inside:
            if line[1] not in TYPES:
                raise ValueError(f"property type {line[1]}")
            fields.append((line[2], TYPES[line[1]]))
    if not {"x", "y", "z"} <= {f for f, _ in fields}:
        raise ValueError("x, y and z are needed")
    if kind == "ascii":
        rows = np.array([r.split()[: len(fields)] for r in body.decode("ascii").splitlines()[:n]], float).reshape(n, len(fields))
        names = [f for f, _ in fields]
        out = rows[:, [names.index(c) for c in "xyz"]]
    elif kind == "binary_little_endian":
        data = np.frombuffer(body, np.dtype(fields), n)
        out = np.stack([data[c].astype(float) for c in "xyz"], 1)
    else:
        raise ValueError(f"format {kind}")
    if not np.isfinite(out).all():
        raise ValueError("coordinates must be finite")
    return out


def load(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, x, y, z) of all PLY files of a folder or pattern."""

    def run(it):
        for pdf in it:
            for f, raw in zip(pdf["path"], pdf["content"], strict=True):
                p = points(bytes(raw))
                yield pd.DataFrame({"file": f, "n": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, n long, x double, y double, z double")
