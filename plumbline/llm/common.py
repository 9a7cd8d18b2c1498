"""Helpers shared by the corpus operators: tables in the shared folder, and text as NumPy arrays.

The array helpers work on slices of an Arrow batch, so that memory follows ``SLICE_BYTES`` (or the longest
single text) and not the batch. All hashes are 64-bit and computed without a Python loop over words.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key held by more than one in HOT rows is hot: there are at most HOT such keys.
HOT = 500
#: Bytes of text handled at once inside a Python worker.
SLICE_BYTES = 1 << 20
#: Java regular expression for a word; the same six separators everywhere.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only a session on one machine, as in tests, may leave it unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="plumbline-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the table read back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plumbline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._plumbline_path = path
    return out


def lean(spark: SparkSession) -> None:
    """Keep batches between Spark and its Python workers small: whole texts are large rows.

    Memory on both sides follows the batch; a session that has set smaller limits keeps them.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1_000), ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)):
        now = int(re.sub("[^0-9-]", "", str(spark.conf.get(key))))
        if now <= 0 or now > most:
            spark.conf.set(key, most)


def drop(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialize` that no later plan reads."""
    for df in tables:
        delete(df.sparkSession, df._plumbline_path)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def others(df: DataFrame, *results: str) -> list[str]:
    """The columns of ``df`` but for those that have a result's name: the result replaces them. Case does not count."""
    taken = {r.lower() for r in results}
    return [c for c in df.columns if c.lower() not in taken]


def packed(df: DataFrame) -> DataFrame:
    """``df`` as one column, row: helper columns beside it can't clash with its own."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))


def hot_join(rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row (or a few) per key and in ``count`` how many rows hold the key.

    Keys that more than one in HOT of ``total`` rows hold are at most HOT and are joined by broadcast, so that no task gets
    all rows of such a key; the others are joined by sort-merge. ``how``: inner or left_semi.
    """
    is_hot = F.col(count) * HOT > total
    hot = keyed.filter(is_hot)
    first = rows.join(F.broadcast(hot), key, how)
    rest = rows.join(F.broadcast(hot.select(key).distinct()), key, "left_anti")
    return first.unionByName(rest.join(keyed.filter(~is_hot).hint("merge"), key, how))


# --- text as arrays -------------------------------------------------------------------------------------------------

_rng = np.random.default_rng(20240229)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(int(_P), -1, 2**64))
_MULT = _rng.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        a = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        a[0] = 1
        _powers[key] = np.cumprod(a, dtype=np.uint64)
    return _powers[key][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply), elementwise."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if not len(column):
        offsets = np.zeros(1, np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(data: np.ndarray, offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row exclusive, bytes, offsets) of runs of whole rows of about ``most`` bytes."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word, in order. ``breaks``: which bytes separate words."""
    inside = ~(_SPACE if breaks is None else breaks)[data]
    if not len(inside):
        return (np.zeros(0, np.int64),) * 3
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    first[full] = inside[full]
    ends = np.append(full[1:], len(data)) - 1
    last[ends] = inside[ends]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(offsets, s, "right") - 1


def running_hash(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """Sums from which :func:`span_hashes` takes the hash of any run of bytes."""
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER if lower else _BYTE)[data] * _power(_P, len(data)), out=c[1:])
    return c


def span_hashes(c: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return mix((c[e] - c[s]) * _power(_PINV, len(c))[s] + (e - s).astype(np.uint64))


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, lower: bool = False) -> np.ndarray:
    """A hash of the bytes of each word; ``lower`` first lower-cases A-Z."""
    return span_hashes(running_hash(data, lower), s, e)


def gram_hashes(w: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive words of ``w`` (rows are not looked at)."""
    if len(w) < n:
        return np.zeros(0, np.uint64)
    m = len(w) - n + 1
    out = w[:m] * _MULT[0]
    for k in range(1, n):
        out += w[k : k + m] * _MULT[k]
    return mix(out)


def whole_grams(row: np.ndarray, n: int) -> np.ndarray:
    """Positions of words at which ``n`` consecutive words of one row start."""
    if len(row) < n:
        return np.zeros(0, np.int64)
    return np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
