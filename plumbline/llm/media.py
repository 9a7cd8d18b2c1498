"""Media columns: audio stored losslessly, and features computed from what is read back.

A payload is stored as an 8-bit mono WAV file at RATE_IN. Features: polyphase resampling to RATE_OUT (two phases of a
windowed sinc, applied as one banded matrix to units of UNIT samples with their surroundings), overlapped frames of two
output units under a Hann window, log energies of MELS mel bands, and segments of loud frames by hysteresis: a segment
starts where the energy exceeds the upper threshold and lasts while it stays above the lower one. A row's features are
stored as an Arrow stream (Spark has no tensor type): one row per block of FRAMES frames with its time span and the bands
as a fixed-shape tensor of FRAMES x MELS; the loud spans stand beside it. :func:`tensors` reads such a column back, and
the query's digest is of what is read back.

Cases: null and empty texts make one unit of spaces; equal payloads give equal values, wherever they stand in a batch
(values are rounded far above the precision of the sums); the units of a payload are worked through in runs of RUN, so that
beside the payload and its stored forms memory does not follow its length; an empty table gives an empty table; columns
other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import lean, slices, text_buffers

UNIT, RATE_IN, RATE_OUT = 192, 24_000, 16_000
OUT = UNIT * RATE_OUT // RATE_IN
REACH, MELS, FRAMES = 24, 40, 32
#: Hysteresis thresholds in standard deviations from a payload's mean log energy.
UPPER, LOWER = 0.5, -0.25
#: Units that are transformed at once.
RUN = 4_096
#: One block of features: its time span in seconds, and log-mel values in hundredths of a decade; the last is padded.
BLOCK = pa.schema([("start_s", pa.float64()), ("end_s", pa.float64()), ("log_mel", pa.fixed_shape_tensor(pa.int16(), (FRAMES, MELS)))])
SILENCE = -600


def _resampler() -> np.ndarray:
    """(UNIT + 2 REACH, OUT): output k of a unit is the sinc-weighted sum of the inputs near 1.5 k."""
    ratio = UNIT / OUT
    t = np.arange(UNIT + 2 * REACH)[:, None] - REACH - np.arange(OUT)[None, :] * ratio
    taps = np.sinc(t / ratio) / ratio * np.where(np.abs(t) < REACH, 0.5 + 0.5 * np.cos(np.pi * t / REACH), 0.0)
    return taps / taps.sum(0)


def _mel_bank() -> np.ndarray:
    """(bins, MELS) triangles, equally spaced in mel."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(40.0), mel(RATE_OUT / 2), MELS + 2) / 2595) - 1)
    f = np.arange(OUT + 1)[:, None] * RATE_OUT / (2 * OUT)
    up, down = (f - edges[:-2]) / np.diff(edges)[:-1], (edges[2:] - f) / np.diff(edges)[1:]
    return np.maximum(0, np.minimum(up, down))


_RESAMPLE, _MEL, _HANN = _resampler(), _mel_bank(), np.hanning(2 * OUT)


def wav(payload: bytes) -> bytes:
    """An 8-bit mono WAV file of the samples."""
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE_IN, RATE_IN, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def samples(file: bytes) -> bytes:
    """The samples of a WAV file: the content of its data chunk."""
    if file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(file):
        size = struct.unpack_from("<I", file, at + 4)[0]
        if file[at : at + 4] == b"data":
            return file[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def _transformed(raw: np.ndarray, first: np.ndarray, last: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Mel bands and log energies of the frames that start at units lo to hi, each with the unit after it."""
    n = len(first)
    a, b = max(0, lo - 1), min(n, hi + 2)  # one unit more before, two after: for the surroundings, and for the last frame
    body = (raw[a * UNIT : b * UNIT].reshape(-1, UNIT).astype(np.float64) - 128) / 128
    want = np.arange(lo, min(n, hi + 1))
    x = np.zeros((len(want), UNIT + 2 * REACH))
    x[:, REACH:-REACH] = body[want - a]
    inner = np.flatnonzero(~first[want])
    x[inner, :REACH] = body[want[inner] - 1 - a, -REACH:]
    inner = np.flatnonzero(~last[want])
    x[inner, -REACH:] = body[want[inner] + 1 - a, :REACH]
    y = x @ _RESAMPLE
    frames = np.zeros((hi - lo, 2 * OUT))
    frames[:, :OUT] = y[: hi - lo]
    inner = np.flatnonzero(~last[lo:hi])
    frames[inner, OUT:] = y[inner + 1]
    spectrum = np.fft.rfft(frames * _HANN, axis=1)
    power = spectrum.real**2 + spectrum.imag**2
    return np.round(np.log10(power @ _MEL + 1e-6) * 100).astype(np.int16), np.round(np.log10((frames**2).sum(1) + 1e-6) * 1000)


def features(raw: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of samples (uint8) of several payloads, whose first units are ``units[:-1]``: mel bands in hundredths of a
    decade (frames x MELS, int16), whether each frame is loud, and the payload of each frame. A frame starts at each unit.
    """
    n = len(raw) // UNIT
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[units[:-1]] = True
    last[units[1:] - 1] = True
    mel, energy = np.empty((n, MELS), np.int16), np.empty(n)
    for lo in range(0, n, RUN):
        mel[lo : lo + RUN], energy[lo : lo + RUN] = _transformed(raw, first, last, lo, min(lo + RUN, n))
    of = np.repeat(np.arange(len(units) - 1), np.diff(units))
    count = np.diff(units)
    mean = np.add.reduceat(energy, units[:-1]) / count
    spread = np.sqrt(np.maximum(np.add.reduceat((energy - mean[of]) ** 2, units[:-1]) / count, 0))
    above, below = energy > np.round((mean + UPPER * spread)[of], 3), energy < np.round((mean + LOWER * spread)[of], 3)
    # the last frame that was above the upper or below the lower threshold decides; each payload starts quiet
    mark = np.where(above, np.arange(n), -1)
    off = np.where(below | first & ~above, np.arange(n), -1)
    loud = np.maximum.accumulate(mark) > np.maximum.accumulate(off)
    return mel, loud, of


def segments(loud: np.ndarray) -> list[tuple[float, float]]:
    """Time spans in seconds of the runs of loud frames of one payload."""
    edge = np.diff(np.concatenate(([0], loud.astype(np.int8), [0])))
    return [(a * UNIT / RATE_IN, b * UNIT / RATE_IN) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def payload_of(text: bytes) -> bytes:
    return text + b" " * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def _stored(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Slices: first row, texts, files, samples read back, features."""
    data, offsets = text_buffers(batch.column(1))
    for i, _, part, off in slices(data, offsets):
        whole = part.tobytes()
        texts = [whole[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
        files = [wav(payload_of(t)) for t in texts]
        back = [samples(f) for f in files]
        units = np.concatenate(([0], np.cumsum([len(p) // UNIT for p in back])))
        yield i, texts, files, back, units, *features(np.frombuffer(b"".join(back), np.uint8), units)


def to_stream(mel: np.ndarray) -> bytes:
    """The Arrow stream of one payload's bands (frames x MELS)."""
    n = len(mel)
    start = np.arange(0, n, FRAMES)
    block = np.full((len(start) * FRAMES, MELS), SILENCE, np.int16)
    block[:n] = mel
    storage = pa.FixedSizeListArray.from_arrays(pa.array(block.ravel()), FRAMES * MELS)
    bands = pa.ExtensionArray.from_storage(BLOCK.field("log_mel").type, storage)
    times = [pa.array(x * UNIT / RATE_IN) for x in (start, np.minimum(start + FRAMES, n))]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, BLOCK) as out:
        out.write_batch(pa.RecordBatch.from_arrays([*times, bands], schema=BLOCK))
    return sink.getvalue().to_pybytes()


def from_stream(stream: bytes) -> pa.Table:
    """The blocks of one row, with their bands as a tensor column."""
    return pa.ipc.open_stream(stream).read_all()


def bands(blocks: pa.Table) -> np.ndarray:
    """(blocks, FRAMES, MELS) of a table of blocks."""
    return blocks.column("log_mel").combine_chunks().to_numpy_ndarray()


def _media_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
    for batch in batches:
        for i, texts, files, back, units, mel, loud, _ in _stored(batch):
            n = len(texts)
            rows = list(zip(units[:-1], units[1:], strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, n),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array(files, pa.large_binary()),
                    pa.array([len(p) for p in back], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in back]),
                    pa.array([zlib.crc32(p[-16:]) for p in back], pa.int64()),
                    pa.array([to_stream(mel[a:b]) for a, b in rows], pa.large_binary()),
                    pa.array([[{"start_s": s, "end_s": e} for s, e in segments(loud[a:b])] for a, b in rows], span),
                ],
                ["id", "n_bytes", "media", "payload_bytes", "payload_sha256", "tail_crc32", "log_mel", "segments"],
            )


MEDIA = "id long, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, log_mel binary, segments array<struct<start_s:double,end_s:double>>"


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the stored file, what is read back from it, its blocks of log-mel bands as an Arrow stream, and its loud spans."""
    lean(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(_media_batches, MEDIA)


def tensors(media: pa.Table) -> pa.Table:
    """The blocks of all rows of a table with id and log_mel: id, start_s, end_s, log_mel as a fixed-shape tensor column."""
    parts = []
    for key, stream in zip(media.column("id"), media.column("log_mel"), strict=True):
        blocks = from_stream(stream.as_py())
        parts.append(blocks.add_column(0, "id", pa.array([key.as_py()] * len(blocks), pa.int64())))
    return pa.concat_tables(parts) if parts else BLOCK.empty_table().add_column(0, "id", pa.array([], pa.int64()))


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of :func:`to_media` without the stored forms, with their sizes and digests."""
    for media in _media_batches(batches):
        column = {name: media.column(k) for k, name in enumerate(media.schema.names)}
        marks = []
        for stream, spans in zip(column["log_mel"], column["segments"], strict=True):
            blocks, loud = from_stream(stream.as_py()), spans.as_py()
            seconds = round(sum(s["end_s"] - s["start_s"] for s in loud), 6)
            marks.append(f"{blocks.column('end_s')[-1].as_py()}:{len(loud)}:{seconds}:{hashlib.sha256(bands(blocks).tobytes()).hexdigest()}")
        files = [f.as_py() for f in column["media"]]
        yield pa.RecordBatch.from_arrays(
            [*(column[c] for c in ("id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")), pa.array([len(f) for f in files], pa.int64()), pa.array([hashlib.sha256(f).hexdigest() for f in files]), pa.array(marks, pa.string())],
            ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's stored payload and features: sizes and digests, taken where the columns are made."""
    lean(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(_digest_batches, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
