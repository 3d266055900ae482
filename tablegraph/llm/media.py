"""Media columns: bytes kept as WAV, read by the wave module, and spectral-peak pair fingerprints.

A payload is the text in UTF-8 with zero bytes up to a positive multiple of 64. It is stored
losslessly as 8-bit mono samples of a WAV file in a binary column. Reading goes through the stored
bytes: short-time Fourier transforms (windows of ``FRAME`` samples, half overlapping) give the
strongest bin of each band, and peaks that follow each other within ``REACH`` frames make a pair; the
column of pairs is two arrays, the frame of the first peak and the code of both bins and their
distance. Frames are transformed some thousands at a time, so a very long recording needs no more
memory than its samples.

Null texts count as empty: 64 zero bytes, whose spectrum has no peak and so no pairs. Equal texts get
equal media and pairs. Rows pass through in place with all columns; added columns replace those of
their names.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from tablegraph.llm.frame import tuned

RATE = 8000
FRAME = 256
BANDS = (1, 9, 25, 57, 129)
REACH = 2
AT_ONCE = 4096
# Bytes of media that one outgoing batch may hold before it is sent on.
BATCH_BYTES = 16 << 20


def payload(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + bytes(-len(data) % 64 if data else 64)


def to_wav(data: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(data)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as f:
        return f.readframes(f.getnframes())


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Strongest bin of each band for each frame, and whether it stands out."""
    x = np.frombuffer(samples, np.uint8)
    step = FRAME // 2
    frames = max(1, -(-len(x) // step) - 1)
    x = np.pad(x, (0, (frames + 1) * step - len(x)))
    views = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::step][:frames]
    window = np.hanning(FRAME).astype(np.float32)
    bins, strong = [], []
    for a in range(0, frames, AT_ONCE):
        part = views[a : a + AT_ONCE].astype(np.float32)
        part -= part.mean(axis=1, keepdims=True)
        power = np.abs(np.fft.rfft(part * window, axis=1))
        # Rounded, so that a difference in the last bits of a transform changes no choice.
        power = np.round(power, 2)
        level = power[:, 1:].mean(axis=1)
        best = [power[:, lo:hi].argmax(axis=1) + lo for lo, hi in zip(BANDS, BANDS[1:])]
        bins.append(np.stack(best, axis=1))
        rows = np.arange(len(part))
        strong.append(np.stack([power[rows, b] > level for b in best], axis=1))
    return np.concatenate(bins), np.concatenate(strong)


def pairs(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times and codes of the peak pairs, by time, distance and band."""
    bins, strong = peaks(samples)
    times, codes = [], []
    for gap in range(1, REACH + 1):
        n = len(bins) - gap
        if n > 0:
            both = strong[:n] & strong[gap:]
            at, band = np.nonzero(both)
            times.append(at)
            codes.append((bins[:n][at, band] << 12) | (bins[gap:][at, band] << 2) | gap)
    if not times:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    at, code = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((code, at))
    return at[order].astype(np.int32), code[order].astype(np.int32)


def _mapped(df: DataFrame, source: str, added: list[tuple[str, object, pa.DataType]], convert) -> DataFrame:
    """The rows with columns made from ``source``, sent on in batches of bounded size."""
    tuned(df.sparkSession)
    new = [a[0] for a in added]
    kept = [f for f in df.schema.fields if f.name not in new]
    schema = StructType([*kept, *[StructField(n, t) for n, t, _ in added]])
    names = [f.name for f in kept]

    def run(batches):
        for batch in batches:
            given = batch.column(batch.schema.get_field_index(source))
            start, held, rows = 0, 0, []
            for i in range(batch.num_rows):
                rows.append(convert(given[i].as_py()))
                held += sum(len(x) for x in rows[-1])
                if held >= BATCH_BYTES or i + 1 == batch.num_rows:
                    part = batch.slice(start, i + 1 - start)
                    columns = [part.column(part.schema.get_field_index(n)) for n in names]
                    made = [pa.array([r[k] for r in rows], a[2]) for k, a in enumerate(added)]
                    yield pa.RecordBatch.from_arrays([*columns, *made], names=[*names, *new])
                    start, held, rows = i + 1, 0, []

    return df.mapInArrow(run, schema)


def stored(df: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """Adds the WAV file of each row's payload."""
    return _mapped(df, text_col, [(media_col, BinaryType(), pa.binary())],
                   lambda text: (to_wav(payload(text)),))


def fingerprinted(df: DataFrame, media_col: str = "media") -> DataFrame:
    """Adds ``payload`` read back from the media, and its pairs in ``times`` and ``codes``."""

    def convert(media):
        data = from_wav(media) if media is not None else b""
        return (data, *pairs(data))

    ints = pa.list_(pa.int32())
    return _mapped(df, media_col, [
        ("payload", BinaryType(), pa.binary()), ("times", ArrayType(IntegerType()), ints),
        ("codes", ArrayType(IntegerType()), ints)], convert)
