"""Media columns: texts stored as WAV files, read back, and fingerprinted by spectral peaks.

`to_media` stores each text's UTF-8 bytes as unsigned 8-bit mono samples. `fingerprints` reads a WAV
column with the wave module, takes short-time Fourier transforms, keeps the peaks of each frame's
spectrum and pairs each with the next peaks in time: a pair's code holds both frequencies and their
distance, and its time is the first peak's frame.

Defined cases: null and empty texts are one block of zero bytes; any length is padded to a whole
number of blocks; equal texts give equal media and equal fingerprints; of equal magnitudes the lower
frequency wins; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexline.llm.common import SLICE_BYTES, slices, whole_text

BLOCK = 64
RATE = 8000
FRAME, HOP = 128, 64
# A peak is paired with this many following peaks.
FAN_OUT = 2


def wav_bytes(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(1)
        file.setframerate(RATE)
        file.writeframes(payload)
    return out.getvalue()


def samples_of(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as file:
        return file.readframes(file.getnframes())


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each whole text as a WAV file."""

    def stored(batches):
        for ids, texts in slices(batches):
            media = [wav_bytes(t + bytes(-len(t) % BLOCK if t else BLOCK)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())],
                ["doc_id", "n_bytes", "media"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return rows.mapInArrow(stored, "doc_id long, n_bytes long, media binary")


def peak_pairs(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times and codes of the peak pairs of one recording."""
    values = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    if len(values) < FRAME:
        values = np.pad(values, (0, FRAME - len(values)))
    window = np.hanning(FRAME).astype(np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(values, FRAME)[::HOP]
    found_t, found_f = [], []
    # Long recordings go piece by piece; a frame's peaks do not depend on other frames.
    for k in range(0, len(frames), 1 << 15):
        power = np.abs(np.fft.rfft(frames[k : k + (1 << 15)] * window, axis=1))[:, 1:]
        inner = power[:, 1:-1]
        # Rounded, so that a tie in exact arithmetic is one here too.
        heights = np.where((inner >= power[:, :-2]) & (inner > power[:, 2:]), np.round(inner, 2), -1)
        strongest = heights.argmax(axis=1)
        has = np.flatnonzero(heights[np.arange(len(heights)), strongest] > 0)
        found_t.append(has + k)
        found_f.append(strongest[has] + 2)
    t, f = np.concatenate(found_t), np.concatenate(found_f)
    times, codes = [], []
    for step in range(1, FAN_OUT + 1):
        gap = np.minimum(t[step:] - t[:-step], 255)
        times.append(t[: max(0, len(t) - step)])
        codes.append(f[: max(0, len(f) - step)] << 16 | f[step:] << 8 | gap)
    times, codes = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((codes, times))
    return times[order].astype(np.int32), codes[order].astype(np.int32)


def fingerprints(media: DataFrame) -> DataFrame:
    """Adds, to rows with a column media: payload (the samples read back), times and codes."""
    kept = [c for c in media.columns if c not in ("media", "payload", "times", "codes")]

    def featured(batches):
        for batch in batches:
            at, n = batch.schema.get_field_index("media"), batch.num_rows
            begin = 0
            while begin < n:
                end, held = begin, 0
                payloads, times, codes = [], [], []
                while end < n and held < SLICE_BYTES:
                    payload = samples_of(batch.column(at)[end].as_py())
                    t, c = peak_pairs(payload)
                    payloads.append(payload)
                    times.append(t)
                    codes.append(c)
                    held += len(payload)
                    end += 1
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(c)) for c in [*kept, "media"]]
                    + [pa.array(payloads, pa.binary()), _lists(times), _lists(codes)],
                    [*kept, "media", "payload", "times", "codes"],
                )
                begin = end

    rows = media.select(*kept, "media")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, payload binary, times array<int>, codes array<int>"
    return rows.mapInArrow(featured, schema)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays)))
