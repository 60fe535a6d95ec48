"""Media columns: WAV bytes read by the wave module, Fourier transforms, and spectral-peak pair fingerprints.

A fingerprint is an array of 64-bit entries ordered by time: the frame of the first peak in
the high 32 bits; below them the two peaks' frequency bins (8 bits each) and the frames
between them (8 bits).
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import pieces, small_batches

RATE = 8000
FRAME, HOP = 256, 128
#: A peak is the strongest bin of a cell of so many frames by one of so many bands.
CELL, BANDS = 8, 4
FAN_OUT = 4
#: Frames transformed at once, a multiple of CELL.
BLOCK = 4096
PAD = 64


def pack_payload(text: str | None) -> bytes:
    """The text as UTF-8 with bytes 0 up to a positive multiple of 64; null is empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (-len(raw) % PAD if raw else PAD)


def to_wav(payload: bytes) -> bytes:
    """One channel of 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as f:
        return f.readframes(f.getnframes())


_WINDOW = np.hanning(FRAME + 1)[:FRAME].astype(np.float32)


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames and frequency bins of the spectral peaks, by frame and then bin. Blocks bound the memory for long media."""
    n = max(1, -(-max(0, len(samples) - FRAME) // HOP) + 1)
    signal = np.zeros((n - 1) * HOP + FRAME, np.float32)
    signal[: len(samples)] = samples
    signal[: len(samples)] -= np.float32(128)
    frames = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP]
    width = FRAME // 2 // BANDS
    times, bins = [], []
    for at in range(0, n, BLOCK):
        part = frames[at : at + BLOCK]
        power = np.abs(np.fft.rfft(part * _WINDOW)[:, 1:])
        cells = -(-len(part) // CELL)
        if cells * CELL != len(part):
            power = np.concatenate([power, np.zeros((cells * CELL - len(part), FRAME // 2), power.dtype)])
        grid = power.reshape(cells, CELL, BANDS, width).transpose(0, 2, 1, 3).reshape(cells, BANDS, CELL * width)
        best = grid.argmax(-1)
        found = np.take_along_axis(grid, best[..., None], -1)[..., 0] > 0
        t = at + np.arange(cells)[:, None] * CELL + best // width
        f = np.arange(BANDS)[None, :] * width + best % width + 1
        times.append(t[found])
        bins.append(f[found])
    t, f = np.concatenate(times), np.concatenate(bins)
    order = np.lexsort((f, t))
    return t[order], f[order]


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Each peak paired with the FAN_OUT that follow it, if within 255 frames."""
    t, f = peaks(samples)
    found = []
    for step in range(1, FAN_OUT + 1):
        gap = t[step:] - t[:-step]
        near = gap < 256
        first, second = t[:-step][near], gap[near]
        found.append((first << 32) | (f[:-step][near] << 16) | (f[step:][near] << 8) | second)
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


FIELDS = [
    ("n_bytes", pa.int64(), "long"),
    ("payload_bytes", pa.int64(), "long"),
    ("payload_sha256", pa.string(), "string"),
    ("tail_crc32", pa.int64(), "long"),
    ("media_bytes", pa.int64(), "long"),
    ("media_sha256", pa.string(), "string"),
    ("n_frames", pa.int64(), "long"),
    ("feature", pa.string(), "string"),
    ("media", pa.binary(), "binary"),
    ("fingerprint", pa.list_(pa.int64()), "array<bigint>"),
]


def media_columns(df: DataFrame, key: str = "doc_id", text: str = "text", columns: tuple[str, ...] = tuple(f[0] for f in FIELDS)) -> DataFrame:
    """One row per input row: the key and the asked columns, made from the whole text.

    Null and empty texts are 64 zero bytes, equal texts give equal values, repeated rows and
    null keys come back as they are. Without shuffle: a narrow map over Arrow batches, cut so
    that a worker holds a few MB of text, however long its batch; one text is held whole.
    """
    small_batches(df.sparkSession)
    own = df.select(df[key].alias("_key"), df[text].cast("string").alias("_text"))
    fields = [f for f in FIELDS if f[0] in columns]
    schema = pa.schema([("_key", pa.null())] + [(n, t) for n, t, _ in fields])
    wants_media, wants_print = "media" in columns, "fingerprint" in columns

    def row(value: str | None) -> dict:
        payload = pack_payload(value)
        media = to_wav(payload)
        stored = from_wav(media)
        prints = fingerprint(np.frombuffer(stored, np.uint8))
        return {
            "n_bytes": len((value or "").encode("utf-8", "surrogatepass")),
            "payload_bytes": len(stored),
            "payload_sha256": hashlib.sha256(stored).hexdigest(),
            "tail_crc32": zlib.crc32(stored[-PAD:]),
            "media_bytes": len(media),
            "media_sha256": hashlib.sha256(media).hexdigest(),
            "n_frames": max(1, -(-max(0, len(stored) - FRAME) // HOP) + 1),
            "feature": f"{len(prints)}:{hashlib.blake2b(prints.astype('<i8').tobytes(), digest_size=16).hexdigest()}",
            "media": media if wants_media else None,
            "fingerprint": prints.tolist() if wants_print else None,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "_text"):
                rows = [row(v) for v in part.column("_text").to_pylist()]
                arrays = [part.column("_key")] + [pa.array([r[n] for r in rows], t) for n, t, _ in fields]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    kind = own.schema["_key"].dataType.simpleString()
    out = own.mapInArrow(run, ", ".join([f"_key {kind}"] + [f"{n} {d}" for n, _, d in fields]))
    return out.withColumnRenamed("_key", key)
