"""Media columns: texts as WAV files, their spectra and spectral-peak fingerprints.

The payload is stored losslessly as unsigned 8-bit samples and read back by the
``wave`` module. Peaks of a short-time Fourier transform are paired with the
next peaks in time; each pair is a code of two frequencies and the time between
them, stored with the frame in which it begins.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsight.llm.staging import documents, map_rows

UNIT = 192
RATE = 8000
FRAME = 256
HOP = 192
#: Bins of the spectrum, lowest without the constant part, in which one peak per frame is sought.
BANDS = ((2, 10), (10, 24), (24, 50), (50, 90), (90, 129))
#: A peak is larger than its band's neighbours in time and so many times the frame's mean.
PROMINENCE = 2.0
FAN_OUT = 3
#: Frames that are transformed at once, so a text of any length takes bounded memory.
CHUNK = 2048

OUTPUTS = {
    "payload_bytes": pa.int64(),
    "media": pa.binary(),
    "frame": pa.list_(pa.int32()),
    "code": pa.list_(pa.int64()),
    "n_frames": pa.int64(),
    "payload_sha256": pa.string(),
    "tail_crc32": pa.int64(),
}


def payload(data: bytes) -> bytes:
    """``data`` with blanks up to a positive multiple of UNIT."""
    return data + b" " * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def to_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(samples)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as f:
        return f.readframes(f.getnframes())


def spectral_peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Frames and bins of the peaks, by frame, then bin; and the number of frames."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128.0
    n_frames = 1 + max(0, -(-(len(x) - FRAME) // HOP))
    x = np.pad(x, (0, (n_frames - 1) * HOP + FRAME - len(x)))
    views = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    window = np.hanning(FRAME).astype(np.float32)
    found = []
    for start in range(0, n_frames, CHUNK):
        low, high = max(0, start - 1), min(n_frames, start + CHUNK + 1)
        power = np.abs(np.fft.rfft(views[low:high] * window, axis=1)).astype(np.float32)
        mean = power[:, 1:].mean(axis=1)
        for a, b in BANDS:
            best = power[:, a:b].argmax(axis=1) + a
            top = power[np.arange(len(power)), best]
            around = np.concatenate([[-1.0], top, [-1.0]])
            keep = (top > around[:-2]) & (top >= around[2:]) & (top > PROMINENCE * mean)
            keep[: start - low] = False
            keep[min(n_frames, start + CHUNK) - low :] = False
            at = np.flatnonzero(keep)
            found.append(np.stack([at + low, best[at]]))
    both = np.concatenate(found, axis=1)
    both = both[:, np.lexsort((both[1], both[0]))]
    return both[0], both[1], n_frames


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs of each peak with the next FAN_OUT peaks: frame of the first, and code."""
    frame, bin_, n_frames = spectral_peaks(samples)
    frames, codes = [], []
    for step in range(1, FAN_OUT + 1):
        gap = frame[step:] - frame[:-step]
        frames.append(frame[:-step])
        codes.append((bin_[:-step].astype(np.int64) << 40) | (bin_[step:].astype(np.int64) << 32) | gap)
    t, c = np.concatenate(frames), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order], n_frames


def _encode(texts: list[str | None]) -> list[tuple]:
    rows = []
    for text in texts:
        stored = to_wav(payload((text or "").encode()))
        back = from_wav(stored)
        t, c, n = fingerprint(back)
        rows.append((len(back), stored, t, c, n, hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:])))
    return list(zip(*rows, strict=True))


def media_column(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns of ``keep``; the WAV file, its fingerprint (arrays ``frame`` and ``code``) and checksums.

    A null text is an empty one; both give one unit of blanks. Equal texts give
    equal rows, whatever batch they are in. Map only: nothing is shuffled.
    """
    return map_rows(docs, keep, [F.col(text)], OUTPUTS, lambda: _encode)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, n_frames and n_pairs; ``feature`` is the hash of the time-coded pairs."""
    docs = documents(spark, sf_dir).select(
        "doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    )
    media = media_column(docs, keep=("doc_id", "n_bytes"))
    pairs = F.concat_ws(",", F.col("frame").cast("array<string>")), F.concat_ws(",", F.col("code").cast("array<string>"))
    return media.select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2(F.col("media"), 256).alias("media_sha256"),
        F.sha2(F.concat_ws(";", *pairs), 256).alias("feature"),
        "n_frames",
        F.size("code").cast("long").alias("n_pairs"),
    )
