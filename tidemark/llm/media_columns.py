"""Media columns: texts carried as 8-bit WAV, their spectrogram and peak-pair fingerprints.

A text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64, are stored as 8-bit
samples by the ``wave`` module, read back, cut into frames, Fourier-transformed, and the pairs of
spectral peaks become time-coded hashes. Frames overlap by three quarters and the first begins in
silence, so every sample lies in four frames. Everything depends on the text alone: equal texts
give equal media and features.

Defined results: a null text is the empty one (64 zero samples); a text whose peaks make no pair has
its single peaks as hashes, with no second bin and no gap; very long texts are
transformed in blocks of frames, so memory is bounded by the payload, not its spectrogram; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, table, texts_of

UNIT, RATE = 64, 8000
FRAME, HOP, BLOCK = 256, 64, 2048
#: Silence before the first sample.
LEAD = FRAME - HOP
BANDS = ((4, 12), (12, 32), (32, 64), (64, 128))
#: A peak is paired with this many peaks of later frames, at most this many frames later.
FAN, REACH = 3, 16
_WINDOW = np.hanning(FRAME).astype(np.float32)


def payload(text: str) -> tuple[int, bytes]:
    """UTF-8 length, and the bytes padded to a positive multiple of 64."""
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))


def to_wav(data: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(data)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def spectral_peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers and frequency bins of the peaks, by time then bin.

    In each frame and band the loudest bin is a candidate; it is a peak where its level is not
    below that of the same band one frame earlier and above the one a frame later.
    """
    x = np.frombuffer(samples, np.uint8)
    frames = -(-(len(x) + LEAD) // HOP)
    times, bins = [], []
    for lo in range(0, frames, BLOCK):
        hi = min(frames, lo + BLOCK)
        a, b = max(0, lo - 1), min(frames, hi + 1)
        start, end = a * HOP - LEAD, (b - 1) * HOP + FRAME - LEAD
        part = x[max(0, start) : end].astype(np.float32) - 128.0
        before = max(0, -start)
        part = np.pad(part, (before, end - start - before - len(part)))
        spectrum = np.fft.rfft(sliding_window_view(part, FRAME)[::HOP] * _WINDOW, axis=1)
        level = spectrum.real**2 + spectrum.imag**2
        for low, high in BANDS:
            best = level[:, low:high].argmax(1)
            top = level[np.arange(len(level)), low + best]
            before = np.concatenate([[-1.0], top[:-1]])
            after = np.concatenate([top[1:], [-1.0]])
            hit = (top >= before) & (top > after) & (top > 1e-6)
            hit[: lo - a] = False
            hit[len(hit) - (b - hi) :] = False
            at = np.flatnonzero(hit)
            times.append(a + at)
            bins.append(low + best[at])
    t, f = np.concatenate(times), np.concatenate(bins)
    order = np.lexsort((f, t))
    return t[order], f[order]


def fingerprints(t: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Time-coded pair hashes: frame << 24 | first bin << 16 | second bin << 8 | frames between.

    Without a pair, each peak alone: frame << 24 | bin << 16.
    """
    out, later = [], np.searchsorted(t, t, "right")
    for k in range(FAN):
        at = np.flatnonzero(later + k < len(t))
        to = later[at] + k
        ok = t[to] - t[at] <= REACH
        at, to = at[ok], to[ok]
        out.append((t[at] << 24) | (f[at] << 16) | (f[to] << 8) | (t[to] - t[at]))
    pairs = np.sort(np.concatenate(out))
    return pairs if len(pairs) else (t << 24) | (f << 16)


SCHEMA = (
    "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, "
    "media_bytes bigint, media_sha256 string, feature string"
)


def media_columns(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """One row per document; with ``keep_media`` also the WAV bytes and the fingerprint array."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, media_out, prints_out = [], [], []
        for text in texts_of(batch):
            n, data = payload(text)
            media = to_wav(data)
            back = from_wav(media)
            prints = fingerprints(*spectral_peaks(back))
            feature = f"{len(prints)}:{hashlib.sha256(prints.astype('<i8').tobytes()).hexdigest()}"
            rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            if keep_media:
                media_out.append(media)
                prints_out.append(prints.tolist())
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        cols = [batch.column("doc_id"), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))]
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        if keep_media:
            cols += [pa.array(media_out, pa.binary()), pa.array(prints_out, pa.list_(pa.int64()))]
            names += ["media", "fingerprints"]
        return pa.RecordBatch.from_arrays(cols, names)

    schema = SCHEMA + (", media binary, fingerprints array<bigint>" if keep_media else "")
    return map_batches(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), one, schema)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))
