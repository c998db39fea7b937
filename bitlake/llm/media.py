"""Media columns: WAV payloads read by the wave module, spectra by short-time Fourier transforms, and fingerprints.

A payload of 8-bit samples is stored losslessly as a mono WAV file in a binary column. Reading gives back the samples
and the fingerprint: the strongest bin of each band of a frame is a peak if it stands out of its band, and each peak
is paired with the next peaks; a pair is stored with the time code of its first peak.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE, FRAME, HOP, UNIT = 8000, 256, 128, 64
#: Bins of each band, how far a peak must stand out of its band's mean, peaks that one is paired with.
BANDS, OVER, FAN = ((2, 16), (16, 48), (48, 128)), 2.0, 2
FRAMES_AT_ONCE = 8192
SCHEMA = "media binary, samples binary, rate int, times array<int>, pairs array<int>"


def payload(text: str | None) -> bytes:
    """UTF-8 bytes of a text, null as empty, with zero bytes up to a positive multiple of UNIT."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % UNIT or (UNIT if not raw else 0))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> tuple[bytes, int]:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes()), w.getframerate()


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers and bins of the peaks, in order of time. The last frame is padded with silence, so that each sample is in one."""
    x = np.frombuffer(samples, np.uint8)
    x = np.concatenate([x, np.full(FRAME - len(x) if len(x) < FRAME else -(len(x) - FRAME) % HOP, 128, np.uint8)])
    window = np.hanning(FRAME).astype(np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    times, bins = [], []
    for at in range(0, len(frames), FRAMES_AT_ONCE):
        part = (frames[at : at + FRAMES_AT_ONCE].astype(np.float32) - 128) * window
        spectrum = np.abs(np.fft.rfft(part, axis=1))
        for lo, hi in BANDS:
            band = spectrum[:, lo:hi]
            best = band.argmax(1)
            top = band[np.arange(len(band)), best]
            good = np.flatnonzero(top > OVER * band.mean(1) + 1e-3)
            times.append(good + at)
            bins.append(best[good] + lo)
    t, b = np.concatenate(times), np.concatenate(bins)
    order = np.lexsort((b, t))
    return t[order], b[order]


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Time codes and hashes of peak pairs: first bin, second bin and frames between them, 8 bits each."""
    t, b = peaks(samples)
    times, pairs = [], []
    for k in range(1, FAN + 1):
        gap = t[k:] - t[:-k]
        near = gap < 256
        times.append(t[:-k][near])
        pairs.append((b[:-k][near] << 16) | (b[k:][near] << 8) | gap[near])
    t, p = np.concatenate(times), np.concatenate(pairs)
    order = np.lexsort((p, t))
    return t[order].astype(np.int32), p[order].astype(np.int32)


def with_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media, samples, rate, times, pairs): one row a document.

    n_bytes is the text's length before padding; samples are what reading the media gives back. Null and empty texts
    give one unit of zero samples; equal texts give equal media, repeated rows too; texts of any length are stored
    whole. Ids may be null; an empty table gives an empty result; other columns are not read.
    """
    kind = dict(docs.dtypes)[id_col]

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                rows = []
                for text in part["text"]:
                    media = to_wav(payload(text))
                    samples, rate = from_wav(media)
                    rows.append((media, samples, rate, *fingerprint(samples)))
                out = pd.DataFrame(rows, columns=["media", "samples", "rate", "times", "pairs"])
                out.insert(0, "n_bytes", part["n_bytes"].to_numpy())
                out.insert(0, id_col, part[id_col].to_numpy())
                yield out

    rows = docs.select(id_col, F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInPandas(make, f"`{id_col}` {kind}, n_bytes long, {SCHEMA}")
