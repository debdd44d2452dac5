"""Media columns: texts stored as WAV audio, read back, and fingerprinted.

The UTF-8 bytes of a text, padded with spaces to a positive multiple of
`PAD` bytes, become unsigned 8-bit mono samples of a WAV file.  The file is
read back by the wave module, and the samples that come out are what all
columns but n_bytes describe.  A short-time Fourier transform finds the
strongest bins of each frame; pairs of peaks of the same or nearby frames give
fingerprints (bin, bin, distance) with the frame as their time code.

Defined results: a null text is an empty one; equal texts give equal values;
rows are handled one by one, so repeated ids, other columns and empty tables
need no special case.
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

from .shared import frugal, small_batches

PAD, RATE = 192, 8000
FRAME, HOP, FAN_OUT, PEAKS = 256, 192, 3, 2
#: Samples transformed at a time; bounds the memory that a long text needs.
CHUNK = 1 << 20

SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary, fingerprint_time array<int>, fingerprint_code array<int>"


def payload(text: bytes) -> bytes:
    return text + b" " * (PAD if not text else -len(text) % PAD)


def encode_wav(data: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(data)
    return out.getvalue()


def decode_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def spectral_peaks(samples: np.ndarray) -> np.ndarray:
    """The PEAKS strongest bins of each frame, strongest first; the last frame is padded with silence."""
    frames = max(1, -(-(len(samples) - FRAME + HOP) // HOP)) if len(samples) else 0
    if not frames:
        return np.zeros((0, PEAKS), np.int32)
    padded = np.full((frames - 1) * HOP + FRAME, 128, np.uint8)
    padded[: min(len(samples), len(padded))] = samples[: len(padded)]
    window = np.hanning(FRAME).astype(np.float32)
    found = []
    step = max(1, CHUNK // FRAME)
    view = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    for at in range(0, frames, step):
        spectrum = np.abs(np.fft.rfft((view[at : at + step].astype(np.float32) - 128) * window, axis=1))[:, 1:]
        # Rounded, so that equal samples give equal peaks whichever way the transform is vectorised.
        spectrum = np.round(spectrum, 2)
        top = np.empty((len(spectrum), PEAKS), np.int32)
        for k in range(PEAKS):
            top[:, k] = spectrum.argmax(axis=1)
            spectrum[np.arange(len(spectrum)), top[:, k]] = -1
        found.append(top + 1)
    return np.concatenate(found)


def fingerprints(peaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(time code, fingerprint) of each pair of peaks of one frame or of frames up to FAN_OUT apart: bin << 12 | bin << 4 | distance."""
    times, codes = [np.arange(len(peaks), dtype=np.int32)] * (PEAKS - 1), [(peaks[:, i] << 12) | (peaks[:, i + 1] << 4) for i in range(PEAKS - 1)]
    for d in range(1, FAN_OUT + 1):
        a, b = peaks[:-d], peaks[d:]
        for i in range(PEAKS):
            for j in range(PEAKS):
                codes.append((a[:, i] << 12) | (b[:, j] << 4) | d)
                times.append(np.arange(len(a), dtype=np.int32))
    time, code = np.concatenate(times), np.concatenate(codes).astype(np.int32)
    order = np.lexsort((code, time))
    return time[order], code[order]


def media_columns(docs: DataFrame, with_media: bool = True) -> DataFrame:
    """One row per document: the contract's columns, the stored file and its time-coded fingerprints.

    `with_media=False` leaves out the file and the arrays where only the digests are wanted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    raw = (text or "").encode()
                    media = encode_wav(payload(raw))
                    back = decode_wav(media)
                    time, code = fingerprints(spectral_peaks(np.frombuffer(back, np.uint8)))
                    feature = hashlib.sha256(time.astype("<i4").tobytes() + code.astype("<i4").tobytes()).hexdigest()
                    row = (doc_id, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), f"{len(code)}:{feature}")
                    rows.append(row + ((media, time, code) if with_media else (None, None, None)))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return small_batches(docs).select(docs.doc_id.cast("long").alias("doc_id"), docs.text).mapInArrow(frugal(run), SCHEMA)
