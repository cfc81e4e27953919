"""Recordings: synthesis from text, WAV files as source and sink, sample rows."""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import CODE_OF

RECORDING = "rec_id string, fs int, samples array<float>"


def keying_events(text: str, wpm: float, ratio: float = 3.0) -> list[tuple[int, float]]:
    """(state, ms) of keyed text: gaps of 1, 3 and 7 dits."""
    dit, out = 1200.0 / wpm, []
    for word in text.upper().split():
        for ch in word:
            for e in CODE_OF.get(ch, ""):
                out += [(1, dit * (ratio if e == "-" else 1)), (0, dit)]
            if out and ch in CODE_OF:
                out[-1] = (0, 3 * dit)
        if out:
            out[-1] = (0, 7 * dit)
    return out[:-1]


def synthesize(text: str, fs: int = 16000, tone: float = 700.0, wpm: float = 20.0, snr_db: float | None = None, seed: int = 0, lead_ms: float = 200.0) -> np.ndarray:
    """Keyed tone with one phase, 3 ms ramps, optional seeded noise, largest value 1."""
    events = [(0, lead_ms), *keying_events(text, wpm), (0, lead_ms)]
    gate = np.concatenate([np.full(int(round(ms * fs / 1000)), s, float) for s, ms in events])
    ramp = np.hanning(2 * max(int(0.003 * fs), 1) + 1)
    sig = np.convolve(gate, ramp / ramp.sum(), "same") * np.sin(2 * np.pi * tone / fs * np.arange(len(gate)))
    sig /= np.abs(sig).max() + 1e-12
    if snr_db is not None:
        noise = np.random.default_rng(seed).normal(size=len(sig))
        sig = sig + noise * np.sqrt(np.mean(sig**2) / 10 ** (snr_db / 10))
    return (sig / (np.abs(sig).max() + 1e-12)).astype(np.float32)


def wav_bytes(sig: np.ndarray, fs: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(int(fs))
        w.writeframes((np.clip(sig, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def wav_samples(content: bytes) -> tuple[int, np.ndarray]:
    """(rate, samples): mean over channels, divided by the largest value + 1e-8; 8-bit offsets stay."""
    with wave.open(io.BytesIO(content), "rb") as w:
        fs, channels, width = w.getframerate(), w.getnchannels(), w.getsampwidth()
        raw = w.readframes(w.getnframes())
    if width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 2] << 24) | (b[:, 1] << 16) | (b[:, 0] << 8)) >> 8
    else:
        x = np.frombuffer(raw, {1: "u1", 2: "<i2", 4: "<i4"}[width])
    x = x.astype(np.float32).reshape(-1, channels).mean(1)
    return fs, x / (np.abs(x).max(initial=0.0) + 1e-8)


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """Recordings of a folder or glob of WAV files, a file a row; a file that isn't one has a null rate and no samples."""

    def parse(batches):
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                try:
                    fs, x = wav_samples(content.as_py())
                except (wave.Error, EOFError, KeyError, ValueError):
                    fs, x = None, np.zeros(0, np.float32)
                yield pa.record_batch([pa.array([name.as_py()]), pa.array([fs], pa.int32()), pa.array([x], pa.list_(pa.float32()))], names=["rec_id", "fs", "samples"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, RECORDING)


def write_wav(recordings: DataFrame) -> DataFrame:
    """(rec_id, content): WAV bytes of each recording, for any binary sink."""

    def render(batches):
        for b in batches:
            fs = b.column(1).to_pylist()
            out = [wav_bytes(np.asarray(x.values), r) for x, r in zip(b.column(2), fs, strict=True)]
            yield pa.record_batch([b.column(0), pa.array(out, pa.binary())], names=["rec_id", "content"])

    return recordings.select("rec_id", "fs", "samples").mapInArrow(render, "rec_id string, content binary")


def synthesized(texts: DataFrame, rec: str, text: str, fs: int = 8000, tone: float = 700.0, wpm: float = 20.0, snr_db: float | None = None) -> DataFrame:
    """Recordings of keyed texts; noise is seeded by the recording's id."""

    def render(batches):
        import zlib

        for b in batches:
            for r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sig = synthesize(t or "", fs, tone, wpm, snr_db, zlib.crc32(r.encode()))
                yield pa.record_batch([pa.array([r]), pa.array([fs], pa.int32()), pa.array([sig], pa.list_(pa.float32()))], names=["rec_id", "fs", "samples"])

    return texts.select(F.col(rec).cast("string"), F.col(text)).mapInArrow(render, RECORDING)


def sample_rows(recordings: DataFrame) -> DataFrame:
    """(rec, i, v) rows of recordings."""
    return recordings.select(F.col("rec_id").alias("rec"), F.posexplode("samples").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
