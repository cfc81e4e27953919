"""Kernels over whole recordings as operators: a row's samples go through numpy in an Arrow batch and come back as rows.

For recursions that no window expresses: gain control, tracking loops, filters.  What is a window or an aggregate is one here too.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from .series import by_rec, hann, mixed_down, weighted_same, whole

#: Recordings of one output batch.
ROWS = 64


def per_sample(df: DataFrame, rec: str, samples: str, kernel: Callable[[np.ndarray], tuple], columns: tuple[str, ...]) -> DataFrame:
    """(rec, i, *columns) of arrays of samples: kernel gives an array for each column; a null or empty array has no rows."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                xs = [np.asarray(x.values.fill_null(0.0), float) if x.is_valid else np.zeros(0) for x in part.column(1)]
                done = [kernel(x) if len(x) else (np.zeros(0),) * len(columns) for x in xs]
                sizes = [len(d[0]) for d in done]
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(xs)), sizes)))
                places = np.concatenate([np.arange(n) for n in sizes]) if sizes else np.zeros(0, int)
                values = [pa.array(np.concatenate([np.asarray(d[k], float) for d in done]) if done else np.zeros(0)) for k in range(len(columns))]
                yield pa.record_batch([ids, pa.array(places, pa.int64()), *values], names=["rec", "i", *columns])

    schema = f"rec {dict(df.dtypes)[rec]}, i long, " + ", ".join(f"{c} double" for c in columns)
    return df.select(F.col(rec).alias("rec"), F.col(samples).alias("x")).mapInArrow(run, schema)


def bandpassed(df: DataFrame, rec: str, samples: str, fs: float, low: float, high: float) -> DataFrame:
    """(rec, i, v): zero-phase Butterworth band-pass."""
    return per_sample(df, rec, samples, lambda x: (kernels.bandpass(x, fs, low, high),), ("v",))


def notched(df: DataFrame, rec: str, samples: str, fs: float, freq: float = 60.0, q: float = 30.0) -> DataFrame:
    """(rec, i, v): zero-phase hum notch."""
    return per_sample(df, rec, samples, lambda x: (kernels.notch(x, fs, freq, q),), ("v",))


def exponential_series(df: DataFrame, rec: str, samples: str, alpha: float, start: float = 0.0) -> DataFrame:
    """(rec, i, v): y = (1 - alpha) y + alpha x from `start`."""
    return per_sample(df, rec, samples, lambda x: (kernels.one_pole(x, alpha, start),), ("v",))


def resampled(df: DataFrame, rec: str, samples: str, fs: int, to: int = 8000) -> DataFrame:
    """(rec, i, v) at another rate, by a polyphase filter."""
    return per_sample(df, rec, samples, lambda x: (kernels.resampled(x, fs, to),), ("v",))


def gained(df: DataFrame, rec: str, samples: str, fs: float, attack_ms: float = 50.0, release_ms: float = 2000.0) -> DataFrame:
    """(rec, i, v, env, gain): gain control sample by sample, the gain falling by the attack and rising by the release constant."""
    return per_sample(df, rec, samples, lambda x: kernels.slow_gain(x, fs, attack_ms, release_ms), ("v", "env", "gain"))


def gain_mode(df: DataFrame, rec: str, samples: str, fs: float, mode: str = "slow") -> DataFrame:
    """(rec, i, v): gain control by two one-pole filters; slow, fast or none, any other word is slow."""
    return per_sample(df, rec, samples, lambda x: (kernels.gain_control(x, fs, mode),), ("v",))


def fading_compensated(df: DataFrame, rec: str, samples: str, fs: float, rate: float = 1.0) -> DataFrame:
    """(rec, i, v): gain control with a release of two periods of a fading of `rate` Hz."""
    return per_sample(df, rec, samples, lambda x: (kernels.fast_gain(x, fs, 50.0, 2000.0 / rate),), ("v",))


def gain_diagnostics(gains: DataFrame) -> DataFrame:
    """(rec, avg_gain, min_gain, max_gain, range_db, env_mean, env_std) of rows (rec, env, gain)."""
    g = gains.groupBy("rec").agg(F.avg("gain").alias("avg_gain"), F.min("gain").alias("min_gain"), F.max("gain").alias("max_gain"), F.avg("env").alias("env_mean"), F.stddev_pop("env").alias("env_std"))
    return g.withColumn("range_db", 20 * F.log10(F.col("max_gain") / (F.col("min_gain") + 1e-6)))


def carrier(df: DataFrame, rec: str, samples: str, fs: float, f0: float, bandwidth: float = 10.0) -> DataFrame:
    """(rec, i, freq, phase, re, im): a second-order loop on the carrier, sample by sample.  Its error pulls the phase in."""

    def loop(x):
        got = kernels.costas_loop(x, fs, f0, bandwidth)
        return got["freq"], got["phase"], got["i"], got["q"]

    return per_sample(df, rec, samples, loop, ("freq", "phase", "re", "im"))


def smooth_carrier(df: DataFrame, rec: str, samples: str, fs: float, f0: float, bandwidth: float = 10.0) -> DataFrame:
    """(rec, i, freq, re): the loop over a whole block, its track the low-passed instantaneous frequency."""
    return per_sample(df, rec, samples, lambda x: kernels.smooth_loop(x, fs, f0, bandwidth), ("freq", "re"))


def lock_status(tracks: DataFrame, f0: float, last: int = 100) -> DataFrame:
    """(rec, locked, current, drift_hz, drift_ppm, samples, avg_freq, freq_std) of rows (rec, i, freq).

    Locked: more than `last` samples, and the last of them spread by less than 1 Hz.
    """
    w = Window.partitionBy("rec")
    rows = tracks.withColumn("n", F.count("*").over(w))
    tail = F.when(F.col("i") >= F.col("n") - last, F.col("freq"))
    per = rows.groupBy("rec").agg(F.stddev_pop(tail).alias("spread"), F.max_by("freq", "i").alias("current"), F.max("n").alias("samples"), F.avg("freq").alias("avg_freq"), F.stddev_pop("freq").alias("freq_std"))
    drift = F.col("current") - F.lit(f0)
    return per.select("rec", ((F.col("samples") > last) & (F.col("spread") < 1.0)).alias("locked"), "current", drift.alias("drift_hz"), (drift / f0 * 1e6).alias("drift_ppm"), "samples", "avg_freq", "freq_std")


def coherent_hann(df: DataFrame, freq: float, fs: float, window: int) -> DataFrame:
    """Adds env to (rec, i, v): magnitude of both products with a tone under a Hann window, over its largest value + 1e-8."""
    w = hann(window)
    w = [x / sum(w) for x in w]
    iq = mixed_down(df, freq, fs).withColumn("mag", F.sqrt(F.pow(weighted_same("re", w), F.lit(2)) + F.pow(weighted_same("im", w), F.lit(2))))
    return iq.withColumn("env", F.col("mag") / (F.max("mag").over(whole()) + 1e-8)).drop("re", "im", "mag")


def ring_magnitude(df: DataFrame, freq: float, fs: float, window: int) -> DataFrame:
    """Adds mag to (rec, i, v): as a ring buffer of `window` samples gives it one by one, the reference phase fixed to the ring's places."""
    phase = (F.col("i") % window) * F.lit(2 * math.pi * freq / fs)
    near = by_rec().rowsBetween(-(window - 1), 0)
    re, im = F.sum(F.col("v") * F.cos(phase)).over(near), F.sum(F.col("v") * F.sin(phase)).over(near)
    return df.withColumn("mag", F.sqrt(re * re + im * im))


def adaptive_envelope(df: DataFrame, rec: str, samples: str, fs: float, freq: float, target_db: float = 10.0) -> DataFrame:
    """(rec, i, env, used_ms): coherent integration over 50 to 200 ms, as long as the recording's own signal-to-noise ratio asks for."""

    def run(x):
        env, ms = kernels.adaptive_envelope(x, fs, freq, target_db)
        return env, np.full(len(env), float(ms))

    return per_sample(df, rec, samples, run, ("env", "used_ms"))
