"""Frequency search over sample blocks.

Blocks are short arrays (`block`), so a transform is an expression inside the row: no shuffle, whatever the number of blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import hann, mean_same, normalised, three_tap


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def windowed(block: Column, m: int) -> Column:
    """block times a Hann window of its length m."""
    return F.zip_with(block, F.array(*[F.lit(x) for x in hann(m)]), lambda v, w: v.cast("double") * w)


def goertzel_power(block: Column, freq: Column, fs: float) -> Column:
    """Power at an exact frequency; 0 for blocks of less than 4 samples."""
    step = freq * F.lit(2 * math.pi / fs)
    re = _sum(F.transform(block, lambda v, n: v.cast("double") * F.cos(step * n)))
    im = _sum(F.transform(block, lambda v, n: v.cast("double") * F.sin(step * n)))
    return F.when(F.size(block) < 4, 0.0).otherwise(re * re + im * im)


def spectrum(df: DataFrame, rec: str, block: str, m: int, fs: float) -> DataFrame:
    """(rec, bin, freq, mag): magnitudes of the real transform of blocks of m samples."""
    bins = F.explode(F.sequence(F.lit(0), F.lit(m // 2))).alias("bin")
    rows = df.select(F.col(rec).alias("rec"), F.col(block).alias("b"), bins)
    freq = F.col("bin") * F.lit(fs / m)
    return rows.select("rec", "bin", freq.alias("freq"), F.sqrt(goertzel_power(F.col("b"), freq, fs)).alias("mag"))


def snr_db(spec: DataFrame, low: float = 300.0, high: float = 1500.0) -> DataFrame:
    """(rec, snr): largest over median power of the band, in dB; 0 without bins, 30 without noise."""
    inside = spec.where((F.col("freq") > low) & (F.col("freq") < high)).withColumn("p", F.col("mag") * F.col("mag"))
    per = inside.groupBy("rec").agg(F.max("p").alias("top"), F.percentile("p", 0.5).alias("mid"))
    return spec.select("rec").distinct().join(per, "rec", "left").select("rec", F.when(F.col("top").isNull(), 0.0).when(F.col("mid") < 1e-10, 30.0).otherwise(10 * F.log10(F.col("top") / F.col("mid"))).alias("snr"))


def local_peaks(spec: DataFrame, factor: float) -> DataFrame:
    """Bins not below their neighbours and above `factor` times the recording's median."""
    w = Window.partitionBy("rec").orderBy("bin")
    marked = spec.withColumn("mid", F.percentile("mag", 0.5).over(Window.partitionBy("rec"))).withColumn("l", F.lag("mag").over(w)).withColumn("r", F.lead("mag").over(w))
    return marked.where((F.col("mag") >= F.col("l")) & (F.col("mag") >= F.col("r")) & (F.col("mag") > factor * F.col("mid"))).drop("l", "r")


def refined_frequency(df: DataFrame, rec: str, block: str, m: int, centre: Column, fs: float, reach: float, step: float) -> DataFrame:
    """(rec, freq, power): the frequency of a grid around `centre` with most power, the lowest of equals."""
    n = int(round(2 * reach / step)) + 1
    rows = df.select(F.col(rec).alias("rec"), windowed(F.col(block), m).alias("b"), centre.alias("f0"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    rows = rows.withColumn("freq", F.col("f0") - reach + F.col("k") * step)
    power = rows.select("rec", "freq", F.round(goertzel_power(F.col("b"), F.col("freq"), fs), 6).alias("power"))
    return power.groupBy("rec").agg(F.max_by(F.struct("freq", "power"), F.struct("power", -F.col("freq"))).alias("best")).select("rec", "best.freq", "best.power")


def goertzel_envelope(df: DataFrame, freq: float, fs: float, block: int) -> DataFrame:
    """(rec, i, env): magnitude at a tone of Hann-windowed blocks, 3-tap smoothed, repeated per sample, averaged and normalised.

    df is a series (rec, i, v).  The samples after the last whole block keep its value.
    """
    step = 2 * math.pi * freq / fs
    n = F.count("*").over(Window.partitionBy("rec"))
    place = F.col("i") % block
    weight = 0.5 - 0.5 * F.cos(place * F.lit(2 * math.pi / (block - 1)))
    rows = df.withColumn("blocks", F.floor(n / block)).withColumn("b", F.least(F.floor(F.col("i") / block), F.col("blocks") - 1)).withColumn("x", F.col("v") * weight)
    inside = F.col("i") < F.col("blocks") * block
    re, im = F.sum(F.when(inside, F.col("x") * F.cos(place * F.lit(step)))), F.sum(F.when(inside, F.col("x") * F.sin(place * F.lit(step))))
    mags = rows.groupBy("rec", "b").agg(re.alias("re"), im.alias("im")).select("rec", F.col("b").alias("i"), F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("v"))
    smooth = three_tap(mags).select("rec", F.col("i").alias("b"), "smooth")
    env = rows.select("rec", "i", "b").join(smooth, ["rec", "b"]).withColumn("m", mean_same(F.col("smooth"), block))
    return env.select("rec", "i", normalised(F.col("m")).alias("env"))


def separated(cands: DataFrame, apart: float, most: int | None = None) -> DataFrame:
    """Candidates (rec, freq, score) kept greedily by score: none within `apart` of a better one that is kept.

    A recording has few candidates (peaks of one spectrum), so they are one array and the choice is a fold over it.
    """
    listed = cands.groupBy("rec").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "freq"))).alias("c"))
    empty = F.array().cast("array<struct<s:double,freq:double>>")
    room = (lambda a: F.size(a) < most) if most else (lambda a: F.lit(True))
    kept = F.aggregate("c", empty, lambda a, x: F.when(room(a) & ~F.exists(a, lambda k: F.abs(k.freq - x.freq) < apart), F.concat(a, F.array(x))).otherwise(a))
    return listed.select("rec", F.explode(kept).alias("k")).select("rec", "k.freq", (-F.col("k.s")).alias("score"))


def scored_tracks(frames: DataFrame, factor: float = 6.0) -> DataFrame:
    """(rec, bin, freq, presence, score) from framed spectra (rec, frame, bin, freq, mag): how often and how strongly a bin peaks.

    A keyed tone is there about a third of the time; score = energy * (.4 + .6 presence) * clip(1 - |presence - .35|, .05, 1).
    """
    w = Window.partitionBy("rec", "frame").orderBy("bin")
    med = F.percentile("mag", 0.5).over(Window.partitionBy("rec", "frame"))
    marked = frames.withColumn("peak", (F.col("mag") >= F.lag("mag").over(w)) & (F.col("mag") >= F.lead("mag").over(w)) & (F.col("mag") > factor * med))
    total = frames.groupBy("rec").agg(F.countDistinct("frame").alias("frames"))
    per = marked.where("peak").groupBy("rec", "bin", "freq").agg(F.count("*").alias("hits"), F.avg("mag").alias("mean")).join(total, "rec")
    per = per.withColumn("presence", F.col("hits") / F.col("frames")).withColumn("energy", F.col("mean") / (F.max("mean").over(Window.partitionBy("rec")) + 1e-12))
    inter = F.least(F.greatest(1 - F.abs(F.col("presence") - 0.35), F.lit(0.05)), F.lit(1.0))
    return per.select("rec", "bin", "freq", "presence", (F.col("energy") * (0.4 + 0.6 * F.col("presence")) * inter).alias("score"))


def duty_weight(duty: Column) -> Column:
    """How a tone's share of marked time speaks against keying."""
    return F.when(duty > 0.9, 0.1).when(duty > 0.8, 0.3).when(duty > 0.6, 0.7).when(duty < 0.1, 0.5).otherwise(1.0)
