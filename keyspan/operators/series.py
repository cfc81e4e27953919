"""Operators on sample series (rec, i, v), i from 0 without holes, as windows over each recording.

Every operator is one pass of windows partitioned by rec and ordered by i, so a plan of several shares one exchange and sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_rec():
    return Window.partitionBy("rec").orderBy("i")


def whole():
    return Window.partitionBy("rec")


def series(df: DataFrame, rec: str, order: str, value: str) -> DataFrame:
    """(rec, i, v) from any table with a key, an ordering column and a value."""
    n = F.row_number().over(Window.partitionBy(rec).orderBy(order)).cast("long") - 1
    return df.select(F.col(rec).alias("rec"), n.alias("i"), F.col(value).cast("double").alias("v"))


def mean_same(x: Column, m: int) -> Column:
    """Zero-padded centred moving average: the sum over m places divided by m, also at the ends."""
    return F.sum(x).over(by_rec().rowsBetween(-(m // 2), (m - 1) // 2)) / m


def mean_causal(x: Column, m: int) -> Column:
    return F.sum(x).over(by_rec().rowsBetween(-(m - 1), 0)) / m


def hann(m: int) -> list[float]:
    return [0.5 - 0.5 * math.cos(2 * math.pi * k / (m - 1)) if m > 1 else 1.0 for k in range(m)]


def weighted_same(x: str, weights: list[float]) -> Column:
    """Zero-padded centred convolution with a short symmetric kernel."""
    m, out = len(weights), F.lit(0.0)
    for k, w in enumerate(weights):
        step = (m - 1) // 2 - k
        near = F.lag(x, -step, 0.0) if step < 0 else F.lead(x, step, 0.0) if step else F.col(x)
        out = out + F.lit(w) * (near.over(by_rec()) if step else near)
    return out


def normalised(x: Column) -> Column:
    """x over its largest value in the recording, or x where that isn't positive."""
    top = F.max(x).over(whole())
    return F.when(top > 0, x / top).otherwise(x)


def moving_average(df: DataFrame, m: int) -> DataFrame:
    return df.withColumn("avg", mean_same(F.col("v"), m))


def hann_average(df: DataFrame, m: int) -> DataFrame:
    w = hann(m)
    return df.withColumn("avg", weighted_same("v", [x / sum(w) for x in w]))


def three_tap(df: DataFrame) -> DataFrame:
    """[.15 .7 .15] smoothing of recordings with five values or more."""
    n = F.count("*").over(whole())
    return df.withColumn("smooth", F.when(n >= 5, weighted_same("v", [0.15, 0.7, 0.15])).otherwise(F.col("v")))


def positive_difference(df: DataFrame, x: str = "v") -> DataFrame:
    """Rises, divided by the largest; the first is 0."""
    return df.withColumn("up", F.greatest(F.col(x) - F.lag(x).over(by_rec()), F.lit(0.0))).withColumn("up", normalised(F.coalesce("up", F.lit(0.0))))


def mixed_down(df: DataFrame, freq: float, fs: float) -> DataFrame:
    """In-phase and quadrature products with a tone."""
    phase = F.col("i") * F.lit(2 * math.pi * freq / fs)
    return df.withColumn("re", F.col("v") * F.cos(phase)).withColumn("im", -F.col("v") * F.sin(phase))


def coherent_envelope(df: DataFrame, freq: float, fs: float, window: int) -> DataFrame:
    """Magnitude of the causal mean of both products, over its largest value + 1e-8."""
    iq = mixed_down(df, freq, fs)
    iq = iq.withColumn("mag", F.sqrt(F.pow(mean_causal(F.col("re"), window), 2) + F.pow(mean_causal(F.col("im"), window), 2)))
    return iq.withColumn("env", F.col("mag") / (F.max("mag").over(whole()) + 1e-8)).drop("re", "im", "mag")


def square_law(df: DataFrame, window: int) -> DataFrame:
    """Root of the moving average of squares, normalised.  RMS is the same with another window."""
    power = df.withColumn("p", F.sqrt(F.greatest(mean_same(F.col("v") * F.col("v"), window), F.lit(0.0))))
    return power.withColumn("env", normalised(F.col("p"))).drop("p")


def hann_rms(df: DataFrame, window: int) -> DataFrame:
    w = hann(max(window, 3))
    power = df.withColumn("sq", F.col("v") * F.col("v"))
    power = power.withColumn("p", F.sqrt(F.greatest(weighted_same("sq", [x / sum(w) for x in w]), F.lit(0.0))))
    return power.withColumn("env", normalised(F.col("p"))).drop("p", "sq")


def onset_enhanced(df: DataFrame, window: int, onset: int) -> DataFrame:
    """Three quarters of the square-law envelope and a quarter of the normalised rise of lightly smoothed power, normalised."""
    base = square_law(df, window).withColumn("pw", mean_same(F.col("v") * F.col("v"), onset))
    base = positive_difference(base, "pw")
    return base.withColumn("env", normalised(0.75 * F.col("env") + 0.25 * F.col("up"))).drop("pw", "up")


def local_mean_normalised(df: DataFrame, window: int, x: str = "v") -> DataFrame:
    out = df.withColumn("q", F.col(x) / F.greatest(mean_same(F.col(x), window), F.lit(1e-6)))
    return out.withColumn("env", normalised(F.col("q"))).drop("q")


def decimate(df: DataFrame, step: int) -> DataFrame:
    """Every step-th sample, filtered before any window above it."""
    return df.where(F.col("i") % step == 0).withColumn("i", (F.col("i") / step).cast("long"))


def repeated(df: DataFrame, times: int) -> DataFrame:
    """Each sample `times` times."""
    return df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("i", F.col("i") * times + F.col("k")).drop("k")


def fading_score(df: DataFrame, window: int) -> DataFrame:
    """(rec, qsb): spread of block means over their mean; 0 for recordings of less than four blocks."""
    n = F.count("*").over(whole())
    blocks = df.withColumn("n", n).withColumn("b", F.floor(F.col("i") / window)).where(F.col("b") < F.floor(F.col("n") / window))
    means = blocks.groupBy("rec", "b").agg(F.avg("v").alias("m"), F.max("n").alias("n"))
    score = means.groupBy("rec").agg(F.when(F.max("n") < 4 * window, 0.0).otherwise(F.stddev_pop("m") / (F.avg("m") + 1e-8)).alias("qsb"))
    return df.select("rec").distinct().join(score, "rec", "left").select("rec", F.coalesce("qsb", F.lit(0.0)).alias("qsb"))


def exponential_average(x: Column, alpha: float) -> Column:
    """Last value of y = (1 - alpha) y + alpha x over an array, from 0: a fold for short arrays."""
    return F.aggregate(x, F.lit(0.0), lambda y, v: (1 - alpha) * y + alpha * v.cast("double"))
