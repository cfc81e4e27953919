"""Thresholds, key states and runs over envelopes (rec, i, env)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import by_rec, whole


def auto_threshold(df: DataFrame, x: str = "env") -> DataFrame:
    """(rec, thr): from percentiles where they separate, else Otsu's threshold."""
    p = [F.percentile(x, q).alias(f"p{int(q * 100)}") for q in (0.10, 0.25, 0.50, 0.75, 0.90)]
    stats = df.groupBy("rec").agg(*p, F.max(x).alias("top"))
    both = stats.join(otsu_threshold(df, x).withColumnRenamed("thr", "otsu"), "rec")
    spread = F.col("p90") - F.col("p50")
    low = F.greatest((F.col("p25") + F.col("p75")) / 2, F.lit(0.15))
    return both.select("rec", F.when((F.col("p10") < 0.02) & (spread > 0.3), low).when(spread > 0.3 * F.col("top"), F.col("p50") + 0.3 * spread).otherwise(F.col("otsu")).alias("thr"))


def otsu_threshold(df: DataFrame, x: str = "env", bins: int = 128) -> DataFrame:
    """(rec, thr): the bin centre with the largest variance between classes, the first of equals.

    Bins span 0 to the largest value + 1e-8.  The background's sum is of bin centres, the total's of the values.
    """
    top = df.groupBy("rec").agg(F.max(x).alias("top"), F.count("*").alias("n"), F.sum(x).alias("total"))
    width = (F.col("top") + 1e-8) / bins
    place = F.least(F.floor(F.col(x) / width), F.lit(bins - 1))
    hist = df.join(top, "rec").groupBy("rec", "top", "n", "total", place.alias("bin")).agg(F.count("*").alias("c"))
    run = Window.partitionBy("rec").orderBy("bin")
    centre = (F.col("bin") + 0.5) * width
    cum = hist.withColumn("wb", F.sum("c").over(run)).withColumn("sb", F.sum(F.col("c") * centre).over(run)).withColumn("centre", centre).where("wb < n")
    gap = F.col("sb") / F.col("wb") - (F.col("total") - F.col("sb")) / (F.col("n") - F.col("wb"))
    scored = cum.withColumn("var", F.round(F.col("wb") * (F.col("n") - F.col("wb")) * gap * gap, 9))
    best = scored.groupBy("rec").agg(F.max_by("centre", F.struct("var", -F.col("bin"))).alias("thr"))
    return top.join(best, "rec", "left").select("rec", F.coalesce("thr", 0.3 * F.col("top")).alias("thr"))


def hard_keyed(df: DataFrame, thresholds: DataFrame, x: str = "env") -> DataFrame:
    """Adds state: above the threshold; where that marks hardly any or nearly all samples, above 0.35 of the top if that is better."""
    joined = df.join(thresholds, "rec").withColumn("top", F.max(x).over(whole()))
    above, other = (F.col(x) > F.col("thr")).cast("int"), (F.col(x) > 0.35 * F.col("top")).cast("int")
    duty, other_duty = F.avg(above).over(whole()), F.avg(other).over(whole())
    bad = ((duty < 0.05) | (duty > 0.97)) & (other_duty > 0.08) & (other_duty < 0.92)
    return joined.withColumn("state", F.when(bad, other).otherwise(above)).drop("top", "thr")


def schmitt(x: Column, high: Column, low: Column) -> Column:
    """State with hysteresis: on above high, off below low, else as before; off at the start."""
    decided = F.when(x > high, 1).when(x < low, 0)
    return F.coalesce(F.last(decided, ignorenulls=True).over(by_rec().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))


def schmitt_keyed(df: DataFrame, thresholds: DataFrame, ratio: float = 0.65, x: str = "env") -> DataFrame:
    """Adds state by hysteresis between a threshold and its part `ratio`."""
    joined = df.join(thresholds, "rec")
    return joined.withColumn("state", schmitt(F.col(x), F.col("thr"), F.col("thr") * ratio)).drop("thr")


def percentile_keyed(df: DataFrame, x: str = "env") -> DataFrame:
    """Adds state by hysteresis between quartiles; state is null where they are too close or the duty is implausible."""
    q = df.groupBy("rec").agg(F.percentile(x, 0.75).alias("hi"), F.percentile(x, 0.25).alias("lo"))
    keyed = df.join(q, "rec").withColumn("s", schmitt(F.col(x), F.col("hi"), F.col("lo")))
    duty = F.avg("s").over(whole())
    good = (F.col("hi") - F.col("lo") >= 0.02) & (duty >= 0.03) & (duty <= 0.97)
    return keyed.withColumn("state", F.when(good, F.col("s"))).drop("s", "hi", "lo")


def runs(df: DataFrame, state: str = "state") -> DataFrame:
    """(rec, run, state, first, length): runs of equal states."""
    change = F.when(F.col(state) == F.lag(state).over(by_rec()), 0).otherwise(1)
    numbered = df.withColumn("change", change).withColumn("run", F.sum("change").over(by_rec()))
    return numbered.groupBy("rec", "run").agg(F.first(state).alias("state"), F.min("i").alias("first"), F.count("*").alias("length"))


def segments(df: DataFrame, fs: float, min_samples: int) -> DataFrame:
    """(rec, seg_no, state, dur_ms): runs, each shorter than min_samples added to the one before it.

    The run before may itself have been given away; it then lives on with the added length and its own state, and
    neighbours of equal state stay apart.  As every run gives to its neighbour only, one look ahead says it all.
    """
    r = runs(df)
    w = Window.partitionBy("rec").orderBy("run")
    short = F.col("length") < min_samples
    own = F.when(short & (F.col("run") > 1), 0).otherwise(F.col("length"))
    given = F.coalesce(F.lead(F.when(short, F.col("length")).otherwise(0)).over(w), F.lit(0))
    kept = r.withColumn("total", own + given).where("total > 0")
    return kept.select("rec", F.row_number().over(w).alias("seg_no"), "state", (F.col("total") * F.lit(1000.0 / fs)).alias("dur_ms"))


def cleaned(df: DataFrame, min_mark: float, min_space: float) -> DataFrame:
    """states with marks of less than min_mark samples removed, then spaces of less than min_space filled."""
    keep = ["rec", "i", "v"] if "v" in df.columns else ["rec", "i"]
    change = lambda s: F.when(F.col(s) == F.lag(s).over(by_rec()), 0).otherwise(1)
    out = df
    for value, least in ((1, min_mark), (0, min_space)):
        if least > 0:
            numbered = out.withColumn("change", change("state")).withColumn("run", F.sum("change").over(by_rec()))
            size = F.count("*").over(Window.partitionBy("rec", "run"))
            several = F.max("run").over(whole()) > 1
            out = numbered.withColumn("state", F.when((F.col("state") == value) & (size < least) & several, 1 - F.col("state")).otherwise(F.col("state")))
    return out.select(*keep, "state")


def merged_fragments(segs: DataFrame, gap_ms: float) -> DataFrame:
    """Marks parted by one space shorter than gap_ms become one, space included."""
    w = Window.partitionBy("rec").orderBy("seg_no")
    joins = (F.col("state") == 1) & (F.lag("state", 1).over(w) == 0) & (F.lag("dur_ms", 1).over(w) < gap_ms) & (F.lag("state", 2).over(w) == 1)
    flagged = segs.withColumn("j", F.coalesce(joins, F.lit(False)))
    inside = flagged.withColumn("in", F.col("j") | F.coalesce(F.lead("j").over(w), F.lit(False)) & (F.col("state") == 0))
    grouped = inside.withColumn("g", F.sum(F.when(F.col("in"), 0).otherwise(1)).over(w))
    out = grouped.groupBy("rec", "g").agg(F.min_by("state", "seg_no").alias("state"), F.sum("dur_ms").alias("dur_ms"))
    return out.select("rec", F.row_number().over(Window.partitionBy("rec").orderBy("g")).alias("seg_no"), "state", "dur_ms")


def duty_cycle(df: DataFrame) -> DataFrame:
    return df.groupBy("rec").agg(F.avg("state").alias("duty"))
