"""Scores, ranks and votes over decoded texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import PLAUSIBLE
from ..functions.columns import let


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def letters(text: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]", ""))


def dominant_letter(text: Column) -> Column:
    """Share of the commonest letter; 0 for less than 8 letters."""
    top = lambda t: F.greatest(*[F.length(t) - F.length(F.replace(t, F.lit(c), F.lit(""))) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"])
    return let(letters(text), lambda t: F.when(F.length(t) >= 8, top(t) / F.length(t)).otherwise(0.0))


def tokens(text: Column) -> Column:
    """Runs of two or more letters and digits, upper-cased."""
    return F.filter(F.split(F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]+", " ")), " "), lambda w: F.length(w) >= 2)


def plausibility(text: Column) -> Column:
    """Likeness to traffic, .15 to 1.25: low for runs of one letter, raised by known tokens, and by words of 2 to 12 letters
    if there are three and they make up half of the tokens; .2 for nothing."""
    base = let(dominant_letter(text), lambda mono: F.when(mono > 0.50, 0.20).when(mono > 0.42, 0.35).when(mono > 0.35, 0.70).otherwise(1.0))

    def raised(found):
        raise_by = lambda wordy, n: F.when((wordy >= 3) & (2 * wordy >= n), 1 + 0.025 * F.least(wordy, F.lit(6))).otherwise(1.0)
        wordy = F.size(F.filter(found, lambda x: x.rlike("^[A-Z]{2,12}$")))
        known = F.size(F.filter(found, lambda x: x.isin(*PLAUSIBLE)))
        return let(wordy, lambda w: raise_by(w, F.size(found))) * (1 + 0.02 * F.least(known, F.lit(5)))

    return F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) == 0, 0.2).otherwise(clamp(base * let(tokens(text), raised), 0.15, 1.25))


def contest_like(text: Column) -> Column:
    """Two cut reports and two serials or more, with TU or a third report."""
    t = F.upper(text)
    cut, serial, tu = F.regexp_count(t, F.lit("[15E]NN")), F.regexp_count(t, F.lit(r"[0-9]{3,4}")), F.regexp_count(t, F.lit("TU"))
    return (cut >= 2) & (serial >= 2) & ((tu >= 1) | (cut >= 3))


def contest_quality(text: Column) -> Column:
    """0 to 1 for an exchange whose run-ons are split: spacing, then capped counts of reports, TU, serials and calls, lowered for one letter."""

    def rate(t):
        spacing = (F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))) / F.greatest(F.length(t), F.lit(1))
        q = F.when(spacing >= 0.08, 0.35).when(spacing >= 0.04, 0.15).otherwise(0.0)
        for cap, each, pattern in ((0.25, 0.05, r"\b5NN\b"), (0.15, 0.03, r"\bTU\b"), (0.15, 0.03, r"\b[0-9]{3,4}\b"), (0.20, 0.04, r"\b(?:[A-Z]{1,2}[0-9]+[A-Z]{1,4}|[A-Z][0-9]{2}[A-Z]{1,4})\b")):
            q = q + F.least(F.lit(cap), each * F.regexp_count(t, F.lit(pattern)))
        mono = dominant_letter(t)
        q = F.least(F.lit(1.0), q * F.when(mono > 0.45, 0.3).when(mono > 0.35, 0.6).otherwise(1.0))
        return F.when(F.length(F.regexp_replace(t, "[^A-Za-z0-9]", "")) < 8, 0.0).otherwise(q)

    return let(text, rate)


def serials(text: Column) -> Column:
    """Distinct numbers of 3 or 4 digits right after a cut report."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(r"[15E]NN ?([0-9]{3,4})"), F.lit(1))))


def calls(text: Column) -> Column:
    """Distinct calls as contests have them, but those of E, I and digits alone, which noise makes."""
    found = F.regexp_extract_all(F.upper(text), F.lit(r"\b(?:[A-Z]{1,2}[0-9]+[A-Z]{1,4}|[A-Z][0-9]{2}[A-Z]{1,4})\b"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(found, lambda c: ~c.rlike("^[EI]+[0-9]*[EI]*$"))))


def speed_weight(wpm: Column) -> Column:
    return F.when((wpm < 3) | (wpm > 140), 0.1).when(wpm < 5, 0.4).when(wpm > 100, 0.55).when(wpm > 85, 0.8).otherwise(1.0)


def ratio_weight(ratio: Column) -> Column:
    return F.when((ratio < 1.5) | (ratio > 6.0), 0.3).when((ratio < 2.0) | (ratio > 4.5), 0.6).otherwise(1.0)


def decode_score(text: Column, duty: Column, dit: Column, dah: Column, regularity: Column | None = None) -> Column:
    """Score of a decoded text, 0 to 1: valid share, duty, speed and ratio, then length, variety, garble and plausibility."""
    solid = F.replace(text, F.lit(" "), F.lit(""))
    n = F.length(solid)
    bad = n - F.length(F.translate(solid, "?&", ""))
    valid = F.length(F.replace(solid, F.lit("?"), F.lit("")))
    score = valid / F.greatest(n, F.lit(1)) * clamp(1 - F.abs(duty - 0.4), 0.4, 1.0)
    score = score * speed_weight(F.when(dit > 0, 1200.0 / dit).otherwise(0.0)) * F.when((dit > 0) & (dah > 0), ratio_weight(dah / dit)).otherwise(1.0)
    if regularity is not None:
        score = score * regularity
    score = F.when(valid < 10, score * valid / 10.0).otherwise(score)
    variety = F.size(F.array_distinct(F.filter(F.split(F.replace(solid, F.lit("?"), F.lit("")), ""), lambda c: c != ""))) / F.least(F.greatest(valid, F.lit(1)), F.lit(26))
    score = score * F.when((valid > 3) & (variety < 0.15), 0.5).when((valid > 20) & (variety > 0.85), 0.8).otherwise(1.0)
    several = F.size(F.filter(F.split(F.replace(text, F.lit("?"), F.lit(" ")), " +"), lambda w: F.length(w) >= 3)) >= 3
    share = bad / F.greatest(n, F.lit(1))
    score = score * F.when(share > 0.25, 0.5).when(share > 0.05, F.when(several, 0.75).otherwise(0.6)).when(bad >= 2, F.when(several, 0.85).otherwise(0.7)).otherwise(1.0)
    return clamp(score * plausibility(text), 0.0, 1.0)


def repaired_score(text: Column, raw: Column, score: Column, duty: Column, wpm: Column, ratio: Column) -> Column:
    """Score of a repaired text: as a decode's without regularity and garble, a steeper duty; raised where run-on text got readable spacing."""
    solid = F.replace(text, F.lit(" "), F.lit(""))
    valid = F.length(F.replace(solid, F.lit("?"), F.lit("")))
    s = valid / F.greatest(F.length(solid), F.lit(1)) * clamp(1 - 1.5 * F.abs(duty - 0.4), 0.3, 1.0) * speed_weight(wpm) * ratio_weight(ratio)
    s = F.when(valid < 10, s * valid / 10.0).otherwise(s)
    kinds = F.size(F.array_distinct(F.filter(F.split(F.replace(solid, F.lit("?"), F.lit("")), ""), lambda c: c != "")))
    s = s * F.when((valid > 3) & (kinds / F.least(F.greatest(valid, F.lit(1)), F.lit(26)) < 0.15), 0.5).otherwise(1.0) * plausibility(text)
    spacing = lambda t: (F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))) / F.greatest(F.length(t), F.lit(1))
    opened = (spacing(raw) < 0.04) & (spacing(text) >= 0.08) & (plausibility(text) >= 0.9) & (dominant_letter(text) < 0.30)
    return clamp(F.when(opened, F.least(F.lit(1.0), F.greatest(s, score) + 0.18) * 1.05).otherwise(s), 0.0, 1.0)


def best_hypotheses(hyps: DataFrame, key: str, k: int) -> DataFrame:
    """The k best rows of each key by score, smaller id first among equals."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "hyp_id")
    return hyps.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def consensus(hyps: DataFrame, key: str) -> DataFrame:
    """(key, text, votes, score): the text with most votes times mean score, earlier text first among equals."""
    per = hyps.groupBy(key, "text").agg(F.count("*").alias("votes"), F.avg("score").alias("score"))
    weight = F.round(F.col("votes") * F.col("score"), 9)
    best = per.groupBy(key).agg(F.min_by(F.struct("text", "votes", "score"), F.struct((-weight).alias("w"), F.col("text").alias("t"))).alias("b"))
    return best.select(key, "b.text", "b.votes", "b.score")


def speed_consensus(hyps: DataFrame, key: str) -> DataFrame:
    """Adds adjusted: score times 1.2, 1 or .7 by the relative distance of wpm from the key's upper median, .8 without a speed; unchanged for less than 3 speeds."""
    mid = hyps.where("wpm > 0").groupBy(key).agg(F.sort_array(F.collect_list("wpm")).alias("w")).where(F.size("w") >= 3).select(key, F.get("w", F.floor(F.size("w") / 2).cast("int")).alias("mid"))
    off = F.abs(F.col("wpm") - F.col("mid")) / F.greatest("mid", F.lit(1.0))
    factor = F.when(F.col("mid").isNull(), 1.0).when(F.col("wpm") <= 0, 0.8).when(off < 0.2, 1.2).when(off < 0.5, 1.0).otherwise(0.7)
    return hyps.join(mid, key, "left").withColumn("adjusted", F.col("score") * factor)


def missing_serials(seen: DataFrame, key: str, serial: str, block: int = 1 << 16) -> DataFrame:
    """(key, serial) between a key's smallest and largest serial that aren't seen.

    Serials are ordered within blocks of a key, so a key with most rows isn't one task; holes between blocks come from their
    ends, a row a block.  A hole is listed in parts, so no array grows with it.
    """
    k, s = F.col(key).alias("k"), F.col(serial).alias("s")
    rows = seen.select(k, s).where("s is not null").distinct().withColumn("b", F.floor(F.col("s") / block))
    inner = rows.withColumn("nxt", F.lead("s").over(Window.partitionBy("k", "b").orderBy("s"))).select("k", "s", "nxt")
    ends = rows.groupBy("k", "b").agg(F.min("s").alias("low"), F.max("s").alias("s"))
    outer = ends.withColumn("nxt", F.lead("low").over(Window.partitionBy("k").orderBy("b"))).select("k", "s", "nxt")
    holes = inner.unionByName(outer).where("nxt > s + 1").withColumn("part", F.explode(F.expr(f"sequence(s + 1, nxt - 1, {block})")))
    return holes.select(F.col("k").alias(key), F.explode(F.sequence("part", F.least(F.col("part") + (block - 1), F.col("nxt") - 1))).alias(serial))
