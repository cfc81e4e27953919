"""Recordings to text: hypotheses of each recording from one pass over its audio, ranked and voted on as rows."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import contest, decoding, kernels
from ..operators import scoring
from . import model_hook

HYPOTHESIS = "rec_id string, hyp_id int, tone int, text string, score double, freq double, freq_initial double, snr_db double, dit double, dah double, wpm double, duty_cycle double, bw_hz double, smooth_ms double, env_method string"
_NAMES = [c.strip().split(" ")[0] for c in HYPOTHESIS.split(",")]
_KINDS = [{"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[c.strip().split(" ")[1]] for c in HYPOTHESIS.split(",")]
OFFSETS = (1.5, 3.0, 4.5, 6.0, 9.0, 12.0, 15.0, 18.0)
#: Seconds from which a recording is decoded in windows, their length and overlap; seconds from which tones are looked for at three places.
LONG, WINDOW, OVERLAP, PLACES_FROM = 120.0, 60.0, 15.0, 60.0
#: Further tones tried around weak candidates, at most, and the share of the first one's score below which a candidate is noise.
EXTRA, FAINT = 24, 0.01


def found_tones(sig: np.ndarray, clean: np.ndarray, fs: int) -> list[dict]:
    """Candidate tones: of a recording beyond a minute, those of the quarter, the middle or the third quarter (20 s each) whose best is best."""
    parts = [sig]
    if len(sig) > PLACES_FROM * fs:
        half = int(10 * fs)
        parts = [sig[max(0, int(x * len(sig)) - half) : int(x * len(sig)) + half] for x in (0.25, 0.5, 0.75)]
    scans = [decoding.scan_tones(p, fs) for p in parts]
    best = max(scans, key=lambda c: c[0]["score"] if c else -1.0)
    return decoding.apart(best + decoding.track_tones(clean, fs), 2.5)


def garble(text: str) -> float:
    return text.count("?") / max(len(text.replace(" ", "")), 1)


def recording_hypotheses(sig: np.ndarray, fs: float, force_freq: float | None = None, tones: int = 4, grid: bool = True, model=None, use_model: bool | str = "auto") -> list[dict]:
    """Hypotheses of one recording.

    Up to four tones, each refined and decoded in every setting; if the best is weak, further candidates and a grid around the
    first ones (six for garbled texts, else three), unless it is a window of a long recording (grid=False); then the texts voted to one, and a model's text where one is given and wanted.
    """
    clean = kernels.notch(sig, fs)
    cands = [{"freq": float(force_freq), "score": 1.0}] if force_freq else found_tones(sig, clean, fs)
    out: list[dict] = []
    for number, c in enumerate(cands[:tones]):
        freq = c["freq"] if force_freq else kernels.refine_frequency(clean, fs, c["freq"])
        snr = kernels.snr_db(clean, fs, freq)
        out += [h | {"freq_initial": c["freq"], "snr_db": snr, "tone": number} for h in decoding.decode_tone(clean, fs, freq)]
        if out and max(h["score"] for h in out) >= 0.95:
            break
    best = max(out, key=lambda h: h["score"], default=None)
    if best is None:
        return out
    bad = decoding.dominant(best["text"]) > 0.35 or garble(best["text"]) > 0.20 or best["score"] < 0.45 or decoding.plausibility(best["text"]) < 0.55
    if grid and (bad or best["score"] < 0.85):
        heard = [c for c in cands if c["score"] >= FAINT * cands[0]["score"]]
        centres = [c["freq"] for c in heard[: 6 if bad else 3]]
        wanted = [c["freq"] for c in heard[tones:10]] + [f + d for step in OFFSETS for d in (-step, step) for f in centres]
        seen, tried = {round(h["freq"], 1) for h in out}, 0
        for f in wanted:
            if round(f, 1) in seen or tried == EXTRA:
                continue
            seen.add(round(f, 1))
            more = [h | {"freq_initial": best["freq_initial"], "snr_db": best["snr_db"], "tone": tones} for h in decoding.decode_tone(clean, fs, f, decoding.FAST)]
            out, tried = out + more, tried + bool(more)
            top = max(more, key=lambda h: h["score"], default=best)
            clear = decoding.dominant(top["text"]) < 0.28 and garble(top["text"]) < 0.10 and decoding.plausibility(top["text"]) >= 0.9
            if top["score"] >= 0.92 and clear or not bad and top["score"] >= 0.95:
                break
    best = max(out, key=lambda h: h["score"])
    if garble(best["text"]) > 0 and (text := contest.fused(out)) and garble(text) < garble(best["text"]):
        out.append(best | {"text": text, "score": min(1.0, best["score"] + garble(best["text"]) - garble(text)), "env_method": "fused"})
    told = model_hook.chosen(model, clean, int(fs), best, use_model)
    return out + [told | {"env_method": "model"}] if told is not best else out


def hypotheses(recordings: DataFrame, force_freq: float | None = None, model=None, use_model: bool | str = "auto") -> DataFrame:
    """Rows of HYPOTHESIS for recordings (rec_id, fs, samples); the audio is read once and not shuffled.

    A recording beyond two minutes is cut to overlapping windows, each a row with hypotheses of its own, so it is the work of
    many tasks; hyp_id counts 10,000 a window.
    """
    from .contest import windows

    long = F.size("samples") > LONG * F.col("fs")
    parts = recordings.where(~F.coalesce(long, F.lit(False))).select("rec_id", "fs", F.lit(0.0).alias("start"), "samples", F.lit(True).alias("grid"))
    parts = parts.unionByName(windows(recordings.where(long), WINDOW, WINDOW - OVERLAP, WINDOW / 2).withColumn("grid", F.lit(False)))

    def decode(batches):
        for b in batches:
            for rec, fs, start, x, grid in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3), b.column(4).to_pylist(), strict=True):
                sig = np.asarray(x.values, float) if x.is_valid else np.zeros(0)
                found = recording_hypotheses(sig, fs, force_freq, grid=grid, model=model, use_model=use_model) if fs and len(sig) >= fs // 4 else []
                first = 10_000 * round(start / (WINDOW - OVERLAP))
                rows = [h | {"rec_id": rec, "hyp_id": first + i} for i, h in enumerate(found)]
                yield pa.record_batch([pa.array([r.get(n) for r in rows], k) for n, k in zip(_NAMES, _KINDS, strict=True)], names=_NAMES)

    return parts.mapInArrow(decode, HYPOTHESIS)


def selection_key(score, text, freq, first):
    """Score weighed by plausibility, single letters, spacing and the distance from the tone first found."""
    mono, letters = scoring.dominant_letter(text), F.length(scoring.letters(text))
    spacing = (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))) / F.greatest(F.length(text), F.lit(1))
    p, off = scoring.plausibility(text), F.abs(freq - first)
    key = score * p * F.when(mono > 0.40, 0.35).when(mono > 0.32, 0.65).otherwise(1.0)
    key = key * F.when((letters >= 40) & spacing.between(0.06, 0.25), 1.08).when((letters >= 40) & (spacing < 0.03) & (p >= 0.9), 1.05).otherwise(1.0)
    return key * F.when(off <= 12, 1.03).when(off >= 35, 0.92).otherwise(1.0)


def similarity(a: str, b: str) -> float:
    keep = lambda s: "".join(c.upper() for c in s if c.isalnum() or c.isspace())
    return difflib.SequenceMatcher(None, keep(a), keep(b)).ratio() if keep(a) and keep(b) else 0.0


def vote(texts: list[str], scores: list[float], limit: float = 0.75) -> int | None:
    """The most central member of the strongest group of similar texts, if it is strong enough; groups form around their first member."""
    plain = ["".join(c for c in t.upper() if c.isalnum()) for t in texts]
    ratio = lambda i, j: difflib.SequenceMatcher(None, plain[i], plain[j]).ratio()
    groups: list[list[int]] = []
    for i, t in enumerate(plain):
        if t:
            near = max(((ratio(g[0], i), -k) for k, g in enumerate(groups)), default=(0.0, 0))
            if near[0] > limit:
                groups[-near[1]].append(i)
            else:
                groups.append([i])
    if not groups:
        return None
    g = max(groups, key=lambda g: sum(scores[i] for i in g))
    central = max(g, key=lambda i: scores[i] * (0.5 + 0.5 * (np.mean([ratio(i, j) for j in g if j != i]) if len(g) > 1 else 0.0)))
    strong = scores[central] >= 0.4 and (len(g) >= 5 or len(g) >= 3 and scores[central] >= 0.7 * max(scores))
    return central if strong and decoding.dominant(texts[central]) <= 0.45 else None


def consensus(hyps: DataFrame) -> DataFrame:
    """(rec_id, hyp_id) of each recording's agreed hypothesis, where its texts agree; a recording has tens of hypotheses."""
    listed = hyps.groupBy("rec_id").agg(F.sort_array(F.collect_list(F.struct("hyp_id", "text", "score"))).alias("h"))

    def pick(batches):
        for b in batches:
            ids = []
            for h in b.column(1).to_pylist():
                at = vote([x["text"] for x in h], [x["score"] for x in h])
                ids.append(None if at is None else h[at]["hyp_id"])
            yield pa.record_batch([b.column(0), pa.array(ids, pa.int32())], names=["rec_id", "hyp_id"])

    return listed.mapInArrow(pick, "rec_id string, hyp_id int").where("hyp_id is not null")


def preferred(ranked: DataFrame) -> DataFrame:
    """The first-ranked row of each recording, or the best one of the tone first found, if that is off by 1 Hz or more, scores 97 % as
    much, and isn't the worse text by a single letter, unknown signs or a low score."""
    first = Window.partitionBy("rec_id")
    own = F.when(F.col("tone") == 0, F.struct((-F.col("rank")).alias("order"), "hyp_id", "score", "freq", "text"))
    rows = ranked.withColumn("own", F.max(own).over(first)).withColumn("top", F.max(F.when(F.col("rank") == 1, F.struct("hyp_id", "score", "freq", "text"))).over(first))
    unknown = lambda t: (F.length(t) - F.length(F.translate(t, "?", ""))) / F.greatest(F.length(F.translate(t, " ", "")), F.lit(1))
    own_mono, top_mono = scoring.dominant_letter(F.col("own.text")), scoring.dominant_letter(F.col("top.text"))
    worse = ((own_mono > 0.42) & (top_mono < 0.35)) | ((unknown(F.col("own.text")) > 0.25) & (unknown(F.col("top.text")) < 0.12)) | ((F.col("own.score") < 0.35) & (F.col("top.score") >= 0.5))
    take = (F.abs(F.col("own.freq") - F.col("top.freq")) >= 1.0) & (F.col("own.score") >= 0.97 * F.col("top.score")) & ~worse
    rows = rows.withColumn("chosen", F.when(F.coalesce(take, F.lit(False)), F.col("own.hyp_id")).otherwise(F.col("top.hyp_id")))
    return rows.where("hyp_id = chosen").drop("own", "top", "chosen")


def legacy(recordings: DataFrame, reference: str | None = None) -> DataFrame:
    """(rec_id, text, score, freq, wpm, dit_ms, method, error): the older decoder, the best of the three strongest tones in one setting."""
    schema = "rec_id string, text string, score double, freq double, wpm double, dit_ms double, method string, error string"
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches):
        for b in batches:
            rows = []
            for rec, fs, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                sig = np.asarray(x.values, float) if x.is_valid else np.zeros(0)
                cands = decoding.scan_tones(sig, fs)[:3] if fs and len(sig) >= fs // 4 else []
                tried = [decoding.legacy_tone(sig, fs, c["freq"]) for c in cands]
                top = max(tried, key=lambda h: h["score"], default={"text": "", "error": "no candidate tone"})
                rows.append(top | {"rec_id": rec, "method": "legacy"})
            yield pa.record_batch([pa.array([r.get(n) for r in rows], pa.float64() if n in ("score", "freq", "wpm", "dit_ms") else pa.string()) for n in names], names=names)

    out = recordings.select("rec_id", "fs", "samples").mapInArrow(run, schema)
    return with_accuracy(out, F.lit(reference)) if reference is not None else out


def decode(recordings: DataFrame, force_freq: float | None = None, force_wpm: float | None = None, reference: str | None = None, correct: bool = True, model=None, use_model: bool | str = "auto") -> DataFrame:
    """One result row a recording.  force_wpm is taken and, as ever, not used.

    A repaired text is scored anew, also where that is lower.  The agreed hypothesis wins where texts agree and it isn't clearly worse than the best by key; text_raw is before repair.
    A recording without a hypothesis has an empty text and an error.
    """
    from ..operators.repair import semantic_correct

    hyps = hypotheses(recordings, force_freq, model, use_model).withColumn("key", F.round(selection_key(F.col("score"), F.col("text"), F.col("freq"), F.col("freq_initial")), 9))
    agreed = consensus(hyps).select("rec_id", F.col("hyp_id").alias("agreed"))
    w = Window.partitionBy("rec_id").orderBy(F.desc("choice"), "hyp_id")
    choice = F.col("key") * F.when(F.col("hyp_id") == F.col("agreed"), 1.05).otherwise(1.0)
    ranked = hyps.join(agreed, "rec_id", "left").withColumn("choice", choice).withColumn("rank", F.row_number().over(w))
    best = preferred(ranked)
    out = recordings.select("rec_id").join(best, "rec_id", "left").withColumn("text_raw", F.coalesce("text", F.lit("")))
    out = out.withColumn("text_raw", F.replace(F.replace("text_raw", F.lit("<AR>"), F.lit("+")), F.lit("<SK>"), F.lit("+")))
    if correct:
        out = semantic_correct(out.drop("text"), "rec_id", "text_raw")
    else:
        out = out.withColumn("text", F.col("text_raw")).withColumn("corrections", F.array().cast("array<struct<pos:int,original:string,corrected:string,type:string>>"))
    again = scoring.repaired_score(F.col("text"), F.col("text_raw"), F.col("score"), F.col("duty_cycle"), F.col("wpm"), F.col("dah") / F.greatest("dit", F.lit(1.0)))
    out = out.withColumn("score", F.when(F.size("corrections") > 0, again).otherwise(F.col("score")))
    out = out.select(
        "rec_id", "text", "text_raw", "score", "freq", "freq_initial", "snr_db", F.round("wpm", 1).alias("wpm"), F.round("dit", 1).alias("dit_ms"), F.round("dah", 1).alias("dah_ms"),
        F.when(F.col("env_method").isin("model", "fused"), F.col("env_method")).otherwise("standard").alias("method"), F.size("corrections").alias("corrections"), F.when(F.col("score").isNull(), "no candidate tone").alias("error"),
    )
    return with_accuracy(out, F.lit(reference)) if reference is not None else out


def with_accuracy(results: DataFrame, reference) -> DataFrame:
    """Adds accuracy: the sequence matcher's ratio of text and reference, letters, digits and spaces only."""
    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity(x or "", y or "") for x, y in zip(a, b, strict=True)])

    return results.withColumn("accuracy", ratio(F.col("text"), reference))
