"""Recording operators that no SQL states, and the parts of the decode plan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyspan.functions import kernels
from keyspan.operators import recordings
from keyspan.plans import decode
from keyspan.sources import audio


def test_stream_filter_goes_on_between_chunks():
    rng = np.random.default_rng(1)
    x = rng.normal(size=3000)
    whole = kernels.StreamBandpass(8000, 660, 740).process(x)
    parts = kernels.StreamBandpass(8000, 660, 740)
    assert np.allclose(np.concatenate([parts.process(c) for c in np.array_split(x, 17)]), whole)
    # magnitude at the middle, the edges and beyond
    n = np.arange(16000)
    for f, low, high in ((700, 0.97, 1.03), (660, 0.68, 0.74), (740, 0.68, 0.74), (500, 0, 0.06), (1000, 0, 0.06)):
        y = kernels.StreamBandpass(8000, 660, 740).process(np.sin(2 * np.pi * f / 8000 * n))[8000:]
        assert low <= np.abs(y).max() <= high, f


def test_smooth_loop_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = np.cos(2 * np.pi * 703 / 8000 * np.arange(400)) + 0.1 * rng.normal(size=400)
    track, re = kernels.smooth_loop(x, 8000, 700)
    angle = np.unwrap(np.angle(x * np.exp(-2j * np.pi * 700 / 8000 * np.arange(400))))
    want = kernels.lowpass(np.r_[700, np.diff(angle) * 8000 / (2 * np.pi) + 700], 8000, 20)
    assert np.allclose(track, want) and np.allclose(re, x * np.cos(2 * np.pi * np.cumsum(want) / 8000))
    df = spark.createDataFrame([(1, x.tolist()), (2, []), (3, None)], "rec long, x array<double>")
    rows = recordings.smooth_carrier(df, "rec", "x", 8000, 700.0).orderBy("i").collect()
    assert [r.rec for r in rows] == [1] * 400 and np.allclose([r.freq for r in rows], want)


def test_resampling_keeps_a_tone():
    x = np.sin(2 * np.pi * 440 / 16000 * np.arange(16000))
    for fs in (16000, 11025, 8000):
        y = kernels.resampled(np.sin(2 * np.pi * 440 / fs * np.arange(fs)), fs, 8000)
        assert len(y) == 8000 and np.allclose(y[200:-200], np.sin(2 * np.pi * 440 / 8000 * np.arange(8000))[200:-200], atol=0.02)
    assert len(kernels.resampled(x[:5], 16000)) == 3 and not len(kernels.resampled(x[:0], 16000))


def test_gain_modes(spark):
    df = spark.createDataFrame([(1, [0.1, -0.2, 0.4])], "rec long, x array<double>")
    none = [r.v for r in recordings.gain_mode(df, "rec", "x", 8000, "none").orderBy("i").collect()]
    assert none == [0.1, -0.2, 0.4]
    slow, odd = ([r.v for r in recordings.gain_mode(df, "rec", "x", 8000, m).orderBy("i").collect()] for m in ("slow", "whatever"))
    assert slow == odd


def test_tones_of_a_long_recording_and_late_texts(spark):
    """A tone that starts late is found, and a recording beyond two minutes is decoded in windows."""
    fs = 4000
    rng = np.random.default_rng(3)
    keyed = audio.synthesize("CQ CQ DE W1AW W1AW K", fs, 700, 25)
    sig = 0.01 * rng.normal(size=150 * fs)
    at = 78 * fs  # where the third place of a 118 s recording begins
    sig[at : at + len(keyed)] += keyed
    tones = decode.found_tones(sig[: 118 * fs], sig[: 118 * fs], fs)
    assert abs(tones[0]["freq"] - 700) < 12
    fs = 2000
    sig = audio.synthesize(" ".join(["CQ CQ DE W1AW W1AW K"] * 12), fs, 700, 25)
    assert len(sig) > 120 * fs
    found = decode.hypotheses(spark.createDataFrame([("a", fs, sig.tolist())], audio.RECORDING), 700.0).collect()
    assert any("W1AW" in h.text and h.hyp_id >= 10_000 for h in found) and len({h.hyp_id for h in found}) == len(found)


def test_first_tone_is_preferred(spark):
    rows = [("a", 0, 1, 0, "CQ DE W1AW TEST", 0.90, 712.0), ("a", 1, 2, 0, "CQ DE W1AW TEST", 0.89, 700.0), ("b", 0, 1, 4, "CQ DE W1AW TEST", 0.9, 712.0), ("b", 1, 2, 0, "EEEEEEEEEEEE", 0.89, 700.0), ("c", 0, 1, 4, "X", 0.9, 712.0), ("c", 1, 2, 0, "Y", 0.5, 700.0)]
    df = spark.createDataFrame([(r, h, k, t, x, s, f) for r, h, k, t, x, s, f in rows], "rec_id string, hyp_id int, rank int, tone int, text string, score double, freq double")
    got = {r.rec_id: r.hyp_id for r in decode.preferred(df).collect()}
    assert got == {"a": 0, "b": 0, "c": 0}
    off = df.where("rec_id = 'a'").withColumn("tone", F.when(F.col("hyp_id") == 0, 4).otherwise(0))
    assert decode.preferred(off).first().hyp_id == 1


def test_model_is_heard_for_weak_texts():
    sig = audio.synthesize("CQ DE W1AW", 4000, 700, 20) + 0.8 * np.random.default_rng(4).normal(size=len(audio.synthesize("CQ DE W1AW", 4000, 700, 20)))
    found = decode.recording_hypotheses(sig, 4000, 700.0, model=lambda s, f, t: ("CQ CQ DE W1AW TEST", 0.95), use_model=True)
    assert not found or any(h["env_method"] == "model" for h in found) or max(h["score"] for h in found) > 0.5


@pytest.mark.parametrize("text, wpm", [("CQ CQ DE W1AW K", 20), ("W1AW DE N0CALL", 25)])
def test_legacy_decode(spark, text, wpm):
    df = spark.createDataFrame([("a", 8000, audio.synthesize(text, 8000, 700, wpm).tolist()), ("b", 8000, [])], audio.RECORDING)
    got = {r.rec_id: r for r in decode.legacy(df, text).collect()}
    assert got["a"].text.strip() == text and got["a"].accuracy > 0.95 and got["b"].error is not None
