import numpy as np
import pytest

from keyspan.functions import decoding, kernels
from keyspan.functions.codes import CODE_OF, SYMBOL_OF
from keyspan.plans import decode
from keyspan.sources import audio

TEXTS = [("CQ CQ DE W1AW K", 20, 750.0), ("W1AW DE N0CALL", 25, 700.0), ("CQ TEST DE K3EST K", 22, 720.0)]


def test_code_table():
    for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
        assert decoding.lookup(CODE_OF[c]) == c
    assert decoding.lookup(".-.-.-.-") == "?" and SYMBOL_OF["-.--."] == "<KN>"


@pytest.mark.parametrize("text, wpm, tone", TEXTS)
def test_clean_signals(text, wpm, tone):
    sig = audio.synthesize(text, 16000, tone, wpm)
    best = max(decode.recording_hypotheses(sig, 16000), key=lambda h: h["score"])
    assert decode.similarity(best["text"], text) >= 0.95
    assert abs(best["freq"] - tone) <= 5 and abs(best["wpm"] - wpm) / wpm < 0.25


def test_noisy_signal():
    sig = audio.synthesize("CQ DE W1AW K", 16000, 750.0, 20, snr_db=15, seed=7)
    best = max(decode.recording_hypotheses(sig, 16000), key=lambda h: h["score"])
    assert best["text"] and decode.similarity(best["text"], "CQ DE W1AW K") >= 0.4


def test_frame_decode(spark, tmp_path):
    df = spark.createDataFrame([(str(i), t) for i, (t, _, _) in enumerate(TEXTS)], "id string, t string")
    rec = audio.synthesized(df, "id", "t")
    for row in audio.write_wav(rec).collect():
        (tmp_path / f"{row.rec_id}.wav").write_bytes(row.content)
    (tmp_path / "bad.wav").write_bytes(b"nothing")
    back = audio.read_wav(spark, str(tmp_path))
    out = {r.rec_id.rsplit("/", 1)[1]: r for r in decode.decode(back).collect()}
    assert out["bad.wav"].error and out["bad.wav"].text == ""
    for i, (t, _, _) in enumerate(TEXTS):
        assert decode.similarity(out[f"{i}.wav"].text_raw, t) >= 0.9, out[f"{i}.wav"]


def test_wav_round_trip():
    x = np.sin(np.arange(4000) / 7).astype(np.float32)
    fs, y = audio.wav_samples(audio.wav_bytes(x, 8000))
    assert fs == 8000 and np.abs(y - x / np.abs(x).max()).max() < 1e-3


def test_runs_keep_their_quirk():
    fs = 1000
    states = np.r_[np.ones(10), np.zeros(2), np.ones(2), np.zeros(10)].astype(np.int8)
    # the second short run lives on with the first one's state, next to the mark it isn't joined with
    assert decoding.segments(states, fs) == [(1, 12.0), (0, 2.0), (0, 10.0)]
    assert decoding.segments(np.r_[np.zeros(2), np.ones(9)].astype(np.int8), fs) == [(0, 2.0), (1, 9.0)]


def test_one_pole_and_average_match_loops():
    rng = np.random.default_rng(1)
    x = rng.normal(size=5000)
    for alpha in (1e-4, 0.01, 0.3, 0.97):
        y, out = 0.0, []
        for v in x:
            y = (1 - alpha) * y + alpha * v
            out.append(y)
        assert np.allclose(kernels.one_pole(x, alpha), out, atol=1e-9)
    for m in (1, 2, 5, 8):
        assert np.allclose(kernels.moving_average(x, m), np.convolve(x, np.ones(m) / m, "same"))


def test_viterbi_matches_enumeration():
    import itertools

    x, dit = np.array([58, 62, 185, 61, 400.0, 63]), 60.0
    mean = np.array([1, 3, 7]) * dit
    emit = -0.5 * ((x[:, None] - mean) / (0.35 * mean)) ** 2 - np.log(0.35 * mean)
    score = lambda p: decoding.FIRST[p[0]] + sum(emit[i, s] for i, s in enumerate(p)) + sum(decoding.STEP[a, b] for a, b in zip(p, p[1:], strict=False))
    best = max(itertools.product(range(3), repeat=len(x)), key=score)
    assert decoding.viterbi_gaps(x, dit) == [("in_char", "char_gap", "word_gap")[s] for s in best]


def test_loop_locks_and_gain_is_bounded():
    fs = 8000
    sig = np.sin(2 * np.pi * 703 / fs * np.arange(fs))
    out = kernels.costas_loop(sig, fs, 700.0)
    assert abs(out["freq"][-500:].mean() - 703) < 2
    y, _, gains = kernels.slow_gain(0.1 * sig[:2000], fs)
    assert np.abs(y).max() <= 1 and gains.min() >= 0.1 and gains.max() <= 50
    assert np.abs(kernels.gain_control(0.1 * sig, fs, "other")).max() <= 1
    assert kernels.coherent_envelope(sig, fs, 703, 160).max() <= 1 and abs(kernels.coherent_gain_db(1600) - 32.04) < 0.01


def test_filters_pass_and_stop():
    fs = 8000
    t = np.arange(fs) / fs
    band = kernels.bandpass(np.sin(2 * np.pi * 700 * t) + np.sin(2 * np.pi * 1200 * t), fs, 640, 760)
    power = lambda f: np.abs(band[1000:-1000] @ np.exp(-2j * np.pi * f * t[1000:-1000])) / 3000
    assert power(700) > 0.95 and power(1200) < 0.01
    hum = kernels.notch(np.sin(2 * np.pi * 60 * t) + np.sin(2 * np.pi * 700 * t), fs)
    assert np.abs(hum[1000:-1000] @ np.exp(-2j * np.pi * 60 * t[1000:-1000])) / 3000 < 0.2


def test_votes():
    assert decode.vote(["CQ DE W1AW", "CQ DE W1AV", "CQ DE W1AW", "EEEE"], [0.8, 0.7, 0.8, 0.9]) in (0, 2)
    assert decode.vote(["?", ""], [0.1, 0.1]) is None
