import numpy as np

from keyspan.functions import contest
from keyspan.plans import contest as plan
from keyspan.plans import model_hook
from keyspan.sources import audio


def test_exchange_parts():
    t = "YO4AAC5NN2169 TU SZ1A 5NN 2170 TU"
    assert contest.serials(t) == {"2169", "2170"} and "YO4AAC" in contest.calls(t)
    assert 0.5 < contest.quality(t) <= 1 and contest.quality("EE") == 0
    assert contest.wanted_serials("5NN 2001 TU 5NN 2004") == [2002, 2003, 2005, 2006, 2007]


def test_stitch_and_inject():
    pieces = [{"start": 0.0, "text": "YO4AAC 5NN 2169 TU", "score": 0.9, "freq": 700.0, "wpm": 25.0}, {"start": 18.0, "text": "5NN 2169 TU DL1ABC 5NN 2170", "score": 0.8, "freq": 700.0, "wpm": 25.0}]
    out = contest.stitch_windows(pieces)
    assert out["serials"] == ["2169", "2170"] and out["text"].count("2169") == 1
    assert contest.injected("DE DL1ABC", ["DL1ABD 5NN 2200"]) == "DE DL1ABC DL1ABD 5NN 2200"
    assert contest.fused([{"text": "CQ D? W1AW", "score": 0.8}, {"text": "CQ DE W1AW", "score": 0.7}]) == "CQ DE W1AW"


def test_windows_and_transcript(spark):
    sig = audio.synthesize("YO4AAC 5NN 2169 TU DL1ABC 5NN 2170 TU", 4000, 700, 20)
    df = spark.createDataFrame([("r", 4000, sig.tolist())], audio.RECORDING)
    parts = plan.windows(df, 16.0, 9.0, 6.0).collect()
    starts = sorted(p.start for p in parts)
    assert starts[0] == 0 and all(np.diff(starts) == 9.0) and starts[-1] * 4000 + len(parts[-1].samples) <= len(sig)
    out = plan.transcript(df, 700.0, 16.0, 9.0).first()
    assert {"2169", "2170"} <= set(out.serials)
    best = plan.long_hypotheses(df, 700.0, 20.0, 5.0).orderBy("score", ascending=False).first()
    assert best.score > 0.5


def test_model_hook():
    best = {"text": "E?E?", "score": 0.2, "freq": 700.0}
    assert model_hook.availability(None) != "available" and model_hook.chosen(None, np.zeros(9), 8, best) is best
    assert model_hook.chosen(lambda s, f, t: ("CQ DE W1AW", 0.9), np.zeros(9), 8, best)["text"] == "CQ DE W1AW"
    assert not model_hook.wanted("CQ DE W1AW", 0.95, True)
