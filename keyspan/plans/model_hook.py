"""A place for a learned decoder: any function of (samples, rate, tone) to (text, confidence).  None is shipped."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from ..functions import decoding

Model = Callable[[np.ndarray, int, float], tuple[str, float]]
#: Seconds of a recording a model is given.
MOST_SECONDS = 45


def availability(model: Model | None) -> str:
    return "available" if model else "no model is registered"


def wanted(text: str, score: float, use: bool | str = "auto") -> bool:
    """auto: for weak, garbled or one-letter texts; True: unless the text is strong; False: never."""
    garble, mono = text.count("?") / max(len(text.replace(" ", "")), 1), decoding.dominant(text)
    if use == "auto":
        return score < 0.55 or garble > 0.12 or mono > 0.40
    return bool(use) and not (score >= 0.85 and garble < 0.05 and mono < 0.35)


def chosen(model: Model | None, sig: np.ndarray, fs: int, best: dict, use: bool | str = "auto") -> dict:
    """best, or the model's text where it has clearly less garble or is clearly more plausible."""
    if model is None or not wanted(best["text"], best["score"], use):
        return best
    text, confidence = model(sig[: MOST_SECONDS * fs], fs, best["freq"])
    share = lambda t: t.count("?") / max(len(t.replace(" ", "")), 1)
    p, q = decoding.plausibility(text), decoding.plausibility(best["text"])
    clearer = share(text) + 0.05 < share(best["text"]) and p >= 0.9 * q
    likelier = confidence >= 0.45 and p > q + 0.08 and decoding.dominant(text) < 0.35
    if len(text) < 3 or not (clearer or likelier):
        return best
    return best | {"text": text, "score": max(best["score"], 0.5 * best["score"] + 0.5 * confidence), "method": "model"}
