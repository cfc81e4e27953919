"""Long recordings by overlapping windows: each window is a row, so one recording is the work of many tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import contest, decoding, kernels

WINDOW = "rec_id string, start double, text string, score double, freq double, wpm double, worth double"
STITCHED = "rec_id string, text string, score double, freq double, serials array<string>, calls array<string>, windows int"
WIDTHS = ((35, 6.0, "square"), (45, 8.0, "square"), (55, 10.0, "square"))


def windows(recordings: DataFrame, seconds: float, hop: float, least: float, begin: float = 0.0) -> DataFrame:
    """(rec_id, fs, start, samples): overlapping parts of each recording from the share `begin` of its length on; the last may be shorter, but not than `least` seconds."""
    size, step = (F.lit(seconds) * F.col("fs")).cast("int"), (F.lit(hop) * F.col("fs")).cast("int")
    n = F.size("samples")
    first = (F.lit(begin) * n).cast("int")
    starts = F.when(n > first, F.sequence(first, F.greatest(n - 1, first), step)).otherwise(F.array().cast("array<int>"))
    # a start is used if enough samples follow and the window before it didn't reach the end
    starts = F.filter(starts, lambda s: (n - s >= F.lit(least) * F.col("fs")) & ((s == first) | (s - step + size < n)))
    rows = recordings.select("rec_id", "fs", "samples", F.explode(starts).alias("at"))
    return rows.select("rec_id", "fs", (F.col("at") / F.col("fs")).alias("start"), F.slice("samples", F.col("at") + 1, size).alias("samples"))


def window_texts(parts: DataFrame, tone: float | None = None) -> DataFrame:
    """Rows of WINDOW: tones of the window and around the given one, three settings each, merged."""

    def decode(batches):
        for b in batches:
            rows = []
            for rec, fs, start, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                sig = np.asarray(x.values, float)
                freqs = [c["freq"] for c in decoding.apart(decoding.scan_tones(sig, fs), 6.0)[:5]]
                freqs += [tone + d for d in (0.0, -8.0, -4.0, 4.0, 8.0, 12.0)] if tone else []
                hyps = [h for f in dict.fromkeys(round(f) for f in freqs) for h in decoding.decode_tone(sig, fs, float(f), WIDTHS)]
                if best := contest.window_text(hyps):
                    rows.append(best | {"rec_id": rec, "start": start})
            names = [c.strip().split(" ")[0] for c in WINDOW.split(",")]
            yield pa.record_batch([pa.array([r[n] for r in rows], pa.string() if n in ("rec_id", "text") else pa.float64()) for n in names], names=names)

    return parts.select("rec_id", "fs", "start", "samples").mapInArrow(decode, WINDOW)


def stitched(pieces: DataFrame) -> DataFrame:
    """Rows of STITCHED from window texts; a recording has one short text for each half minute."""
    listed = pieces.groupBy("rec_id").agg(F.collect_list(F.struct("start", "text", "score", "freq", "wpm")).alias("p"))

    def merge(batches):
        for b in batches:
            found = [(r, contest.stitch_windows(p)) for r, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            found = [(r, f) for r, f in found if f]
            yield pa.record_batch(
                [pa.array([r for r, _ in found], pa.string()), pa.array([f["text"] for _, f in found], pa.string()), pa.array([f["score"] for _, f in found], pa.float64()), pa.array([f["freq"] for _, f in found], pa.float64()),
                 pa.array([f["serials"] for _, f in found], pa.list_(pa.string())), pa.array([f["calls"] for _, f in found], pa.list_(pa.string())), pa.array([f["windows"] for _, f in found], pa.int32())],
                names=["rec_id", "text", "score", "freq", "serials", "calls", "windows"],
            )

    return listed.mapInArrow(merge, STITCHED)


def transcript(recordings: DataFrame, tone: float | None = None, seconds: float = 32.0, hop: float = 18.0) -> DataFrame:
    """One stitched transcript a recording; recordings whose serials have gaps or may go on are searched again from 55 % on in shorter windows."""
    pieces = window_texts(windows(recordings, seconds, hop, 12.0), tone).where((F.col("worth") >= 0.28) & (F.length(F.replace("text", F.lit(" "), F.lit(""))) >= 8))
    first = stitched(pieces)
    again = recordings.join(first.where(F.size("serials") >= 2).select("rec_id"), "rec_id", "left_semi")
    late = window_texts(windows(again, 28.0, 16.0, 10.0, 0.55), tone).where("worth >= 0.30")
    both = pieces.unionByName(late)
    return stitched(both)


def long_hypotheses(recordings: DataFrame, tone: float, seconds: float = 60.0, overlap: float = 15.0) -> DataFrame:
    """Hypotheses (rec_id, start, text, score, ...) of windows of long recordings in the quick settings, for a top-k by score."""

    def decode(batches):
        for b in batches:
            rows = []
            for rec, fs, start, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                sig = kernels.notch(np.asarray(x.values, float), fs)
                rows += [h | {"rec_id": rec, "start": start} for h in decoding.decode_tone(sig, fs, tone, decoding.FAST)]
            names = ["rec_id", "start", "text", "score", "wpm"]
            yield pa.record_batch([pa.array([r[n] for r in rows], pa.string() if n in ("rec_id", "text") else pa.float64()) for n in names], names=names)

    return windows(recordings, seconds, seconds - overlap, seconds / 2).mapInArrow(decode, "rec_id string, start double, text string, score double, wpm double")
