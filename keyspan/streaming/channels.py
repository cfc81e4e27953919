"""Many channels of sample chunks (channel, seq, fs, samples), decoded with keyed state; and windows over event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.realtime import Channel

HITS = "channel string, seq long, stream_id int, freq_hz double, text string, score double, wpm double"
COLUMNS = [c.strip().split(" ")[0] for c in HITS.split(",")]


def fed(channel: str, state: Channel | None, chunks: pd.DataFrame) -> tuple[Channel | None, pd.DataFrame]:
    """Chunks of one channel, in order of seq, through its state."""
    rows = []
    for c in chunks.sort_values("seq").itertuples():
        state = state or Channel(fs=int(c.fs))
        rows += [{"channel": channel, "seq": c.seq, **hit} for hit in state.process(c.samples)]
    return state, pd.DataFrame(rows, columns=COLUMNS)


def decode_batch(chunks: DataFrame) -> DataFrame:
    """The same hits from stored chunks: one group a channel."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return fed(key[0], None, pdf)[1]

    return chunks.groupBy("channel").applyInPandas(run, HITS)


def decode_stream(chunks: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Hits of a stream of chunks; a channel's state is its ring of three seconds, its tracks and transcripts.

    Chunks of a channel must come in order across micro-batches; within one they are sorted.  With ttl_ms the state of a channel
    that has sent nothing for so long is dropped, and the channel begins anew when it comes back; without, it stays.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame(columns=COLUMNS)
            return
        got = list(parts)
        held = Channel.load(state.get[0]) if state.exists else None
        held, out = fed(key[0], held, pd.concat(got)) if got else (held, pd.DataFrame(columns=COLUMNS))
        if held is not None:
            state.update((held.dump(),))
            if ttl_ms:
                state.setTimeoutDuration(ttl_ms)
        yield out

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return chunks.groupBy("channel").applyInPandasWithState(run, HITS, "state binary", "append", timeout)


def chunked(recordings: DataFrame, samples: int) -> DataFrame:
    """Recordings (rec_id, fs, samples) cut to chunks."""
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("samples") - 1, F.lit(0)), F.lit(samples))).alias("at")
    return recordings.select(F.col("rec_id").alias("channel"), "fs", "samples", starts).select("channel", (F.col("at") / samples).cast("long").alias("seq"), "fs", F.slice("samples", F.col("at") + 1, F.lit(samples)).alias("samples"))


def tumbling(events: DataFrame, size: str, late: str, key: str = "event_type", ts: str = "ts", value: str = "value") -> DataFrame:
    """Counts and sums by window, closed by the watermark when events is a stream."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(key, F.window(ts, size).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(key, F.col("w.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str, late: str, key: str = "user_id", ts: str = "ts", value: str = "value") -> DataFrame:
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(key, F.col("w.start").alias("start"), "n", "total")
