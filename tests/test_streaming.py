import numpy as np
from pyspark.sql import functions as F

from keyspan.__main__ import main
from keyspan.functions.realtime import Channel, facade
from keyspan.sources import audio
from keyspan.streaming import channels


def chunks(sig, n):
    return [sig[a : a + n] for a in range(0, len(sig), n)]


def test_two_tones_are_tracked():
    fs = 8000
    a, b = audio.synthesize("PARIS PARIS", fs, 600, 25), audio.synthesize("TEST DE K3EST", fs, 900, 25)
    n = min(len(a), len(b))
    c = Channel(fs=fs)
    hits = [h for part in chunks((a[:n] + b[:n]) / 2, 2000) for h in c.process(part)]
    assert hits and {round(h["freq_hz"] / 100) for h in hits} >= {6, 9}
    assert facade(hits[:1]).startswith("[")
    back = Channel.load(c.dump())
    assert back.snapshot() == c.snapshot()
    c.reset()
    assert not c.tracks and c.opened == back.opened


def test_stream_equals_batch(spark, tmp_path):
    rec = spark.createDataFrame([("a", "CQ DE W1AW"), ("b", "TEST K3EST")], "id string, t string")
    parts = channels.chunked(audio.synthesized(rec, "id", "t", 8000), 4000)
    # a file for each half second of all channels, read in order
    for seq in range(4):
        parts.where(F.col("seq").between(seq * 5, seq * 5 + 4)).coalesce(1).write.parquet(str(tmp_path / f"in/{seq}"))
    stored = spark.read.parquet(*[str(tmp_path / f"in/{s}") for s in range(4)])
    want = sorted(map(tuple, channels.decode_batch(stored).collect()))
    src = tmp_path / "src"
    src.mkdir()
    stream = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = channels.decode_stream(stream).writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for seq in range(4):
            for f in (tmp_path / f"in/{seq}").glob("part-*.parquet"):
                f.rename(src / f"{seq}-{f.name}")
            q.processAllAvailable()
    finally:
        q.stop()
    got = sorted(map(tuple, spark.table("hits").collect()))
    assert want and got == want


def test_watermarked_windows(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "ts", "value")
    (tmp_path / "e").mkdir()
    events.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = channels.tumbling(stream, "1 hour", "10 minutes").writeStream.outputMode("append").format("memory").queryName("hours").start()
    q.processAllAvailable()
    q.stop()
    batch = {(r.event_type, r.start): r.n for r in channels.tumbling(events, "1 hour", "10 minutes").collect()}
    got = {(r.event_type, r.start): r.n for r in spark.table("hours").collect()}
    assert got and all(batch[k] == n for k, n in got.items())


def test_command_line(spark, tmp_path, capsys):
    sig = audio.synthesize("CQ DE W1AW", 8000, 700, 20)
    path = tmp_path / "x.wav"
    path.write_bytes(audio.wav_bytes(sig, 8000))
    assert main(["-i", str(path), "--ref", "CQ DE W1AW", "--json"]) == 0
    assert '"accuracy"' in capsys.readouterr().out
    assert main(["-i", str(path), "-q", "-o", str(tmp_path / "out.txt")]) == 0
    assert "W1AW" in (tmp_path / "out.txt").read_text()
    assert np.isfinite(sig).all()
