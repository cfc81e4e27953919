"""Exact substring deduplication with prefix-partitioned suffix trees over words.

Suffixes are split by a prefix of 5 words: the one with the smallest hash among the 9 that begin in a 13-word window, so equal
windows are always under equal prefixes, and consecutive windows mostly under the same one.  All prefixes are counted first.

* A prefix in one document only is a leaf: its suffixes can't repeat and never leave their task.
* A prefix with at most GROUP windows is a group that fits memory.  Its documents send the words around the prefix once for a
  run of windows, and the group's tree is built in one task: suffixes in lexical order with the common length of neighbours,
  which are the tree's nodes.  Internal nodes of depth 13 are the repeats; the tree isn't grown further, as longer repeats
  are runs of such nodes, which are merged to maximal ones in each document.
* A prefix with more windows is lengthened to the whole 13 words.  Suffixes under such a prefix share all that matters, so no
  tree is left to build: its smallest document is a minimum that each task combines over the windows it reads, and no task
  gathers it.  A second look at the texts finds the windows that start in a smaller document, and gives them as runs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import HOT, Filter, dropped, hot_keys, spread_join, tidied, written
from .textscan import grams, mix64, scan_words, signed, slices, sliding_min

#: Words of a window (depth of a reported node), and of the prefix that suffixes are split by.
DEPTH, PREFIX = 13, 5
#: Windows of a group whose tree is built in memory, and windows (of whole groups) handled at once.
GROUP, CHUNK = 1 << 14, 1 << 16
#: Windows under hot prefixes that a task holds before it combines equal ones.
HELD = 1 << 18
#: Bytes of words in an Arrow batch of segments.
SEGMENT_BYTES = 1 << 24
_OTHER_SEED = 0x8CB92BA72F3D8DD7


def keyed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, th, text): th tells rows with equal ids apart."""
    return documents.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).bitwiseAND(F.lit(0x7FFFFFFF)).alias("th"), F.col(text_col).alias("text"))


def whole_texts(docs: DataFrame) -> DataFrame:
    """(doc, th, n, c1, c2): number of words and fingerprint of the word sequence of each row."""

    def scan(batches):
        for b in batches:
            for w in scan_words(b.column(2), lower=False):
                n, h = w.hi - w.lo, w.hashes()
                place = np.arange(len(h)) - np.repeat(w.first[:-1], w.counts)
                out = []
                for salt in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03):
                    sums = np.r_[np.uint64(0), np.cumsum(mix64(h ^ mix64(place.astype(np.uint64) + np.uint64(salt))))]
                    out.append(signed(mix64(sums[w.first[1:]] - sums[w.first[:-1]] + w.counts.astype(np.uint64))))
                yield pa.record_batch([b.column(0).slice(w.lo, n), b.column(1).slice(w.lo, n), pa.array(w.counts.astype(np.int64)), pa.array(out[0]), pa.array(out[1])], names=["doc", "th", "n", "c1", "c2"])

    return docs.select("doc", "th", "text").mapInArrow(scan, "doc long, th long, n long, c1 long, c2 long")


def sampled(h: np.ndarray, left: np.ndarray, depth: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """(window starts, hash of the sampled prefix in each window)."""
    low = sliding_min(grams(h, prefix), depth - prefix + 1)
    at = np.flatnonzero(left[: len(low)] >= depth)
    return at, low[at]


def prefix_counts(docs: DataFrame, origin, depth: int, prefix: int) -> DataFrame:
    """(prefix, windows) of the prefixes in two documents or more of those that `origin` passes."""

    def scan(batches):
        for b in batches:
            ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            for w in scan_words(b.column(2), lower=False):
                at, low = sampled(w.hashes(), w.left(), depth, prefix)
                doc = w.doc[at]
                keep = origin.value.has(ids[w.lo : w.hi])[doc]
                low, doc = low[keep], doc[keep]
                order = np.lexsort((low, doc))
                low, doc = low[order], doc[order]
                new = np.ones(len(low), bool)
                new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
                first = np.flatnonzero(new)
                yield pa.record_batch({"prefix": signed(low[first]), "windows": np.diff(np.r_[first, len(low)])})

    rows = docs.where("doc is not null").mapInArrow(scan, "prefix long, windows long")
    return rows.groupBy("prefix").agg(F.count("*").alias("docs"), F.sum("windows").alias("windows")).where("docs > 1").select("prefix", "windows")


def gathered(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces of buffer one after another."""
    first = np.r_[0, np.cumsum(lengths)[:-1]]
    return buffer[np.repeat(starts - first, lengths) + np.arange(int(lengths.sum()))]


def segments(docs: DataFrame, origin, shared, hot, depth: int, prefix: int) -> DataFrame:
    """(prefix, doc, at, words) of every run of windows under one prefix that is `shared` and not `hot`; at holds th and the first word's place."""

    def scan(batches):
        for b in batches:
            ids, th = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for w in scan_words(b.column(2), lower=False):
                h = w.hashes()
                at, low = sampled(h, w.left(), depth, prefix)
                doc = w.doc[at]
                keep = origin.value.has(ids[w.lo : w.hi])[doc]
                at, low, doc = at[keep], low[keep], doc[keep]
                keep = shared.value.has(signed(low)) & ~hot.value.has(signed(low))
                at, low, doc = at[keep], low[keep], doc[keep]
                new = np.ones(len(at), bool)
                new[1:] = (at[1:] != at[:-1] + 1) | (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
                first = np.flatnonzero(new)
                if not len(first):
                    continue
                length = np.diff(np.r_[first, len(at)]) + depth - 1
                begin, doc, low = at[first], doc[first], low[first]
                place = (th[w.lo + doc] << 32) | (begin - w.first[doc])
                cuts = np.searchsorted(np.cumsum(length), np.arange(0, int(length.sum()), SEGMENT_BYTES // 8))
                for x, y in zip(cuts, np.r_[cuts[1:], len(first)], strict=True):
                    if x < y:
                        words = gathered(h, begin[x:y], length[x:y])
                        ends = np.r_[0, np.cumsum(length[x:y] * 8)].astype(np.int32)
                        words = pa.Array.from_buffers(pa.binary(), int(y - x), [None, pa.py_buffer(ends), pa.py_buffer(words)])
                        yield pa.record_batch([pa.array(signed(low[x:y])), pa.array(ids[w.lo + doc[x:y]]), pa.array(place[x:y]), words], names=["prefix", "doc", "at", "words"])

    return docs.where("doc is not null").mapInArrow(scan, "prefix long, doc long, at long, words binary")


def subtree(prefix: np.ndarray, doc: np.ndarray, words: np.ndarray, starts: np.ndarray, counts: np.ndarray, depth: int) -> np.ndarray:
    """For each window of each segment, whether its node of depth `depth` has a smaller document.

    Suffixes are sorted by prefix and words; the words that neighbours have in common bound the tree's internal nodes.
    """
    of = np.repeat(np.arange(len(counts)), counts)
    first = np.repeat(starts - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(len(of))
    rows = words[first[:, None] + np.arange(depth)]
    order = np.lexsort([*(rows[:, j] for j in range(depth - 1, -1, -1)), prefix[of]])
    rows, group, owner = rows[order], prefix[of][order], doc[of][order]
    common = np.logical_and.accumulate(rows[1:] == rows[:-1], axis=1).sum(1) * (group[1:] == group[:-1])
    node = np.flatnonzero(np.r_[True, common < depth])
    low = np.repeat(np.minimum.reduceat(owner, node), np.diff(np.r_[node, len(owner)]))
    out = np.empty(len(of), bool)
    out[order] = owner > low
    return out


def tree_runs(rows: DataFrame, depth: int) -> DataFrame:
    """(doc, th, start, windows): runs of windows with a smaller document in their node, from the segments of each group."""

    def handle(t: pa.Table):
        words = t["words"].chunk(0) if t["words"].num_chunks else pa.array([], pa.binary())
        ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2], np.uint64, count=int(ends[-1]) // 8)
        counts = np.diff(ends) // 8 - (depth - 1)
        prefix, doc, at = t["prefix"].to_numpy(), t["doc"].to_numpy(), t["at"].to_numpy()
        hit = subtree(prefix, doc, data, ends[:-1] // 8, counts, depth)
        of = np.repeat(np.arange(len(counts)), counts)
        first = np.flatnonzero(hit & np.r_[True, ~hit[:-1] | (of[1:] != of[:-1])])
        last = np.flatnonzero(hit & np.r_[~hit[1:] | (of[1:] != of[:-1]), True])
        seg = of[first]
        start = (at[seg] & 0xFFFFFFFF) + first - (np.cumsum(counts) - counts)[seg]
        return pa.record_batch({"doc": doc[seg], "th": at[seg] >> 32, "start": start.astype(np.int32), "windows": (last - first + 1).astype(np.int32)})

    def build(batches):
        held: list = []
        size = 0
        for b in slices(batches, 4096):
            held.append(b)
            size += b.num_rows * 4
            if size >= CHUNK:
                t = pa.Table.from_batches(held).combine_chunks()
                prefix = t["prefix"].to_numpy()
                cut = int(np.searchsorted(prefix, prefix[-1]))  # the last group may go on
                if cut:
                    yield handle(t.slice(0, cut).combine_chunks())
                    held, size = t.slice(cut).to_batches(), (t.num_rows - cut) * 4
        if held:
            yield handle(pa.Table.from_batches(held).combine_chunks())

    return rows.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(build, "doc long, th long, start int, windows int")


def hot_windows(batch, origin, hot, depth: int, prefix: int):
    """(w1, w2, doc, at), in the order of the texts, of a batch's windows under a hot prefix, which is lengthened to the window itself."""
    ids, th = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
    for w in scan_words(batch.column(2), lower=False):
        h = w.hashes()
        at, low = sampled(h, w.left(), depth, prefix)
        at = at[origin.value.has(ids[w.lo : w.hi])[w.doc[at]] & hot.value.has(signed(low))]
        if len(at):
            doc = w.doc[at]
            yield signed(grams(h, depth, at=at)), signed(grams(h, depth, _OTHER_SEED, at)), ids[w.lo + doc], (th[w.lo + doc] << 32) | (at - w.first[doc])


def hot_nodes(docs: DataFrame, origin, hot, depth: int, prefix: int) -> DataFrame:
    """(w1, w2, low, n) of the windows under hot prefixes that two documents or more have: the smallest of them and the number of windows.

    A task gives a row for each different window it meets, not for each window: it combines them whenever it holds HELD.
    """

    def combined(held: list) -> tuple:
        w1, w2, low, high, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((w2, w1))
        w1, w2 = w1[order], w2[order]
        first = np.flatnonzero(np.r_[True, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])])
        return w1[first], w2[first], np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first), np.add.reduceat(n[order], first)

    def scan(batches):
        held: list = []
        size = 0
        for b in batches:
            for w1, w2, doc, _ in hot_windows(b, origin, hot, depth, prefix):
                held.append((w1, w2, doc, doc, np.ones(len(doc), np.int64)))
                size += len(doc)
                if size >= HELD:
                    held = [combined(held)]
                    size = len(held[0][0])
                    if size >= HELD // 2:  # mostly different ones: the shuffle's turn
                        yield pa.record_batch(list(held[0]), names=["w1", "w2", "low", "high", "n"])
                        held, size = [], 0
        if held:
            yield pa.record_batch(list(combined(held)), names=["w1", "w2", "low", "high", "n"])

    rows = docs.where("doc is not null").mapInArrow(scan, "w1 long, w2 long, low long, high long, n long")
    return rows.groupBy("w1", "w2").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).where("low < high").drop("high")


def hot_runs(docs: DataFrame, origin, hot, nodes: DataFrame, depth: int, prefix: int, least: int = 128) -> tuple[DataFrame, DataFrame]:
    """(doc, th, start, windows) of the windows under hot prefixes whose node (w1, w2, low, n) has a smaller document, and the written table it reads.

    Nodes with more than a HOT-th of all windows are fewer than HOT: they are broadcast, and their windows, which are most,
    leave the scan as runs.  Windows of all other nodes meet them in a join, a row each; windows without a node stay.
    """
    most = max(least, (nodes.agg(F.sum("n")).first()[0] or 0) // HOT)
    top = nodes.where(F.col("n") > most).select("w1", "w2", "low").toArrow().sort_by("w1")
    keys = [top[c].to_numpy() for c in ("w1", "w2", "low")]
    if len(np.unique(keys[0])) < len(top):  # two hot windows with one hash: all through the join
        keys, most = [k[:0] for k in keys], 1 << 62
    known = docs.sparkSession.sparkContext.broadcast(keys)
    rest = nodes.where(F.col("n") <= most).drop("n")
    met = Filter.over(rest, "w1")

    def place(a, b):
        w1, w2, low = known.value
        if not len(w1):
            return np.zeros(len(a), bool), np.zeros(len(a), np.int64)
        at = np.minimum(np.searchsorted(w1, a), len(w1) - 1)
        return (w1[at] == a) & (w2[at] == b), low[at]

    def scan(batches):
        for b in batches:
            for w1, w2, doc, at in hot_windows(b, origin, hot, depth, prefix):
                found, low = place(w1, w2)
                other = np.flatnonzero(~found & met.value.has(w1))
                keep = np.flatnonzero(found & (doc > low))
                d, p = doc[keep], at[keep]
                first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)]) if len(d) else keep
                none = np.zeros(len(first), np.int64)
                yield pa.record_batch([
                    pa.array(np.r_[none, w1[other]], mask=np.r_[none == 0, other < 0]),
                    pa.array(np.r_[none, w2[other]]),
                    pa.array(np.r_[d[first], doc[other]]),
                    pa.array(np.r_[p[first], at[other]]),
                    pa.array(np.r_[np.diff(np.r_[first, len(d)]), np.ones(len(other), int)].astype(np.int32)),
                ], names=["w1", "w2", "doc", "at", "windows"])

    rows = written(docs.where("doc is not null").mapInArrow(scan, "w1 long, w2 long, doc long, at long, windows int"), "windows")
    known.destroy()
    met.destroy()
    run = [F.col("doc"), F.shiftright("at", 32).alias("th"), F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("start"), F.col("windows")]
    under = rows.where("w1 is not null").join(rest, ["w1", "w2"]).where("doc > low")
    return rows.where("w1 is null").select(*run).unionByName(under.select(*run)), rows


def repeats(docs: DataFrame, depth: int = DEPTH, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """(doc, th, runs, whole), written: runs (start, windows) of a row's windows that also start in a document with a smaller id; whole if its whole text does.

    docs as keyed() makes them.  Texts with equal word sequences are found first; only the first of each enters the trees.
    """
    texts = written(whole_texts(docs), "texts")
    first = texts.where(F.col("n") >= depth).groupBy("c1", "c2").agg(F.min("doc").alias("low"), F.count("*").alias("rows"))
    first = written(first, "first")
    again = spread_join(texts.where(F.col("n") >= depth), first.where("rows > 1").select("c1", "c2", "low"), ["c1", "c2"], hot_keys(texts, ["c1", "c2"])).where("doc > low")
    again = written(again.select("doc", "th").distinct(), "again")
    origin = Filter.over(first.where("low is not null").select("low"), "low")  # a false hit lets a copy in, which changes nothing
    counts = written(prefix_counts(docs, origin, depth, prefix), "prefixes")
    large = counts.where(F.col("windows") > group)
    shared, hot = Filter.over(counts, "prefix"), Filter.over(large, "prefix")
    later = tree_runs(segments(docs, origin, shared, hot, depth, prefix), depth)
    rows = None
    if large.take(1):
        nodes = written(hot_nodes(docs, origin, hot, depth, prefix), "nodes")
        runs, rows = hot_runs(docs, origin, hot, nodes, depth, prefix)
        later = later.unionByName(runs)
    runs = later.groupBy("doc", "th").agg(F.sort_array(F.collect_set(F.struct("start", "windows"))).alias("runs"))
    runs = runs.join(again, ["doc", "th"], "left_anti").withColumn("whole", F.lit(False))
    none = F.array().cast("array<struct<start:int,windows:int>>")
    out = written(runs.unionByName(again.select("doc", "th", none.alias("runs"), F.lit(True).alias("whole"))), "repeats")
    dropped(texts, first, again, counts, *([rows, nodes] if rows is not None else []))
    for f in (origin, shared, hot):
        f.destroy()
    tidied(docs.sparkSession)
    return out


def maximal_repeats(documents: DataFrame, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, th, start, words): every maximal run of words covered by windows that also start in a document with a smaller id; texts that are whole copies of an earlier one have start 0 and null words."""
    rows = repeats(keyed(documents, id_col, text_col), depth)
    step = lambda a, x: F.when(
        (F.size(a) > 0) & (F.element_at(a, -1).upto >= x.start),
        F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1).start.alias("start"), F.greatest(F.element_at(a, -1).upto, x.start + x.windows + depth - 1).alias("upto")))),
    ).otherwise(F.concat(a, F.array(F.struct(x.start.alias("start"), (x.start + x.windows + depth - 1).alias("upto")))))
    merged = F.aggregate("runs", F.array().cast("array<struct<start:int,upto:int>>"), step)
    spans = rows.where("not whole").select("doc", "th", F.explode(merged).alias("s")).select("doc", "th", "s.start", (F.col("s.upto") - F.col("s.start")).alias("words"))
    return spans.unionByName(rows.where("whole").select("doc", "th", F.lit(0).alias("start"), F.lit(None).cast("int").alias("words")))


def kept_words(words: list[bytes], runs: list[dict], whole: bool, depth: int) -> list[bytes]:
    """The words outside all windows."""
    if whole:
        return []
    steps = np.zeros(len(words) + 1, int)
    for r in runs:
        steps[r["start"]] += 1
        steps[r["start"] + r["windows"] + depth - 1] -= 1
    return [w for w, c in zip(words, np.cumsum(steps[:-1]), strict=True) if not c]


def without_repeats(documents: DataFrame, digest: bool = False, depth: int = DEPTH, prefix: int = PREFIX, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents' rows (doc, th, n_words, n_removed, kept, changed): kept are the words left, joined by one space, or their SHA-256 if digest.

    Ids must be integers.  kept is null for an unchanged row unless digest.  A window's repeat within one document, or in
    rows with the same id, isn't removed; null texts have no words; rows with a null id keep all words and give none.
    Only texts of rows with a removal (and a few false hits) are shuffled.
    """
    docs = keyed(documents, id_col, text_col)
    marks = repeats(docs, depth, prefix, group)
    marked = Filter.over(marks.select(F.col("doc").bitwiseXOR(F.shiftleft("th", 32)).alias("k")), "k")
    sha = lambda words: hashlib.sha256(b" ".join(words)).hexdigest()

    def scan(batches):
        for b in slices(batches):
            ids, th = b.column(0).fill_null(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            hit = marked.value.has(ids ^ (th << 32)) & b.column(0).is_valid().to_numpy(zero_copy_only=False)
            n, kept, text = [], [], []
            for t, h in zip(b.column(2).to_pylist(), hit, strict=True):
                words = (t or "").encode().split()
                n.append(len(words))
                kept.append(sha(words) if digest and not h else None)
                text.append(t if h else None)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(kept, pa.string()), pa.array(text, pa.string())], names=["doc", "th", "n_words", "kept", "text"])

    def remove(batches):
        for b in slices(batches):
            removed, kept, changed = [], [], []
            for n, done, t, runs, whole in zip(*(b.column(i).to_pylist() for i in range(2, 7)), strict=True):
                if t is None:
                    removed.append(0), kept.append(done), changed.append(False)
                    continue
                words = t.encode().split()
                left = kept_words(words, runs or [], bool(whole), depth)
                removed.append(n - len(left)), changed.append(len(left) < n)
                kept.append(sha(left) if digest else b" ".join(left).decode() if changed[-1] else None)
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(changed, pa.bool_())], names=["doc", "th", "n_words", "n_removed", "kept", "changed"])

    rows = docs.mapInArrow(scan, "doc long, th long, n_words long, kept string, text string").join(marks, ["doc", "th"], "left")
    return rows.select("doc", "th", "n_words", "kept", "text", "runs", "whole").mapInArrow(remove, "doc long, th long, n_words long, n_removed long, kept string, changed boolean")

